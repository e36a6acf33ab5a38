"""Entities: names, tables, fields and the links between them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Lookup:
    """A foreign key: which entity it names, by which field, and what to show instead."""

    target: str
    key: str
    display: str


@dataclass(frozen=True)
class Entity:
    name: str
    key: str
    load: Callable[[], DataFrame]
    lookups: dict[str, Lookup] = field(default_factory=dict)
    indexed: frozenset[str] = frozenset()


class Catalog:
    """Entities by name, case aside. An unknown name is an error."""

    def __init__(self, entities: list[Entity] = ()):
        self._all = {e.name.lower(): e for e in entities}

    def add(self, entity: Entity) -> None:
        self._all[entity.name.lower()] = entity

    def __getitem__(self, name: str) -> Entity:
        try:
            return self._all[name.lower()]
        except KeyError:
            raise ValueError(f"unknown entity {name!r}") from None

    def __iter__(self):
        return iter(self._all.values())

    def frame(self, name: str) -> DataFrame:
        return self[name].load()

    def views(self) -> None:
        """A temporary view for each entity."""
        for e in self:
            e.load().createOrReplaceTempView(e.name)


#: Keys and links of the sample tables.
SAMPLE = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": Lookup("region", "r_regionkey", "r_name")}),
    "customer": ("c_custkey", {"c_nationkey": Lookup("nation", "n_nationkey", "n_name")}),
    "supplier": ("s_suppkey", {"s_nationkey": Lookup("nation", "n_nationkey", "n_name")}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": Lookup("customer", "c_custkey", "c_name")}),
    "lineitem": ("l_orderkey", {"l_orderkey": Lookup("orders", "o_orderkey", "o_orderstatus"), "l_partkey": Lookup("part", "p_partkey", "p_name"), "l_suppkey": Lookup("supplier", "s_suppkey", "s_name")}),
    "events": ("event_id", {}),
    "documents": ("doc_id", {}),
    "embeddings": ("vec_id", {}),
    "pages": ("page_id", {}),
    "benchmark": ("item_id", {}),
    "labels": ("doc_id", {"doc_id": Lookup("documents", "doc_id", "source")}),
    "conversations": ("conv_id", {}),
}


def sample_catalog(spark: SparkSession, folder: str) -> Catalog:
    def entity(name: str) -> Entity:
        key, lookups = SAMPLE[name]
        return Entity(name, key, lambda: spark.read.parquet(f"{folder}/{name}.parquet"), lookups, frozenset({key}))

    return Catalog([entity(n) for n in SAMPLE])
