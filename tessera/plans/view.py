"""Stored views: a root with first-match joins, filters, projections, sorts and a page; optionally materialised."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.semantics import join_key, sort_key
from tessera.operators.filters import Clause, Group, condition

from .entities import Catalog
from .report import internal


@dataclass(frozen=True)
class Projection:
    field: str
    entity: str = ""
    alias: str = ""


@dataclass(frozen=True)
class ViewJoin:
    left: str
    left_field: str
    right: str
    right_field: str
    how: str = "left"


@dataclass(frozen=True)
class View:
    name: str
    root: str
    projections: tuple[Projection, ...]
    joins: tuple[ViewJoin, ...] = ()
    filters: tuple[tuple[str, Clause], ...] = ()
    sorts: tuple[tuple[str, bool], ...] = ()
    offset: int = 0
    limit: int = 10_000

    def entities(self) -> set[str]:
        return {self.root.lower(), *(j.right.lower() for j in self.joins)}

    def plan(self, catalog: Catalog) -> DataFrame:
        """Each join takes the first row of its key, by the target's own key; unknown fields are errors."""
        side = lambda e: (d := catalog.frame(e)).select(*[F.col(f"`{c}`").alias(internal(e, c)) for c in d.columns])
        df = side(self.root)
        for j in self.joins:
            a, b = internal(j.left, j.left_field), internal(j.right, j.right_field)
            right = side(j.right).withColumn("_key", join_key(F.col(b))).where("_key <> ''")
            order = F.col(internal(j.right, catalog[j.right].key)).asc_nulls_first()
            if j.right_field.lower() != catalog[j.right].key.lower():  # a unique key has but one row
                right = right.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(order))).where("_nth = 1").drop("_nth")
            df = df.join(right, join_key(df[a]) == right["_key"], {"full": "full_outer"}.get(j.how, j.how)).drop("_key")
        if self.filters:
            df = df.where(condition(df, Group(tuple(Clause(internal(e or self.root, c.field), c.op, c.value) for e, c in self.filters))))
        df = df.select(*[F.col(internal(p.entity or self.root, p.field)).alias(p.alias or (f"{p.entity}.{p.field}" if p.entity else p.field)) for p in self.projections])
        if self.sorts:
            df = df.orderBy(*[sort_key(F.col(f"`{n}`"), df.schema[n].dataType, d) for n, d in self.sorts])
        df = df.offset(self.offset) if self.offset else df
        return df.limit(self.limit)


class Materialised:
    """Views kept in Spark's cache until an entity that they read changes."""

    def __init__(self, catalog: Catalog):
        self.catalog, self._kept, self._lock = catalog, {}, threading.Lock()
        self.computed = 0

    def get(self, view: View) -> DataFrame:
        with self._lock:
            if view.name not in self._kept or self._kept[view.name][0] != view:
                self._forget(view.name)
                df = view.plan(self.catalog).cache()
                df.createOrReplaceTempView(f"view_{view.name}")
                self._kept[view.name] = (view, df)
                self.computed += 1
            return self._kept[view.name][1]

    def changed(self, entity: str) -> list[str]:
        """Forgets the views that read the entity, and names them."""
        with self._lock:
            gone = [n for n, (v, _) in self._kept.items() if entity.lower() in v.entities()]
            for n in gone:
                self._forget(n)
            return gone

    def _forget(self, name: str) -> None:
        if name in self._kept:
            self._kept.pop(name)[1].unpersist()
