"""Reports: entities joined, filtered, projected or grouped, sorted and limited; one lazy plan."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import format_value
from tessera.functions.semantics import join_key, sort_key
from tessera.operators.aggregates import grouped
from tessera.operators.filters import Clause, Group, condition

from .entities import Catalog


@dataclass(frozen=True)
class Out:
    entity: str
    field: str
    label: str
    form: str | None = None
    aggregate: str | None = None


@dataclass(frozen=True)
class Link:
    how: str
    left: str
    left_field: str
    right: str
    right_field: str


def internal(entity: str, field: str) -> str:
    return f"{entity.lower()}__{field.lower()}"


class Report:
    """A fluent builder; every step returns the report.

    Report(catalog, "orders").join("orders", "o_custkey", "customer", "c_custkey").where(...).select(...).run()
    """

    def __init__(self, catalog: Catalog, root: str):
        self.catalog, self.root = catalog, root
        self.links: list[Link] = []
        self.clauses: list[tuple[str, Clause]] = []
        self.outs: list[Out] = []
        self.sorts: list[tuple[str, bool]] = []
        self.most: int | None = None

    def join(self, left: str, left_field: str, right: str, right_field: str, how: str = "inner") -> Report:
        self.links.append(Link(how, left, left_field, right, right_field))
        return self

    def left_join(self, *a: str) -> Report:
        return self.join(*a, how="left")

    def right_join(self, *a: str) -> Report:
        return self.join(*a, how="right")

    def full_join(self, *a: str) -> Report:
        return self.join(*a, how="full")

    def where(self, path: str, op: str, value: object) -> Report:
        entity, _, field = path.rpartition(".")
        self.clauses.append((entity or self.root, Clause(field, op, value)))
        return self

    def select(self, *paths: str) -> Report:
        for p in paths:
            entity, _, field = p.rpartition(".")
            self.column(f"{entity or self.root}.{field}", p)
        return self

    def column(self, path: str, label: str, form: str | None = None, aggregate: str | None = None) -> Report:
        entity, _, field = path.rpartition(".")
        self.outs.append(Out(entity or self.root, field, label, form, aggregate))
        return self

    def order_by(self, label: str, descending: bool = False) -> Report:
        self.sorts.append((label, descending))
        return self

    def limit(self, most: int) -> Report:
        self.most = most
        return self

    # -- the plan

    def _side(self, entity: str) -> DataFrame:
        df = self.catalog.frame(entity)
        return df.select(*[F.col(f"`{c}`").alias(internal(entity, c)) for c in df.columns])

    def joined(self) -> DataFrame:
        df = self._side(self.root)
        for x in self.links:
            right = self._side(x.right)
            a, b = internal(x.left, x.left_field), internal(x.right, x.right_field)
            whole = all(isinstance(d.schema[c].dataType, T.IntegralType) for d, c in ((df, a), (right, b)))
            on = df[a] == right[b] if whole else join_key(df[a]) == join_key(right[b])
            df = df.join(right, on, {"full": "full_outer"}.get(x.how, x.how))
        return df

    def matching(self) -> DataFrame:
        """Joined rows that meet every filter; Catalyst moves filters to the scans where that is the same."""
        df = self.joined()
        return df.where(condition(df, Group(tuple(Clause(internal(e, c.field), c.op, c.value) for e, c in self.clauses)))) if self.clauses else df

    def run(self) -> DataFrame:
        df = self.matching()
        outs = self.outs or [Out(self.root, c, c) for c in self.catalog.frame(self.root).columns]
        cols = {o.label: internal(o.entity, o.field) for o in outs}
        if any(o.aggregate for o in outs):
            keys = [F.col(cols[o.label]).alias(o.label) for o in outs if not o.aggregate]
            df = df.groupBy(*keys).agg(*[grouped(o.aggregate, cols[o.label]).alias(o.label) for o in outs if o.aggregate])
            df = df.select(*[F.col(f"`{o.label}`") for o in outs])
        else:
            df = df.select(*[F.col(cols[o.label]).alias(o.label) for o in outs])
        order = [sort_key(F.col(f"`{label}`"), df.schema[label].dataType, desc) for label, desc in self.sorts]
        df = df.orderBy(*order) if order else df
        df = df.limit(self.most) if self.most is not None else df
        forms = {o.label: o.form for o in outs if o.form}
        return df.select(*[format_value(F.col(f"`{c}`"), forms[c]).alias(c) if c in forms else F.col(f"`{c}`") for c in df.columns]) if forms else df


def with_parameters(text: str, given: Mapping[str, object], defaults: Mapping[str, object] = {}) -> str:
    """{name} replaced by its value, else its default; an unknown name is an error."""

    def one(m: re.Match) -> str:
        if m[1] not in given and m[1] not in defaults:
            raise ValueError(f"no value for parameter {m[1]!r}")
        return str(given.get(m[1], defaults.get(m[1])))

    return re.sub(r"\{(\w+)\}", one, text)


def from_definition(catalog: Catalog, definition: str | Mapping, given: Mapping[str, object] = {}) -> Report:
    """A stored report: root, joins, columns, filters, sorts, limit and parameters with defaults, as JSON."""
    d = json.loads(definition) if isinstance(definition, str) else definition
    defaults = {p["name"]: p.get("default") for p in d.get("parameters", ())}
    out = Report(catalog, d["root"])
    for j in d.get("joins", ()):
        out.join(j["from"], j["fromField"], j["to"], j["toField"], str(j.get("type", "inner")).lower())
    for c in d.get("columns", ()):
        out.column(f"{c.get('entity', d['root'])}.{c['field']}", c.get("label", c["field"]), c.get("format"), c.get("aggregate"))
    for f in d.get("filters", ()):
        value = f.get("value")
        out.where(f"{f.get('entity', d['root'])}.{f['field']}", f.get("operator", "eq"), with_parameters(value, given, defaults) if isinstance(value, str) else value)
    for s in d.get("sorts", ()):
        out.order_by(s["label"], bool(s.get("descending")))
    return out.limit(d["limit"]) if d.get("limit") is not None else out


def column_of(df: DataFrame, label: str) -> Column:
    return F.col(f"`{label}`")
