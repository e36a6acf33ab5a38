"""Structured expressions, as actions use them.

Unlike formulas: arithmetic is in double and null with null, x / 0 and x % 0 are 0, equality takes null as a value and
heeds case, and null is below everything.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .semantics import below, truthy


@dataclass(frozen=True)
class X:
    """op: lit, field, item, param, and, or, not, eq, ne, lt, gt, le, ge, add, sub, mul, div, mod, neg, if, or a list
    aggregate (sum, count, min, max, any, all over the list in ``value`` with a selector)."""

    op: str
    args: tuple[X, ...] = ()
    value: object = None


def lit(v: object) -> X:
    return X("lit", value=v)


def field(name: str) -> X:
    return X("field", value=name)


def item(name: str) -> X:
    return X("item", value=name)


def param(name: str) -> X:
    return X("param", value=name)


def x(op: str, *args: X, value: object = None) -> X:
    return X(op, args, value)


class Build:
    def __init__(self, df: DataFrame, params: Mapping[str, object] = {}, element: Column | None = None, element_type: T.StructType | None = None):
        self.df, self.params, self.element, self.element_type = df, params, element, element_type

    def kind(self, e: X) -> T.DataType:
        if e.op == "field":
            return self.df.schema[e.value].dataType
        if e.op == "item" and self.element_type is not None:
            return self.element_type[e.value].dataType
        if e.op in ("and", "or", "not", "eq", "ne", "lt", "gt", "le", "ge", "any", "all"):
            return T.BooleanType()
        if e.op in ("lit", "param"):
            v = self.params.get(e.value) if e.op == "param" else e.value
            return T.BooleanType() if isinstance(v, bool) else T.StringType() if isinstance(v, str) else T.DoubleType()
        return self.kind(e.args[1]) if e.op == "if" else T.DoubleType()

    def true(self, e: X) -> Column:
        return truthy(self(e), self.kind(e))

    def __call__(self, e: X) -> Column:
        a = e.args
        if e.op == "lit":
            return F.lit(e.value)
        if e.op == "field":
            return F.col(f"`{e.value}`")
        if e.op == "item":
            return self.element[e.value]
        if e.op == "param":
            if e.value not in self.params:
                raise ValueError(f"no value for parameter {e.value!r}")
            return F.lit(self.params[e.value])
        if e.op in ("and", "or"):
            p, q = self.true(a[0]), self.true(a[1])
            return p & q if e.op == "and" else p | q
        if e.op == "not":
            return ~self.true(a[0])
        if e.op in ("eq", "ne"):
            same = self(a[0]).eqNullSafe(self(a[1]))
            return same if e.op == "eq" else ~same
        if e.op in ("lt", "le"):
            return below(self(a[0]), self(a[1]), e.op == "le")
        if e.op in ("gt", "ge"):
            return below(self(a[1]), self(a[0]), e.op == "ge")
        if e.op in ("add", "sub", "mul", "div", "mod"):
            p, q = self(a[0]).cast("double"), self(a[1]).cast("double")
            if e.op in ("div", "mod"):
                return F.when(p.isNull() | q.isNull(), F.lit(None)).when(q == 0, F.lit(0.0)).otherwise(F.try_divide(p, q) if e.op == "div" else F.try_mod(p, q))
            return {"add": p + q, "sub": p - q, "mul": p * q}[e.op]
        if e.op == "neg":
            return -self(a[0]).cast("double")
        if e.op == "if":
            return F.when(self.true(a[0]), self(a[1])).otherwise(self(a[2]))
        if e.op in ("sum", "count", "min", "max", "avg", "any", "all"):
            from tessera.operators.aggregates import over_list

            inner = self.df.schema[e.value].dataType.elementType

            def pick(el: Column) -> Column:
                b = Build(self.df, self.params, el, inner if isinstance(inner, T.StructType) else None)
                return (b.true(a[0]) if e.op in ("any", "all") else b(a[0])) if a else el

            return over_list(F.col(f"`{e.value}`"), e.op, pick)
        raise ValueError(f"unknown operation {e.op!r}")
