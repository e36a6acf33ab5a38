"""Value semantics as column expressions: case-insensitive text, nulls below everything, lenient conversion.

All of these are built-in expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(c: Column) -> Column:
    """Text as it is compared: without regard to case."""
    return F.lower(c.cast("string"))


def ci_eq(a: Column, b: Column) -> Column:
    """Null equals null, and nothing else."""
    return fold(a).eqNullSafe(fold(b))


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def below(a: Column, b: Column, or_equal: bool = False) -> Column:
    """a < b (or <=) with null below every value and equal to itself."""
    both = false_if_null(a <= b if or_equal else a < b)
    return F.when(a.isNull(), F.lit(True) if or_equal else b.isNotNull()).otherwise(both)


def truthy(c: Column, kind: T.DataType) -> Column:
    """Null is false; text is true unless empty; numbers unless zero."""
    if isinstance(kind, T.BooleanType):
        return false_if_null(c)
    if isinstance(kind, T.StringType):
        return false_if_null(c != "")
    if isinstance(kind, T.NumericType):
        return false_if_null(c != 0)
    return c.isNotNull()


def literal(value: object, kind: T.DataType) -> Column:
    """A literal of a column's type; ValueError if the value has no reading in it."""
    if value is None:
        return F.lit(None).cast(kind)
    text = str(value).strip()
    try:
        if isinstance(kind, T.BooleanType):
            return F.lit({"true": True, "false": False, "1": True, "0": False}[text.lower()])
        if isinstance(kind, T.IntegralType):
            number = Decimal(text)
            return F.lit(int(number)).cast(kind) if number == int(number) else F.lit(float(number))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.lit(float(text)).cast(kind)
        if isinstance(kind, T.DecimalType):
            return F.lit(Decimal(text)).cast(kind)
        if isinstance(kind, T.DateType):
            return F.lit(value if isinstance(value, date) and not isinstance(value, datetime) else date.fromisoformat(text[:10]))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.lit(value if isinstance(value, datetime) else datetime.fromisoformat(text)).cast(kind)
    except (KeyError, ValueError, InvalidOperation) as e:
        raise ValueError(f"{value!r} cannot be read as {kind.simpleString()}") from e
    return F.lit(value if isinstance(value, str) else text)


def parse_list(value: object) -> list[str]:
    """A list, ``[a,"b"]`` or ``a,b``: quotes trimmed, blanks skipped."""
    if value is None:
        return []
    if isinstance(value, (list, tuple, set)):
        return [str(v) for v in value if v is not None]
    text = str(value).strip().removeprefix("[").removesuffix("]")
    return [p for p in (part.strip().strip("\"'") for part in text.split(",")) if p]


def sort_key(c: Column, kind: T.DataType, descending: bool) -> Column:
    """Nulls lowest, text without regard to case."""
    c = F.lower(c) if isinstance(kind, T.StringType) else c
    return c.desc_nulls_last() if descending else c.asc_nulls_first()


def join_key(c: Column) -> Column:
    """Keys that are not integers meet as text, without regard to case, and null meets null and the empty text."""
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))
