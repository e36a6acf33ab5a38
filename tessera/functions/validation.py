"""Row checks: each rule is a column that holds where the row is right, and messages are gathered per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .formula import formula

EMAIL = r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"
#: Fixed value: what counts as a telephone number. Digits and spaces of any script count, hence (?U).
PHONE = r"(?U)^[\+]?[\d\s\-\(\)\.]{7,20}$"


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def length(c: Column, least: int = 0, most: int | None = None) -> Column:
    """Empty passes."""
    n = F.length(c)
    return _blank(c) | ((n >= least) & (n <= most if most is not None else F.lit(True)))


def in_range(c: Column, low: float, high: float) -> Column:
    """What isn't a number passes."""
    return F.coalesce(c.try_cast("double").between(low, high), F.lit(True))


def matches(c: Column, pattern: str) -> Column:
    return _blank(c) | c.rlike(pattern)


def email(c: Column) -> Column:
    return matches(c, EMAIL)


def phone(c: Column) -> Column:
    return matches(c, PHONE)


def url(c: Column) -> Column:
    """Absolute, with http or https and a host."""
    return _blank(c) | F.coalesce(F.lower(F.regexp_extract(c, r"\A(\w+)://[^/?#\s]+", 1)).isin("http", "https"), F.lit(False))


def rule(df: DataFrame, text: str) -> Column:
    """A formula that must hold; null passes, and so does a rule that cannot be compiled."""
    try:
        return F.coalesce(formula(df, text).cast("boolean"), F.lit(True))
    except ValueError:
        return F.lit(True)


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The rows with ``errors``, the messages of the rules that do not hold, in order."""
    found = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(message)) for message, ok in rules.items()]
    return df.withColumn("errors", F.filter(F.array(*found), lambda m: m.isNotNull()))
