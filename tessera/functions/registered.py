"""Functions of one's own in SQL: scalars and aggregates on Arrow batches, and functions that give tables.

Built-in expressions are faster and come first; these are for what they can't say. ``register`` enters the ones below.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .scalars import FNV_BASIS, FNV_PRIME


def scalar(spark: SparkSession, name: str, f: Callable[..., object], returns: str) -> None:
    """A function of the values of a row, called for a batch of rows at a time; null in any of them gives null."""

    def batch(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else f(*row) for row in zip(*columns)], dtype=object)

    typed = {1: lambda a: batch(a), 2: lambda a, b: batch(a, b), 3: lambda a, b, c: batch(a, b, c)}[f.__code__.co_argcount]
    typed.__annotations__ = dict.fromkeys(typed.__code__.co_varnames, pd.Series) | {"return": pd.Series}
    spark.udf.register(name, F.pandas_udf(typed, returns))


def aggregate(spark: SparkSession, name: str, f: Callable[[pd.Series], object], returns: str) -> None:
    """A function of all values of a group without nulls; a group is in one task's memory."""

    def whole(values: pd.Series) -> object:
        return f(values.dropna())

    whole.__annotations__ = {"values": pd.Series, "return": {"double": float, "bigint": int, "string": str}[returns]}
    spark.udf.register(name, F.pandas_udf(whole, returns))


def table(spark: SparkSession, name: str, f: Callable[..., Iterator[tuple]], returns: str) -> None:
    """A function that gives rows for the values of one row, for LATERAL joins."""

    class Rows:
        def eval(self, *values):
            yield from f(*values)

    spark.udtf.register(name, F.udtf(Rows, returnType=returns))


def fnv1a(text: str) -> int:
    h = FNV_BASIS
    for c in text:
        h = (h ^ ord(c)) * FNV_PRIME & 0xFFFFFFFF
    return h


def nearest_rank_95(values: pd.Series) -> float:
    """The element at place ceil(0.95 n) of the sorted values; 0 of nothing."""
    return float(values.sort_values().iloc[-(-95 * len(values) // 100) - 1]) if len(values) else 0.0


def words(text: str | None) -> Iterator[tuple[int, str]]:
    """Words with their places from 1."""
    for k, w in enumerate(re.findall("[a-z0-9]+", (text or "").lower()), 1):
        yield k, w


def register(spark: SparkSession) -> None:
    scalar(spark, "fnv1a_32", fnv1a, "bigint")
    aggregate(spark, "nearest_rank_95", nearest_rank_95, "double")
    table(spark, "words_of", words, "place int, word string")
