"""Joins between entities: many-to-many reports, first-match views, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.semantics import join_key


def _integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.IntegralType)


def on_keys(left: DataFrame, lcol: str, right: DataFrame, rcol: str) -> Column:
    """Whole numbers meet as they are, so bucketing and pruning hold; other keys as text without regard to case."""
    a, b = left[lcol], right[rcol]
    return a == b if _integral(left, lcol) and _integral(right, rcol) else join_key(a) == join_key(b)


def join(left: DataFrame, right: DataFrame, lcol: str, rcol: str, how: str = "inner") -> DataFrame:
    """All pairs of rows whose keys meet. Keys that are no whole numbers meet as text, null with null too, so where both
    sides have many nulls the result itself has a row for each pair; adaptive execution splits such a key."""
    return left.join(right, on_keys(left, lcol, right, rcol), {"full": "full_outer"}.get(how, how))


def first_match(right: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key, the first by ``order``; rows without a key go."""
    ranked = right.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return ranked.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")


def join_first(left: DataFrame, right: DataFrame, lcol: str, rcol: str, order: list[Column], how: str = "left") -> DataFrame:
    return join(left, first_match(right, rcol, order), lcol, rcol, how)


def lookup(df: DataFrame, fk: str, target: DataFrame, key: str, field: str, alias: str) -> DataFrame:
    """The field of the row that ``fk`` names, null where there is none. ``key`` is unique in ``target``."""
    side = target.select(F.col(key).alias("_key"), F.col(field).alias(alias))
    return df.join(side, df[fk] == side["_key"], "left").drop("_key")


def lookup_chain(df: DataFrame, hops: list[tuple[str, DataFrame, str, str]], alias: str) -> DataFrame:
    """Several hops (fk, target, key, field), each on the field that the one before found."""
    names = df.columns
    for k, (fk, target, key, field) in enumerate(hops):
        df = lookup(df, fk if k == 0 else f"_hop{k - 1}", target, key, field, f"_hop{k}")
    return df.select(*names, F.col(f"_hop{len(hops) - 1}").alias(alias))


def lookup_display(df: DataFrame, fk: str, target: DataFrame, key: str, display: str, alias: str) -> DataFrame:
    """The display value, or the key itself where nothing is found."""
    found = lookup(df, fk, target, key, display, "_shown")
    return found.withColumn(alias, F.coalesce(F.col("_shown").cast("string"), F.col(fk).cast("string"))).drop("_shown")


def query_lookup(df: DataFrame, target: DataFrame, pairs: dict[str, str], key: str, field: str, alias: str) -> DataFrame:
    """The field of the first target row, by key, in which every target column equals the given column of ``df``."""
    first = target.groupBy(*pairs).agg(F.min_by(field, key).alias(alias)).select(*[F.col(t).alias(f"_k{i}") for i, t in enumerate(pairs)], alias)
    cond = [F.col(own) == F.col(f"_k{i}") for i, own in enumerate(pairs.values())]
    return df.join(first, cond, "left").drop(*[f"_k{i}" for i in range(len(pairs))])


def expand(df: DataFrame, fk: str, target: DataFrame, key: str, alias: str) -> DataFrame:
    """The key replaced by the related row as a struct."""
    side = target.select(F.col(key).alias("_key"), F.struct(*target.columns).alias(alias))
    return df.join(side, df[fk] == side["_key"], "left").drop("_key", fk)


def options(df: DataFrame, value: str, display: str, order: list[Column]) -> DataFrame:
    """Distinct values with the display text of their first row."""
    return first_match(df, value, order).select(F.col(value).alias("value"), F.col(display).alias("display"))


def related(parents: DataFrame, children: DataFrame, key: str, fk: str, order: list[Column], most: int = 50) -> DataFrame:
    """Children of each parent, at most ``most``."""
    rank = F.row_number().over(Window.partitionBy(fk).orderBy(*order))
    few = children.withColumn("rank", rank).where(F.col("rank") <= most)
    return parents.join(few, parents[key] == few[fk])
