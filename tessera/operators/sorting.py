"""Sorting and paging. A key breaks ties, so a page is the same every time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.semantics import sort_key

from .filters import QueryDefinition, Sort, condition, kind_of


def sort_keys(df: DataFrame, sorts: tuple[Sort, ...], key: str | None = None) -> list[Column]:
    out = [sort_key(F.col(f"`{(f := kind_of(df, s.field)).name}`"), f.dataType, s.descending) for s in sorts]
    return out + ([F.col(f"`{key}`").asc_nulls_first()] if key else [])


def sort_by(df: DataFrame, sorts: tuple[Sort, ...], key: str | None = None) -> DataFrame:
    keys = sort_keys(df, sorts, key)
    return df.orderBy(*keys) if keys else df


def page(df: DataFrame, skip: int = 0, top: int | None = None) -> DataFrame:
    df = df.offset(skip) if skip else df
    return df if top is None else df.limit(top)


def run_query(df: DataFrame, query: QueryDefinition, key: str | None = None) -> DataFrame:
    """Filter, sort, skip, take."""
    found = df.where(condition(df, query.where))
    if query.sorts or query.skip or query.top is not None:
        found = sort_by(found, query.sorts, key)
    return page(found, query.skip, query.top)


def page_with_total(df: DataFrame, query: QueryDefinition, key: str) -> tuple[DataFrame, DataFrame]:
    """The page, and one row with the count of all rows that match."""
    whole = QueryDefinition(query.where)
    return run_query(df, query, key), run_query(df, whole).agg(F.count(F.lit(1)).alias("total"))


def truncated(df: DataFrame, most: int = 10_000) -> bool:
    """Whether a result has more rows than may be shown."""
    return df.limit(most + 1).count() > most


def top_per_group(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group; each task forwards no more than ``most`` rows of a group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= most)
