"""Aggregates: scalar, grouped, by drill level, over lists, and column statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = ("count", "sum", "avg", "min", "max", "stddev")


def scalar(fn: str, field: str | None = None) -> Column:
    """count takes all rows; sum of nothing is 0; min, max, avg and the population deviation of nothing are null."""
    if fn == "count":
        return F.count(F.lit(1))
    value = F.expr(f"try_cast(`{field}` as double)")
    if fn == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0))
    return {"avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_pop}[fn](value)


def aggregate(df: DataFrame, **measures: tuple[str, str | None]) -> DataFrame:
    """One row with every measure, from one pass: aggregate(df, total=("sum", "x"), n=("count", None))."""
    return df.agg(*[scalar(fn, field).alias(name) for name, (fn, field) in measures.items()])


def grouped(fn: str, field: str | None = None) -> Column:
    """As in a report: avg and deviation of nothing are 0, min and max keep their type."""
    if fn in ("min", "max"):
        return {"min": F.min, "max": F.max}[fn](F.col(f"`{field}`"))
    out = scalar(fn, field)
    return F.coalesce(out, F.lit(0.0)) if fn in ("avg", "stddev") else out


def group(df: DataFrame, keys: list[str], **measures: tuple[str, str | None]) -> DataFrame:
    return df.groupBy(*keys).agg(*[grouped(fn, field).alias(name) for name, (fn, field) in measures.items()])


def drill(df: DataFrame, levels: list[str], **measures: tuple[str, str | None]) -> DataFrame:
    """Subtotals at each prefix of the levels, in one pass. Null and empty keys are (empty); depth tells the level."""
    named = df.withColumns({c: F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), "(empty)").otherwise(F.col(c).cast("string")) for c in levels})
    sets = [[F.col(c) for c in levels[: k + 1]] for k in range(len(levels))]
    depth = sum((1 - F.grouping(c) for c in levels), F.lit(0)).cast("int")
    # what isn't a number counts as 0
    made = [F.count(F.lit(1)).alias(n) if fn == "count" else {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn](F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0))).alias(n) for n, (fn, c) in measures.items()]
    return named.groupingSets(sets, *levels).agg(depth.alias("depth"), *made)


def sparkline(df: DataFrame, label: str, value: str, fn: str = "sum") -> DataFrame:
    """Points by label, case aside; rows without a label go; a missing value adds 0 and counts in the average."""
    number = F.coalesce(F.expr(f"try_cast(`{value}` as double)"), F.lit(0.0))
    point = {"count": F.count(F.lit(1)).cast("double"), "sum": F.sum(number), "avg": F.sum(number) / F.count(F.lit(1))}[fn]
    return df.where(F.col(label).isNotNull()).groupBy(F.lower(F.col(label).cast("string")).alias("label")).agg(point.alias("point")).orderBy("label")


def distinct_values(df: DataFrame, field: str) -> DataFrame:
    """Distinct non-blank values, case aside (the smallest spelling stands for all), in order."""
    text = F.col(field).cast("string")
    return df.where(F.trim(text) != "").groupBy(F.lower(text).alias("folded")).agg(F.min(text).alias("value")).orderBy("folded").select("value")


def by_day(df: DataFrame, when: str) -> DataFrame:
    return df.where(F.col(when).isNotNull()).groupBy(F.to_date(when).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def timetable(df: DataFrame, slot: Column, order: Column, entry: Column) -> DataFrame:
    """Entries of each slot in order. A slot's entries make one list, which is the feature; so a slot must fit one row."""
    return df.groupBy(slot.alias("slot")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), entry.alias("e")))), lambda x: x["e"]).alias("entries"))


def timeline(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Intervals, with an end before the start moved to it."""
    return df.withColumns({"start": start, "end": F.greatest(start, end)})


def over_list(items: Column, fn: str, pick, start: float = 0.0) -> Column:
    """sum, count, min, max, avg, any or all of ``pick(item)``; null items are skipped and all of nothing is false."""
    if fn == "any":
        return F.coalesce(F.exists(items, pick), F.lit(False))
    if fn == "all":
        return F.coalesce(F.forall(items, lambda x: F.coalesce(pick(x), F.lit(False))) & (F.size(items) > 0), F.lit(False))
    values = F.filter(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: pick(x).cast("double")), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(start), lambda t, v: t + v)
    if fn == "count":
        return F.size(values)
    if fn == "sum":
        return total
    if fn == "avg":
        return F.try_divide(total, F.size(values).cast("double"))
    return {"min": F.array_min, "max": F.array_max}[fn](values)


def child(parents: DataFrame, children: DataFrame, key: str, fk: str, fn: str, field: str, alias: str) -> DataFrame:
    """A figure over each parent's children; without any, sum and count are 0 and the others null."""
    figure = {"count": F.count(F.lit(1)), "sum": F.sum(field), "avg": F.avg(field), "min": F.min(field), "max": F.max(field)}[fn]
    side = children.groupBy(F.col(fk).alias("_fk")).agg(figure.alias("_figure"))
    out = F.coalesce("_figure", F.lit(0)) if fn in ("sum", "count") else F.col("_figure")
    return parents.join(side, parents[key] == side["_fk"], "left").withColumn(alias, out).drop("_fk", "_figure")


def tiles(parts: dict[str, tuple[DataFrame, str, str | None]]) -> DataFrame:
    """One row a tile: name and value."""
    rows = [df.agg(scalar(fn, field).cast("double").alias("value")).select(F.lit(name).alias("tile"), "value") for name, (df, fn, field) in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def document_graph(parts: dict[str, DataFrame], links: dict[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """Nodes with their record counts and, for each (from, to) with its (entity, key), how many records fill the key."""
    nodes = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), F.lit(name).alias("source"), F.lit(None).cast("string").alias("target"), "n") for name, df in parts.items()]
    edges = [parts[own].agg(F.count(key).alias("n")).select(F.lit("link").alias("kind"), F.lit(a).alias("source"), F.lit(b).alias("target"), "n") for (a, b), (own, key) in links.items()]
    out = nodes[0]
    for r in [*nodes[1:], *edges]:
        out = out.unionByName(r)
    return out


def column_stats(df: DataFrame, fields: list[str]) -> DataFrame:
    """Of each numeric column: rows, nulls, distinct values, smallest and largest.

    A pass a column, which reads that column alone: its values are counted, and the rest follows from the counts. All
    distinct counts in one pass would make a row of each row for each column."""
    out = None
    for c in fields:
        counts = df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        low, high = (f(F.col("v").cast("double")) for f in (F.min, F.max))
        one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct_values"), low.alias("low"), high.alias("high"))
        one = one.select(F.lit(c).alias("field"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def histogram(df: DataFrame, field: str, buckets: int = 64) -> DataFrame:
    """Counts by equal-width bucket between the smallest and the largest value."""
    value = F.col(field).cast("double")
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / buckets
    bucket = F.when(width == 0, 0).otherwise(F.least(F.lit(buckets - 1), F.floor((value - F.col("lo")) / width)))
    return df.where(value.isNotNull()).crossJoin(F.broadcast(span)).groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
