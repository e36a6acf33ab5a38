"""Exact nearest vectors and vector upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import DISTANCES


def search(df: DataFrame, key: str, vector: str, query: list[float], most: int, metric: str = "cosine") -> DataFrame:
    """key, distance: smaller is nearer, ties by key. Each task keeps its ``most`` nearest before any are moved."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return df.select(key, DISTANCES[metric](F.col(vector), asked).alias("distance")).orderBy("distance", key).limit(most)


def live(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The newest write of each key, without deleted ones. The log has op, upsert or delete."""
    rest = [c for c in log.columns if c not in (key,)]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_row"))
    return newest.select(key, "_row.*").where("op <> 'delete'").drop("op")


def centroid(df: DataFrame, vector: str) -> DataFrame:
    """position, mean: one row a component."""
    return df.select(F.posexplode(vector).alias("position", "x")).groupBy("position").agg(F.avg(F.col("x").cast("double")).alias("mean"))
