"""Traversal of edge tables (src, dst, kind), hierarchies and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import settle


def neighbours(edges: DataFrame, node: object, kind: str | None = None) -> DataFrame:
    found = edges.where(F.col("src") == node)
    return (found.where(F.col("kind") == kind) if kind else found).select(F.col("dst").alias("node")).distinct()


def reverse_neighbours(edges: DataFrame, node: object, kind: str | None = None) -> DataFrame:
    found = edges.where(F.col("dst") == node)
    return (found.where(F.col("kind") == kind) if kind else found).select(F.col("src").alias("node")).distinct()


def traverse(edges: DataFrame, start: DataFrame, hops: int, kind: str | None = None) -> DataFrame:
    """node, depth: all nodes within ``hops`` of the start nodes, which are at 0.

    Each hop joins only the newest nodes and is written before the next, and an empty hop is the last. Edges that repeat
    cost nothing more than their rows, since what they reach is made distinct."""
    links = (edges.where(F.col("kind") == kind) if kind else edges).select("src", "dst")
    seen = front = settle(start.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, hops + 1):
        reached = front.join(links, front["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        front = settle(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def tree(df: DataFrame, key: str, parent: str, display: Column, depth: int = 10) -> DataFrame:
    """key, depth and path (the display texts from the root) of all rows down to ``depth`` levels; roots have no parent
    or one that isn't there."""
    rows = df.select(F.col(key).alias("key"), F.col(parent).alias("up"), display.cast("string").alias("name"))
    known = rows.select(F.col("key").alias("up"))
    kids = rows.where("up is not null and up <> key")
    roots = rows.where("up is null or up = key").unionByName(kids.join(known, "up", "left_anti").select("key", "up", "name"))
    level = out = settle(roots.select("key", F.lit(0).alias("depth"), F.col("name").alias("path")))
    for k in range(1, depth + 1):
        level = settle(kids.join(level.select(F.col("key").alias("up"), "path"), "up").select("key", F.lit(k).alias("depth"), F.concat_ws(" / ", "path", "name").alias("path")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def closure(members: DataFrame, nested: DataFrame, depth: int = 10) -> DataFrame:
    """who, grp: direct and inherited groups. members (who, grp), nested (grp, parent)."""
    found = front = settle(members.select("who", "grp").distinct())
    for _ in range(depth):
        front = settle(front.join(nested, "grp").select("who", F.col("parent").alias("grp")).distinct().join(found, ["who", "grp"], "left_anti"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def permissions(members: DataFrame, nested: DataFrame, grants: DataFrame) -> DataFrame:
    """who, code: the comma-separated codes of all groups, one row each. grants (grp, codes)."""
    codes = F.explode(F.filter(F.transform(F.split("codes", ","), lambda c: F.trim(c)), lambda c: c != ""))
    return closure(members, nested).join(grants, "grp").select("who", codes.alias("code")).distinct()
