"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """node, label for the nodes of edges (a, b), both long: label is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so chains shorten by
    more than half. Labels only fall, and a round that changes none ends the loop. Edges and labels never leave the
    cluster; every round is written, so lineage stays short.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.save(both, f"{tag}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{tag}-0")
    rounds = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "m").alias("via"))
        jumped = lower.join(labels.select(F.col("node").alias("via"), F.col("label").alias("far")), "via", "left").select("node", "was", F.least("via", "far").alias("label"))
        new = scratch.save(jumped, f"{tag}-{rounds + 1}")
        scratch.drop(f"{tag}-{rounds}")
        rounds += 1
        changed = new.where("label <> was").limit(1).count()
        labels = new.drop("was")
        if not changed:
            scratch.drop(f"{tag}-edges")
            return labels


def stars(near: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each component of a symmetric boolean matrix, edges from its members to the smallest id among them.

    The smallest ids are the same in many overlapping groups, so the edges of all groups are few when made distinct."""
    label = np.arange(len(ids))
    for i in range(1, len(ids)):
        roots = np.unique(label[np.flatnonzero(near[i, :i])])
        if len(roots):
            label[np.isin(label, roots)] = i
            label[i] = i
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    root = least[label]
    return ids[ids != root], root[ids != root]
