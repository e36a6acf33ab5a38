"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised. Alpha is bisected between 0 (all sources alike)
and 1 (as they are) until the weights reach a target entropy, or until no source is repeated more often than a limit.
The target is a share of the largest entropy, or a share of the way from the entropy that the sources have to the
largest one, which binds however even or uneven they are. A budget of tokens then gives each source a quota. Whole
epochs repeat every document; the rest is taken from a permutation of the source's blocks, block by block, and within
the block where the quota ends document by document.

A document's block is a hash of it, so that block sums are partial aggregates and no source is ever sorted as a whole:
the ``blocks`` blocks of a source meet in one window, and then the documents of its one cut block, a ``blocks``-th of
the source. Hashes are md5, which SQL engines agree on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, wrapped

ROUNDS, POINTS = 6, 31  # five bisections a round, all from one pass over the sources


def words(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


def exponent(shares: DataFrame, total: float, budget: float, target_entropy: float | None, evener: float | None, max_repeats: float | None) -> float:
    """The largest alpha in [0, 1] whose weights are even enough, or the smallest that repeats no source too often.

    ``shares`` has _tokens a source, all above 0. With a target entropy (a fraction of that of equal weights, or of the
    way there) alpha 0 always meets it; with a limit on repeats alpha 1 comes closest where none meets it.
    """
    sources = shares.count()
    if evener is not None:
        p = F.col("_tokens") / F.lit(total)
        own = -shares.agg(F.sum(p * F.log(p))).first()[0] / math.log(sources)
        target_entropy = own + evener * (1 - own)
    lo, hi = 0.0, 1.0

    def measures(alphas: list[float]) -> list[bool]:
        p = F.col("_tokens") / F.lit(total)
        row = shares.agg(*[x for k, a in enumerate(alphas) for x in (F.sum(F.pow(p, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{k}"), F.max(F.pow(p, F.lit(a)) / F.col("_tokens")).alias(f"r{k}"))]).first()
        met = []
        for k, a in enumerate(alphas):
            z, logs, repeat = row[f"z{k}"], row[f"l{k}"], row[f"r{k}"]
            if max_repeats is not None:
                met.append(repeat / z * budget <= max_repeats * (1 + 1e-9))
            else:
                entropy = math.log(z) - a * logs / z
                met.append(entropy >= target_entropy * math.log(sources) - 1e-9)
        return met

    if max_repeats is not None:
        if measures([0.0])[0]:
            return 0.0
        if not measures([1.0])[0]:
            return 1.0
    elif measures([1.0])[0]:
        return 1.0
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * k / (POINTS + 1) for k in range(1, POINTS + 1)]
        met = measures(grid)
        # repeats: not met below, met above; entropy: met below, not met above
        first = next((k for k, m in enumerate(met) if m == (max_repeats is not None)), POINTS)
        lo, hi = ([lo, *grid, hi][first], [lo, *grid, hi][first + 1])
    return hi if max_repeats is not None else lo


def _source(col: str) -> Column:
    return F.when(F.col(col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(col).cast("string")))


def _unit(digest: Column, at: int) -> Column:
    """Thirteen hexadecimal digits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, at, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def decisions(
    spark: SparkSession,
    docs: DataFrame,
    target_entropy: float | None = None,
    evener: float | None = None,
    max_repeats: float | None = None,
    budget: int | None = None,
    blocks: int = 1024,
    seed: int = 9,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows of ``docs`` (a struct, _all), and mix_tokens, mix_weight, mix_block (place of its block in the permutation)
    and mix_copies (how often it is taken; 0: not at all).

    A token is a word between white space; the budget is all tokens of the table unless given. A null source is a
    source of its own. Null and empty texts have no tokens: they cost nothing and follow their block. A very long text
    is taken whole or not at all, so a source can stay below its quota by less than its longest document. A source
    without tokens has weight 0 and is kept as it is, once. Rows that agree in id and text share their fate, so ties
    need no order. Exactly one of target_entropy (share of the largest entropy), evener (share of the way to it) and
    max_repeats must be given. An empty table gives an empty result.
    """
    if sum(x is not None for x in (target_entropy, evener, max_repeats)) != 1:
        raise ValueError("give one of target_entropy, evener and max_repeats")
    scratch = Scratch(spark, "mix")
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("|"), F.col(text_col).cast("string")), F.lit(""))).cast("binary"))
    own = [_source(source_col).alias("_src"), words(F.col(text_col)).alias("_n"), _unit(digest, 1).alias("_u"), _unit(digest, 17).alias("_v")]
    narrow = scratch.save(docs.select(*own), "narrow")
    shares = scratch.save(narrow.groupBy("_src").agg(F.sum("_n").alias("_tokens")), "shares")
    total = shares.agg(F.sum("_tokens")).first()[0] or 0
    budget = total if budget is None else budget
    full = shares.where("_tokens > 0")
    alpha = exponent(full, total, budget, target_entropy, evener, max_repeats) if total and full.count() > 1 else 1.0
    z = full.agg(F.sum(F.pow(F.col("_tokens") / F.lit(float(total or 1)), F.lit(alpha)))).first()[0] or 1.0
    some = F.col("_tokens") > 0
    quota = F.col("mix_weight") * F.lit(float(budget))
    plan = shares.withColumn("mix_weight", F.when(some, F.pow(F.col("_tokens") / F.lit(float(total or 1)), F.lit(alpha)) / F.lit(z)).otherwise(0.0))
    # a billionth of a token guards whole epochs against rounding
    plan = plan.withColumn("_epochs", F.when(some, F.floor((quota + 1e-9) / F.col("_tokens"))).otherwise(1).cast("int"))
    plan = plan.withColumn("_rest", F.when(some, quota - F.col("_epochs") * F.col("_tokens")).otherwise(0.0))
    plan = scratch.save(plan.drop("_tokens"), "plan")
    block = F.floor(F.col("_u") * F.lit(blocks)).cast("int").alias("_block")
    placed = narrow.join(plan, "_src").select("_src", "_n", "_v", "_rest", block)
    sums = placed.groupBy("_src", "_block").agg(F.sum("_n").alias("_sum"), F.first("_rest").alias("_rest"))
    permuted = Window.partitionBy("_src").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "_src", F.col("_block").cast("string")).cast("binary")), "_block")
    sums = sums.withColumns({"_upto": F.sum("_sum").over(permuted), "mix_block": F.row_number().over(permuted)}).withColumn("_left", F.col("_rest") - F.col("_upto") + F.col("_sum"))
    sums = scratch.save(sums.select("_src", "_block", "mix_block", "_left", "_sum"), "blocks")
    # the one block of each source in which the quota ends: the last place in its order that still fits
    cut = sums.where("_left > 0 and _left < _sum").select("_src", "_block", "_left")
    inside = placed.select("_src", "_block", "_n", "_v").join(cut, ["_src", "_block"])
    upto = F.sum("_n").over(Window.partitionBy("_src").orderBy("_v"))
    last = inside.withColumn("_upto", upto).where("_upto <= _left").groupBy("_src", "_block").agg(F.max("_v").alias("_last"))
    fate = sums.join(last, ["_src", "_block"], "left").select("_src", "_block", "mix_block", F.when(F.col("_left") >= F.col("_sum"), 2.0).when(F.col("_left") <= 0, -1.0).otherwise(F.coalesce("_last", F.lit(-1.0))).alias("_last"))
    fate = scratch.save(fate, "fate")
    scratch.drop("narrow", "blocks")
    rows = docs.select(wrapped(docs), *own).withColumnRenamed("_n", "mix_tokens")
    rows = rows.join(plan.select("_src", "mix_weight", "_epochs"), "_src").withColumn("_block", block).join(fate, ["_src", "_block"])
    copies = F.col("_epochs") + F.when((F.col("mix_weight") > 0) & (F.col("_v") <= F.col("_last")), 1).otherwise(0)
    return rows.select("_all", "mix_tokens", "mix_weight", "mix_block", copies.cast("int").alias("mix_copies"))


def decide(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """``decisions`` with the columns of ``docs`` side by side; a column of theirs with one of our names goes."""
    ours = ["mix_tokens", "mix_weight", "mix_block", "mix_copies"]
    return decisions(spark, docs, **how).select(*[F.col(f"_all.`{c}`") for c in docs.columns if c not in ours], *ours)


def mix(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The chosen documents with the columns of ``docs``, each as often as it was taken; null and empty texts, ties,
    repeated rows, empty tables and clashing names as ``decisions`` states."""
    chosen = decisions(spark, docs, **how).where("mix_copies > 0")
    return chosen.select("_all", F.explode(F.sequence(F.lit(1), "mix_copies"))).select("_all.*")
