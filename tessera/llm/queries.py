"""The ten operators over their whole tables, with production parameters, as the driver runs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import read
from .edit_join import edit_classes
from .edit_sketch import edit_fingerprints
from .jaccard import near_duplicates
from .language import identify
from .mixing import decide
from .neighbours import nearest
from .packing import pack
from .quality import score_quality
from .substring import dedupe_passages
from .token_count import token_counts
from .url_filter import judge_urls


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedupe_passages(spark, read(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "sub_chunks", "sub_removed", "sub_spans")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, read(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, read(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(spark, read(spark, sf_dir, "documents"))


def edit_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of op8's method: fingerprints banded by sampled bits, and verified by edit distance."""
    return edit_classes(spark, read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = decide(spark, read(spark, sf_dir, "documents"), evener=0.5)
    return chosen.select("doc_id", "source", "mix_tokens", F.round("mix_weight", 6).alias("mix_weight"), "mix_block", "mix_copies")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark, read(spark, sf_dir, "pages")).withColumn("purity", F.round("purity", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [edit_near_duplicates, op1_substring_dedup, op2_token_counts, op3_quality, op4_ngram_jaccard, op5_nearest_neighbours, op6_best_fit_packing, op7_language_id, op8_fingerprints, op9_mixing, op10_url_filter]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard": oracles.NEAR_DUPLICATES, "op5_nearest_neighbours": oracles.NEAREST, "op9_mixing": oracles.MIXING, "op10_url_filter": oracles.URLS}
