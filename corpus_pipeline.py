"""From documents to packed training sequences: quality filter, near-duplicate removal, passage removal, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, read
from tessera.llm.jaccard import one_of_each
from tessera.llm.mixing import mix
from tessera.llm.packing import pack
from tessera.llm.quality import accepted
from tessera.llm.substring import OURS, dedupe_passages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't reject.

    Null and empty texts are scored without features, very long ones whole; rows with equal texts (ties, repeats) get the
    same score; an empty table stays empty; all columns stay."""
    return accepted(spark, docs, read(spark, sf_dir, "labels"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest doc_id, then the smallest key of id and text.

    Rows with a null text all stay, empty texts are copies of each other, very long ones are compared whole; of rows that
    repeat one stays; an empty table stays empty; all columns stay."""
    return one_of_each(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that another document owns; n_chars follows the text.

    Null and empty texts stay, very long ones are cut whole; rows that repeat stay alike; an empty table stays empty; a
    column with a name of the operator's goes, all others stay."""
    plain = docs.select(*[c for c in docs.columns if c not in OURS])
    shorter = dedupe_passages(spark, plain)
    length = F.when(F.col("sub_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return shorter.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*plain.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights halfway, in entropy, from what they have to equal weights, in as many tokens as there are.

    Null and empty texts cost nothing and follow their block; a very long one is taken whole or not; rows that agree in id
    and text share their fate; an empty table stays empty; all columns stay."""
    return mix(spark, docs, evener=0.5)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens; a null or empty text is one end id, a very long one is cut,
    repeated rows are packed each on its own, an empty table gives none."""
    return pack(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("substring dedup", substring_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Learned scores, hashed candidates and packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
