"""Language identification by n-gram filters whose entries are bitmasks over languages.

A character n-gram belongs to a language if the language's own texts hold it at no less than ``keep`` of the rate of the
language that has it most. One bit-sliced Bloom filter serves all languages: each of its slots is a mask with a bit for
each language, an n-gram sets its languages' bits in ``HASHES`` slots, and the AND of these slots gives all languages
that contain it. A text's score of a language is the number of its n-grams with that bit, less the expected number of
false positives by the language's fill; the language with the largest count wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held_out, byte_batches, spread, unit_hash

SLOT_BITS, HASHES, WORD_BITS = 20, 3, 63
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")  # marks belong to the letters before them
UNDETERMINED = "und"


def grams(text: str | None, size: int) -> np.ndarray:
    """Hashes of the n-grams of a text's words, lower-cased, with a space around each; none without a letter."""
    words = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not any(c.isalpha() for c in words):
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(f" {words} ".center(size).encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(codes) - size + 1
    h = codes[:n].copy()
    for k in range(1, size):
        h *= np.uint64(0x100000001B3)
        h ^= codes[k : k + n]
    return h * MIX[1]


def slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h * m) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for m in MIX[:HASHES]]


def fit(spark: SparkSession, docs: DataFrame, scratch: Scratch, size: int, rows: int, keep: float, least: int):
    """Languages, the filter as an array (mask word, slot), and each language's rate of false positives."""
    seen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    per = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("_docs")).collect()  # one row a language
    langs = sorted(r["lang"] for r in per)
    if not langs:
        return [], None, None
    number = {x: k for k, x in enumerate(langs)}
    shares = spark.createDataFrame([(r["lang"], number[r["lang"]], min(1.0, rows / r["_docs"])) for r in per], "lang string, _lang int, _share double")
    sample = seen.join(F.broadcast(shares), "lang").where(unit_hash(7, F.col("doc_id")) < F.col("_share")).select("_lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[int, list[np.ndarray]] = {}
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                own.setdefault(k, []).append(grams(t.as_py(), size))
            for k, parts in own.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["_lang", "_gram", "_n"])

    counts = sample.mapInArrow(count, "_lang int, _gram long, _n long").groupBy("_lang", "_gram").agg(F.sum("_n").alias("_n"))
    counts = scratch.save(counts, "grams")
    totals = counts.groupBy("_lang").agg(F.sum("_n").alias("_all"))
    rated = counts.where(F.col("_n") >= least).join(F.broadcast(totals), "_lang").withColumn("_rate", F.col("_n") / F.col("_all"))
    best = rated.groupBy("_gram").agg(F.max("_rate").alias("_best"))
    members = rated.join(best, "_gram").where(F.col("_rate") >= keep * F.col("_best")).select("_gram", "_lang")

    def enter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, k = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for at in slots(g):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((k // WORD_BITS).astype(np.int32)), pa.array(np.int64(1) << (k % WORD_BITS).astype(np.int64))], ["_slot", "_word", "_bits"])

    filled = members.mapInArrow(enter, "_slot long, _word int, _bits long").groupBy("_slot", "_word").agg(F.bit_or("_bits").alias("_bits")).toArrow()  # at most one row a slot and word
    table = np.zeros((-(-len(langs) // WORD_BITS), 1 << SLOT_BITS), np.int64)
    table[filled["_word"].to_numpy(), filled["_slot"].to_numpy()] = filled["_bits"].to_numpy()
    fill = np.array([((table[k // WORD_BITS] >> (k % WORD_BITS)) & 1).mean() for k in range(len(langs))])
    return langs, table, fill**HASHES


def predict(text: str | None, langs: list[str], table: np.ndarray, false: np.ndarray, usual: str, size: int) -> tuple[str, float]:
    """The language and its share of all corrected counts; the smaller name wins a tie."""
    h = grams(text, size)
    if not len(h) or not langs:
        return UNDETERMINED, 0.0
    at = slots(h)
    got = np.zeros(len(langs))
    for w, words in enumerate(table):
        mask = words[at[0]]
        for more in at[1:]:
            mask &= words[more]
        for k in range(w * WORD_BITS, min(len(langs), (w + 1) * WORD_BITS)):
            got[k] = np.count_nonzero(mask & np.int64(1 << (k % WORD_BITS)))
    got = np.maximum(0, (got - len(h) * false) / np.maximum(1e-9, 1 - false))
    best = int(got.argmax())
    return (langs[best], float(got[best] / got.sum())) if got[best] > 0 else (usual, 0.0)


def identify(
    spark: SparkSession, docs: DataFrame, train: DataFrame | None = None, size: int = 4, train_rows: int = 500, keep: float = 0.25, least: int = 2
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from ``train`` (else ``docs``), from rows with a language that are not held out: about ``train_rows`` of each
    language, chosen by a hash of the id. Null and empty texts and texts without a letter are ``und`` with score 0, and so
    is everything if there is nothing to learn from; very long texts are read whole. A text of which no n-gram is known
    gets the first language by name, with score 0; ties go to the smaller name. Repeated rows each give a row; other
    columns are not read, so they may have any name; an empty table gives an empty result.
    """
    byte_batches(spark)
    langs, table, false = fit(spark, (docs if train is None else train).select("doc_id", "lang", "text"), Scratch(spark, "lang"), size, train_rows, keep, least)
    model = spark.sparkContext.broadcast((langs, table, false))  # fixed size: slots x mask words

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, false = model.value
        for b in batches:
            out = [predict(t.as_py(), langs, table, false, langs[0] if langs else UNDETERMINED, size) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string"))
    return spread(rows).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
