"""Document fingerprints by randomised edit embedding.

A walk over the characters of a text emits the current character at every step and moves on to the next one when a
random bit, shared by all texts and fixed by the step and one of ``CLASSES`` classes of characters, is set. Texts a few edits apart fall back into step
after each edit, so that edit distance becomes Hamming distance between the emitted strings. A fingerprint is the
number of characters and, at two scales, one hashed bit of the emitted string at each of ``SAMPLES`` fixed steps: the
scale is the power of two from the length up, so texts of like length sample the same steps, and the scale below
lets a text be compared with a shorter one. The walk's bits repeat every ``PERIOD`` steps.

The likeness of two fingerprints is twice the share of equal bits less one (0 for chance), among steps that either text
reaches, and 1 for equal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, text_key

PERIOD, CLASSES, SAMPLES, SMALLEST = 1 << 16, 64, 256, 16
#: Fewer texts than this are walked one by one.
LANES = 12


def _steps() -> list[bytes]:
    """For each character class and step, the number of steps until the walk has left the character."""
    rng = np.random.default_rng(8)
    out = []
    for _ in range(CLASSES):
        moves = rng.integers(0, 2, PERIOD, dtype=np.uint8)
        moves[:: 128] = 1  # so that no wait is longer than a byte can say
        nxt = np.flatnonzero(moves)
        at = np.searchsorted(nxt, np.arange(PERIOD))
        ends = np.append(nxt, nxt[0] + PERIOD)[at]
        out.append((ends - np.arange(PERIOD) + 1).astype(np.uint8).tobytes())
    return out


class Embedder:
    def __init__(self):
        self.steps = _steps()
        self.share = np.sort(np.random.default_rng(88).random(SAMPLES))
        self.salt = np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def walk(self, codes: np.ndarray, start: int = 0) -> np.ndarray:
        """The step at which each character is reached, and the step after the last."""
        classes = ((codes * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint8).tobytes()
        steps, wrap = self.steps, PERIOD - 1
        return np.fromiter(accumulate(classes, lambda j, c: j + steps[c][j & wrap], initial=start), np.int64, len(codes) + 1)

    def walks(self, many: list[np.ndarray]) -> list[np.ndarray]:
        """``walk`` of each of many, all of them a character at a time; of the longest few the rest one by one."""
        if not hasattr(self, "table"):
            self.table = np.frombuffer(b"".join(self.steps), np.uint8)
        order = np.argsort([-len(c) for c in many], kind="stable")
        size = np.array([len(many[k]) for k in order])
        together = int(size[LANES - 1]) if len(many) >= LANES else 0  # so many characters are walked by LANES texts or more
        alive = np.searchsorted(-size, -np.arange(together), "left")  # texts that have the character; they are the first ones
        begin = np.concatenate([[0], np.cumsum(alive)])
        rows, reached = np.zeros(begin[-1], np.int32), np.zeros(begin[-1], np.int64)
        for lane, k in enumerate(order):
            c = many[k][:together]
            rows[begin[: len(c)] + lane] = ((c * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.int32) * PERIOD
        now = np.zeros(len(many), np.int64)
        for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist()):
            at = now[: hi - lo]
            at += self.table[rows[lo:hi] + (at & (PERIOD - 1))]
            reached[lo:hi] = at
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(many)
        for lane, k in enumerate(order):
            own = reached[begin[: min(len(many[k]), together)] + lane]
            last = int(own[-1]) if len(own) else 0
            out[k] = np.concatenate([[0], own, self.walk(many[k][together:], last)[1:]])
        return out

    def bits(self, codes: np.ndarray, reached: np.ndarray, scale: int) -> bytes:
        at = np.searchsorted(reached, (self.share * (2 * scale)).astype(np.int64), "right") - 1
        padded = np.append(codes, np.uint32(0x110000))[np.minimum(at, len(codes))].astype(np.uint64)
        h = (padded + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ self.salt
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return np.packbits((h >> np.uint64(63)).astype(np.uint8)).tobytes()

    def fingerprint(self, codes: np.ndarray, reached: np.ndarray) -> str:
        scale = scale_of(len(codes))
        return f"{len(codes):08x}" + (self.bits(codes, reached, scale) + self.bits(codes, reached, scale // 2)).hex()

    def likeness(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        if len(a) > len(b) or int(a[:8], 16) < int(b[:8], 16):
            a, b = b, a
        n, m = int(a[:8], 16), int(b[:8], 16)
        big, small = scale_of(n), scale_of(m)
        if big > 2 * small:
            return 0.0
        block = SAMPLES // 4
        x, y = a[8 : 8 + block] if big == small else a[8 + block :], b[8 : 8 + block]
        same = np.unpackbits(np.frombuffer(bytes.fromhex(x), np.uint8) ^ np.frombuffer(bytes.fromhex(y), np.uint8)) == 0
        inside = self.share * (2 * small) < 2 * n
        return max(0.0, 2 * float(same[inside].mean()) - 1) * min(1.0, small / n) if inside.any() else 0.0


def scale_of(n: int) -> int:
    return max(SMALLEST, 1 << max(0, n - 1).bit_length())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def edited(text: str, following: str) -> str:
    """The last third of the code points (rounded down) replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


class Pending:
    """A document that waits for the next one."""

    def __init__(self, embed: Embedder, doc_id, text: str):
        self.doc_id, self.text, self.codes = doc_id, text, code_points(text)
        self.reached = embed.walk(self.codes)
        self.fingerprint = embed.fingerprint(self.codes, self.reached)

    def row(self, embed: Embedder, following: Pending) -> tuple:
        new = edited(self.text, following.text)
        codes, kept = code_points(new), len(self.text) - len(self.text) // 3
        reached = np.concatenate([self.reached[:kept], embed.walk(codes[kept:], int(self.reached[kept]))])
        other = embed.fingerprint(codes, reached)
        return (self.doc_id, len(self.text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), self.fingerprint, other, embed.likeness(self.fingerprint, other), embed.likeness(self.fingerprint, following.fingerprint))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def above(cuts: list[int], value: Column) -> Column:
    """How many of the descending cuts are above the value, by binary search."""
    powers = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    if not powers:
        return F.lit(0)
    table = F.lit(cuts).cast("array<long>")
    step = lambda at, p: at + F.when(F.coalesce(F.get(table, at + p - 1) > value, F.lit(False)), p).otherwise(0)
    return F.aggregate(F.lit(powers).cast("array<int>"), F.lit(0), step)


def in_segments(spark: SparkSession, docs: DataFrame, segments: int) -> DataFrame:
    """doc_id, _text, _seg, _guest: documents in descending order of doc_id, cut into segments, each followed by a guest,
    the document that comes after its last one. Only ids go to the driver: one a segment."""
    ids = docs.select("doc_id")
    cuts = ids.where(F.col("doc_id").isNotNull()).agg(F.percentile_approx("doc_id", [k / segments for k in range(1, segments)], 20_000) if segments > 1 else F.array().cast("array<long>")).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    seg = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(above(cuts, F.col("doc_id")))
    heads = sorted((r["_seg"], r["head"]) for r in ids.groupBy(seg.cast("int").alias("_seg")).agg(F.max("doc_id").alias("head")).collect())
    guests = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    own = docs.select("doc_id", F.col("text").cast("string").alias("_text")).withColumn("_own", seg.cast("int"))
    known = spark.createDataFrame(guests, "_head long, _to int")
    rows = own.join(F.broadcast(known), F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    places = F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_own").alias("s"), F.lit(0).alias("g")))).otherwise(F.array(F.struct(F.col("_own").alias("s"), F.lit(0).alias("g")), F.struct(F.col("_to").alias("s"), F.lit(1).alias("g"))))
    return rows.select("doc_id", "_text", F.explode(places).alias("_p")).select("doc_id", "_text", F.col("_p.s").alias("_seg"), F.col("_p.g").alias("_guest"))


def edit_fingerprints(spark: SparkSession, docs: DataFrame, segments: int | None = None) -> DataFrame:
    """One row per document, with its own fingerprint and that of its edited text (see ``edited``), and the likeness of
    the former to the latter and to the next document's fingerprint.

    The next document is that with the next smaller doc_id, after the last the first. Null texts are as empty ones; very
    long ones are walked whole. Rows that repeat a doc_id follow each other by a hash of the text (ties: equal rows), null
    ids come last. Columns but doc_id and text are not read, so they may have any name; an empty table gives an empty
    result; a single document is its own next one.
    """
    byte_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = in_segments(spark, docs, segments or 4 * parts)
    order = ["_seg", "_guest", F.desc_nulls_last("doc_id"), text_key("_text")]
    rows = rows.repartition(parts, "_seg").sortWithinPartitions(*order)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed, held, seg, done = Embedder(), None, None, False
        for b in batches:
            out = []
            for doc, text, s, guest in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if s != seg:
                    held, seg, done = None, s, False
                if done:
                    continue  # more rows with the guest's id: the first has served
                now = Pending(embed, doc, text.as_py() or "")
                if held is not None:
                    out.append(held.row(embed, now))
                held, done = now, bool(guest)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], NAMES)

    return rows.mapInArrow(work, SCHEMA)
