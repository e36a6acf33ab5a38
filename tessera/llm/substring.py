"""Removal of passages that repeat, found by content-defined chunks.

A gear hash rolls over the bytes of a text; where a word begins and the hash of the ``WINDOW`` bytes before it is below
those at the ``SPAN`` word beginnings on either side, a chunk ends. Where no word has begun for ``WORDLESS`` bytes (scripts without spaces, encoded data) the hash cuts between
characters; only what it leaves longer than ``LONGEST`` is cut by length. Cuts depend on nearby bytes alone, so an insertion moves
no cut but those beside it, and a passage that occurs twice has the same chunks inside both times. Chunks are known by a 64-bit digest. The document with the smallest
doc_id that holds a chunk owns it; elsewhere, and after its first place in a document, the chunk is a repeat. Runs of
neighbouring repeats are extended byte by byte as far as the text agrees with the owner's, and those of at least
``least_bytes`` are taken out, 51 words of three letters; each byte taken out has an equal one in an earlier place.
Shorter ones (a common phrase, a licence line) stay, which also keeps a chance collision of digests from doing harm.

Chunk counts are summed before they are shuffled, owners are found by an aggregate and not by sorting a chunk's
occurrences, and only shared chunks are joined back, so a chunk that a third of all documents hold costs no task more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, byte_batches, spread, text_key, wrapped

#: Word beginnings on either side that a cut's hash is below, so that one in about 2 SPAN + 1 is a cut and few chunks are
#: much longer; a chunk is cut at LONGEST bytes; bytes that the gear hash spans.
SPAN, LONGEST, WINDOW = 3, 512, 16
#: Chunks on either side of a run that are told for comparison; bytes beside a chunk whose hash tells a chance repeat.
BESIDE, TOUCH = 3, 32
#: Where no word has begun for WORDLESS bytes, one byte in so many is a cut if its hash is below those of the 8 before.
WORDLESS, ONE_BYTE_IN = 64, 24
_RNG = np.random.default_rng(1)
GEAR = _RNG.integers(0, 1 << 16, 256, dtype=np.uint16)
VALUE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
NO_ID = (1 << 63) - 1
OURS = ["sub_chunks", "sub_removed", "sub_spans"]


class Powers:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


def gear(raw: np.ndarray) -> np.ndarray:
    """At each byte the gear hash h = 2 h + GEAR[byte]; its 16 bits know the last 16 bytes, so doubling spans suffice."""
    h = GEAR[raw]
    for span in (1, 2, 4, 8):
        h[span:] += h[:-span] << np.uint16(span)
    return h


def chunks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of a text's UTF-8 bytes, in order and without gaps."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, here = raw[:-1], raw[1:]
    begins = ((before == 32) | ((before >= 9) & (before <= 13)) | (here >= 0xE3)) & (here != 32)
    h = gear(raw)[:-1]
    word = np.flatnonzero(begins)
    low, least = h[word], np.ones(len(word), bool)
    for k in range(1, SPAN + 1):
        least[k:] &= low[k:] < low[:-k]
        least[:-k] &= low[:-k] < low[k:]
    cuts = np.concatenate([[0], word[least] + 1, [len(raw)]])
    words = np.concatenate([[0], word + 1, [len(raw)]])
    if (np.diff(words) > WORDLESS).any():
        at = np.flatnonzero((h < np.uint16((1 << 16) // ONE_BYTE_IN)) & ((here & 0xC0) != 0x80)) + 1
        at = at[at - words[np.searchsorted(words, at, "right") - 1] > WORDLESS]
        for k in range(1, 9):  # a stretch of one character has no place of its own
            at = at[h[at - 1] < h[at - 1 - k]]
        cuts = np.union1d(cuts, at)
    if (np.diff(cuts) > LONGEST).any():
        cuts = np.concatenate([np.append(np.arange(a, b - LONGEST // 2, LONGEST), a) if b - a > LONGEST else [a] for a, b in zip(cuts, cuts[1:])] + [[len(raw)]])
        cuts = np.unique(cuts)
        inside = (raw[np.minimum(cuts, len(raw) - 1)] & 0xC0) == 0x80  # never cut a character
        cuts = np.unique(np.concatenate([cuts[~inside | (cuts == len(raw))], [0]]))
    return cuts[:-1], cuts[1:]


def digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial hashes of the chunks modulo 2**64, from prefix sums, mixed with the lengths."""
    up, down = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE[raw] * up[: len(raw)], dtype=np.uint64)])
    h = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def chunk_rows(docs: DataFrame) -> DataFrame:
    """_digest, _doc, _row and _place: from the highest bits the chunk's number, its length up to 255, and 8-bit hashes of
    the TOUCH bytes before and after it."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for doc, row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = np.frombuffer((t.as_py() or "").encode(), np.uint8)
                starts, ends = chunks(raw)
                d = digests(raw, starts, ends, powers)
                pre = digests(raw, np.maximum(starts - TOUCH, 0), starts, powers) & 255
                post = digests(raw, ends, np.minimum(ends + TOUCH, len(raw)), powers) & 255
                place = np.arange(len(d)) << 24 | np.minimum(ends - starts, 255) << 16 | pre << 8 | post
                for c, x in zip(cols, (d, np.full(len(d), doc), np.full(len(d), row), place)):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["_digest", "_doc", "_row", "_place"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), text_key("doc_id", "text"), F.col("text").cast("string"))
    return spread(rows).mapInArrow(work, "_digest long, _doc long, _row long, _place long")


def surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """_orow, _oat, _before, _after: the bytes on either side of the wanted chunks (_orow, _oat) in their owners' texts.

    If a whole chunk agreed, and what its cut depends on, it would be a repeat itself and in the run, unless another text
    owns it; so BESIDE chunks are told, for common words there that others own."""
    reach = WORDLESS + WINDOW

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for row, t, ats in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = t.as_py().encode()
                starts, ends = chunks(np.frombuffer(raw, np.uint8))
                for at in ats.as_py():
                    low, high = max(0, int(starts[max(0, at - BESIDE)]) - reach), int(ends[min(len(ends) - 1, at + BESIDE)]) + reach
                    for c, x in zip(cols, (row, at, raw[low : starts[at]], raw[ends[at] : high])):
                        c.append(x)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["_orow", "_oat", "_before", "_after"])

    texts = docs.select(text_key("doc_id", "text").alias("_orow"), F.col("text").cast("string").alias("_text"))
    asked = wanted.groupBy("_orow").agg(F.collect_set("_oat").alias("_ats"))  # no more than the chunks of one text
    told = texts.join(asked, "_orow").select("_orow", "_text", "_ats").mapInArrow(work, "_orow long, _oat int, _before binary, _after binary")
    return told.dropDuplicates(["_orow", "_oat"])


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    odd = np.flatnonzero(x != y)
    return int(odd[0]) if len(odd) else n


def without(text: str, ends_of_runs: list[dict], least: int) -> tuple[str, list[tuple[int, int]], int]:
    """The text without long enough runs of repeats, the runs as (start, end) in bytes, and the number of chunks.

    A run of chunks with one owner comes as its first and last chunk, with the owner's bytes before and after them; it
    reaches as far as these agree with the text, in whole characters. Runs that meet are one."""
    raw = text.encode()
    starts, ends = chunks(np.frombuffer(raw, np.uint8))
    spans: list[tuple[int, int]] = []
    low = 0
    for e in sorted(ends_of_runs, key=lambda e: e["_at"]):
        if e["_left"]:
            low, before = int(starts[e["_at"]]), e["_before"] or b""
            low -= common(raw[max(0, low - len(before)) : low][::-1], before[::-1])
            while low < len(raw) and raw[low] & 0xC0 == 0x80:
                low += 1
        if e["_right"]:
            high, after = int(ends[e["_at"]]), e["_after"] or b""
            high += common(raw[high : high + len(after)], after)
            while high < len(raw) and raw[high] & 0xC0 == 0x80:
                high -= 1
            spans.append((low, high))
    gone: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if gone and low <= gone[-1][1]:
            gone[-1] = (gone[-1][0], max(gone[-1][1], high))
        else:
            gone.append((low, high))
    gone = [(a, b) for a, b in gone if b - a >= least]
    kept, upto = [], 0
    for a, b in gone:
        kept.append(raw[upto:a])
        upto = b
    return b"".join([*kept, raw[upto:]]).decode(), gone, len(starts)


def dedupe_passages(spark: SparkSession, docs: DataFrame, least_bytes: int = 200) -> DataFrame:
    """All rows and columns of ``docs`` (but any with one of our names) with the shortened text, and sub_chunks, sub_removed (characters taken out) and
    sub_spans (start and end in the bytes of the old text).

    A null text stays null, with no chunks; an empty one stays empty. A very long text is cut and compared whole, as any
    other. Rows without an id come after all others. Among rows that agree in doc_id, or have none, the key of id and
    text decides; rows that agree in text too are one document and stay alike. A document whose whole text repeats keeps
    its row with an empty text. An empty table gives an empty result.
    """
    byte_batches(spark)
    scratch = Scratch(spark, "passages")
    rows = scratch.save(chunk_rows(docs), "chunks")
    first = F.min(F.struct("_doc", "_row", "_place")).alias("_first")
    owners = rows.groupBy("_digest").agg(first, F.count(F.lit(1)).alias("_n")).where("_n > 1")
    owners = scratch.save(owners.select("_digest", F.col("_first._row").alias("_orow"), F.col("_first._place").alias("_oplace")), "owners")
    at = lambda place: F.shiftright(place, 24).cast("int")
    like = lambda low: F.expr(f"((_place ^ _oplace) >> {low}) & 255") == 0
    repeats = rows.select("_digest", "_row", "_place").join(owners, "_digest").where("_row <> _orow or _place <> _oplace")
    repeats = repeats.select("_row", at("_place").alias("_at"), F.expr("cast((_place >> 16) & 255 as int)").alias("_len"), "_orow", at("_oplace").alias("_oat"), like(8).alias("_pre"), like(0).alias("_post"))
    repeats = repeats.repartition("_row").distinct()
    beside = Window.partitionBy("_row").orderBy("_at")
    for name, other, back, step in (("_left", F.lag, F.lead, -1), ("_right", F.lead, F.lag, 1)):
        near = F.coalesce(other("_at").over(beside) == F.col("_at") + step, F.lit(False))
        same = near & (other("_orow").over(beside) == F.col("_orow")) & (other("_oat").over(beside) == F.col("_oat") + step)
        # a change of owner deep inside a run of repeats needs no comparison: what could agree goes anyway
        deep = (other("_at", BESIDE + 1).over(beside) == F.col("_at") + (BESIDE + 1) * step) & (back("_at", BESIDE).over(beside) == F.col("_at") - BESIDE * step)
        same = same | F.coalesce(deep, F.lit(False))
        same = F.coalesce(same, F.lit(False))
        repeats = repeats.withColumns({name: ~same, f"{name}_near": near})
    # a lone chunk with other bytes on both sides of it in the owner's text reaches no further than they do
    lone = F.col("_left") & F.col("_right") & ~F.col("_pre") & ~F.col("_post")
    short = ~F.col("_left_near") & ~F.col("_right_near") & (F.col("_len") + 2 * TOUCH < least_bytes)
    ends = repeats.where(F.col("_left") | F.col("_right")).where(~(lone & short)).select("_row", "_at", "_orow", "_oat", "_left", "_right")
    ends = scratch.save(ends, "ends")
    scratch.drop("chunks", "owners")
    near = scratch.save(surroundings(docs, ends.select("_orow", "_oat").distinct()), "near")
    told = F.struct("_at", "_left", "_right", F.when(F.col("_left"), F.col("_before")).alias("_before"), F.when(F.col("_right"), F.col("_after")).alias("_after"))
    repeats = ends.join(near, ["_orow", "_oat"]).groupBy("_row").agg(F.collect_list(told).alias("_repeats"))  # no more than the chunks of one text
    repeats = scratch.save(repeats, "repeats")
    scratch.drop("ends", "near")
    keyed = docs.select(wrapped(docs, ("text",)), F.col("text").cast("string").alias("_text"), text_key("doc_id", "text").alias("_row"))
    joined = keyed.join(repeats, "_row", "left").select("_text", "_repeats", "_all")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, removed, spans = [], [], [], []
            for t, r in zip(b.column(0), b.column(1)):
                old = t.as_py()
                new, gone, n = without(old or "", r.as_py() or [], least_bytes)
                texts.append(None if old is None else new)
                counts.append(n)
                removed.append(len(old or "") - len(new))
                spans.append([{"start": a, "end": z} for a, z in gone])
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span)], ["_all", "_text", *OURS])

    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = [joined.schema["_all"], T.StructField("_text", T.StringType()), T.StructField("sub_chunks", T.LongType()), T.StructField("sub_removed", T.LongType()), T.StructField("sub_spans", spans_type)]
    done = joined.mapInArrow(work, T.StructType(kinds))
    return done.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_all.`{c}`") for c in docs.columns if c not in OURS], *OURS)
