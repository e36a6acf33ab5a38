"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Documents are tokenised and cut into pieces. A piece longer than half a sequence opens one; its rest is a gap. Then
rounds follow until every piece has a place. A round range-sorts the pieces that wait together with the gaps, by size,
and sweeps the sorted order: a piece's successor is the smallest gap that holds it, and where several pieces want one
gap, rank decides: the largest takes it and the others go on to the next gap. That is the matching of brackets, pieces
opening and gaps closing them. Every partition matches its own rows until no piece of it fits a gap of it, gaps shrinking
by what they took; what it leaves over is matched between partitions from their counts, one row a partition. Then the
gaps are updated and the next round begins. A gap at least twice as large as the largest piece takes part as several.
Before a round pieces that fit no gap, down to half the largest, open new sequences, run by run in rank order.

Each round at least halves the largest piece or leaves few waiting, so rounds are few at any size. Pieces, gaps and
placements are tables throughout, and a sequence has the id of its first piece, so nothing is numbered in one place.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_batches, spread

END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Kinds of rows in a round's tables.
WAITS, GAP, PLACED = 0, 1, 2


class Encoder:
    """Ids of ``byte_bpe_50k.json``, as little-endian bytes.

    The rank file of the same vocabulary gives the same ids several times faster; a text that spells a special token
    goes to the tokenizer itself, which reads it as that token.
    """

    def __init__(self, vocabulary: str, ranks: str, special: str = "<|endoftext|>"):
        import tiktoken

        self.vocabulary, self.special, self.whole = vocabulary, special, None
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def exactly(self, text: str) -> list[int]:
        """By the tokenizer itself, which is loaded only when a text asks for it."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.vocabulary)
        return self.whole.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        ids = self.exactly(text) if self.special in text else self.fast.encode_ordinary(text)
        return np.asarray([*ids, END_ID], dtype="<u4").tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one, or full ones after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int, vocabulary: str, ranks: str) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary, ranks)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py() or "")
                rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(work, PIECES)


def brackets(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces (WAITS) and gaps (GAP) in ascending order: the places of matched pieces and of their gaps. A gap takes the
    last piece before it that no gap between took."""
    opens = kind == WAITS
    depth = np.cumsum(np.where(opens, 1, -1))
    by = np.argsort(np.where(opens, depth, depth + 1), kind="stable")  # rows of one depth alternate
    level, o = np.where(opens, depth, depth + 1)[by], opens[by]
    at = np.flatnonzero(o[:-1] & ~o[1:] & (level[:-1] == level[1:]))
    return by[at], by[at + 1]


SWEPT = "kind int, id long, seq long, n long, part int, nth long"


def settled(ids: np.ndarray, n: np.ndarray, seqs: np.ndarray, free: np.ndarray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Rounds within a partition, of pieces and gaps in ascending order: (ids, seqs, lengths) placed, one entry a round, and
    afterwards the room of each gap and whether each piece still waits."""
    placed, waits, free = [], np.ones(len(ids), bool), free.copy()
    while waits.any() and len(free):
        w = np.flatnonzero(waits)
        g = np.flatnonzero(free >= n[w[0]])
        sizes, kind = np.concatenate([n[w], free[g]]), np.repeat([WAITS, GAP], [len(w), len(g)])
        by = np.lexsort((kind, sizes))
        pieces, gaps = brackets(kind[by])
        if not len(pieces):
            break
        a, b = w[by[pieces]], g[by[gaps] - len(w)]
        placed.append((ids[a], seqs[b], n[a]))
        waits[a] = False
        free[b] -= n[a]
    return placed, free, waits


def sweep(rows: DataFrame) -> DataFrame:
    """Of rows (size, kind, key, n) in ascending order: pieces with the gaps that they took (PLACED), and what each partition
    leaves over: gaps that hold any piece of the partitions before, numbered in order, and pieces, numbered from the
    largest."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = list(batches)  # a range partition of narrow rows
        if not any(b.num_rows for b in whole):
            return
        size, kind, key, n = (np.concatenate([b.column(k).to_numpy() for b in whole]) for k in range(4))
        part, waits = TaskContext.get().partitionId(), kind == WAITS
        seqs, free = key[~waits], size[~waits]
        ids, n = key[waits], n[waits]
        placed, room, still = settled(ids, n, seqs, free)

        def told(kind: int, ids: np.ndarray, seqs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            cols = [np.full(len(n), kind, np.int32), ids, seqs, n, np.full(len(n), part, np.int32), np.arange(len(n))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "id", "seq", "n", "part", "nth"])

        for a, b, c in placed:
            yield told(PLACED, a, b, c)
        spare = np.flatnonzero(room >= size[0])
        spare = spare[np.argsort(room[spare], kind="stable")]
        yield told(GAP, seqs[spare], seqs[spare], room[spare])
        yield told(WAITS, ids[still][::-1], ids[still][::-1], n[still][::-1])

    return rows.select("size", "kind", "key", "n").mapInArrow(work, SWEPT)


def between(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Of each partition's number, gaps and pieces left over, in order: runs (number, partition and first place of gaps,
    partition and first place of pieces, length) that belong together."""
    runs, stack = [], []
    for part, gaps, pieces in sorted(counts):
        at = 0
        while at < gaps and stack:
            other, low, high = stack.pop()
            n = min(gaps - at, high - low)
            runs.append((len(runs), part, at, other, low, n))
            at += n
            if low + n < high:
                stack.append((other, low + n, high))
        if pieces:
            stack.append((part, 0, pieces))
    return runs


STATE = "kind int, id long, n long, off long"


def match(waits: DataFrame, gaps: DataFrame, largest: int, capacity: int, scratch: Scratch, tag: str) -> DataFrame:
    """A round: (kind, id, n, off): pieces that wait still, gaps as they are now, and pieces placed at off in sequence n."""
    parts = F.when(F.col("n") >= 2 * largest, F.floor(F.col("n") / largest)).otherwise(1)
    slots = gaps.withColumn("_parts", parts).select(F.floor(F.col("n") / F.col("_parts")).alias("size"), F.lit(GAP).alias("kind"), F.col("id").alias("key"), F.lit(0).cast("long").alias("n"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_parts"))).alias("_part"))
    rows = waits.select(F.col("n").alias("size"), F.lit(WAITS).alias("kind"), F.col("id").alias("key"), "n").unionByName(slots.drop("_part"))
    swept = scratch.save(sweep(rows.repartitionByRange("size", "kind", "key").sortWithinPartitions("size", "kind", "key")), f"swept{tag}")
    left = swept.where(F.col("kind") != PLACED).groupBy("part").agg(F.sum((F.col("kind") == GAP).cast("long")).alias("g"), F.sum((F.col("kind") == WAITS).cast("long")).alias("w")).collect()  # one row a partition
    runs = between([(r["part"], r["g"], r["w"]) for r in left])
    took, late = swept.where(F.col("kind") == PLACED).select("id", "seq", "n"), swept.where(F.col("kind") == WAITS)
    if runs:
        known = F.broadcast(swept.sparkSession.createDataFrame(runs, "run long, _gpart int, _gat long, _wpart int, _wat long, _many long"))
        inside = lambda part, at: (F.col("part") == F.col(part)) & (F.col("nth") >= F.col(at)) & (F.col("nth") < F.col(at) + F.col("_many"))
        spare = swept.where(F.col("kind") == GAP).join(known, inside("_gpart", "_gat")).select("run", (F.col("nth") - F.col("_gat")).alias("_k"), F.col("seq").alias("_seq"))
        late = late.join(known, inside("_wpart", "_wat"), "left").select("id", "n", "run", (F.col("nth") - F.col("_wat")).alias("_k"))
        late = scratch.save(late.join(spare, ["run", "_k"], "left").select("id", F.col("_seq").alias("seq"), "n"), f"late{tag}")
        took = took.unionByName(late.where("seq is not null"))
        late = late.where("seq is null")
    # a sequence's gap and what it took in this round meet: no more rows than a sequence has tokens
    own = Window.partitionBy("seq")
    both = took.select("seq", "id", F.col("n").alias("_took"), F.lit(None).cast("long").alias("_free")).unionByName(gaps.select(F.col("id").alias("seq"), F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("_took"), F.col("n").alias("_free")))
    both = both.withColumns({"_had": F.max("_free").over(own), "_all": F.sum("_took").over(own), "_upto": F.sum("_took").over(own.orderBy(F.col("id").asc_nulls_first()))})
    gap = F.col("id").isNull()
    both = both.select(F.when(gap, GAP).otherwise(PLACED).alias("kind"), F.when(gap, F.col("seq")).otherwise(F.col("id")).alias("id"), F.when(gap, F.col("_free") - F.col("_all")).otherwise(F.col("seq")).alias("n"), F.when(~gap, capacity - F.col("_had") + F.col("_upto") - F.col("_took")).alias("off"))
    return both.unionByName(late.select(F.lit(WAITS).alias("kind"), "id", "n", F.lit(None).cast("long").alias("off")))


def open_new(tall: DataFrame, capacity: int) -> DataFrame:
    """(kind, id, n, off): pieces placed in sequences that they open, and the gaps that are left there.

    Each partition fills its sequences with consecutive pieces of the descending order; its last one may have room left,
    which is a gap like any other."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, room, left = 0, 0, 0  # of the sequence that is being filled: how many more pieces, how many tokens

        def told(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["kind", "id", "n", "off"])

        for b in batches:
            rows: list[tuple] = []
            for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not room:
                    if left:
                        rows.append((GAP, seq, left, None))
                    seq, room, left = i, capacity // n, capacity
                rows.append((PLACED, i, seq, capacity - left))
                room, left = room - 1, left - n
            yield told(rows)
        if left:
            yield told([(GAP, seq, left, None)])

    order = [F.desc("n"), F.asc("id")]
    return tall.select("id", "n").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, STATE)


def best_fit(pieces: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """id, sequence_id and offset of pieces (id, n), none longer than ``capacity``; a sequence has the id of its first piece."""
    tall = F.col("n") > capacity // 2
    placed = [pieces.where(tall).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    state = pieces.select(F.when(tall, GAP).otherwise(WAITS).alias("kind"), "id", F.when(tall, F.lit(capacity) - F.col("n")).otherwise(F.col("n")).alias("n"))
    of = lambda table, kind: table.where(F.col("kind") == kind)

    def keep(table: DataFrame) -> None:
        placed.append(of(table, PLACED).select("id", F.col("n").alias("sequence_id"), F.col("off").alias("offset")))

    for k in itertools.count(1):
        own = lambda kind: F.when(F.col("kind") == kind, F.col("n"))
        now = state.agg(F.max(own(WAITS)).alias("most"), F.min(own(WAITS)).alias("least"), F.max(own(GAP)).alias("room")).first()
        if now["most"] is None:
            break
        waits, gaps, most, room = of(state, WAITS).select("id", "n"), of(state, GAP).where(F.col("n") >= now["least"]).select("id", "n"), now["most"], now["room"] or 0
        if most > room:
            above = max(room, most // 2)
            opened = scratch.save(open_new(waits.where(F.col("n") > above), capacity), f"opened{k}")
            keep(opened)
            waits, most = waits.where(F.col("n") <= above), above
            gaps = gaps.unionByName(of(opened, GAP).where(F.col("n") >= now["least"]).select("id", "n"))
        if most < now["least"]:
            break
        state = scratch.save(match(waits, gaps, most, capacity, scratch, str(k)), f"round{k}")
        scratch.drop(f"swept{k}", f"late{k}")
        keep(state)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack(
    spark: SparkSession,
    docs: DataFrame,
    capacity: int = 1024,
    vocabulary: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Reads doc_id and text, so other columns may have any name. A null or empty text is the end id alone; a very long one
    is tokenised whole and cut. Rows that repeat a doc_id are packed each on its own; pieces of equal length take gaps in
    the order of their rows. An empty table gives an empty result; a null doc_id stays null.
    """
    byte_batches(spark)
    scratch = Scratch(spark, "pack")
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = scratch.save(token_pieces(docs, capacity, vocabulary, ranks).withColumn("_id", F.monotonically_increasing_id()), "pieces")
    places = best_fit(pieces.select(F.col("_id").alias("id"), F.col("length").alias("n")), capacity, scratch)
    out = pieces.join(places.withColumnRenamed("id", "_id"), "_id")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
