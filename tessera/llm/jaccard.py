"""Similarity join of documents on the Jaccard similarity of their word n-gram sets, by chosen paths.

Every text becomes its set of hashed n-grams, and every distinct set a sketch of ``TOKENS`` minima. Sets agree in a
sketch position with probability equal to their similarity, so positions with their values serve as tokens of sets of
one size. A run starts with all sets at one node; a node splits on sampled tokens (each with probability
1 / (threshold * TOKENS), a fixed function of the node's path) and each set goes to the children of its sampled tokens.
Nodes of one set die, small ones are compared by brute force on sketches, large ones split again; those that are still
large after ``DEPTH`` splits hold truly similar sets and are compared in pairs of blocks. Runs repeat until a pair at
the threshold is met with the target recall: a pair shares a node ``d`` splits deep as a branching process with mean
one child survives. At the roots all sets share one draw, so the positions that the roots really draw are counted.

Sketches only nominate: nominated sets are joined to components, and inside each component pairs are checked exactly on
the whole sets, in pairs of blocks of bounded size. A component of more than one block is cut by set size first, by
factors of the threshold, since sets that are linked lie in one class of sizes or in neighbouring ones. Links are counted
there, and edges to the smallest set of each linked group give the classes. Copies are one set throughout; pairs never
leave a task. The work that remains is quadratic in the number of different sets of one component and of like size,
spread over blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, runs, shingles, byte_batches, spread, text_key, wrapped
from .graph import components, stars

TOKENS, DEPTH, SMALL, BLOCK = 128, 3, 256, 256
#: Standard deviations below the threshold from which a sketch nominates a pair.
SLACK = 4.0
COLUMNS = 8192


def chance(depth: int) -> float:
    """That a pair at the threshold shares a node so many splits deep in one run."""
    dead = 0.0
    for _ in range(depth):
        dead = math.exp(dead - 1)
    return 1 - dead


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs that the recall would take if each pair's draws at the roots were its own; ``roots_for`` counts the real ones."""
    return math.ceil(math.log(1 - recall) / math.log(1 - chance(depth)))


def drawn_at(paths: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The mixed value of each sketch position under each path, and whether the position is drawn there."""
    place = _mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mixed = _mix(paths[:, None] ^ place)
    return mixed, mixed < np.uint64(int((1 << 64) / (threshold * TOKENS)))


def nominates_at(threshold: float) -> float:
    """The share of agreeing sketch positions from which a pair is nominated."""
    return threshold - SLACK * math.sqrt(threshold * (1 - threshold) / TOKENS)


def missed(times: np.ndarray, threshold: float, depth: int = DEPTH) -> float:
    """That a pair at the threshold, all of whose nodes are large, is not nominated when the roots draw each sketch
    position so many times.

    All sets share a root's draws, so those are counted as they are, and only the draws below are random. A pair whose
    sketches agree in ``a`` positions goes on from a shared node to a mean of a / (threshold * TOKENS) shared children."""
    agree = np.arange(TOKENS + 1)
    dead = np.zeros(TOKENS + 1)
    for _ in range(depth - 1):
        dead = (1 - (1 - dead) / (threshold * TOKENS)) ** agree
    dead[agree < nominates_at(threshold) * TOKENS] = 1.0
    ways = np.zeros((TOKENS + 1, TOKENS + 1))  # for each a: the weight of meeting nowhere, by agreeing positions so far
    ways[:, 0] = 1.0
    for n in times:
        met = threshold * ways * (dead ** int(n))[:, None]
        ways *= 1 - threshold
        ways[:, 1:] += met[:, :-1]
    return float(np.trace(ways))


def roots_for(threshold: float, recall: float, depth: int = DEPTH) -> np.ndarray:
    """Paths of the roots, all of which draw some position, as many as bring ``missed`` down to 1 - recall.

    A pair that the sketches themselves miss no root can meet; if that alone is more, the roots end when they gain no more."""
    roots, times, floor = [], np.zeros(TOKENS, np.int64), missed(np.full(TOKENS, 64), threshold, depth)
    for k in range(1, 64 * TOKENS):
        root = _mix(np.array([k], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        drawn = drawn_at(root, threshold)[1][0]
        if drawn.any():
            roots.append(root)
            times += drawn
            if missed(times, threshold, depth) <= max(1 - recall, 1.05 * floor):
                break
    return np.concatenate(roots)


class Sets:
    """A text's sorted n-gram hashes, the key of that set, and its sketch."""

    def __init__(self, width: int):
        self.width, self.words = width, WordHashes()
        rng = np.random.default_rng(4)
        self.times = rng.integers(0, 1 << 32, TOKENS, dtype=np.uint32) | np.uint32(1)
        self.plus = rng.integers(0, 1 << 32, TOKENS, dtype=np.uint32)

    def set_of(self, text: str) -> np.ndarray:
        return np.unique(shingles(self.words.of(text.split()), self.width))

    @staticmethod
    def key(grams: np.ndarray) -> int:
        return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)

    def sketch(self, grams: np.ndarray) -> bytes:
        out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
        folded = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
        for k in range(0, len(folded), 1024):
            x = folded[k : k + 1024, None] * self.times + self.plus
            x ^= x >> np.uint32(16)
            np.minimum(out, (x * np.uint32(0x7FEB352D)).min(axis=0), out=out)
        return out.tobytes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def children(paths: np.ndarray, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row (a path and its set's sketch) the row numbers and paths of its children."""
    mixed, drawn = drawn_at(paths, threshold)
    row, at = np.nonzero(drawn)
    return row, _mix(mixed[row, at] ^ (sketches[row, at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def describe(docs: DataFrame, width: int) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(width)
        for b in batches:
            keys, sketches = [], []
            for t in b.column(2):
                text = t.as_py()
                grams = None if text is None else sets.set_of(text)
                keys.append(None if text is None else sets.key(grams))
                sketches.append(None if text is None else sets.sketch(grams))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "_row", "_set", "_sketch"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key("doc_id", "text"), F.col("text").cast("string"))
    return spread(rows).mapInArrow(work, "doc_id long, _row long, _set long, _sketch binary")


def split(rows: DataFrame, threshold: float) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, paths = children(b.column(1).to_numpy().view(np.uint64), _matrix(b.column(2)), threshold)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(paths.view(np.int64))], ["_set", "_path"])

    return rows.select("_set", "_path", "_sketch").mapInArrow(work, "_set long, _path long")


def start(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    roots = roots_for(threshold, recall)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sketches = _matrix(b.column(1))
                for root in roots:  # all sets stand at the root, so the same positions are drawn for all
                    row, paths = children(np.full(len(sketches), root), sketches, threshold)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(paths.view(np.int64))], ["_set", "_path"])

    return sets.select("_set", "_sketch").mapInArrow(work, "_set long, _path long")


def nominate(rows: DataFrame, threshold: float) -> DataFrame:
    """Of rows (_task, _side, _set, _sketch) edges (a, b) that join the sets whose sketches agree enough, each to the smallest.

    A task's sides 0 and 1 are two blocks of one large node: only pairs across are compared, and within a side none.
    Without a side 1 all pairs are."""
    least = nominates_at(threshold)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(batches, "_task"):
            ids, side, x = group["_set"].to_numpy(), group["_side"].to_numpy(), _matrix(group["_sketch"])
            near = np.stack([(x == v).mean(axis=1, dtype=np.float32) >= least for v in x]) if len(x) else np.zeros((0, 0), bool)
            if side.any():
                near &= side[:, None] != side[None, :]
            a, b = stars(near, ids)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return spread_tasks(rows).mapInArrow(work, "a long, b long")


def spread_tasks(rows: DataFrame) -> DataFrame:
    return rows.repartition("_task").sortWithinPartitions("_task")


def in_blocks(rows: DataFrame, node: str, size: str, keep: list[str], block: int = BLOCK) -> DataFrame:
    """_task, _side and ``keep``: a node of up to ``block`` rows is one task; a larger one is cut into blocks by a hash of the
    set, with a task for each block and each pair of blocks."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumns({"_blocks": blocks, "_own": F.pmod(F.xxhash64(F.lit(44), "_set"), blocks.cast("long")).cast("int")})
    others = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: F.struct(F.least(k, "_own").alias("lo"), F.greatest(k, "_own").alias("hi")))
    rows = rows.withColumn("_pair", F.explode(others))
    task = F.xxhash64(node, "_pair.lo", "_pair.hi")
    side = ((F.col("_pair.lo") != F.col("_pair.hi")) & (F.col("_own") == F.col("_pair.hi"))).cast("int")
    return rows.select(task.alias("_task"), side.alias("_side"), *keep)


def in_size_classes(whole: DataFrame, scratch: Scratch, threshold: float, keep: list[str], size: Column, block: int = BLOCK) -> DataFrame:
    """``in_blocks`` of components (_label): those that one block holds as they are, others by classes of ``size``, with
    tasks for the blocks of each class and for pairs of blocks of neighbouring classes."""
    whole = whole.join(scratch.save(whole.groupBy("_label").agg(F.count(F.lit(1)).alias("_size")), "label-sizes"), "_label")
    few = in_blocks(whole.where(F.col("_size") <= block), "_label", "_size", keep, block)
    many = whole.where(F.col("_size") > block).drop("_size").withColumn("_class", F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int"))
    sizes = scratch.save(many.groupBy("_label", "_class").agg(F.count(F.lit(1)).alias("_size")), "class-sizes")
    for name, step in (("_below", 1), ("_above", -1)):
        beside = sizes.select("_label", (F.col("_class") + step).alias("_class"), F.ceil(F.col("_size") / block).cast("int").alias(name))
        many = many.join(beside, ["_label", "_class"], "left")
    many = many.join(sizes, ["_label", "_class"])
    own = F.pmod(F.xxhash64(F.lit(44), "_set"), F.ceil(F.col("_size") / block).cast("long")).cast("int")
    node = F.xxhash64("_label", "_class")
    same = in_blocks(many.withColumn("_node", node), "_node", "_size", keep, block)
    out = few.unionByName(same)
    for name, side in (("_below", 1), ("_above", 0)):
        across = many.where(F.col(name).isNotNull()).withColumns({"_own": own, "_other": F.explode(F.sequence(F.lit(0), F.col(name) - 1))})
        lo, hi = ("_other", "_own") if side else ("_own", "_other")
        task = F.xxhash64("_label", F.col("_class") - side, F.lit("across"), lo, hi)
        out = out.unionByName(across.select(task.alias("_task"), F.lit(side).alias("_side"), *keep))
    return out


def candidates(sets: DataFrame, scratch: Scratch, threshold: float, recall: float) -> DataFrame:
    """Edges between sets that the runs have met in one node and whose sketches agree enough."""
    state = scratch.save(start(sets, threshold, recall), "state1")
    edges = []
    for depth in range(1, DEPTH + 1):
        # written, so that adaptive execution can split a path that many sets share
        sizes = scratch.save(state.groupBy("_path").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1"), f"sizes{depth}")
        alive = scratch.save(state.join(sizes, "_path"), f"alive{depth}")
        scratch.drop(f"state{depth}", f"sizes{depth}")
        ends = alive.where(F.col("_size") <= SMALL) if depth < DEPTH else alive
        told = in_blocks(ends, "_path", "_size", ["_set"]).join(sets.select("_set", "_sketch"), "_set")
        edges.append(scratch.save(nominate(told, threshold), f"met{depth}"))
        if depth < DEPTH:
            more = alive.where(F.col("_size") > SMALL).select("_set", "_path")
            state = scratch.save(split(more.join(sets.select("_set", "_sketch"), "_set"), threshold).distinct(), f"state{depth + 1}")
        scratch.drop(f"alive{depth}")
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, from incidence matrices of some thousand n-grams at a time."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # n-grams of one set only meet nothing
    shared = count[gram] > 1
    owner, gram = owner[shared], number[gram[shared]]
    by = np.argsort(gram, kind="stable")
    owner, gram = owner[by], gram[by]
    for low in range(0, int(gram[-1]) + 1 if len(gram) else 0, COLUMNS):
        lo, hi = np.searchsorted(gram, [low, low + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, int(gram[-1]) + 1 - low)), np.float32)
        x[owner[lo:hi], gram[lo:hi] - low] = 1
        out += x @ x.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def verify(rows: DataFrame, threshold: float) -> DataFrame:
    """Of rows (_task, _side, _set, _copies, _grams): a, b edges that join linked sets, each to the smallest, and rows with b
    null and the number of documents that a task's partners stand for."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(batches, "_task"):
            ids, side, copies = (group[c].to_numpy() for c in ("_set", "_side", "_copies"))
            sets = [np.frombuffer(g, np.uint64) for g in group["_grams"].to_pylist()]
            size = np.array([len(s) for s in sets], np.float64)
            both = overlaps(sets).astype(np.float64)
            near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            near &= size[:, None] + size[None, :] > 0
            np.fill_diagonal(near, False)
            if side.any():
                near &= side[:, None] != side[None, :]
            links = near @ copies
            some = np.flatnonzero(links)
            if len(some):
                a, b = stars(near, ids)
                ends = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b, pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], a])), ends, pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]).astype(np.int64))], ["a", "b", "links"])

    return spread_tasks(rows).mapInArrow(work, "a long, b long, links long")


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """_set, _copies, _label, _grams of the wanted sets (_row, _set, _copies, _label), from the whole text of one document each."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(width)
        for b in batches:
            grams = [sets.set_of(t.as_py()).tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(grams, pa.binary())], ["_set", "_copies", "_label", "_grams"])

    rows = docs.where(F.col("text").isNotNull()).select(text_key("doc_id", "text").alias("_row"), F.col("text").cast("string").alias("_text"))
    rows = rows.join(wanted, "_row").select("_set", "_copies", "_label", "_text")
    return rows.mapInArrow(work, "_set long, _copies long, _label long, _grams binary").dropDuplicates(["_set"])


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id among the documents it is linked to, directly or
    through others) and links (the number of other documents with a similarity of ``threshold`` or more; copies count).

    Words are what white space separates. A text of fewer words than ``width`` has its whole self as its one n-gram;
    texts without words are copies of each other; a very long one is compared whole. A null text is linked to nothing and
    is its own class. Repeated rows are copies. Null ids never name a class that has others; of ids the smallest names
    it. Columns but doc_id and text are not read, so they may have any name; an empty table gives an empty result. Hashes
    have 64 bits: sets are told apart by them, as are n-grams.
    """
    return classes(spark, docs, threshold, width, recall).select("doc_id", "class_id", "links")


def classes(spark: SparkSession, docs: DataFrame, threshold: float, width: int, recall: float) -> DataFrame:
    """``near_duplicates`` with _row, the key of a row by id and text, and _class, a key of its class (null for null texts)."""
    byte_batches(spark)
    scratch = Scratch(spark, "jaccard")
    told = scratch.save(describe(docs, width), "told")
    sets = told.where(F.col("_set").isNotNull()).groupBy("_set").agg(F.first("_sketch").alias("_sketch"), F.min("doc_id").alias("_first"), F.min("_row").alias("_row"), F.count(F.lit(1)).alias("_copies"))
    sets = scratch.save(sets, "sets")
    members = scratch.save(told.drop("_sketch"), "members")
    scratch.drop("told")
    groups = scratch.save(components(candidates(sets, scratch, threshold, recall), scratch, "met"), "groups")
    wanted = sets.join(groups.select(F.col("node").alias("_set"), F.col("label").alias("_label")), "_set").select("_row", "_set", "_copies", "_label")
    whole = scratch.save(whole_sets(docs, wanted, width), "whole")
    found = scratch.save(verify(in_size_classes(whole, scratch, threshold, ["_set", "_copies", "_grams"], F.octet_length("_grams")), threshold), "found")
    labels = components(found.where("b is not null").select("a", "b"), scratch, "linked").select(F.col("node").alias("_set"), F.col("label").alias("_class"))
    links = found.where("b is null").groupBy(F.col("a").alias("_set")).agg(F.sum("links").alias("_links"))
    named = sets.select("_set", "_first", "_copies").join(labels, "_set", "left").join(links, "_set", "left")
    named = scratch.save(named.withColumn("_class", F.coalesce("_class", "_set")), "named")
    ids = named.groupBy("_class").agg(F.min("_first").alias("class_id"))
    named = named.join(ids, "_class").select("_set", "_class", "class_id", (F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))).alias("links"))
    named = scratch.save(named, "classes")
    scratch.drop("whole", "sets", "met1", "met2", "met3")
    out = members.join(named, "_set", "left")
    own = F.col("_set").isNull()
    return out.select("doc_id", "_row", "_class", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def one_of_each(spark: SparkSession, docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999) -> DataFrame:
    """The rows of ``docs`` without all but one of each class: the one with the smallest doc_id, then the smallest key.

    Rows that agree in id and text are one document; one of them stays. Rows with a null text all stay.
    """
    scratch = Scratch(spark, "kept")
    some = docs.where(F.col("text").isNotNull())
    rows = scratch.save(classes(spark, some, threshold, width, recall), "rows")
    first = rows.groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_first")).select("_first._row")
    gone = scratch.save(rows.select("_row").distinct().join(first, "_row", "left_anti"), "gone")
    again = scratch.save(rows.groupBy("_row").count().where("count > 1").select("_row"), "again")
    keyed = some.select(wrapped(some), text_key("doc_id", "text").alias("_row"))
    kept = keyed.join(gone, "_row", "left_anti")
    if again.limit(1).count():  # repeated rows share their key: they are thinned on their own
        kept = kept.join(again, "_row", "left_anti").unionByName(kept.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return kept.select("_all.*").unionByName(docs.where(F.col("text").isNull()))
