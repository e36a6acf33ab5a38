"""Approximate nearest neighbours by cosine: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node of the graph. The graph starts from random hyperplane trees: nodes on the same side of all
hyperplanes of a tree share a leaf and take their nearest leaf mates as first neighbours; nodes that find too few there
are linked to the nearest of ``ENTRIES`` fixed nodes, so that none stands alone. Then rounds of NN-descent: every node's
neighbours, and as many of the nodes that count it among theirs, the nearest first, are compared with each other, if one
of a pair is new, and every node keeps its ``degree`` best. The rounds end when few lists still change. A query starts
from its own node and the fixed ones, and repeatedly the best nodes not yet expanded are joined with the graph and their
neighbours compared with the query, until the best ``beam`` nodes of a query are all expanded. The whole beam is then
scored in double precision on the vectors as given.

Graph, vectors and beams are tables throughout. Nodes are dealt to homes of about ``HOME`` nodes, leaf by leaf of one
tree and so near each other; a home's neighbourhoods are compared in one task, which gets the lists as ids and each
vector once, however many lists name it. Leaves larger than a block are dealt to blocks by a hash. Nothing that grows
with the rows is broadcast.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_batches, runs

LEAF, HOME, ENTRIES = 160, 128, 64
#: Neighbourhoods compared at once, and queries of one task.
GROUPS, QUERIES = 64, 8
EDGE = "u long, uh int, v long, vh int, s float, fresh boolean"
#: Edges, and for each node a row without v that has its vector and the last similarity of a full list.
GRAPH = f"{EDGE}, worst float, unit binary"
OPEN = np.float32(-3)  # below any similarity


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id, _vec (array of double) of vectors that have a direction and the usual number of components."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("_id"), vec.alias("_vec")).where(F.col("_id").isNotNull() & F.col("_vec").isNotNull())
    rows = rows.where(fine & F.exists("_vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("_vec").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    return rows.where(F.size("_vec") == (sizes[0]["size"] if sizes else 0))


def _array(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    got = column.to_pylist()
    return np.frombuffer(b"".join(got), "<f4").reshape(len(got), -1)


def closeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine less 1 of all pairs of unit vectors, as half the negative squared distance: in double precision, since the
    cosines of near vectors differ by less than 32 bits hold, and small enough for a 32-bit float once 1 is taken off."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a @ b.T - ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]) / 2).astype(np.float32)


def units(nodes: DataFrame) -> DataFrame:
    """node and its vector at length 1, as the bytes of 32-bit floats."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype("<f4")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["node", "unit"])

    return nodes.select("node", "_vec").mapInArrow(work, "node long, unit binary")


def leaves(nodes: DataFrame, count: int, trees: int, seed: int = 5) -> DataFrame:
    """leaf, node, unit and what else nodes have: each node once a tree."""
    depth = max(0, math.ceil(math.log2(max(1, count) / LEAF * 1.25)))
    rest = [f for f in nodes.schema.fields if f.name not in ("node", "unit")]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            if not b.num_rows:
                continue
            x = _array(b.column(1))
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((trees, depth, x.shape[1])).astype("<f4")
            for t in range(trees):
                side = (x @ planes[t].T > 0).astype(np.int64)
                leaf = side @ (np.int64(1) << np.arange(depth, dtype=np.int64)) * trees + t
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), *b.columns], ["leaf", *b.schema.names])

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rest)
    return nodes.select("node", "unit", *[f.name for f in rest]).mapInArrow(work, f"leaf long, node long, unit binary{more}")


def blocks(rows: DataFrame, scratch: Scratch, tag: str, seed: int) -> DataFrame:
    """The rows with _block: leaves larger than 2 LEAF nodes are dealt to blocks of about that size by a hash of the node."""
    sizes = scratch.save(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("_size")), tag)
    part = F.pmod(F.xxhash64(F.lit(seed), "leaf", "node"), F.ceil(F.col("_size") / (2 * LEAF)))
    return rows.join(sizes, "leaf").withColumn("_block", F.xxhash64("leaf", part)).drop("_size")


def at_home(nodes: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """node, unit, home: nodes of one block share a home."""
    one = blocks(scratch.save(leaves(nodes, count, 1), "homes"), scratch, "home-sizes", 50)
    homes = math.ceil(max(1, count) / HOME)
    return scratch.save(one.select("node", "unit", F.pmod(F.xxhash64("_block"), F.lit(homes)).cast("int").alias("home")), "units-home")


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by the key, cut so that no group is in two of them."""
    held = None
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            k = t[key].to_numpy()
            last = int(np.searchsorted(k, k[-1]))
            if last:
                yield t.slice(0, last)
            held = t.slice(last)
    if held is not None:
        yield held


def edges(u: np.ndarray, uh: np.ndarray, v: np.ndarray, vh: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    cols = [u, uh.astype(np.int32), v, vh.astype(np.int32), s.astype(np.float32), np.ones(len(u), bool)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["u", "uh", "v", "vh", "s", "fresh"])


def best_of(sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of similarities (the last axis) the best: places of rows, of columns, and the similarities. Excluded ones
    are -inf."""
    flat = sims.reshape(-1, sims.shape[-1])
    most = min(most, flat.shape[1])
    at = np.argpartition(-flat, most - 1, axis=1)[:, :most]
    s = np.take_along_axis(flat, at, 1)
    fine = np.isfinite(s)
    return np.broadcast_to(np.arange(len(flat))[:, None], at.shape)[fine], at[fine], s[fine]


def first_graph(tasks: DataFrame, degree: int) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(batches, "_block"):
            x, ids, home = _array(group["unit"]), group["node"].to_numpy(), group["home"].to_numpy()
            if len(ids) > 1:
                sims = closeness(x, x)
                np.fill_diagonal(sims, -np.inf)
                a, b, s = best_of(sims, degree)
                yield edges(ids[a], home[a], ids[b], home[b], s)

    return tasks.select("_block", "node", "home", "unit").repartition("_block").sortWithinPartitions("_block").mapInArrow(work, EDGE)


def keep_best(rows: DataFrame, degree: int) -> DataFrame:
    """Of edges and node rows, each u's best edges, an edge that was there before being fresh no more, and its node row."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "u"):
            node = t["v"].is_null().to_numpy()
            own, t = t.filter(pa.array(node)), t.filter(pa.array(~node))
            u, uh, v, vh, s, fresh = (t[c].to_numpy() for c in ("u", "uh", "v", "vh", "s", "fresh"))
            by = np.lexsort((fresh, v, u))  # the old one of equal edges first
            by = by[np.append(True, (u[by][1:] != u[by][:-1]) | (v[by][1:] != v[by][:-1]))] if len(by) else by
            by = by[np.lexsort((v[by], -s[by], u[by]))]
            ids, first, many = np.unique(u[by], return_index=True, return_counts=True)
            by_rank = np.arange(len(by)) - np.repeat(first, many)
            full = many >= degree
            worst = np.full(len(ids), OPEN, np.float32)
            worst[full] = s[by][first[full] + degree - 1]
            by = by[by_rank < degree]
            empty = pa.nulls(len(by), pa.float32()), pa.nulls(len(by), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c[by]) for c in (u, uh, v, vh, s, fresh)] + [*empty], [f.split()[0] for f in GRAPH.split(", ")])
            mine = own["u"].to_numpy()
            at = np.minimum(np.searchsorted(ids, mine), max(0, len(ids) - 1))
            known = ids[at] == mine if len(ids) else np.zeros(len(mine), bool)
            last = np.full(len(mine), OPEN, np.float32)
            last[known] = worst[at[known]]
            cols = [own["u"], own["uh"], own["v"], own["vh"], own["s"], own["fresh"], pa.array(last), own["unit"]]
            for b in pa.table(cols, [f.split()[0] for f in GRAPH.split(", ")]).combine_chunks().to_batches():
                yield b

    return rows.repartition("u").sortWithinPartitions("u").mapInArrow(work, GRAPH)


def as_edges(rows: DataFrame) -> DataFrame:
    return rows.select("u", "uh", "v", "vh", "s", "fresh", F.lit(None).cast("float").alias("worst"), F.lit(None).cast("binary").alias("unit"))


def as_nodes(nodes: DataFrame) -> DataFrame:
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return nodes.select(F.col("node").alias("u"), F.col("home").alias("uh"), none("long", "v"), none("int", "vh"), none("float", "s"), none("boolean", "fresh"), none("float", "worst"), "unit")


def reverse(graph: DataFrame, degree: int) -> DataFrame:
    """Edges the other way round, the nearest ``degree`` of each node; a rank limit that is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), "u"))
    near = graph.where("v is not null").select("u", "uh", "v", "vh", "s", "fresh").withColumn("_rank", rank).where(F.col("_rank") <= degree)
    return near.select(F.col("v").alias("u"), F.col("vh").alias("uh"), F.col("u").alias("v"), F.col("uh").alias("vh"), "fresh")


def local_joins(graph: DataFrame, degree: int) -> DataFrame:
    """Pairs of a node's neighbours, one of them fresh, that would enter a list; each home keeps its best of each node."""
    lists = graph.where("v is not null").select("u", "uh", "v", "vh", "fresh").unionByName(reverse(graph, degree))
    told = graph.where("v is null").select(F.col("u").alias("member"), F.col("uh").alias("own"), "worst", "unit")
    wanted = lists.select(F.col("v").alias("member"), F.col("uh").alias("home")).repartition("member").distinct()
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    vectors = wanted.join(told, "member").select("home", none("long", "centre"), "member", none("boolean", "fresh"), "own", "worst", "unit")
    ids = lists.select(F.col("uh").alias("home"), F.col("u").alias("centre"), F.col("v").alias("member"), "fresh", none("int", "own"), none("float", "worst"), none("binary", "unit"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(batches, "home"):
            vector = group["centre"].is_null().to_numpy()
            own, group = group.filter(pa.array(vector)), group.filter(pa.array(~vector))
            node = own["member"].to_numpy()
            by = np.argsort(node)
            node, home, worst, x = node[by], own["own"].to_numpy()[by], own["worst"].to_numpy()[by], _array(own["unit"])[by]
            centre, member, fresh = (group[c].to_numpy() for c in ("centre", "member", "fresh"))
            by = np.lexsort((~fresh, member, centre))
            by = by[np.append(True, (centre[by][1:] != centre[by][:-1]) | (member[by][1:] != member[by][:-1]))]
            centre, member, fresh = centre[by], np.searchsorted(node, member[by]), fresh[by]
            _, first, many = np.unique(centre, return_index=True, return_counts=True)
            some = np.add.reduceat(fresh, first) > 0
            first, many = first[some], many[some]
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for k in range(0, len(first), GROUPS):
                f, m = first[k : k + GROUPS], many[k : k + GROUPS]
                inside = np.arange(m.max())[None, :] < m[:, None]
                at = np.where(inside, f[:, None] + np.arange(m.max())[None, :], 0)
                idx, new = member[at], fresh[at]
                y = x[idx].astype(np.float64)
                half = (y * y).sum(axis=2) / 2
                sims = (y @ y.transpose(0, 2, 1) - half[:, :, None] - half[:, None, :]).astype(np.float32)
                bar = worst[idx]
                out = (sims <= bar[:, :, None]) | ~(new[:, :, None] | new[:, None, :]) | ~inside[:, :, None] | ~inside[:, None, :]
                out |= np.eye(m.max(), dtype=bool)[None]
                sims[out] = -np.inf
                a, b, s = best_of(sims, degree)
                g = a // m.max()
                found.append((idx.reshape(-1)[a], idx[g, b], s))
            if not found:
                continue
            a, b, s = (np.concatenate(c) for c in zip(*found))
            _, once = np.unique(a * len(node) + b, return_index=True)
            a, b, s = a[once], b[once], s[once]
            by = np.lexsort((-s, a))
            _, first, many = np.unique(a[by], return_index=True, return_counts=True)
            by = by[np.arange(len(by)) - np.repeat(first, many) < degree]
            a, b, s = a[by], b[by], s[by]
            yield edges(node[a], home[a], node[b], home[b], s)

    rows = vectors.unionByName(ids).repartition("home").sortWithinPartitions("home")
    return rows.mapInArrow(work, EDGE)


def entries_of(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, homes and vectors of the fixed nodes: those ``ENTRIES`` with the smallest hash."""
    got = nodes.orderBy(F.xxhash64(F.lit(5), "node"), "node").limit(ENTRIES).collect()
    x = np.frombuffer(b"".join(r["unit"] for r in got), "<f4").reshape(len(got), -1 if got else 0)
    return np.array([r["node"] for r in got], np.int64), np.array([r["home"] for r in got], np.int32), x


def to_entries(rows: DataFrame, entries: tuple[np.ndarray, np.ndarray, np.ndarray], degree: int) -> DataFrame:
    """Edges from each node (u, uh, unit) to the nearest of the fixed ones."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, homes, x = entries
        for b in batches:
            if b.num_rows:
                u, uh = b.column(0).to_numpy(), b.column(1).to_numpy()
                s = closeness(_array(b.column(2)), x)
                s[u[:, None] == ids[None, :]] = -np.inf
                at, to, s = best_of(s, degree)
                yield edges(u[at], uh[at], ids[to], homes[to], s)

    return rows.select("u", "uh", "unit").mapInArrow(work, EDGE)


def descend(nodes: DataFrame, count: int, entries: tuple[np.ndarray, np.ndarray, np.ndarray], scratch: Scratch, degree: int, trees: int, rounds: int, still: float) -> DataFrame:
    """The neighbour graph: NN-descent until less than ``still`` of all edges are new after a round, or for so many rounds."""
    spread_out = scratch.save(leaves(nodes, count, trees), "leaves")
    first = first_graph(blocks(spread_out, scratch, "leaf-sizes", 51), math.ceil(degree / 2))  # of each tree
    graph = scratch.save(keep_best(as_edges(first).unionByName(as_nodes(nodes)), degree), "graph0")
    scratch.drop("leaves")
    lone = graph.where((F.col("v").isNull()) & (F.col("worst") == float(OPEN)))
    if count > 1 and lone.limit(1).count():
        graph = scratch.save(keep_best(graph.unionByName(as_edges(to_entries(lone, entries, degree))), degree), "graph0-linked")
        scratch.drop("graph0")
    for k in range(1, rounds + 1):
        found = scratch.save(local_joins(graph, degree), f"found{k}")
        old = graph.withColumn("fresh", F.when(F.col("v").isNotNull(), F.lit(False)))
        graph = scratch.save(keep_best(old.unionByName(as_edges(found)), degree), f"graph{k}")
        scratch.drop(f"found{k}", f"graph{k - 1}", *(["graph0-linked"] if k == 1 else []))
        if graph.where("fresh").count() < still * degree * count:
            break
    return graph


BEAM = "task int, q long, unit binary, nodes binary, sims binary, done binary, going boolean"


def beams(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (task, q, unit, nodes, sims, done) of arrays."""
    packed = [(t, q, unit, n.astype("<i8").tobytes(), s.astype("<f4").tobytes(), d.tobytes(), not d.all()) for t, q, unit, n, s, d in rows]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*packed)) or [()] * 7, kinds)], [f.split()[0] for f in BEAM.split(", ")])


def beam_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["nodes"], "<i8"), np.frombuffer(row["sims"], "<f4"), np.frombuffer(row["done"], bool)


def ahead(sims: np.ndarray, done: np.ndarray, expand: int) -> np.ndarray:
    """Places of the best nodes of a beam that are to be expanded; the beam is in order."""
    return np.flatnonzero(~done)[:expand]


def begin(asked: DataFrame, entries: tuple[np.ndarray, np.ndarray, np.ndarray], beam: int) -> DataFrame:
    """The first beam of each query (task, q, unit): its own node and the fixed ones."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, _, x = entries
        for b in batches:
            if b.num_rows:
                sims, rows = closeness(_array(b.column(2)), x), []
                for k, (t, q, unit) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                    other = ids != q
                    node, s = np.append(q, ids[other]), np.append(np.float32(0), sims[k][other])
                    by = np.argsort(-s, kind="stable")[:beam]
                    rows.append((t, q, unit, node[by], s[by], np.zeros(len(by), bool)))
                yield beams(rows)

    return asked.select("task", "q", "unit").mapInArrow(work, BEAM)


def search(graph: DataFrame, starts: DataFrame, many: int, entries: tuple[np.ndarray, np.ndarray, np.ndarray], scratch: Scratch, degree: int, beam: int, expand: int) -> DataFrame:
    """q, node: the best nodes found for each of the starts (q), ``many`` nodes of the graph. Every hop expands a node of each
    query that has one left, so the hops end by themselves."""
    nodes = graph.where("v is null").select(F.col("u").alias("node"), F.col("uh").alias("home"), "unit")
    both = graph.where("v is not null").select("u", "v").unionByName(reverse(graph, degree).select("u", "v"))
    links = scratch.save(both.groupBy(F.col("u").alias("node")).agg(F.collect_set("v").alias("nbrs")), "links")  # at most two lists a node
    tasks = math.ceil(max(1, many) / QUERIES)
    asked = starts.join(nodes.withColumnRenamed("node", "q"), "q").select(F.pmod(F.xxhash64("home"), F.lit(tasks)).cast("int").alias("task"), "q", "unit")
    state = scratch.save(begin(asked, entries, beam), "beam0")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    packed = ["unit", "nodes", "sims", "done"]

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for row in b.to_pylist():
                node, s, done = beam_of(row)
                out += [(row["task"], row["q"], n) for n in node[ahead(s, done, expand)].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, (pa.int32(), pa.int64(), pa.int64()))], ["task", "q", "node"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, group in runs(batches, "task"):
            kind = group["kind"].to_numpy()
            vector, lists, own = (group.filter(pa.array(kind == k)) for k in (0, 1, 2))
            node = vector["id"].to_numpy()
            by = np.argsort(node)
            node = node[by]
            x = _array(vector["unit"])[by] if len(node) else None
            reached: dict[int, list[np.ndarray]] = {}
            for q, nbrs in zip(lists["id"].to_pylist(), lists["nbrs"]):
                reached.setdefault(q, []).append(nbrs.values.to_numpy())
            rows = []
            for row in own.select(["id", *packed]).to_pylist():
                q = row["id"]
                n, s, done = beam_of(row)
                done = done.copy()
                done[ahead(s, done, expand)] = True
                new = np.setdiff1d(np.concatenate(reached.get(q, [np.zeros(0, np.int64)])), n)
                if len(new):
                    t = closeness(x[np.searchsorted(node, new)], np.frombuffer(row["unit"], "<f4")[None, :])[:, 0]
                    n, s, done = np.append(n, new), np.append(s, t), np.append(done, np.zeros(len(new), bool))
                    by = np.lexsort((n, -s))[:beam]
                    n, s, done = n[by], s[by], done[by]
                rows.append((task, q, row["unit"], n, s, done))
            if rows:
                yield beams(rows)

    finished = []
    for k in itertools.count(1):
        finished.append(state.where("not going"))
        state = state.where("going")
        if not state.limit(1).count():
            break
        steps = state.select("task", "q", *packed).mapInArrow(pick, "task int, q long, node long")
        steps = scratch.save(steps.join(links, "node").select("task", "q", "nbrs"), f"steps{k}")
        wanted = steps.select("task", F.explode("nbrs").alias("node")).repartition("node").distinct()
        vectors = wanted.join(nodes.drop("home"), "node").select("task", F.lit(0).alias("kind"), F.col("node").alias("id"), none("array<long>", "nbrs"), "unit", *[none("binary", c) for c in packed[1:]])
        lists = steps.select("task", F.lit(1).alias("kind"), F.col("q").alias("id"), "nbrs", *[none("binary", c) for c in packed])
        own = state.select("task", F.lit(2).alias("kind"), F.col("q").alias("id"), none("array<long>", "nbrs"), *packed)
        rows = vectors.unionByName(lists).unionByName(own).repartition("task").sortWithinPartitions("task")
        state = scratch.save(rows.mapInArrow(compare, BEAM), f"beam{k}")
        scratch.drop(f"steps{k}")

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = np.frombuffer(row["nodes"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["q"])), pa.array(n)], ["q", "node"])

    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select("q", "nodes").mapInArrow(spell, "q long, node long")


def dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)


def nearest(
    spark: SparkSession, rows: DataFrame, every: int = 50, most: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    degree: int = 28, trees: int = 6, rounds: int = 12, still: float = 0.02, beam: int = 16,
) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by ``every`` the ``most`` nearest other rows.

    Score is the cosine in double precision on the vectors as given. Nearest first, ties to the smaller id. Every query has
    ``most`` rows, or as many as there are candidates; which they are is approximate, as the graph is: ``rounds`` bounds
    the work on it. Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a
    null id or with another number of components than most rows have; vectors of any length serve. Equal vectors are found
    through their node: its ``most`` + 1 smallest ids stand for all, since no answer can hold more. A query keeps ``beam``
    nodes for each doubling of the number of nodes, and expands a fifth of them a hop. Rows that repeat an id count as one
    if their vectors agree, and as several with that id if not. Other columns are not read, so they may have any name. An
    empty table gives an empty result.
    """
    byte_batches(spark)
    scratch = Scratch(spark, "near")
    given = scratch.save(usable(rows, id_col, vector_col).dropDuplicates(["_id", "_vec"]).withColumn("_key", F.xxhash64("_vec")), "given")
    first = Window.partitionBy("_key").orderBy("_id")
    members = scratch.save(given.select("_key", "_id").withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= most + 1), "members")
    vectors = given.groupBy(F.col("_key").alias("node")).agg(F.first("_vec").alias("_vec"))
    vectors = scratch.save(vectors.withColumn("_norm", F.sqrt(dot("_vec", "_vec"))), "vectors")
    units_of = scratch.save(units(vectors), "units")
    count = units_of.count()
    nodes = at_home(units_of, count, scratch)
    entries = entries_of(nodes)
    graph = descend(nodes, count, entries, scratch, degree, trees, rounds, still)
    wide = max(2 * degree, round(beam * math.log2(count + 1)))
    queries = scratch.save(given.where(F.pmod("_id", F.lit(every)) == 0).select(F.col("_id").alias("query_id"), F.col("_key").alias("q")), "queries")
    starts = scratch.save(queries.select("q").distinct(), "starts")
    found = search(graph, starts, starts.count(), entries, scratch, degree, wide, max(1, wide // 5))
    asked = starts.join(vectors.select(F.col("node").alias("q"), F.col("_vec").alias("_b"), F.col("_norm").alias("_bn")), "q")
    scored = found.join(vectors, "node").join(asked, "q")
    scored = scratch.save(scored.select("q", "node", (dot("_b", "_vec") / (F.col("_bn") * F.col("_norm"))).alias("score")), "scored")
    pairs = queries.join(scored, "q").join(members.select(F.col("_key").alias("node"), F.col("_id").alias("vec_id")), "node").where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= most)
