"""Queries on search, graphs, hierarchies, places, vectors and id sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as sc
from tessera.operators import graphs as gr
from tessera.operators import search as se
from tessera.operators import spatial as sp
from tessera.operators import vectors as ve
from tessera.operators.filters import Clause, filtered

from .registry import query
from .tables import load

TOKENS = "(SELECT p_partkey, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'))) AS t FROM part)"


def _search(name: str, kind: str, text: str, where: str):
    @query(name, f"SELECT DISTINCT p_partkey FROM {TOKENS} WHERE {where}")
    def _(s, d):
        return se.search(load(s, d, "part"), "p_partkey", ["p_name", "p_type"], text, kind)


_search("search_inverted", "inverted", "blu, economy zzz get", "starts_with(t, 'blu') OR t = 'economy' OR ends_with(t, 'get')")
_search("search_prefix_tree", "prefix", "wid sm", "starts_with(t, 'wid') OR t = 'sm'")
_search("search_suffix", "suffix", "get", "ends_with(t, 'get')")
_search("search_btree", "btree", "r", "starts_with(t, 'r')")
_search("search_treap", "treap", "idg olt", "contains(t, 'idg') OR contains(t, 'olt')")
_search("search_bloom", "bloom", "econ", "contains(t, 'econ')")


@query("search_dispatch", f"SELECT DISTINCT p_partkey FROM {TOKENS} WHERE t = 'red'")
def _(s, d):
    return se.search(load(s, d, "part"), "p_partkey", ["p_name", "p_type"], "RED")


@query("set_intersect_ids", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND p_size < 20")
def _(s, d):
    part = load(s, d, "part")
    return se.all_of(part, "p_partkey", se.search(part, "p_partkey", ["p_name"], "ring", "treap"), filtered(part, Clause("p_size", "<", 20))).select("p_partkey", "p_name")


@query("set_union_ids", "SELECT p_partkey FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'bolt')")
def _(s, d):
    part = load(s, d, "part")
    return se.any_of("p_partkey", *[se.search(part, "p_partkey", ["p_name"], w, "treap") for w in ("ring", "bolt")])


@query(
    "set_changes",
    """SELECT s_suppkey, 'bal' AS field, CAST(CAST(s_acctbal AS INTEGER) AS VARCHAR) AS old_value, CAST(CAST(s_acctbal AS INTEGER) + 1 AS VARCHAR) AS new_value FROM (SELECT s_suppkey, floor(s_acctbal) AS s_acctbal FROM supplier) WHERE s_suppkey % 3 = 0""",
)
def _(s, d):
    from tessera.operators.changes import diff

    a = load(s, d, "supplier").select("s_suppkey", F.floor("s_acctbal").cast("int").alias("bal"), "s_name")
    return diff(a, a.withColumn("bal", F.when(F.col("s_suppkey") % 3 == 0, F.col("bal") + 1).otherwise(F.col("bal"))), "s_suppkey", ["bal", "s_name"])


def _edges(s, d):
    c = load(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("customer").alias("kind"))
    n = load(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("nation").alias("kind"))
    return c.unionByName(n)


EDGES = "(SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'customer' AS kind FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation' FROM nation)"


@query("graph_traverse", f"WITH RECURSIVE t AS (SELECT 'c7' AS node, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM t JOIN {EDGES} ON src = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM t GROUP BY 1")
def _(s, d):
    return gr.traverse(_edges(s, d), s.createDataFrame([("c7",)], "node string"), 3)


@query("graph_neighbours", f"SELECT DISTINCT dst AS node FROM {EDGES} WHERE src = 'n3'")
def _(s, d):
    return gr.neighbours(_edges(s, d), "n3")


@query("graph_reverse", f"SELECT DISTINCT src AS node FROM {EDGES} WHERE dst = 'n3' AND kind = 'customer'")
def _(s, d):
    return gr.reverse_neighbours(_edges(s, d), "n3", "customer")


@query("hier_tree", "WITH RECURSIVE t AS (SELECT p_partkey AS key, 0 AS depth, CAST(p_partkey AS VARCHAR) AS path FROM part WHERE p_partkey = 0 UNION ALL SELECT p_partkey, depth + 1, path || ' / ' || p_partkey FROM part JOIN t ON p_partkey // 10 = key WHERE p_partkey <> 0) SELECT * FROM t")
def _(s, d):
    df = load(s, d, "part").withColumn("up", F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 10)))
    return gr.tree(df, "p_partkey", "up", F.col("p_partkey"))


@query("hier_org", "SELECT depth, count(*) AS n FROM (WITH RECURSIVE t AS (SELECT s_suppkey AS key, 0 AS depth FROM supplier WHERE s_suppkey = 0 UNION ALL SELECT s_suppkey, depth + 1 FROM supplier JOIN t ON (s_suppkey - 1) // 4 = key WHERE s_suppkey > 0) SELECT * FROM t) GROUP BY 1")
def _(s, d):
    df = load(s, d, "supplier").withColumn("up", F.when(F.col("s_suppkey") > 0, F.floor((F.col("s_suppkey") - 1) / 4)))
    return gr.tree(df, "s_suppkey", "up", F.col("s_name")).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query(
    "perm_closure",
    """SELECT DISTINCT c_custkey AS who, code FROM customer JOIN nation ON c_nationkey = n_nationkey, (SELECT unnest(['read', 'write']) AS code, unnest([1, 0]) AS regions) k
    WHERE (code = 'read') OR n_nationkey % 2 = 0""",
)
def _(s, d):
    members = load(s, d, "customer").select(F.col("c_custkey").alias("who"), F.concat(F.lit("n"), "c_nationkey").alias("grp"))
    nested = load(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("grp"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    regions = load(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("grp"), F.lit("read, ").alias("codes"))
    even = load(s, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("grp"), F.lit(" write").alias("codes"))
    return gr.permissions(members, nested, regions.unionByName(even))


PLACES = "(SELECT c_custkey AS k, (c_custkey * 37 % 18000) / 100.0 - 90 AS lat, (c_custkey * 91 % 36000) / 100.0 - 180 AS lng FROM customer)"
KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - {0}) / 2), 2) + cos(radians({0})) * cos(radians(lat)) * pow(sin(radians(lng - {1}) / 2), 2))))"


def _places(s, d):
    k = F.col("c_custkey")
    return load(s, d, "customer").select(k.alias("k"), (k * 37 % 18000 / 100.0 - 90).alias("lat"), (k * 91 % 36000 / 100.0 - 180).alias("lng"))


@query("spatial_bbox", f"SELECT * FROM {PLACES} WHERE lat BETWEEN -60 AND 10 AND lng BETWEEN -150 AND 0")
def _(s, d):
    return sp.in_box(_places(s, d), -60, -150, 10, 0)


@query("spatial_radius", f"SELECT k, round({KM.format(-80.0, -160.0)}, 4) AS km FROM {PLACES} WHERE {KM.format(-80.0, -160.0)} <= 900")
def _(s, d):
    return sp.in_radius(_places(s, d), (-80.0, -160.0), 900).select("k", F.round("distance_km", 4).alias("km"))


@query("spatial_knn", f"SELECT k, round({KM.format(-70.5, -100.25)}, 4) AS km FROM {PLACES} ORDER BY {KM.format(-70.5, -100.25)}, k LIMIT 12")
def _(s, d):
    return sp.nearest(_places(s, d), (-70.5, -100.25), 12, "k").select("k", F.round("distance_km", 4).alias("km"))


@query("spatial_token", f"SELECT *, 'box' AS form FROM {PLACES} WHERE lat BETWEEN -89 AND -50 AND lng BETWEEN -170 AND -20 UNION ALL SELECT *, 'radius' FROM {PLACES} WHERE {KM.format(-70.0, -120.0)} <= 1500")
def _(s, d):
    box = sp.by_token(_places(s, d), "-89,-170,-50,-20").withColumn("form", F.lit("box"))
    return box.unionByName(sp.by_token(_places(s, d), "-70,-120,1500").withColumn("form", F.lit("radius")))


@query("pipeline_steps", "SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'gear')) AND p_size = 11 AND p_partkey // 10 IN (0, 1, 2, 3, 4, 5)")
def _(s, d):
    part = load(s, d, "part")
    edges = part.select(F.floor(F.col("p_partkey") / 10).alias("src"), F.col("p_partkey").alias("dst"))
    near = gr.traverse(edges, s.createDataFrame([(k,) for k in range(6)], "node long"), 1).where("depth = 1 or node < 10").select(F.col("node").alias("p_partkey"))
    text = se.search(part, "p_partkey", ["p_name"], "ring gear", "treap")
    return se.all_of(part, "p_partkey", text, near, filtered(part, Clause("p_size", "eq", 11))).select("p_partkey").where(F.floor(F.col("p_partkey") / 10) < 6)


def _distance(name: str, f, sql: str):
    @query(name, f"SELECT b.vec_id AS vec_id, round({sql}, 6) AS v FROM embeddings a, embeddings b WHERE a.vec_id = 0")
    def _(s, d):
        e = load(s, d, "embeddings")
        one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
        return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(f(F.col("q"), F.col("embedding")), 6).alias("v"))


_D = "CAST({0}.embedding AS DOUBLE[])"
_A, _B = _D.format("a"), _D.format("b")
_distance("vec_cosine", sc.cosine_distance, f"1 - list_cosine_similarity({_A}, {_B})")
_distance("vec_dot", sc.dot_distance, f"-list_inner_product({_A}, {_B})")
_distance("vec_l2", sc.l2_distance, f"list_distance({_A}, {_B})")


@query("vec_search", f"SELECT b.vec_id AS vec_id, round(1 - list_cosine_similarity({_A}, {_B}), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 3 ORDER BY 1 - list_cosine_similarity({_A}, {_B}), b.vec_id LIMIT 10")
def _(s, d):
    e = load(s, d, "embeddings")
    asked = e.where("vec_id = 3").first()["embedding"]  # one vector, the query
    return ve.search(e, "vec_id", "embedding", asked, 10).select("vec_id", F.round("distance", 6).alias("distance"))


def _vector_log(s, d, *more):
    e = load(s, d, "embeddings").select("vec_id", "label")
    log = e.select("vec_id", F.lit("upsert").alias("op"), F.lit(1).alias("seq"), "label")
    for seq, (op, where, grown) in enumerate(more, 2):
        log = log.unionByName(e.where(where).select("vec_id", F.lit(op).alias("op"), F.lit(seq).alias("seq"), (F.col("label") + grown).alias("label")))
    return log


@query("vec_upsert", "SELECT vec_id, label + CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 0 END AS label FROM embeddings")
def _(s, d):
    return ve.live(_vector_log(s, d, ("upsert", "vec_id % 10 = 0", 1)), "vec_id", "seq").select("vec_id", "label")


@query("vec_delete", "SELECT vec_id, label FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id, label + 1 FROM embeddings WHERE vec_id % 10 = 0")
def _(s, d):
    return ve.live(_vector_log(s, d, ("delete", "vec_id % 5 = 0", 0), ("upsert", "vec_id % 10 = 0", 1)), "vec_id", "seq").select("vec_id", "label")


@query("vec_centroid", "SELECT CAST(p - 1 AS INTEGER) AS position, round(avg(CAST(embedding[p] AS DOUBLE)), 6) AS mean FROM embeddings, range(1, 65) r(p) GROUP BY 1")
def _(s, d):
    return ve.centroid(load(s, d, "embeddings"), "embedding").select("position", F.round("mean", 6).alias("mean"))
