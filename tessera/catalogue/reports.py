"""Queries on joins, aggregates, views and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregates as ag
from tessera.operators import joins as jn
from tessera.operators.filters import Clause
from tessera.plans.entities import sample_catalog
from tessera.plans.explain import History, advice, steps
from tessera.plans.report import Report, from_definition
from tessera.plans.view import Materialised, Projection, View, ViewJoin

from .registry import query
from .tables import load


@query(
    "report_revenue_by_nation",
    """SELECT n_name AS nation, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_quantity), 6) AS quantity, count(*) AS lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE c_mktsegment = 'BUILDING' GROUP BY n_name ORDER BY revenue DESC, nation LIMIT 10""",
)
def _(s, d):
    r = Report(sample_catalog(s, d), "lineitem").join("lineitem", "l_orderkey", "orders", "o_orderkey").join("orders", "o_custkey", "customer", "c_custkey")
    r = r.join("customer", "c_nationkey", "nation", "n_nationkey").where("customer.c_mktsegment", "eq", "building")
    r = r.column("nation.n_name", "nation").column("lineitem.l_extendedprice", "revenue", aggregate="sum").column("lineitem.l_quantity", "quantity", aggregate="avg").column("lineitem.l_orderkey", "lines", aggregate="count")
    out = r.order_by("revenue", True).order_by("nation").limit(10).run()
    return out.withColumns({"revenue": F.round("revenue", 2), "quantity": F.round("quantity", 6)})


def _join(name: str, how: str, kind: str):
    sql = f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') {kind} JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey"

    @query(name, sql)
    def _(s, d):
        c, o = load(s, d, "customer").where("c_mktsegment = 'BUILDING'"), load(s, d, "orders").where("o_orderstatus = 'F'")
        return jn.join(c, o, "c_custkey", "o_custkey", how).select("c_custkey", "o_orderkey")


for _n, _h, _k in (("join_inner", "inner", "INNER"), ("join_left", "left", "LEFT"), ("join_right", "right", "RIGHT"), ("join_full", "full", "FULL")):
    _join(_n, _h, _k)


@query("join_chain", "SELECT o_orderkey AS k, n_name AS nation, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    r = Report(sample_catalog(s, d), "orders").join("orders", "o_custkey", "customer", "c_custkey").left_join("customer", "c_nationkey", "nation", "n_nationkey").left_join("nation", "n_regionkey", "region", "r_regionkey")
    return r.column("orders.o_orderkey", "k").column("nation.n_name", "nation").column("region.r_name", "region").run()


@query("join_view_first", "SELECT c_name, k AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(s, d):
    v = View("v", "customer", (Projection("c_name"), Projection("o_orderkey", "orders", "first_order")), (ViewJoin("customer", "c_custkey", "orders", "o_custkey"),), limit=1_000_000_000)
    return v.plan(sample_catalog(s, d))


@query("join_key_norm", "SELECT a.p_partkey AS a, b.k AS b FROM part a JOIN (SELECT upper(p_type) AS t, min(p_partkey) AS k FROM part GROUP BY 1) b ON lower(a.p_type) = lower(b.t)")
def _(s, d):
    part = load(s, d, "part")
    b = part.groupBy(F.upper("p_type").alias("t")).agg(F.min("p_partkey").alias("b"))
    return jn.join(part, b, "p_type", "t").select(F.col("p_partkey").alias("a"), "b")


@query("join_lookup", "SELECT o_orderkey, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    return jn.lookup(load(s, d, "orders"), "o_custkey", load(s, d, "customer"), "c_custkey", "c_name", "customer").select("o_orderkey", "customer")


@query("join_lookup_chain", "SELECT o_orderkey, r_name AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    hops = [("o_custkey", load(s, d, "customer"), "c_custkey", "c_nationkey"), ("", load(s, d, "nation"), "n_nationkey", "n_regionkey"), ("", load(s, d, "region"), "r_regionkey", "r_name")]
    return jn.lookup_chain(load(s, d, "orders"), hops, "region").select("o_orderkey", "region")


@query("join_query_lookup", "SELECT s_suppkey, k AS part FROM supplier LEFT JOIN (SELECT p_size, p_type, min(p_partkey) AS k FROM part GROUP BY 1, 2) ON p_size = s_nationkey AND p_type = 'ECONOMY'")
def _(s, d):
    sup = load(s, d, "supplier").withColumn("wanted", F.lit("ECONOMY"))
    return jn.query_lookup(sup, load(s, d, "part"), {"p_size": "s_nationkey", "p_type": "wanted"}, "p_partkey", "p_partkey", "part").select("s_suppkey", "part")


@query("join_get", "SELECT l_orderkey, l_linenumber, l_partkey, o_totalprice AS total FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def _(s, d):
    return jn.lookup(load(s, d, "lineitem"), "l_orderkey", load(s, d, "orders"), "o_orderkey", "o_totalprice", "total").select("l_orderkey", "l_linenumber", "l_partkey", "total")


@query("related_chain", "SELECT c_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) ON c_custkey = o_custkey WHERE rank <= 50")
def _(s, d):
    return jn.related(load(s, d, "customer"), load(s, d, "orders"), "c_custkey", "o_custkey", [F.col("o_orderkey")]).select("c_custkey", "o_orderkey", "rank")


# -- aggregates


@query("agg_scalar", "SELECT round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    return ag.aggregate(load(s, d, "orders").where("o_orderstatus = 'F'"), total=("sum", "o_totalprice")).select(F.round("total", 2).alias("total"))


@query("agg_multi", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_discount) AS low, max(l_discount) AS high, round(stddev_pop(l_quantity), 6) AS spread FROM lineitem")
def _(s, d):
    q = "l_quantity"
    out = ag.aggregate(load(s, d, "lineitem"), n=("count", None), total=("sum", q), mean=("avg", q), low=("min", "l_discount"), high=("max", "l_discount"), spread=("stddev", q))
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6), "spread": F.round("spread", 6)})


@query("agg_count", "SELECT count(*) AS n FROM lineitem")
def _(s, d):
    return ag.aggregate(load(s, d, "lineitem"), n=("count", None))


@query("agg_sum", "SELECT coalesce(sum(c_acctbal), 0) AS total FROM customer WHERE c_mktsegment = 'none'")
def _(s, d):
    return ag.aggregate(load(s, d, "customer").where("c_mktsegment = 'none'"), total=("sum", "c_acctbal"))


@query("agg_min", "SELECT min(c_acctbal) AS low FROM customer")
def _(s, d):
    return ag.aggregate(load(s, d, "customer"), low=("min", "c_acctbal"))


@query("agg_max", "SELECT max(c_acctbal) AS high FROM customer")
def _(s, d):
    return ag.aggregate(load(s, d, "customer"), high=("max", "c_acctbal"))


@query("agg_avg", "SELECT round(avg(p_retailprice), 6) AS mean FROM part")
def _(s, d):
    return ag.aggregate(load(s, d, "part"), mean=("avg", "p_retailprice")).select(F.round("mean", 6).alias("mean"))


@query("agg_stddev", "SELECT round(stddev_pop(o_totalprice), 4) AS spread FROM orders")
def _(s, d):
    return ag.aggregate(load(s, d, "orders"), spread=("stddev", "o_totalprice")).select(F.round("spread", 4).alias("spread"))


@query("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s, d):
    return ag.group(load(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], n=("count", None))


@query("agg_group_sum", "SELECT l_returnflag, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def _(s, d):
    return ag.group(load(s, d, "lineitem"), ["l_returnflag"], total=("sum", "l_quantity")).withColumn("total", F.round("total", 2))


@query("agg_group_minmax", "SELECT p_brand, min(p_name) AS low, max(p_retailprice) AS high FROM part GROUP BY 1")
def _(s, d):
    return ag.group(load(s, d, "part"), ["p_brand"], low=("min", "p_name"), high=("max", "p_retailprice"))


@query("agg_group_avg", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _(s, d):
    return ag.group(load(s, d, "orders"), ["o_orderpriority"], mean=("avg", "o_totalprice")).withColumn("mean", F.round("mean", 4))


@query("agg_group_stddev", "SELECT c_mktsegment, round(coalesce(stddev_pop(c_acctbal), 0), 4) AS spread FROM customer GROUP BY 1")
def _(s, d):
    return ag.group(load(s, d, "customer"), ["c_mktsegment"], spread=("stddev", "c_acctbal")).withColumn("spread", F.round("spread", 4))


@query(
    "agg_drill",
    """SELECT r_name, n_name, c_mktsegment, CAST(3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment) AS INTEGER) AS depth, count(*) AS n, round(sum(c_acctbal), 2) AS total
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (r_name, n_name, c_mktsegment))""",
)
def _(s, d):
    rows = load(s, d, "customer").join(load(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return ag.drill(rows, ["r_name", "n_name", "c_mktsegment"], n=("count", None), total=("sum", "c_acctbal")).withColumn("total", F.round("total", 2))


@query("agg_chart", "SELECT p_type, round(sum(p_retailprice), 2) AS a, CAST(sum(p_size) AS DOUBLE) AS b FROM part GROUP BY 1")
def _(s, d):
    return ag.group(load(s, d, "part"), ["p_type"], a=("sum", "p_retailprice"), b=("sum", "p_size")).withColumns({"a": F.round("a", 2), "b": F.round("b", 2)})


@query("agg_sparkline", "SELECT lower(o_orderpriority) AS label, round(sum(coalesce(o_totalprice, 0)) / count(*), 4) AS point FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def _(s, d):
    return ag.sparkline(load(s, d, "orders"), "o_orderpriority", "o_totalprice", "avg").withColumn("point", F.round("point", 4))


@query("agg_calendar", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return ag.by_day(load(s, d, "events"), "ts")


@query("agg_timetable", "SELECT o_custkey AS slot, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS entries FROM orders GROUP BY 1")
def _(s, d):
    return ag.timetable(load(s, d, "orders"), F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderkey"))


@query("agg_timeline", "SELECT min(o_orderdate) AS start, max(greatest(o_orderdate, o_orderdate + INTERVAL 5 DAY)) AS \"end\" FROM orders")
def _(s, d):
    o = ag.timeline(load(s, d, "orders"), F.col("o_orderdate"), F.expr("o_orderdate + interval 5 days"))
    return o.agg(F.min("start").alias("start"), F.max("end").alias("end"))


@query("agg_tile", "SELECT '$' || printf('%,.2f', sum(o_totalprice)) AS value FROM orders WHERE o_orderstatus = 'O'")
def _(s, d):
    from tessera.functions.scalars import format_value

    return ag.aggregate(load(s, d, "orders").where("o_orderstatus = 'O'"), value=("sum", "o_totalprice")).select(format_value(F.col("value"), "currency").alias("value"))


@query("agg_dashboard", "SELECT 'orders' AS tile, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'largest', max(o_totalprice) FROM orders")
def _(s, d):
    return ag.tiles({"orders": (load(s, d, "orders"), "count", None), "customers": (load(s, d, "customer"), "count", None), "largest": (load(s, d, "orders"), "max", "o_totalprice")})


@query("agg_distinct_values", "SELECT min(p_type) AS value FROM part WHERE trim(p_type) <> '' GROUP BY lower(p_type)")
def _(s, d):
    return ag.distinct_values(load(s, d, "part"), "p_type")


@query("agg_child", "SELECT o_orderkey, coalesce(round(t, 2), 0) AS total FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def _(s, d):
    return ag.child(load(s, d, "orders"), load(s, d, "lineitem"), "o_orderkey", "l_orderkey", "sum", "l_extendedprice", "total").select("o_orderkey", F.round("total", 2).alias("total"))


@query(
    "agg_expr_list",
    """SELECT l_orderkey AS k, count(*) AS n, sum(l_quantity) AS total, max(l_quantity) AS high, bool_or(l_discount > 0.09) AS anyof, bool_and(l_quantity > 5) AS allof
    FROM lineitem GROUP BY 1""",
)
def _(s, d):
    lists = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct("l_quantity", "l_discount")).alias("items"))
    q = lambda x: x["l_quantity"]
    i = F.col("items")
    return lists.select("k", ag.over_list(i, "count", q).cast("long").alias("n"), ag.over_list(i, "sum", q).alias("total"), ag.over_list(i, "max", q).alias("high"), ag.over_list(i, "any", lambda x: x["l_discount"] > 0.09).alias("anyof"), ag.over_list(i, "all", lambda x: x["l_quantity"] > 5).alias("allof"))


@query(
    "agg_doc_graph",
    """SELECT 'node' AS kind, 'customer' AS source, NULL AS target, count(*) AS n FROM customer UNION ALL SELECT 'node', 'orders', NULL, count(*) FROM orders
    UNION ALL SELECT 'link', 'customer', 'orders', count(o_custkey) FROM orders""",
)
def _(s, d):
    return ag.document_graph({"customer": load(s, d, "customer"), "orders": load(s, d, "orders")}, {("customer", "orders"): ("orders", "o_custkey")})


@query(
    "agg_column_stats",
    """SELECT 'l_quantity' AS field, count(*) AS rows, count(*) - count(l_quantity) AS nulls, count(DISTINCT l_quantity) AS distinct_values, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem
    UNION ALL SELECT 'l_linenumber', count(*), count(*) - count(l_linenumber), count(DISTINCT l_linenumber), min(l_linenumber), max(l_linenumber) FROM lineitem""",
)
def _(s, d):
    return ag.column_stats(load(s, d, "lineitem"), ["l_quantity", "l_linenumber"])


@query(
    "agg_histogram",
    """SELECT CAST(least(63, floor((o_totalprice - lo) / ((hi - lo) / 64))) AS INTEGER) AS bucket, count(*) AS n
    FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1""",
)
def _(s, d):
    return ag.histogram(load(s, d, "orders"), "o_totalprice")


# -- plans

DEFINITION = {
    "root": "orders",
    "joins": [{"type": "LeftJoin".removesuffix("Join"), "from": "orders", "fromField": "o_custkey", "to": "customer", "toField": "c_custkey"}],
    "columns": [{"entity": "customer", "field": "c_mktsegment", "label": "segment"}, {"field": "o_totalprice", "label": "total", "aggregate": "sum"}, {"field": "o_orderkey", "label": "n", "aggregate": "count"}],
    "filters": [{"field": "o_orderstatus", "operator": "eq", "value": "{status}"}, {"field": "o_totalprice", "operator": ">=", "value": "{least}"}],
    "sorts": [{"label": "segment"}],
    "parameters": [{"name": "status", "default": "F"}, {"name": "least", "default": "0"}],
}


@query("report_params", "SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_totalprice >= 200000 GROUP BY 1")
def _(s, d):
    return from_definition(sample_catalog(s, d), DEFINITION, {"least": 200000}).run().withColumn("total", F.round("total", 2))


@query("definition_json", "SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND o_totalprice >= 0 GROUP BY 1")
def _(s, d):
    import json

    return from_definition(sample_catalog(s, d), json.dumps(DEFINITION), {"status": "O"}).run().withColumn("total", F.round("total", 2))


@query("mv_cache", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    v = View("nations", "nation", (Projection("n_name", alias="n_name"), Projection("r_name", "region", "r_name")), (ViewJoin("nation", "n_regionkey", "region", "r_regionkey"),))
    kept = Materialised(sample_catalog(s, d))
    kept.get(v)
    kept.changed("region")
    return kept.get(v)


def _sample_report(s, d) -> Report:
    r = Report(sample_catalog(s, d), "orders").join("orders", "o_custkey", "customer", "c_custkey").where("customer.c_mktsegment", "eq", "BUILDING")
    return r.column("customer.c_name", "name").order_by("name")


@query("plan_explain", "SELECT * FROM (VALUES (1, 'LoadEntity', 'orders'), (2, 'LoadEntity', 'customer'), (3, 'HashJoin', 'orders.o_custkey = customer.c_custkey (inner)'), (4, 'PostJoinFilter', 'customer.c_mktsegment eq BUILDING'), (5, 'ProjectAndSort', 'name')) t(place, step, detail)")
def _(s, d):
    return s.createDataFrame([(k + 1, x["step"], x["detail"]) for k, x in enumerate(steps(_sample_report(s, d)))], "place int, step string, detail string")


@query("plan_missing_index", "SELECT * FROM (VALUES ('customer.c_mktsegment: no index for filter'), ('customer.c_name: no index for sort')) t(advice)")
def _(s, d):
    return s.createDataFrame([(a,) for a in advice(_sample_report(s, d))], "advice string")


@query("plan_history", "SELECT 'second' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'first', count(*) FROM region")
def _(s, d):
    h = History()
    h.run("first", load(s, d, "region"))
    h.run("second", load(s, d, "nation"))
    return s.createDataFrame([(r.name, r.rows) for r in h], "name string, rows long")


@query("filter_clauses_on_view", "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(s, d):
    from tessera.operators.filters import filtered

    big = filtered(load(s, d, "orders"), Clause("o_totalprice", ">", 400000)).select(F.col("o_custkey").alias("c_custkey"))
    return load(s, d, "customer").join(big, "c_custkey", "left_semi").select("c_name")
