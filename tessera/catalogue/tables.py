"""Queries on sources, filters, projections and sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import display, format_value, strip_html
from tessera.operators import filters as fl
from tessera.operators import joins as jn
from tessera.operators.filters import Clause, Group, QueryDefinition, Sort, filtered
from tessera.operators.sorting import page_with_total, run_query, sort_by, top_per_group, truncated
from tessera.plans.report import Report
from tessera.plans.entities import sample_catalog
from tessera.plans.view import Projection, View
from tessera.sources import files

from .registry import query


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- sources


@query("scan_entity", "SELECT * FROM nation")
def _(s, d):
    return sample_catalog(s, d).frame("nation")


@query("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 7")
def _(s, d):
    return load(s, d, "orders").where(F.col("o_orderkey") == 7)


@query("batch_lookup", "SELECT * FROM customer WHERE c_custkey IN (3, 5, 8, 13)")
def _(s, d):
    wanted = s.createDataFrame([(k,) for k in dict.fromkeys([5, 3, 8, 13, 5])], "c_custkey long")
    return load(s, d, "customer").join(F.broadcast(wanted), "c_custkey", "left_semi")


@query("field_lookup", "SELECT c_name FROM customer WHERE c_custkey = 3")
def _(s, d):
    return load(s, d, "customer").where("c_custkey = 3").select("c_name")


@query("count_entity", "SELECT count(*) AS n FROM orders WHERE lower(o_orderstatus) = 'f'")
def _(s, d):
    return filtered(load(s, d, "orders"), Clause("o_orderstatus", "eq", "f")).agg(F.count(F.lit(1)).alias("n"))


@query("ingest_get", "SELECT * FROM benchmark UNION ALL SELECT -1, 'a note'")
def _(s, d):
    return files.append_text(s, load(s, d, "benchmark"), "text", "a note", "item_id", -1)


@query(
    "crud_command",
    """SELECT user_id, arg_max(value, event_id) AS value FROM
    (SELECT user_id, event_id, event_type, value FROM events UNION ALL SELECT 0, 1000000000, 'view', 99.5 UNION ALL SELECT 1, 1000000001, 'error', 0.0)
    GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'""",
)
def _(s, d):
    from tessera.operators.changes import latest

    log = load(s, d, "events").select("user_id", "event_id", "event_type", "value")
    more = s.createDataFrame([(0, 1_000_000_000, "view", 99.5), (1, 1_000_000_001, "error", 0.0)], log.schema)
    log = log.unionByName(more).withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("upsert"))
    return latest(log, "user_id", "event_id", "op").select("user_id", "value")


@query("version_history", "SELECT turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn")
def _(s, d):
    return load(s, d, "conversations").where("conv_id = 3").orderBy("turn").select("turn", "role", "text")


@query("wal_scan_raw", "SELECT user_id AS k, event_id AS seq, props AS payload FROM events ORDER BY event_id LIMIT 1000")
def _(s, d):
    return load(s, d, "events").orderBy("event_id").limit(1000).select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.col("props").alias("payload"))


@query("wal_stream_sink", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def _(s, d):
    from tessera.operators.changes import latest

    return latest(load(s, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id").select("user_id", "value")


@query("json_export", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def _(s, d):
    return files.to_json(load(s, d, "region"))


@query("csv_export", "SELECT p_partkey || ',' || p_name || ',' || p_brand || ',' || p_size AS line FROM part")
def _(s, d):
    return files.csv_line(load(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"))


@query("csv_parse", "SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part")
def _(s, d):
    lines = files.csv_line(load(s, d, "part").select("p_partkey", "p_name", "p_size"))
    return lines.select(files.parse_csv(F.col("line"), "k long, name string, size int").alias("r")).select("r.*")


@query(
    "csv_import",
    """SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation
    UNION ALL SELECT 100, 'NEW'""",
)
def _(s, d):
    current = load(s, d, "nation").select("n_nationkey", "n_name")
    changed = current.where("n_nationkey < 5").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))
    new = s.createDataFrame([(100, "NEW")], current.schema)
    given = changed.unionByName(new).withColumn("bad_row", F.lit(None).cast("string"))
    bad = s.createDataFrame([(None, None, "x,y,z")], given.schema)
    return files.import_rows(current, given.unionByName(bad), "n_nationkey")[0]


def _orders_with_lines(s, d):
    lines = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("items"))
    return load(s, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query("nested_extract", "SELECT o_orderkey, l_linenumber, l_partkey, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def _(s, d):
    return files.nested(_orders_with_lines(s, d), "o_orderkey", "items")


@query("export_formats", "SELECT o_orderkey, count(l_orderkey) AS items FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _(s, d):
    return _orders_with_lines(s, d).select("o_orderkey", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("items"))


# -- projections


@query("project_columns", 'SELECT c_name AS "customer.c_name", c_acctbal AS "customer.c_acctbal" FROM customer')
def _(s, d):
    return Report(sample_catalog(s, d), "customer").select("customer.c_name", "customer.c_acctbal").run()


@query("project_labelled", "SELECT c_name AS \"Name\", '$' || printf('%,.2f', abs(c_acctbal)) AS \"Balance\" FROM customer WHERE c_acctbal >= 0")
def _(s, d):
    return Report(sample_catalog(s, d), "customer").column("customer.c_name", "Name").column("customer.c_acctbal", "Balance", form="currency").where("customer.c_acctbal", ">=", 0).run()


@query("project_default", "SELECT * FROM region")
def _(s, d):
    return Report(sample_catalog(s, d), "region").run()


@query("project_view", 'SELECT n_name AS nation, n_regionkey FROM nation')
def _(s, d):
    return View("v", "nation", (Projection("n_name", alias="nation"), Projection("n_regionkey"))).plan(sample_catalog(s, d))


@query("project_graphql", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def _(s, d):
    df = load(s, d, "part")
    named = {c.lower(): c for c in df.columns}
    return df.select(F.col("p_partkey").cast("string").alias("id"), *[F.col(named[f.lower()]).cast("string").alias(named[f.lower()]) for f in ("P_NAME", "p_size")])


@query("expand_fk", "SELECT n_nationkey, n_name, r_name AS region_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    out = jn.expand(load(s, d, "nation"), "n_regionkey", load(s, d, "region"), "r_regionkey", "region")
    return out.select("n_nationkey", "n_name", F.col("region.r_name").alias("region_name"))


@query("lookup_display", "SELECT s_suppkey, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey")
def _(s, d):
    return jn.lookup_display(load(s, d, "supplier"), "s_nationkey", load(s, d, "nation").where("n_regionkey <> 2"), "n_nationkey", "n_name", "nation").select("s_suppkey", "nation")


@query("lookup_options", "SELECT p_brand AS value, arg_min(p_name, p_partkey) AS display FROM part GROUP BY p_brand")
def _(s, d):
    return jn.options(load(s, d, "part"), "p_brand", "p_name", [F.col("p_partkey")])


@query("format_value", "SELECT o_orderkey, printf('%,.2f', o_totalprice) AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS minute FROM orders")
def _(s, d):
    return load(s, d, "orders").select("o_orderkey", format_value(F.col("o_totalprice"), "number").alias("amount"), format_value(F.col("o_orderdate"), "date").alias("day"), format_value(F.col("o_orderdate"), "datetime").alias("minute"))


@query("display_string", "SELECT vec_id, array_to_string(list_transform(embedding[1:2], lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) AS INTEGER)), ', ') AS shown FROM embeddings")
def _(s, d):
    two = F.transform(F.slice("embedding", 1, 2), lambda x: F.floor(x.cast("double") * 100).cast("int"))
    return load(s, d, "embeddings").select("vec_id", display(two, "array").alias("shown"))


@query("strip_html", "SELECT page_id, replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '>', '') AS text FROM pages")
def _(s, d):
    return load(s, d, "pages").select("page_id", strip_html(F.col("html")).alias("text"))


# -- filters


def _filter(name: str, table: str, sql: str, *clauses, any_of: bool = False):
    query(name, f"SELECT * FROM {table} WHERE {sql}")(lambda s, d: filtered(load(s, d, table), *clauses, any_of=any_of))


_filter("filter_eq", "customer", "lower(c_mktsegment) = 'household'", Clause("c_mktsegment", "=", "Household"))
_filter("filter_ne", "customer", "lower(c_mktsegment) <> 'household'", Clause("c_mktsegment", "<>", "household"))
_filter("filter_contains_str", "part", "contains(lower(p_name), 'wid')", Clause("p_name", "contains", "WID"))
_filter("filter_startswith", "part", "starts_with(lower(p_name), 'blue')", Clause("p_name", "startswith", "Blue"))
_filter("filter_endswith", "part", "ends_with(lower(p_name), 'ring')", Clause("p_name", "endswith", "RING"))
_filter("filter_in", "part", "lower(p_type) IN ('economy', 'small') AND p_size IN (3, 5, 11)", Clause("p_type", "in", '[economy,"SMALL"]'), Clause("p_size", "in", "3, 5,, 11"))
_filter("filter_notin", "part", "p_size NOT IN (3, 5, 11)", Clause("p_size", "notin", [3, 5, 11]))
_filter("filter_gt", "lineitem", "l_quantity > 45", Clause("l_quantity", "gt", "45"))
_filter("filter_lt", "lineitem", "l_quantity < 3", Clause("l_quantity", "lt", 3))
_filter("filter_gte", "lineitem", "l_shipdate >= TIMESTAMP '2001-01-01'", Clause("l_shipdate", "gte", "2001-01-01"))
_filter("filter_lte", "customer", "c_acctbal <= 0.5", Clause("c_acctbal", "lte", "0.5"))
_filter("filter_coerce", "orders", "o_orderkey = 12 OR o_totalprice >= 499000.5", Clause("o_orderkey", "eq", " 12 "), Clause("o_totalprice", ">=", "499000.5"), any_of=True)
_filter("filter_bitmask3", "lineitem", "l_linenumber = 2 AND l_extendedprice > 50000 AND l_discount <= 0.05", Clause("l_linenumber", "eq", 2), Clause("l_extendedprice", "gt", 50000), Clause("l_discount", "le", 0.05))
_filter("filter_columnar", "lineitem", "l_partkey >= 100 AND l_partkey < 200 AND l_tax > 0.02", Clause("l_partkey", "ge", 100), Clause("l_partkey", "lt", 200), Clause("l_tax", "gt", 0.02))
_filter("filter_dict", "orders", "lower(o_orderpriority) IN ('1-urgent', '2-high') AND lower(o_orderstatus) <> 'p'", Clause("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), Clause("o_orderstatus", "ne", "P"))
_filter("filter_batch", "events", "lower(event_type) = 'click' AND value > 20", Clause("event_type", "eq", "CLICK"), Clause("value", ">", 20))
_filter(
    "filter_groups", "part", "(lower(p_brand) = 'brand#2' OR p_size < 5) AND (p_retailprice > 1000 OR (p_retailprice < 950 AND contains(p_name, 'red')))",
    Group((Clause("p_brand", "eq", "Brand#2"), Clause("p_size", "lt", 5)), any_of=True),
    Group((Clause("p_retailprice", "gt", 1000),), (Group((Clause("p_retailprice", "lt", 950), Clause("p_name", "contains", "red"))),), any_of=True),
)
_filter("filter_global_search", "part", "contains(lower(p_name), 'blu') OR contains(lower(p_brand), 'blu') OR contains(lower(p_type), 'blu')", fl.search_all(["p_name", "p_brand", "p_type"], "Blu"))


@query("filter_contains_coll", "SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS seen FROM orders GROUP BY o_custkey HAVING list_contains(list(lower(o_orderpriority)), '1-urgent') OR list_contains(list(lower(o_orderpriority)), '5-low')")
def _(s, d):
    lists = load(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("seen"))
    return filtered(lists, Clause("seen", "contains", ["1-Urgent", "5-low"]))


@query("filter_querystring", "SELECT * FROM part WHERE contains(lower(p_name), 'bolt') AND p_size = 33 ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 2")
def _(s, d):
    df = load(s, d, "part")
    return run_query(df, fl.from_querystring(df, {"f_p_name": "Bolt", "field": "p_size", "value": "33", "sort": "p_retailprice", "dir": "desc", "skip": "2", "top": "20"}), "p_partkey")


@query("filter_json", "SELECT * FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 30")
def _(s, d):
    body = {"clauses": [{"field": "o_totalprice", "operator": "GreaterThan", "value": 300000}, {"field": "o_orderstatus", "operator": "Equals", "value": "f"}], "sorts": [{"field": "o_totalprice"}], "top": 30}
    return run_query(load(s, d, "orders"), fl.from_json(body), "o_orderkey")


@query("filter_lookup_api", "SELECT * FROM customer WHERE c_nationkey = 3 AND contains(lower(c_name), '1') ORDER BY c_custkey LIMIT 200")
def _(s, d):
    return run_query(load(s, d, "customer"), fl.from_lookup({"filter": ["c_nationkey:3"], "search": "1", "searchField": "c_name", "sort": "c_custkey"}), "c_custkey")


@query("filter_mcp", "SELECT * FROM supplier WHERE s_acctbal > 1000 ORDER BY s_acctbal DESC, s_suppkey LIMIT 50")
def _(s, d):
    return run_query(load(s, d, "supplier"), fl.from_tool({"filters": [{"field": "s_acctbal", "operator": ">", "value": 1000}], "sorts": [{"field": "s_acctbal", "direction": "desc"}]}), "s_suppkey")


@query("filter_graphql", "SELECT * FROM customer WHERE c_nationkey = 4 ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5")
def _(s, d):
    return run_query(load(s, d, "customer"), fl.from_graphql({"c_nationkey": 4, "sort": "c_acctbal", "take": 10, "skip": 5}), "c_custkey")


@query("filter_report", "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000 AND o_totalprice < 100000")
def _(s, d):
    r = Report(sample_catalog(s, d), "orders").join("orders", "o_custkey", "customer", "c_custkey")
    return r.where("customer.c_acctbal", ">", "9000").where("orders.o_totalprice", "<", 100000).column("orders.o_orderkey", "k").column("customer.c_name", "name").run()


@query("filter_view", "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 AND ends_with(lower(n_name), '3')")
def _(s, d):
    from tessera.plans.view import ViewJoin

    v = View("v", "supplier", (Projection("s_name", alias="s_name"), Projection("n_name", "nation", "n_name")), (ViewJoin("supplier", "s_nationkey", "nation", "n_nationkey", "inner"),), (("supplier", Clause("s_acctbal", ">", 5000)), ("nation", Clause("n_name", "endswith", "3"))))
    return v.plan(sample_catalog(s, d))


@query("dict_encode", "SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_brand AS value FROM part)")
def _(s, d):
    from tessera.operators.changes import dictionary

    return dictionary(load(s, d, "part"), "p_brand")


# -- sorting and paging


@query("sort_multi", "SELECT p_partkey, row_number() OVER (ORDER BY lower(p_type) DESC, p_size, p_partkey) AS place FROM part ORDER BY place LIMIT 500")
def _(s, d):
    out = run_query(load(s, d, "part"), QueryDefinition(sorts=(Sort("p_type", True), Sort("p_size")), top=500), "p_partkey")
    return _numbered(out.select("p_partkey"))


def _numbered(df: DataFrame) -> DataFrame:
    """The place of each row of a short, sorted result."""
    at = F.monotonically_increasing_id()
    return df.coalesce(1).withColumn("place", at + 1)


@query("sort_store", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def _(s, d):
    return sort_by(load(s, d, "customer"), (Sort("c_acctbal", True),), "c_custkey").limit(100)


@query("sort_report", "SELECT c_name AS name, c_acctbal AS balance FROM customer ORDER BY balance DESC, name LIMIT 25")
def _(s, d):
    r = Report(sample_catalog(s, d), "customer").column("customer.c_name", "name").column("customer.c_acctbal", "balance")
    return r.order_by("balance", True).order_by("name").limit(25).run()


@query("sort_view", "SELECT s_name, s_acctbal FROM supplier ORDER BY s_acctbal, s_name LIMIT 40")
def _(s, d):
    return View("v", "supplier", (Projection("s_name"), Projection("s_acctbal")), sorts=(("s_acctbal", False), ("s_name", False)), limit=40).plan(sample_catalog(s, d))


@query("page_skip_top", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(s, d):
    return run_query(load(s, d, "orders"), QueryDefinition(sorts=(Sort("o_orderdate", True),), skip=100, top=50), "o_orderkey")


@query("page_view", "SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey LIMIT 30 OFFSET 30")
def _(s, d):
    return View("v", "part", (Projection("p_name"), Projection("p_partkey")), sorts=(("p_name", False), ("p_partkey", False)), offset=30, limit=30).plan(sample_catalog(s, d))


@query("limit_report", "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 10000")
def _(s, d):
    return Report(sample_catalog(s, d), "orders").column("orders.o_orderkey", "k").order_by("k").limit(10_000).run()


@query("scan_limits", "SELECT count(*) > 10000 AS truncated FROM lineitem")
def _(s, d):
    return s.createDataFrame([(truncated(load(s, d, "lineitem")),)], "truncated boolean")


@query("page_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'")
def _(s, d):
    return page_with_total(load(s, d, "orders"), QueryDefinition(Group((Clause("o_orderstatus", "eq", "O"),)), top=10), "o_orderkey")[1]


@query(
    "topk_per_group",
    """SELECT entity, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY id) AS rank FROM (
    SELECT 'customer' AS entity, c_custkey AS id FROM customer WHERE contains(lower(c_name), '00') UNION ALL
    SELECT 'supplier', s_suppkey FROM supplier WHERE contains(lower(s_name), '00') UNION ALL
    SELECT 'nation', n_nationkey FROM nation WHERE contains(lower(n_name), '00'))) WHERE rank <= 5""",
)
def _(s, d):
    parts = [filtered(load(s, d, t), Clause(n, "contains", "00")).select(F.lit(t).alias("entity"), F.col(k).cast("long").alias("id")) for t, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"))]
    return top_per_group(parts[0].unionByName(parts[1]).unionByName(parts[2]), "entity", [F.col("id")], 5).withColumn("rank", F.col("rank").cast("long"))


@query(
    "sort_tree",
    """WITH RECURSIVE t AS (SELECT p_partkey AS key, 0 AS depth, CAST(p_partkey AS VARCHAR) AS path FROM part WHERE p_partkey = 0
    UNION ALL SELECT p_partkey, depth + 1, path || ' / ' || p_partkey FROM part JOIN t ON p_partkey // 10 = key WHERE p_partkey <> 0)
    SELECT key, depth, path FROM t ORDER BY path""",
)
def _(s, d):
    from tessera.operators.graphs import tree

    df = load(s, d, "part").withColumn("up", F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 10)))
    return tree(df, "p_partkey", "up", F.col("p_partkey")).orderBy("path")
