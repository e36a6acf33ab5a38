"""Queries on scalar functions, both expression languages, validation and actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as sc
from tessera.functions import validation as va
from tessera.functions.formula import Node, calculated, formula, parse, to_script
from tessera.functions.registered import register
from tessera.functions.structured import Build, field, item, lit, param, x
from tessera.operators import actions as ac
from tessera.operators import joins as jn

from .registry import query
from .tables import load


def _formula(name: str, table: str, key: str, text: str, sql: str, kind: str = "double"):
    cast = {"double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}[kind]
    wrap = f"round(CAST({sql} AS DOUBLE), 4)" if kind == "double" else f"CAST({sql} AS {cast})"

    @query(name, f"SELECT {key}, {wrap} AS v FROM {table}")
    def _(s, d):
        df = load(s, d, table)
        v = formula(df, text).cast(kind)
        return df.select(key, (F.round(v, 4) if kind == "double" else v).alias("v"))


_formula("expr_arith", "part", "p_partkey", "p_size * 2 + p_retailprice - 1.5", "p_size * 2 + p_retailprice - 1.5")
_formula("expr_div_mod", "part", "p_partkey", "p_retailprice / 7 + p_partkey % 7", "p_retailprice / 7 + p_partkey % 7")
_formula("expr_concat", "part", "p_partkey", "p_brand + '/' + p_name", "p_brand || '/' || p_name", "string")
_formula("expr_compare", "part", "p_partkey", "p_size * 3 >= p_partkey - 10", "p_size * 3 >= p_partkey - 10", "boolean")
_formula("expr_unary", "part", "p_partkey", "-p_size + +3", "-p_size + 3")
_formula("expr_round", "part", "p_partkey", "Round(p_size / 2) + Round(p_retailprice * 0.125, 1)", "round_even(p_size / 2, 0) + round_even(CAST(p_retailprice AS DECIMAL(18,4)) * 0.125, 1)")
_formula("expr_min", "part", "p_partkey", "Min(p_size, 10, p_partkey)", "least(p_size, 10, p_partkey)")
_formula("expr_max", "part", "p_partkey", "Max(p_size, 10, p_partkey)", "greatest(p_size, 10, p_partkey)")
_formula("expr_abs", "customer", "c_custkey", "Abs(c_acctbal - 5000)", "abs(c_acctbal - 5000)")
_formula("expr_if", "part", "p_partkey", "If(p_size > 25, 'large', If(p_size > 10, 'middle', 'small'))", "CASE WHEN p_size > 25 THEN 'large' WHEN p_size > 10 THEN 'middle' ELSE 'small' END", "string")


@query("expr_related", "SELECT s_suppkey, n_name || '!' AS v FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(s, d):
    df = jn.lookup(load(s, d, "supplier"), "s_nationkey", load(s, d, "nation"), "n_nationkey", "n_name", "_v")
    return df.select("s_suppkey", formula(df, "RelatedLookup(s_nationkey, 'n_name') + '!'", {"relatedlookup(s_nationkey,n_name)": F.col("_v")}).alias("v"))


@query("expr_query", "SELECT n_nationkey, coalesce(CAST(k AS VARCHAR), '') || '#' AS v FROM nation LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS k FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) ON c_nationkey = n_nationkey")
def _(s, d):
    df = load(s, d, "nation").withColumn("seg", F.lit("BUILDING"))
    df = jn.query_lookup(df, load(s, d, "customer"), {"c_nationkey": "n_nationkey", "c_mktsegment": "seg"}, "c_custkey", "c_custkey", "_v")
    text = "QueryLookup('customer', 'c_nationkey', n_nationkey, 'c_custkey') + '#'"
    return df.select("n_nationkey", formula(df, text, {"querylookup(customer,c_nationkey,n_nationkey,c_custkey)": F.col("_v")}).alias("v"))


@query("expr_dot", "SELECT c_custkey, r_name || ':' || c_name AS v FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    hops = [("c_nationkey", load(s, d, "nation"), "n_nationkey", "n_regionkey"), ("", load(s, d, "region"), "r_regionkey", "r_name")]
    df = jn.lookup_chain(load(s, d, "customer"), hops, "_v")
    return df.select("c_custkey", formula(df, "Nation.Region.Name + ':' + c_name", {"Nation.Region.Name": F.col("_v")}).alias("v"))


@query("expr_ast", "SELECT p_partkey, CAST(p_size + 2 * p_size AS DOUBLE) AS v FROM part")
def _(s, d):
    from tessera.functions.formula import Compiler

    df = load(s, d, "part")
    tree = Node.from_json(parse("p_size + 2 * p_size").to_json())
    return df.select("p_partkey", Compiler(df).compile(tree)[0].cast("double").alias("v"))


@query("calc_fields", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(e * (1 - c), 2) AS DOUBLE) AS net, CAST(round(e * (1 - c) * (1 + t), 2) AS DOUBLE) AS gross FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(9,2)) AS e, CAST(l_discount AS DECIMAL(4,2)) AS c, CAST(l_tax AS DECIMAL(4,2)) AS t FROM lineitem)")
def _(s, d):
    out = calculated(load(s, d, "lineitem"), {"gross": "net * (1 + l_tax)", "net": "l_extendedprice * (1 - l_discount)"})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("net", 2).cast("double").alias("net"), F.round("gross", 2).cast("double").alias("gross"))


def _structured(name: str, tree, sql: str, kind: str = "double"):
    wrap = f"round({sql}, 6)" if kind == "double" else sql

    @query(name, f"SELECT l_orderkey, l_linenumber, l_partkey, {wrap} AS v FROM lineitem")
    def _(s, d):
        df = load(s, d, "lineitem")
        v = Build(df, {"least": 20})(tree).cast(kind)
        return df.select("l_orderkey", "l_linenumber", "l_partkey", (F.round(v, 6) if kind == "double" else v).alias("v"))


_structured("sx_leaf", x("add", field("l_quantity"), x("mul", param("least"), lit(2))), "l_quantity + 40")
_structured("sx_logic", x("or", x("and", x("gt", field("l_quantity"), param("least")), x("not", field("l_discount"))), x("eq", field("l_returnflag"), lit("R"))), "(l_quantity > 20 AND l_discount = 0) OR l_returnflag = 'R'", "boolean")
_structured("sx_compare", x("and", x("ne", field("l_returnflag"), lit("a")), x("le", field("l_tax"), field("l_discount"))), "l_returnflag <> 'a' AND l_tax <= l_discount", "boolean")
_structured("sx_arith", x("div", x("sub", field("l_extendedprice"), lit(1)), field("l_discount")), "CASE WHEN l_discount = 0 THEN 0.0 ELSE (l_extendedprice - 1) / l_discount END")
_structured("sx_cond", x("if", x("ge", field("l_quantity"), param("least")), x("neg", field("l_tax")), x("mod", field("l_quantity"), lit(3))), "CASE WHEN l_quantity >= 20 THEN -l_tax ELSE l_quantity % 3 END")


def _orders_with_items(s, d):
    items = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("items"))
    return load(s, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_totalprice", "o_orderstatus", "items")


@query("sx_agg", "SELECT l_orderkey AS o_orderkey, sum(l_quantity) * 2 AS v, bool_and(l_quantity > 3) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(s, d):
    df = _orders_with_items(s, d)
    b = Build(df)
    return df.select("o_orderkey", b(x("mul", x("sum", item("l_quantity"), value="items"), lit(2))).alias("v"), b(x("all", x("gt", item("l_quantity"), lit(3)), value="items")).alias("w"))


# -- other scalars


@query("text_tokenize", "SELECT p_partkey, list_sort(list_distinct(regexp_extract_all(lower(p_brand || ' ' || p_name), '[a-z0-9]+'))) AS tokens FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", F.sort_array(sc.tokens(F.concat_ws(" ", "p_brand", "p_name"))).alias("tokens"))


@query("text_reverse", "SELECT p_partkey, reverse(p_name) AS v FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", F.reverse("p_name").alias("v"))


@query("byte_scan", "SELECT item_id, CAST(instr(text, 'the') AS BIGINT) AS at, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS n FROM benchmark")
def _(s, d):
    return load(s, d, "benchmark").select("item_id", F.instr("text", "the").cast("long").alias("at"), sc.count_byte(F.col("text"), "e").cast("long").alias("n"))


@query("conv_string", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, TRY_CAST(event_type AS INTEGER) AS none FROM events")
def _(s, d):
    return load(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.col("event_type").try_cast("int").alias("none"))


@query("conv_list", "SELECT p_partkey, [p_type, p_name] AS v FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", sc.split_list(F.concat("p_type", F.lit(", ,"), "p_name")).alias("v"))


@query("conv_dict", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def _(s, d):
    return load(s, d, "events").select("event_id", F.from_json("props", "map<string,int>")["k"].alias("k"))


@query("conv_childlist", "SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def _(s, d):
    text = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct("l_quantity"))).alias("j"))
    back = text.select("l_orderkey", F.from_json("j", "array<struct<l_quantity:double>>").alias("a"))
    return back.select("l_orderkey", F.size("a").cast("long").alias("n"), F.aggregate("a", F.lit(0.0), lambda t, i: t + i["l_quantity"]).alias("total"))


@query("json_codecs", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS v FROM events")
def _(s, d):
    return load(s, d, "events").select("event_id", F.to_json(F.from_json("props", "struct<k:int>")).alias("v"))


@query("name_case", "SELECT n_nationkey, 'customer-order' AS slug, 'Customer Order' AS spaced, 'Categories' AS plural FROM nation")
def _(s, d):
    n = F.lit("CustomerOrder")
    return load(s, d, "nation").select("n_nationkey", sc.slug(n).alias("slug"), sc.spaced(n).alias("spaced"), sc.plural(F.lit("Category")).alias("plural"))


@query(
    "expr_js",
    "SELECT r_regionkey, ['(roundNumber((parseFieldValue(''o_totalprice'') * 0.5), 2) > Math.max(parseFieldValue(''a.b''), -3))', '(parseFieldValue(''x'') ? ''it\\''s'' : null)'] AS scripts FROM region",
)
def _(s, d):
    scripts = [to_script(parse(t)) for t in ("Round(o_totalprice * .5, 2) > Max(a.b, -3)", """If(x, "it's", null)""")]
    return load(s, d, "region").select("r_regionkey", F.array(*map(F.lit, scripts)).alias("scripts"))


@query("udf_scalar", "SELECT n_name, CAST(list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(n_name, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS BIGINT) AS h FROM nation")
def _(s, d):
    register(s)
    return s.sql("SELECT n_name, fnv1a_32(n_name) AS h FROM {t}", t=load(s, d, "nation"))


@query("udf_aggregate", "SELECT o_orderstatus, quantile_disc(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1")
def _(s, d):
    register(s)
    return s.sql("SELECT o_orderstatus, nearest_rank_95(o_totalprice) AS p95 FROM {t} GROUP BY 1", t=load(s, d, "orders"))


@query("udf_table", "SELECT p_partkey, CAST(k AS INTEGER) AS place, w[k] AS word FROM (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS w, unnest(range(1, len(w) + 1)) AS k FROM part)")
def _(s, d):
    register(s)
    return s.sql("SELECT p_partkey, place, word FROM {t}, LATERAL words_of(p_name)", t=load(s, d, "part"))


@query("date_advance", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST((greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')) // 7 + 1) * 7 AS INTEGER) AS v FROM orders WHERE o_orderdate <= DATE '2002-01-01'")
def _(s, d):
    o = load(s, d, "orders").where("o_orderdate <= date'2002-01-01'")
    return o.select("o_orderkey", sc.date_advance(F.to_date("o_orderdate"), "Weekly", F.lit("2002-01-01").cast("date")).alias("v"))


@query("composite_key", "SELECT l_orderkey, l_linenumber, l_partkey, length(CAST(l_orderkey AS VARCHAR)) || ':' || l_orderkey || '|' || length(l_returnflag) || ':' || l_returnflag AS v FROM lineitem")
def _(s, d):
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sc.composite_key(F.col("l_orderkey"), F.col("l_returnflag")).alias("v"))


@query(
    "hash_fnv1a",
    """WITH RECURSIVE h AS (SELECT r_name, 0 AS k, CAST(2166136261 AS BIGINT) AS v FROM region
    UNION ALL SELECT r_name, k + 1, CAST((CAST(xor(v, CAST(ascii(substr(r_name, k + 1, 1)) AS BIGINT)) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT) FROM h WHERE k < length(r_name))
    SELECT r_name, v FROM h WHERE k = length(r_name)""",
)
def _(s, d):
    return load(s, d, "region").select("r_name", sc.fnv1a_32(F.col("r_name")).alias("v"))


@query(
    "crc32c",
    """WITH RECURSIVE h AS (SELECT r_name, 0 AS bit, CAST(4294967295 AS BIGINT) AS v FROM region
    UNION ALL SELECT r_name, bit + 1, CASE WHEN w & 1 = 1 THEN xor(w >> 1, CAST(2197175160 AS BIGINT)) ELSE w >> 1 END FROM (
      SELECT r_name, bit, CASE WHEN bit % 8 = 0 THEN xor(v, CAST(ascii(substr(r_name, bit // 8 + 1, 1)) AS BIGINT)) ELSE v END AS w FROM h WHERE bit < 8 * length(r_name)))
    SELECT r_name, xor(v, CAST(4294967295 AS BIGINT)) AS crc FROM h WHERE bit = 8 * length(r_name)""",
)
def _(s, d):
    return load(s, d, "region").select("r_name", sc.crc32c(F.col("r_name")).alias("crc"))


@query("delta_codec", "SELECT event_id, user_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta, event_id AS value FROM events")
def _(s, d):
    from tessera.operators.changes import deltas, undelta

    e = load(s, d, "events").select("event_id", "user_id")
    return undelta(deltas(e, ["event_id"], "event_id", ["user_id"]), ["event_id"], ["user_id"])


@query("sequence_ids", "SELECT c_name, (SELECT max(c_custkey) FROM customer WHERE c_custkey % 3 = 0) + row_number() OVER (ORDER BY c_name) AS id FROM customer WHERE c_custkey % 3 <> 0")
def _(s, d):
    """New rows get ids after the largest of the rows that have one, whose keys have gaps."""
    from tessera.operators.changes import next_ids

    c = load(s, d, "customer")
    return next_ids(c.where("c_custkey % 3 <> 0").select("c_name"), ["c_name"], c.where("c_custkey % 3 = 0"), "c_custkey").select("c_name", "id")


# -- validation


def _check(name: str, table: str, key: str, rule, sql: str):
    @query(name, f"SELECT {key}, {sql} AS ok FROM {table}")
    def _(s, d):
        df = load(s, d, table)
        return df.select(key, rule(df).alias("ok"))


_check("val_length", "part", "p_partkey", lambda df: va.length(F.col("p_name"), 9, 11), "length(p_name) BETWEEN 9 AND 11")
_check("val_range", "part", "p_partkey", lambda df: va.in_range(F.col("p_size").cast("string"), 5, 30), "p_size BETWEEN 5 AND 30")
_check("val_regex", "part", "p_partkey", lambda df: va.matches(F.col("p_brand"), r"\ABrand#[0-9]\z"), "regexp_full_match(p_brand, 'Brand#[0-9]')")
_check("val_email", "customer", "c_custkey", lambda df: va.email(F.concat(F.col("c_name"), F.lit("@example.com"))), "c_name NOT LIKE '% %'")
_check("val_phone", "customer", "c_custkey", lambda df: va.phone(F.col("c_custkey").cast("string")), "length(CAST(c_custkey AS VARCHAR)) >= 7")
_check("val_url", "pages", "page_id", lambda df: va.url(F.col("url")), "regexp_matches(lower(url), '^https?://[^/?#\\s]+')")
_check("val_rule", "orders", "o_orderkey", lambda df: va.rule(df, "o_totalprice > 1000"), "o_totalprice > 1000")


@query("val_entity", "SELECT p_partkey, list_filter([CASE WHEN p_size > 25 THEN 'too large' END, CASE WHEN length(p_name) < 9 THEN 'short name' END], lambda m: m IS NOT NULL) AS errors FROM part")
def _(s, d):
    df = load(s, d, "part")
    return va.validate(df, {"too large": F.col("p_size") <= 25, "short name": va.length(F.col("p_name"), 9)}).select("p_partkey", "errors")


# -- actions


@query("act_assert", "SELECT o_orderkey, list_filter([CASE WHEN o_totalprice <= 100000 THEN 'error: too cheap' END, CASE WHEN o_orderstatus = 'P' THEN 'warning: pending' END], lambda m: m IS NOT NULL) AS problems FROM orders")
def _(s, d):
    steps = [ac.Assert(x("gt", field("o_totalprice"), lit(100000)), "too cheap"), ac.Assert(x("ne", field("o_orderstatus"), lit("P")), "pending", "warning")]
    return ac.apply(load(s, d, "orders"), steps).select("o_orderkey", "problems")


@query("act_set", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(s, d):
    return ac.apply(load(s, d, "orders"), [ac.Set("o_orderstatus", lit("X"), x("gt", field("o_totalprice"), param("least")))], {"least": 300000}).select("o_orderkey", "o_orderstatus")


@query("act_calc", "SELECT o_orderkey, round(o_totalprice * 1.1, 4) AS o_totalprice FROM orders")
def _(s, d):
    return ac.apply(load(s, d, "orders"), [ac.Set("o_totalprice", x("mul", field("o_totalprice"), lit(1.1)))]).select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query(
    "act_forset",
    """SELECT o_orderkey, coalesce(arg_max(l_quantity, struct_pack(a := l_linenumber, b := l_partkey, c := l_quantity)) FILTER (l_quantity > 10), any_value(o_totalprice)) AS o_totalprice
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def _(s, d):
    step = ac.ForEach("items", "o_totalprice", item("l_quantity"), x("gt", item("l_quantity"), lit(10)))
    return ac.apply(_orders_with_items(s, d), [step]).select("o_orderkey", "o_totalprice")


@query("act_forset_seq", "SELECT o_orderkey, round(any_value(o_totalprice) + sum(l_quantity), 4) AS o_totalprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(s, d):
    step = ac.ForEach("items", "o_totalprice", x("add", field("o_totalprice"), item("l_quantity")), running=True)
    return ac.apply(_orders_with_items(s, d), [step]).select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("act_invoke", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(s, d):
    out = ac.invoke(load(s, d, "orders"), load(s, d, "customer"), "o_custkey", "c_custkey", [ac.Set("c_acctbal", lit(0))], x("gt", field("o_totalprice"), lit(400000)))
    return out.select("c_custkey", "c_acctbal")


@query("act_commit", "SELECT o_orderkey, CASE WHEN o_totalprice > 1000 AND o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(s, d):
    steps = [ac.Assert(x("gt", field("o_totalprice"), lit(1000)), "too cheap"), ac.Set("o_orderstatus", lit("F"), x("eq", field("o_orderstatus"), lit("P")))]
    return ac.apply(load(s, d, "orders"), steps).select("o_orderkey", "o_orderstatus")


@query("computed_lookup", "SELECT o_orderkey, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    return jn.lookup(load(s, d, "orders"), "o_custkey", load(s, d, "customer"), "c_custkey", "c_mktsegment", "segment").select("o_orderkey", "segment")
