import pytest
from pyspark.sql import functions as F

from tessera.functions.semantics import below, ci_eq, literal, parse_list
from tessera.operators.filters import CANONICAL, Clause, Group, QueryDefinition, Sort, condition, filtered, from_graphql, from_json, from_lookup, from_querystring, from_tool, operator
from tessera.operators.sorting import page_with_total, run_query, truncated

ROWS = [(1, "Ann", 5.0, ["a", "B"]), (2, "bob", None, ["c"]), (3, None, 7.5, None), (4, "ANNA", -1.0, []), (5, "", 5.0, ["b"])]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, name string, x double, tags array<string>")


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    "clause, want",
    [
        (Clause("name", "eq", "ANN"), [1]), (Clause("name", "eq", None), [3]), (Clause("name", "ne", "ann"), [2, 3, 4, 5]), (Clause("name", "ne", None), [1, 2, 4, 5]),
        (Clause("NAME", "contains", "nn"), [1, 4]), (Clause("name", "contains", None), []), (Clause("name", "startswith", "AN"), [1, 4]), (Clause("name", "endswith", "B"), [2]),
        (Clause("name", "in", "ann, 'BOB'"), [1, 2]), (Clause("name", "notin", "ann, 'BOB'"), [3, 4, 5]), (Clause("name", "in", None), []), (Clause("name", "notin", None), [1, 2, 3, 4, 5]),
        (Clause("x", "lt", 5), [2, 4]), (Clause("x", "le", "5"), [1, 2, 4, 5]), (Clause("x", "gt", 5), [3]), (Clause("x", ">=", 5.0), [1, 3, 5]),
        (Clause("x", "lt", None), []), (Clause("x", "le", None), [2]), (Clause("x", "gt", None), [1, 3, 4, 5]), (Clause("x", "ge", None), [1, 2, 3, 4, 5]),
        (Clause("tags", "contains", "b"), [1, 5]), (Clause("tags", "contains", ["C", "z"]), [2]), (Clause("id", "in", [1, "4"]), [1, 4]), (Clause("name", "gt", "anna"), [2]),
    ],
)
def test_clause(df, clause, want):
    assert ids(filtered(df, clause)) == want


def test_groups(df):
    assert ids(df.where(condition(df, Group()))) == [1, 2, 3, 4, 5] and ids(df.where(condition(df, Group(any_of=True)))) == []
    either = Group((Clause("id", "eq", 1), Clause("id", "eq", 2)), any_of=True)
    assert ids(filtered(df, either, Clause("x", "ge", 0))) == [1]


def test_errors(df):
    for bad in (Clause("none", "eq", 1), Clause("x", "wat", 1), Clause("id", "eq", "seven")):
        with pytest.raises(ValueError):
            filtered(df, bad)
    assert operator("<>") == operator("NotEquals") == "ne" and set(CANONICAL.values()) == {"eq", "ne", "contains", "startswith", "endswith", "in", "notin", "gt", "lt", "ge", "le"}


def test_sort_and_page(df):
    order = lambda *s, **k: [r.id for r in run_query(df, QueryDefinition(sorts=s, **k), "id").collect()]
    assert order(Sort("x")) == [2, 4, 1, 5, 3] and order(Sort("x", True)) == [3, 1, 5, 4, 2]
    assert order(Sort("name")) == [3, 5, 1, 4, 2] and order(Sort("name"), skip=1, top=2) == [5, 1]
    page, total = page_with_total(df, QueryDefinition(Group((Clause("x", "gt", 0),)), top=1), "id")
    assert page.count() == 1 and total.first().total == 3
    assert truncated(df, 4) and not truncated(df, 5)


def test_builders(df):
    assert ids(run_query(df, from_json({"logic": "or", "clauses": [{"field": "id", "op": "=", "value": 1}], "groups": [{"clauses": [{"field": "x", "operator": "GreaterThan", "value": 7}]}]}))) == [1, 3]
    assert ids(run_query(df, from_querystring(df, {"q": "nn"}), "id")) == [1, 4]
    assert ids(run_query(df, from_querystring(df, {"f_name": "an", "f_id": "4"}), "id")) == [4]
    assert from_querystring(df, {"top": "99999"}).top == 10_000 and from_querystring(df, {"top": "0"}).top == 1
    assert from_lookup({}).top == 200 and from_tool({}).top == 50 and from_tool({"top": 900}).top == 200
    assert ids(run_query(df, from_graphql({"name": "BOB", "take": 5}), "id")) == [2]


def test_values(spark):
    assert parse_list('[a, "b",,\'c\']') == ["a", "b", "c"] and parse_list(None) == []
    one = spark.range(1).select(ci_eq(F.lit("A"), F.lit("a")).alias("a"), ci_eq(F.lit(None), F.lit("a")).alias("b"), below(F.lit(None).cast("int"), F.lit(1)).alias("c"), below(F.lit(1), F.lit(None).cast("int")).alias("d")).first()
    assert (one.a, one.b, one.c, one.d) == (True, False, True, False)
    with pytest.raises(ValueError):
        literal("x", spark.range(1).schema["id"].dataType)


def test_equality_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = filtered(df, Clause("l_quantity", "gt", 45), Clause("l_orderkey", "eq", 7)).select("l_tax")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "EqualTo(l_orderkey,7)" in plan and "l_shipdate" not in plan
