import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import changes as ch
from tessera.operators import graphs, joins, search, spatial
from tessera.plans.entities import Catalog, Entity, sample_catalog
from tessera.plans.explain import History
from tessera.plans.report import Report, from_definition, with_parameters
from tessera.plans.view import Materialised, Projection, View, ViewJoin
from tessera.sources import files

FOLDER = "/root/testdata/sf0.001"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc', 1.5), (2, None, None), (3, "plain", 2.0)], "id int, s string, x double")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(map(tuple, back.select("id", "s", "x").collect())) == sorted(map(tuple, df.collect()))
    assert [r.line for r in files.csv_line(df).collect()] == ['1,"a,""b""\nc",1.5', "2,,", "3,plain,2.0"]


def test_csv_import_counts(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name\n1,ann\n2,bob\nx,bad\n9,new\n\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    current = spark.createDataFrame([(1, "old"), (5, "stays")], schema)
    after, counts = files.import_rows(current, files.read_csv(spark, str(tmp_path / "in.csv"), schema).cache(), "id")
    assert sorted(map(tuple, after.collect())) == [(1, "ann"), (2, "bob"), (5, "stays"), (9, "new")]
    assert tuple(counts.first()) == (2, 1, 1)


@pytest.mark.parametrize("form", ["simple", "flat", "sheets", "hierarchical"])
def test_exports(spark, tmp_path, form):
    df = spark.createDataFrame([(1, [("a", 2)]), (2, [])], "id int, items array<struct<k:string,n:int>>")
    files.export(df, str(tmp_path / "out"), form, "id", "items")
    if form == "hierarchical":
        assert spark.read.json(str(tmp_path / "out")).count() == 2
    else:
        assert spark.read.csv(str(tmp_path / "out" / ("items" if form == "sheets" else "")), header=True).count() == 2
    with pytest.raises(ValueError):
        files.export(df, str(tmp_path / "x"), "other")


def test_snapshot_and_replay(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "upsert", "a"), (2, 2, "upsert", "b"), (1, 3, "upsert", "c"), (3, 4, "upsert", "d"), (2, 5, "delete", None)], "k int, seq int, op string, v string")
    kept = files.snapshot(log.where("seq <= 3"), str(tmp_path / "s"), "k", "seq", "op")
    assert files.differences(files.replay(kept, log, "k", "seq", "op"), ch.latest(log, "k", "seq", "op")).count() == 0
    assert files.compact(log, str(tmp_path / "c"), "k", "seq", "op").count() == 2
    grown = files.command(spark.createDataFrame([], "key int, op string, seq int, fields string"), 7, "upsert", 1, name="x")
    assert tuple(grown.first()) == (7, "upsert", 1, '{"name": "x"}')


def test_index_log_expiry_and_patch(spark):
    log = spark.createDataFrame([("x", 1, 1, "A", None), ("x", 2, 2, "A", 5), ("x", 1, 3, "D", None), ("y", 3, 4, "A", 50)], "v string, id int, seq int, op string, expires int")
    assert [tuple(r) for r in ch.index_log(log, "v", "id", "seq", "op", F.lit(10), "expires").collect()] == [("y", 3)]
    rows = spark.createDataFrame([(1, "a", 3)], "k int, v string, version int")
    delta = spark.createDataFrame([(1, 3, None)], "k int, version int, v string")
    assert ch.patch(rows, delta, "k", "version").first().asDict() == {"k": 1, "v": "a", "version": 4, "status": "applied"}


def test_report_null_keys_and_errors(spark):
    a = spark.createDataFrame([("X", 1), (None, 2)], "k string, n int")
    b = spark.createDataFrame([("x", 10), (None, 20)], "k string, m int")
    cat = Catalog([Entity("a", "n", lambda: a), Entity("b", "m", lambda: b)])
    got = Report(cat, "a").join("a", "k", "b", "k").select("a.n", "b.m").run().collect()
    assert sorted(map(tuple, got)) == [(1, 10), (2, 20)]
    with pytest.raises(ValueError):
        cat["c"]
    with pytest.raises(ValueError):
        Report(cat, "a").where("a.zzz", "eq", 1).run()
    assert with_parameters("{x}-{y}", {"x": 1}, {"y": 2}) == "1-2"
    with pytest.raises(ValueError):
        with_parameters("{z}", {})
    assert Report(cat, "a").left_join("a", "k", "b", "k").run().columns == ["k", "n"]
    d = {"root": "a", "columns": [{"field": "n", "label": "N"}], "filters": [{"field": "n", "operator": "in", "value": "1,2"}], "limit": 1, "sorts": [{"label": "N", "descending": True}]}
    assert [tuple(r) for r in from_definition(cat, d).run().collect()] == [(2,)]


def test_view_right_rows_and_cache(spark):
    cat = sample_catalog(spark, FOLDER)
    v = View("v", "nation", (Projection("n_name"), Projection("r_name", "region", "r")), (ViewJoin("nation", "n_regionkey", "region", "r_regionkey", "full"),))
    kept = Materialised(cat)
    assert kept.get(v).count() == 25 and kept.get(v) is kept.get(v) and kept.computed == 1
    assert kept.changed("Region") == ["v"] and kept.changed("orders") == []
    kept.get(v)
    assert kept.computed == 2
    h = History(2)
    for k in range(3):
        h.run(str(k), spark.range(k))
    assert [(r.name, r.rows) for r in h] == [("2", 2), ("1", 1)]


def test_first_match_and_lookup(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, fk int")
    b = spark.createDataFrame([(5, "late", 2), (5, "first", 1)], "k int, v string, o int")
    got = joins.join_first(a, b, "fk", "k", [F.col("o")]).select("id", "v").collect()
    assert sorted(map(tuple, got)) == [(1, "first"), (2, None), (3, None)]
    shown = joins.lookup_display(a, "fk", b.where("o = 1"), "k", "v", "d").select("id", "d").collect()
    assert sorted(map(tuple, shown)) == [(1, "first"), (2, "6"), (3, None)]


def test_graph_cycles(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (2, 3, "a"), (3, 1, "a"), (3, 4, "b")], "src int, dst int, kind string")
    start = spark.createDataFrame([(1,)], "node int")
    assert {(r.node, r.depth) for r in graphs.traverse(edges, start, 5).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {r.node for r in graphs.traverse(edges, start, 5, "a").collect()} == {1, 2, 3}
    assert {r.node for r in graphs.traverse(edges, start, 0).collect()} == {1}
    members, nested = spark.createDataFrame([("u", 1)], "who string, grp int"), edges.select(F.col("src").alias("grp"), F.col("dst").alias("parent"))
    assert {r.grp for r in graphs.closure(members, nested).collect()} == {1, 2, 3, 4}


def test_search_tiers(spark):
    df = spark.createDataFrame([(1, "cart"), (2, "cartoon"), (3, "gocart"), (4, "x carts y"), (5, None)], "id int, t string")
    find = lambda text: sorted(r.id for r in search.inverted(df, "id", ["t"], text).collect())
    assert find("cart") == [1] and find("carto") == [2] and find("ocart") == [3] and find("rt") == [1, 2, 3, 4] and find("CART toon") == [1, 2] and find("  ") == []
    with pytest.raises(ValueError):
        search.search(df, "id", ["t"], "x", "other")


def test_spatial(spark):
    df = spark.createDataFrame([(1, 0.0, 179.9), (2, 0.0, -179.9), (3, 89.9, 10.0), (4, 0.0, 0.0)], "k int, lat double, lng double")
    assert {r.k for r in spatial.in_radius(df, (0.0, 179.95), 50).collect()} == {1, 2}
    assert [r.k for r in spatial.nearest(df, (0.0, 1.0), 2, "k").collect()] == [4, 3]
    assert {r.k for r in spatial.by_token(df, "0,0,10").collect()} == {4}
    with pytest.raises(ValueError):
        spatial.parse_token("1,2")


@pytest.mark.parametrize("master, fine", [("local[4]", True), ("local", True), ("local-cluster[2,1,512]", False), ("spark://host:7077", False), ("yarn", False)])
def test_scratch_is_shared_or_an_error(master, fine):
    """Only a single machine may do without a folder that all executors share."""
    from types import SimpleNamespace

    from tessera.sources.scratch import shared

    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    if fine:
        assert "tessera" in shared(session)
    else:
        with pytest.raises(ValueError):
            shared(session)
    context.getCheckpointDir = lambda: "hdfs://shared/checkpoints"
    assert shared(session) == "hdfs://shared/checkpoints"
