import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import oracles, queries
from tests.llm.test_packing import one_at_a_time
from tests.llm.test_substring import check_against_windows

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (name, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_stages_keep_the_columns(spark, stages):
    want = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    for _, df in stages[:-1]:
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in want]


def test_quality_keeps_good_and_drops_bad(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    left = labels.join(stages[0][1], "doc_id", "left_semi").groupBy("quality").count().collect()
    whole = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    left = {r.quality: r["count"] for r in left}
    assert left[1] > 0.97 * whole[1] and left.get(0, 0) < 0.1 * whole[0]


def test_one_of_each_class_stays(stages):
    before, after = stages[0][1].select("text").distinct().count(), stages[1][1]
    assert after.count() == after.select("text").distinct().count() <= before


def test_same_classes_as_sql(stages, tmp_path):
    """The documents that stay are the first of the classes that exact SQL finds among those before."""
    con = duckdb.connect()
    stages[0][1].write.parquet(str(tmp_path / "d"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = {r[0] for r in con.execute(f"SELECT DISTINCT class_id FROM ({oracles.NEAR_DUPLICATES})").fetchall()}
    assert {r.doc_id for r in stages[1][1].select("doc_id").collect()} == want


def test_same_mixture_as_sql(stages, tmp_path):
    con = duckdb.connect()
    stages[2][1].write.parquet(str(tmp_path / "d"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = {d: n for d, n in con.execute(f"SELECT doc_id, mix_copies FROM ({oracles.MIXING})").fetchall() if n}
    assert {r.doc_id: r["count"] for r in stages[3][1].groupBy("doc_id").count().collect()} == want
    assert set(want.values()) > {1} and len(want) < stages[2][1].count()


def test_passages_go_by_brute_force(stages):
    old = {r.doc_id: r.text for r in stages[1][1].collect()}
    new = {r.doc_id: r.text for r in stages[2][1].collect()}
    check_against_windows(old, new)


def test_as_few_sequences_as_one_at_a_time(stages):
    lengths = [r.length for r in stages[4][1].select("length").collect()]
    assert stages[4][1].select("sequence_id").distinct().count() <= len(one_at_a_time(lengths, 1024)) + 4


def test_text_and_length_agree(stages):
    assert stages[2][1].where(F.length("text") != F.col("n_chars")).count() == 0
    assert stages[2][1].count() == stages[1][1].count()


def test_packed_whole(spark, stages):
    mixed, packed = stages[3][1], stages[4][1]
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.where("n <> end or n > 1024").count() == 0
    pieces = packed.where("piece = 0").count()
    assert pieces == mixed.count()


def test_run_is_the_stages(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = (sorted(map(tuple, df.select(*key).collect())) for df in (cp.run(spark, FOLDER), stages[-1][1]))
    assert a == b


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{k}" for k in range(1, 11)]


def test_documents_with_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame([(None, None, None, None, None), (5000, "", "en", "src1", 0), (5001, None, "en", "src1", None), (5002, "word " * 60_000, None, None, 300_000), (5, "another five", "en", "src1", 12)], docs.schema)
    odd.unionByName(docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() > 0


def test_extra_columns_with_our_names(spark, tmp_path):
    names = ["predicted", "score", "held_out", "_all", "_row", "_text", "_src", "_u", "_copy", "_class", "mix_copies", "links", "length"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 80")
    docs.select("*", *[F.lit(f"x{k}").alias(n) for k, n in enumerate(names)]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in cp.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert [r[n] for r in df.limit(1).collect() for n in names] == [f"x{k}" for k in range(len(names))]
    assert cp.run(spark, str(tmp_path)).count() > 0


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
