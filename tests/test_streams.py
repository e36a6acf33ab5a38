import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from tessera.operators.changes import entries, maintain
from tessera.streaming import streams as st

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in three files, in order."""
    folder = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{FOLDER}/events.parquet").orderBy("event_id").toPandas()
    n = len(events) // 3 + 1
    for k in range(3):
        spark.createDataFrame(events[k * n : (k + 1) * n], spark.read.parquet(f"{FOLDER}/events.parquet").schema).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def run(query):
    query.processAllAvailable()
    query.stop()


def stream(spark, parts):
    return st.stream_files(spark, parts, spark.read.parquet(f"{FOLDER}/events.parquet").schema)


def test_tumbling_stream_equals_batch(spark, parts, tmp_path):
    q = st.tumbling(stream(spark, parts), "ts", "1 hour", "30 days", ["event_type"]).writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", str(tmp_path)).start()
    run(q)
    want = st.tumbling(spark.read.parquet(f"{FOLDER}/events.parquet"), "ts", "1 hour", "30 days", ["event_type"])
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("tumbling")) == key(want)


def test_upsert_stream_equals_latest(spark, parts, tmp_path):
    log = stream(spark, parts).withColumn("op", F.lit("upsert"))
    run(st.upsert_stream(log, "user_id", "event_id", "op", str(tmp_path / "t"), str(tmp_path / "c")))
    got = {r.user_id: r.value for r in spark.read.parquet(str(tmp_path / "t" / "2")).collect()}
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/events.parquet").orderBy("event_id").collect():
        want[r.user_id] = r.value
    assert got == want


def test_projection_stream_keeps_the_index(spark, parts, tmp_path):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    log = stream(spark, parts).withColumn("op", op)
    run(st.projection_stream(log, "user_id", "event_type", "event_id", "op", str(tmp_path / "t"), str(tmp_path / "c")))
    got = {(r.value, r.id) for r in entries(spark.read.parquet(str(tmp_path / "t" / "2")), "user_id", "event_type", "op").collect()}
    newest = {r.user_id: r.event_type for r in spark.read.parquet(f"{FOLDER}/events.parquet").orderBy("event_id").collect()}
    assert got == {(v, k) for k, v in newest.items() if v != "error"}


def test_late_commits_bring_nothing_back(spark):
    rows = lambda *r: spark.createDataFrame(r, "k long, v string, seq long, op string")
    index = maintain(None, rows((1, "a", 5, "upsert"), (2, "b", 6, "upsert")), "k", "v", "seq", "op")
    index = maintain(index, rows((1, "a", 9, "delete"), (3, "c", 7, "upsert")), "k", "v", "seq", "op")
    index = maintain(index, rows((1, "z", 8, "upsert"), (2, "y", 1, "upsert")), "k", "v", "seq", "op")
    assert sorted((r.value, r.id) for r in entries(index, "k", "v", "op").collect()) == [("b", 2), ("c", 3)]


@settings(max_examples=500, deadline=None)
@given(st_.lists(st_.integers(0, 60), max_size=40), st_.integers(1, 5), st_.integers(1, 5), st_.integers(1, 20), st_.integers(0, 40))
def test_windows_at_a_time_equal_requests_at_a_time(times, limit, lowered, width, cut):
    """In one piece or in two, whatever the limits."""
    t = np.sort(np.array(times, float)) / 8
    want = st.EMPTY
    for x in t.tolist():
        want = st.advance(want, x, limit, lowered, width / 8)
    assert st.advance_all(st.EMPTY, t, limit, lowered, width / 8) == want
    assert st.advance_all(st.advance_all(st.EMPTY, t[:cut], limit, lowered, width / 8), t[cut:], limit, lowered, width / 8) == want


def test_idle_clients_go(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    whole = {r.client: r.last_seen for r in st.clients(events, "user_id", "ts", 2, 1, 3600.0).collect()}
    kept = {r.client for r in st.clients(events, "user_id", "ts", 2, 1, 3600.0, idle=6 * 3600 * 1000).collect()}
    assert kept == {c for c, t in whole.items() if t >= max(whole.values()) - 6 * 3600} and 0 < len(kept) < len(whole)


def test_client_state_is_a_plain_loop(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    got = {r.client: tuple(r)[1:] for r in st.clients(events, "user_id", "ts", 2, 1, 3600.0).collect()}
    want = {}
    for r in events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).orderBy("t").collect():
        n, _, start, inside, sus, _ = want.get(r.user_id, (0, None, None, 0, False, False))
        if start is None or r.t - start >= 3600.0:
            start, inside = r.t, 0
        inside += 1
        blocked = inside > (1 if sus else 2)
        want[r.user_id] = (n + 1, r.t, start, inside, sus or blocked, blocked)
    assert got == want


def test_client_state_stream(spark, parts, tmp_path):
    rows = st.clients(stream(spark, parts), "user_id", "ts", 2, 1, 3600.0)
    run(rows.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out{n}"))).option("checkpointLocation", str(tmp_path / "c")).start())
    got = {}
    for n in range(3):
        got |= {r.client: r.n for r in spark.read.parquet(str(tmp_path / f"out{n}")).collect()}
    want = {r.user_id: r.n for r in spark.read.parquet(f"{FOLDER}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_window_starts_again_after_it_has_expired():
    rng, state = random.Random(1), st.EMPTY
    for t in (0.0, 0.4, 0.9, 1.0, 1.5, 5.0):
        state = st.advance(state, t + rng.random() * 0, 2, 1, 1.0)
    assert state == (6, 5.0, 5.0, 1, True, False)
