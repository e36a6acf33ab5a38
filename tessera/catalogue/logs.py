"""Queries on change logs, audit trails, rolling measures and windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import changes as ch
from tessera.sources import files
from tessera.sources.scratch import folder
from tessera.streaming import streams as st

from .registry import query
from .tables import load


@query("cdc_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def _(s, d):
    log = load(s, d, "events").withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("upsert"))
    return ch.latest(log, "user_id", "event_id", "op").select("user_id", "event_type", "value")


@query(
    "cdc_delta",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CAST(CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS INTEGER) AS version,
    CASE WHEN c_custkey % 4 = 0 THEN 'applied' WHEN c_custkey % 4 = 1 THEN 'conflict' ELSE 'unchanged' END AS status FROM customer""",
)
def _(s, d):
    rows = load(s, d, "customer").select("c_custkey", "c_mktsegment", "c_name", F.lit(1).alias("version"))
    deltas = load(s, d, "customer").where("c_custkey % 4 < 2").select("c_custkey", (F.col("c_custkey") % 4 + 1).cast("int").alias("version"), F.lit("NEW").alias("c_mktsegment"), F.lit("no").alias("c_name"))
    return ch.patch(rows, deltas, "c_custkey", "version", read_only=("c_name",)).select("c_custkey", "c_mktsegment", "version", "status")


@query("cdc_projection", "SELECT arg_max(event_type, event_id) AS value, user_id AS id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def _(s, d):
    """The index after three commits, the last of which holds entries older than those before it."""
    log = load(s, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    index = None
    for third in (1, 2, 0):
        index = ch.maintain(index, log.where(F.col("event_id") % 3 == third), "user_id", "event_type", "event_id", "op")
    return ch.entries(index, "user_id", "event_type", "op")


LIVE = "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'"


def _log(s, d):
    return load(s, d, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))


@query("wal_compact", LIVE)
def _(s, d):
    return files.compact(_log(s, d), folder(s, "compact"), "user_id", "event_id", "op").select("user_id", "value")


@query("wal_snapshot", LIVE)
def _(s, d):
    return files.snapshot(_log(s, d), folder(s, "snapshot"), "user_id", "event_id", "op").select("user_id", "value")


@query("wal_replay", LIVE)
def _(s, d):
    log = _log(s, d)
    old = log.where(F.col("event_id") <= 500)
    return files.replay(files.snapshot(old, folder(s, "snapshot"), "user_id", "event_id", "op"), log, "user_id", "event_id", "op").select("user_id", "value")


@query("wal_backup", "SELECT event_id, 'left' AS side FROM events WHERE event_id % 7 = 0")
def _(s, d):
    """A backup taken before every seventh entry was written: restored, it lacks these and nothing else."""
    log, path = _log(s, d), folder(s, "backup")
    log.where(F.col("event_id") % 7 != 0).write.parquet(path)
    return files.differences(log, s.read.parquet(path)).select("event_id", "side")


@query("replicate_status", "SELECT 3 AS epoch, max(event_id) AS leader_lsn, CAST(500 AS BIGINT) AS after_lsn, max(event_id) - 500 AS lag, count(*) FILTER (event_id > 500) AS pending FROM events")
def _(s, d):
    return ch.replication(_log(s, d), "event_id", 500, 3)


@query("binary_serializer", "SELECT * FROM customer")
def _(s, d):
    path = folder(s, "binary")
    load(s, d, "customer").write.parquet(path)
    return s.read.parquet(path)


@query("payload_compression", "SELECT event_id, props FROM events")
def _(s, d):
    path = folder(s, "packed")
    load(s, d, "events").select("event_id", "props").write.option("compression", "zstd").parquet(path)
    return s.read.parquet(path)


STATUS = "CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 10 = 0 THEN 404 WHEN event_id % 10 = 1 THEN 429 WHEN event_id % 10 = 2 THEN 302 ELSE 200 END"


@query(
    "roll_metrics",
    f"""WITH timed AS (SELECT value, {STATUS} AS status, (epoch_us(ts) + 59999999) // 60000000 AS first, (epoch_us(ts) + 300000000) // 60000000 AS last FROM events),
    ticks AS (SELECT DISTINCT unnest(range(first, last + 1)) AS k FROM timed),
    recent AS (SELECT k, count(*) AS n, round(min(value), 4) AS low, round(max(value), 4) AS high, round(avg(value), 4) AS mean, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99
      FROM ticks JOIN timed ON k BETWEEN first AND last GROUP BY k),
    firsts AS (SELECT first AS k, count(*) AS total, count(*) FILTER (status // 100 = 2) AS ok, count(*) FILTER (status // 100 = 4) AS client, count(*) FILTER (status // 100 = 5) AS server,
      count(*) FILTER (status // 100 NOT IN (2, 4, 5)) AS other, count(*) FILTER (status >= 500) AS errors, count(*) FILTER (status = 429) AS throttled FROM timed GROUP BY 1)
    SELECT k * 60 AS tick, n, low, high, mean, p95, p99, {", ".join(f"CAST(sum(coalesce({c}, 0)) OVER w AS BIGINT) AS {c}" for c in ("total", "ok", "client", "server", "other", "errors", "throttled"))}
    FROM recent LEFT JOIN firsts USING (k) WINDOW w AS (ORDER BY k)""",
)
def _(s, d):
    """Each minute the figures of the last five and the counters so far."""
    out = ch.snapshots(load(s, d, "events").withColumn("status", F.expr(STATUS)), "ts", "value", "status", 60, 300)
    return out.withColumns({c: F.round(c, 4) for c in ("low", "high", "mean")})


@query("roll_percentile", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def _(s, d):
    return ch.summary(load(s, d, "events"), "value", ["event_type"]).select("event_type", "n", "p95", "p99")


@query("client_topk", "SELECT user_id, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY 1 ORDER BY n DESC, last_seen DESC, user_id LIMIT 10")
def _(s, d):
    return ch.top_clients(load(s, d, "events"), "user_id", "ts", 10)


@query(
    "client_state",
    """WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) / 1e6 AS t FROM events),
    w AS (SELECT user_id, k, t, t AS began, CAST(1 AS BIGINT) AS inside, false AS suspicious, false AS blocked FROM o WHERE k = 1
      UNION ALL SELECT user_id, k, t, began, inside, suspicious OR inside > allowed, inside > allowed FROM (
        SELECT o.user_id, o.k, o.t, CASE WHEN o.t - w.began >= 600 THEN o.t ELSE w.began END AS began, CASE WHEN o.t - w.began >= 600 THEN 1 ELSE w.inside + 1 END AS inside,
               w.suspicious, CASE WHEN w.suspicious THEN 1 ELSE 3 END AS allowed FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1))
    SELECT user_id AS client, k AS n, round(t, 3) AS last_seen, round(began, 3) AS window_start, inside AS window_n, suspicious, blocked FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""",
)
def _(s, d):
    out = st.clients(load(s, d, "events"), "user_id", "ts", limit=3, lowered=1, width=600.0)
    return out.withColumns({c: F.round(c, 3) for c in ("last_seen", "window_start")})


@query("state_prune", "SELECT user_id AS client, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def _(s, d):
    """The states that are left when those idle for two hours have gone, as a stream's timers let them go."""
    return st.clients(load(s, d, "events"), "user_id", "ts", limit=3, lowered=1, width=600.0, idle=2 * 3600 * 1000).select("client", "n")


@query("idx_secondary", "SELECT event_type AS value, user_id AS id FROM (SELECT event_type, user_id, arg_max(event_id % 3, event_id) AS op FROM events GROUP BY ALL) WHERE op <> 0")
def _(s, d):
    log = load(s, d, "events").withColumn("op", F.when(F.col("event_id") % 3 == 0, "D").otherwise("A"))
    return ch.index_log(log, "event_type", "user_id", "event_id", "op")


@query("idx_latest_value", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(s, d):
    return ch.latest_value(load(s, d, "events"), "user_id", "value", "event_id")


def _moves(s, d):
    o = load(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return ch.diff(o, o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise(F.col("o_orderstatus"))), "o_orderkey", ["o_orderstatus"])


@query(
    "event_dispatch",
    """SELECT o_orderkey, o_orderstatus AS old_value, 'F' AS new_value, subscription, CAST(priority AS INTEGER) AS priority FROM orders, (VALUES ('any', NULL, 1), ('opened', 'O', 2)) t(subscription, old, priority)
    WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'F' AND (old IS NULL OR old = o_orderstatus)""",
)
def _(s, d):
    subs = [ch.Subscription("any", "o_orderstatus", None, "F", 1), ch.Subscription("opened", "o_orderstatus", "O", "F", 2), ch.Subscription("never", "o_orderstatus", "F", "O", 3)]
    return ch.dispatch(_moves(s, d), subs).select("o_orderkey", "old_value", "new_value", "subscription", "priority").orderBy("priority")


@query("audit_history", "SELECT event_id, ts, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(s, d):
    return ch.audit(load(s, d, "events"), user=7).select("event_id", "ts", "event_type")


@query("audit_query", "SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(s, d):
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    return ch.audit(load(s, d, "events"), kind="purchase", start=lit("2024-01-02"), end=lit("2024-01-10")).select("event_id", "user_id", "ts")


@query("sched_run", "SELECT o_orderkey, CASE WHEN due THEN 'R' ELSE o_orderstatus END AS o_orderstatus, due AS ran FROM (SELECT *, o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1996-01-01' AS due FROM orders)")
def _(s, d):
    """The action runs on the rows whose interval has passed; the others stay as they are."""
    from tessera.functions.structured import lit
    from tessera.operators import actions as ac

    now = F.lit("1996-01-01").cast("timestamp_ntz")
    o = load(s, d, "orders").select("o_orderkey", "o_orderstatus", (F.expr("o_orderdate + interval 30 days") <= now).alias("ran"))
    return ac.when_due(o, "ran", [ac.Set("o_orderstatus", lit("R"))])


PERIODS = ("Daily", "Weekly", "Monthly", "Quarterly", "Yearly")


@query(
    "periodic_reset",
    """WITH RECURSIVE done AS (SELECT o_orderkey, last_day(o_orderdate) AS d, ['Daily', 'Weekly', 'Monthly', 'Quarterly', 'Yearly'][o_orderkey % 5 + 1] AS period FROM orders WHERE o_orderstatus = 'F'),
    walk AS (SELECT DISTINCT d, period, d AS next FROM done
      UNION ALL SELECT d, period, CAST(next + CASE period WHEN 'Daily' THEN INTERVAL 1 DAY WHEN 'Weekly' THEN INTERVAL 7 DAY WHEN 'Monthly' THEN INTERVAL 1 MONTH WHEN 'Quarterly' THEN INTERVAL 3 MONTH ELSE INTERVAL 1 YEAR END AS DATE) FROM walk WHERE next <= DATE '2003-02-10')
    SELECT o_orderkey, 'O' AS status, period, next FROM done JOIN walk USING (d, period) WHERE next > DATE '2003-02-10'""",
)
def _(s, d):
    """Finished orders get their next date by their own period; month ends are clamped, and stay clamped."""
    from tessera.functions.scalars import date_advance

    o = load(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.last_day(F.to_date("o_orderdate")).alias("d"), F.element_at(F.array(*map(F.lit, PERIODS)), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("period"))
    today = F.lit("2003-02-10").cast("date")
    steps = F.coalesce(*[F.when(F.col("period") == p, date_advance(F.col("d"), p, today)) for p in PERIODS])
    return o.select("o_orderkey", F.lit("O").alias("status"), "period", steps.alias("next"))


# -- windows over events, additions to what the change-driven engine has


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    out = st.tumbling(load(s, d, "events"), "ts", "1 hour", "10 minutes", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding", "SELECT b - INTERVAL 30 MINUTE * k AS start, count(*) AS n, max(value) AS high FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, value FROM events), range(0, 2) r(k) GROUP BY 1")
def _(s, d):
    return st.sliding(load(s, d, "events"), "ts", "1 hour", "30 minutes", "10 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "high")


@query(
    "stream_sessions",
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k""",
)
def _(s, d):
    return st.sessions(load(s, d, "events"), "ts", "30 minutes", "user_id", "10 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
