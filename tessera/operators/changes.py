"""Change logs: newest rows, patches, audit trails, index logs, subscriptions, rolling measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import settle


def latest(log: DataFrame, key: str, seq: str, op: str | None = None) -> DataFrame:
    """The newest row of each key; keys whose newest op is delete are gone. A partial aggregate, not a sort."""
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(key, "_row.*")
    return newest.where(F.col(op) != "delete") if op else newest


def latest_value(log: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    return log.groupBy(key).agg(F.max_by(value, seq).alias(value))


def patch(rows: DataFrame, deltas: DataFrame, key: str, version: str, read_only: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a status: applied (version grown by one, given fields taken), conflict (other version) or unchanged.

    deltas has the key, the expected version, and a null for each field that stays."""
    fields = [c for c in deltas.columns if c in rows.columns and c not in (key, version, *read_only)]
    side = deltas.select(F.col(key).alias("_key"), F.col(version).alias("_version"), *[F.col(c).alias(f"_{c}") for c in fields])
    out = rows.join(side, rows[key] == side["_key"], "left")
    hit = F.col("_key").isNotNull() & F.col("_version").eqNullSafe(F.col(version))
    new = {c: F.when(hit, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in fields}
    status = F.when(hit, "applied").when(F.col("_key").isNotNull(), "conflict").otherwise("unchanged")
    grown = F.when(hit, F.col(version) + 1).otherwise(F.col(version))
    return out.withColumns({"status": status, **new, version: grown}).drop("_key", "_version", *[f"_{c}" for c in fields])


def diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, old_value, new_value (as text) of every field that differs; rows on one side differ from null."""
    a = before.select(key, *[F.col(f).cast("string").alias(f"_a{i}") for i, f in enumerate(fields)])
    b = after.select(key, *[F.col(f).cast("string").alias(f"_b{i}") for i, f in enumerate(fields)])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a{i}").alias("old_value"), F.col(f"_b{i}").alias("new_value")) for i, f in enumerate(fields)])
    found = F.explode(F.filter(each, lambda x: ~x["old_value"].eqNullSafe(x["new_value"])))
    return a.join(b, key, "full_outer").select(key, found.alias("c")).select(key, "c.*")


def index_log(log: DataFrame, value: str, key: str, seq: str, op: str, now: Column | None = None, expires: str | None = None) -> DataFrame:
    """value, id: from a log of added (A) and deleted (D) entries the live ids of each value, a row each; expired ones go."""
    newest = log.groupBy(value, key).agg(F.max_by(F.struct(op, *([expires] if expires else [])), seq).alias("_e"))
    alive = newest.where(F.col(f"_e.{op}") == "A")
    if expires:
        alive = alive.where(F.col(f"_e.{expires}").isNull() | (F.col(f"_e.{expires}") > now))
    return alive.select(F.col(value).alias("value"), F.col(key).alias("id"))


def maintain(index: DataFrame | None, commits: DataFrame, key: str, value: str, seq: str, op: str) -> DataFrame:
    """A secondary index after some more commits: key, value, seq and op of each key's newest commit. A delete stays as
    such, so that an older commit that comes late doesn't bring the entry back."""
    rows = commits.select(key, value, seq, op)
    return latest(rows if index is None else index.unionByName(rows), key, seq)


def entries(index: DataFrame, key: str, value: str, op: str) -> DataFrame:
    """value, id of the live entries."""
    return index.where(F.col(op) != "delete").select(F.col(value).alias("value"), F.col(key).alias("id"))


def replication(log: DataFrame, seq: str, after: int, epoch: int) -> DataFrame:
    """What a leader tells a follower that has come as far as ``after``: epoch, leader_lsn, after_lsn, lag, and how many
    entries it has to send."""
    return log.agg(F.lit(epoch).alias("epoch"), F.max(seq).alias("leader_lsn"), F.lit(after).cast("long").alias("after_lsn"), (F.max(seq) - after).alias("lag"), F.count_if(F.col(seq) > after).alias("pending"))


@dataclass(frozen=True)
class Subscription:
    name: str
    field: str
    old: str | None = None  # any, if None
    new: str | None = None
    priority: int = 0


def dispatch(changes: DataFrame, subscriptions: list[Subscription]) -> DataFrame:
    """Changes with the subscriptions that their transition fires, by priority. One level: nothing fires again."""
    side = changes.sparkSession.createDataFrame([(s.name, s.field, s.old, s.new, s.priority) for s in subscriptions], "subscription string, _field string, _old string, _new string, priority int")
    on = (F.col("field") == F.col("_field")) & (F.col("_old").isNull() | F.col("_old").eqNullSafe(F.col("old_value"))) & (F.col("_new").isNull() | F.col("_new").eqNullSafe(F.col("new_value")))
    return changes.join(F.broadcast(side), on).drop("_field", "_old", "_new")  # as many rows as subscriptions were given


def audit(log: DataFrame, kind: str | None = None, user: object = None, start: Column | None = None, end: Column | None = None, most: int = 100) -> DataFrame:
    """Newest entries first, by kind, user and time."""
    if kind is not None:
        log = log.where(F.col("event_type") == kind)
    if user is not None:
        log = log.where(F.col("user_id") == user)
    if start is not None:
        log = log.where(F.col("ts") >= start)
    if end is not None:
        log = log.where(F.col("ts") <= end)
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def nearest_rank(p: float, value: str) -> Column:
    """The element at place ceil(p n) of the sorted values; 0 of nothing."""
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)"), F.lit(0.0))


def summary(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """n, low, high, mean, p95, p99."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), nearest_rank(0.95, value).alias("p95"), nearest_rank(0.99, value).alias("p99"))


def status_counts(status: Column) -> dict[str, Column]:
    """Requests by the class of their status: what each counter counts."""
    between = lambda low, high: (status >= low) & (status <= high)
    ok, client, server = between(200, 299), between(400, 499), between(500, 599)
    return {"total": F.lit(True), "ok": ok, "client": client, "server": server, "other": ~(ok | client | server), "errors": status >= 500, "throttled": status == 429}


def snapshots(df: DataFrame, when: str, value: str, status: str, every: int, seconds: int) -> DataFrame:
    """tick (in seconds since 1970) and the figures that a monitor shows then: n, low, high, mean, p95 and p99 of the last
    ``seconds``, and counters by class of status of all there has been. Ticks whose window is empty have no row.

    A request goes to the ticks whose windows hold it, ``seconds`` / ``every`` of them, so figures are one aggregate by
    tick and no window is sorted; counters are sums over ticks, a row each."""
    step, width = every * 1_000_000, seconds * 1_000_000
    if step > width:
        raise ValueError("ticks may not be further apart than their windows are wide")
    rows = df.select(F.unix_micros(F.col(when).cast("timestamp")).alias("_at"), F.col(value).alias("_v"), F.col(status).alias("_s"))
    rows = rows.withColumns({"_first": F.expr(f"(_at + {step - 1}) div {step}"), "_last": F.expr(f"(_at + {width}) div {step}")})
    rows = rows.select("_v", "_s", "_first", F.explode(F.sequence("_first", "_last")).alias("_tick"))
    counters = status_counts(F.col("_s"))
    new = [F.sum((F.coalesce(hit, F.lit(False)) & (F.col("_tick") == F.col("_first"))).cast("long")).alias(name) for name, hit in counters.items()]
    out = rows.groupBy("_tick").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.avg("_v").alias("mean"), nearest_rank(0.95, "_v").alias("p95"), nearest_rank(0.99, "_v").alias("p99"), *new)
    so_far = Window.orderBy("_tick").rowsBetween(Window.unboundedPreceding, 0)  # one row a tick
    return out.select((F.col("_tick") * every).alias("tick"), "n", "low", "high", "mean", "p95", "p99", *[F.sum(name).over(so_far).alias(name) for name in counters])


def top_clients(df: DataFrame, client: str, when: str, most: int) -> DataFrame:
    """Clients with the most events, then those seen last."""
    return df.groupBy(client).agg(F.count(F.lit(1)).alias("n"), F.max(when).alias("last_seen")).orderBy(F.desc("n"), F.desc("last_seen"), client).limit(most)


def deltas(df: DataFrame, order: list[str], value: str, by: list[str]) -> DataFrame:
    """Each value less the one before it in its group; the first stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def undelta(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    return df.withColumn("value", F.sum("delta").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their place in this order, from 0.

    They are sorted by range and numbered within each partition; the partitions' counts, one row each, give the rest."""
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(at, 33), "_place": at.bitwiseAND(F.lit((1 << 33) - 1))})
    ranged = settle(ranged)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def dictionary(df: DataFrame, field: str) -> DataFrame:
    """value, code: distinct values numbered in order from 0."""
    values = df.where(F.col(field).isNotNull()).select(F.col(field).alias("value")).distinct()
    return numbered(values, ["value"], "code").withColumn("code", F.col("code").cast("int"))


def next_ids(rows: DataFrame, order: list[str], taken: DataFrame, key: str) -> DataFrame:
    """The rows with id: numbers in this order, from the one after the largest key that is taken."""
    top = taken.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_top"))  # one row
    return numbered(rows, order, "_nth").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + 1 + F.col("_nth")).drop("_top", "_nth")
