"""Structured Streaming over event tables: windows, sessions, upserts and per-client state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.changes import latest, maintain


def stream_files(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling(events: DataFrame, when: str, size: str, late: str, keys: list[str] = ()) -> DataFrame:
    """Counts and sums by window; on a stream, windows close ``late`` after their end."""
    events = events.withColumn("_t", F.col(when).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("_t", late)
    found = events.groupBy(F.window("_t", size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sliding(events: DataFrame, when: str, size: str, step: str, late: str) -> DataFrame:
    """Latency figures of overlapping windows."""
    events = events.withColumn("_t", F.col(when).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("_t", late)
    found = events.groupBy(F.window("_t", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "low", "high", "mean")


def sessions(events: DataFrame, when: str, gap: str, key: str, late: str) -> DataFrame:
    """Runs of a key's events with no pause of ``gap`` or more."""
    events = events.withColumn("_t", F.col(when).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("_t", late)
    found = events.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_stream(log: DataFrame, key: str, seq: str, op: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``path``/<batch> at the newest row of each key; deletes stay as tombstones until the reader drops them.

    Each batch writes a new version from the one before, so a batch that is run again gives the same version."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = latest(batch, key, seq)
        if number:
            newest = latest(newest.unionByName(spark.read.parquet(f"{path}/{number - 1}").select(*newest.columns)), key, seq)
        newest.write.mode("overwrite").parquet(f"{path}/{number}")

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def projection_stream(log: DataFrame, key: str, value: str, seq: str, op: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a secondary index in step with the commits: after batch n it is in ``path``/<n>, and the one before the last
    may go. A batch that is run again gives the same index."""

    def step(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.parquet(f"{path}/{number - 1}") if number else None
        maintain(old, batch, key, value, seq, op).write.mode("overwrite").parquet(f"{path}/{number}")

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


CLIENT = "client long, n long, last_seen double, window_start double, window_n long, suspicious boolean, blocked boolean"


def advance(state: tuple, seconds: float, limit: int, lowered: int, width: float) -> tuple:
    """One request: (n, last_seen, window_start, window_n, suspicious, blocked) after it.

    The window starts anew at the first request after it has expired. Over the limit a client is blocked and from then
    on suspicious, with the lower limit."""
    n, _, start, inside, suspicious, _ = state
    if start is None or seconds - start >= width:
        start, inside = seconds, 0
    inside += 1
    blocked = inside > (lowered if suspicious else limit)
    return n + 1, seconds, start, inside, suspicious or blocked, blocked


EMPTY = (0, None, None, 0, False, False)


def advance_all(state: tuple, times: np.ndarray, limit: int, lowered: int, width: float) -> tuple:
    """``advance`` over requests in order, a window at a time: where it ends is found by binary search, and what its requests
    do to the state follows from how many they are."""
    n, seen, start, inside, suspicious, blocked = state
    at = 0
    while at < len(times):
        if start is None or times[at] - start >= width:
            start, inside = float(times[at]), 0
        end = max(at + 1, int(np.searchsorted(times, start + width)))
        while end < len(times) and times[end] - start < width:  # where the sum was rounded
            end += 1
        while end > at + 1 and times[end - 1] - start >= width:
            end -= 1
        last = inside + end - at
        if suspicious:
            blocked = last > lowered
        else:
            crossed = max(limit, inside) + 1  # the request that is the first over the limit
            suspicious = last >= crossed
            blocked = suspicious and (last == crossed or last > lowered)
        inside, at = last, end
    return (n + len(times), float(times[-1]), start, inside, suspicious, blocked) if len(times) else state


def pruned(states: DataFrame, now: Column | float, idle: float) -> DataFrame:
    """Client states that were seen in the last ``idle`` seconds."""
    return states.where(F.col("last_seen") >= F.lit(now) - F.lit(idle))


def clients(events: DataFrame, client: str, when: str, limit: int, lowered: int, width: float = 1.0, idle: int | None = None) -> DataFrame:
    """The state of each client after its events in order; with ``idle``, without clients that have been idle for more than
    so many milliseconds: on a batch at the time of the last event, on a stream, which keeps state between batches, by a
    timer of each state."""
    rows = events.select(F.col(client).cast("long").alias("client"), (F.unix_micros(F.col(when).cast("timestamp")) / 1e6).alias("t"))

    names = [f.split()[0] for f in CLIENT.split(", ")]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by client and time; a batch and one client's state are held, however many events it has."""
        now, state = None, EMPTY
        for pdf in frames:
            out, c, t = [], pdf["client"].to_numpy(), pdf["t"].to_numpy()
            edges = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
            for low, high in zip(edges, edges[1:]) if len(c) else ():
                if c[low] != now:
                    if now is not None:
                        out.append((now, *state))
                    now, state = int(c[low]), EMPTY
                state = advance_all(state, t[low:high], limit, lowered, width)
            if out:
                yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([(now, *state)], columns=names)

    if not events.isStreaming:
        states = rows.where("client is not null").repartition("client").sortWithinPartitions("client", "t").mapInPandas(fold, CLIENT)
        if idle is None:
            return states
        now = rows.agg(F.max("t").alias("_now"))  # one row
        return pruned(states.crossJoin(F.broadcast(now)), F.col("_now"), idle / 1000).drop("_now")

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else EMPTY
        now = advance_all(now, np.sort(np.concatenate([p["t"].to_numpy() for p in parts])), limit, lowered, width)
        state.update(now)
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame([(key[0], *now)], columns=names)

    kept = CLIENT.removeprefix("client long, ")
    return rows.groupBy("client").applyInPandasWithState(keep, CLIENT, kept, "update", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
