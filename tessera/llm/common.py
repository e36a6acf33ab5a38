"""What the operators share: scratch tables in the cluster's shared folder, streamed groups, hashed words."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import shared

#: Bytes of one Arrow batch, unless the session sets its own; documents may be long, so a count of rows bounds nothing.
BATCH_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wrapped(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """All columns of a row as one struct, so that no name of theirs meets one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in but]).alias("_all")


def byte_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches where the session has no bound; a batch has one row at least."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


#: Input below so many bytes a core is dealt out anew: one small file would otherwise keep all but one core idle.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows, over as many partitions as there are cores if the estimated size is small."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if estimate < cores * SPREAD_BYTES else df


class Scratch:
    """Tables written to the folder that spark.checkpoint.dir names, so that a lost executor costs no recomputation.

    Without the setting a temporary folder serves a single machine; on a cluster that is an error. Everything goes when
    the driver ends; ``drop`` frees a table earlier.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared(spark)}/{tag}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        try:
            for path in [f"{self.root}/{n}" for n in names] or [self.root]:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may have gone when the interpreter ends
            if names:
                raise


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Groups of consecutive rows with the same key, from batches sorted by it; one group is in memory at a time."""
    held: list[pa.RecordBatch] = []
    held_key: object = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(edges, edges[1:]):
            if held and held_key != k[lo]:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = k[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield held_key, pa.Table.from_batches(held)


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when it grows too large, which changes no value."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of ``width`` words; a shorter text has its whole self as its only shingle, an empty one none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def text_key(*cols: Column | str) -> Column:
    """A 64-bit key for rows that agree in these columns; null counts as a value."""
    own = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(*[x for c in own for x in (c.isNull(), c)])


def unit_hash(seed: int, *cols: Column | str) -> Column:
    """A fixed pseudo-random number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def held_out(col: Column | str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves remainder 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % 4 == 2, F.lit(False))
