"""Entities in and out of files: Parquet, CSV, JSON, nested rows, change logs and snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.changes import latest


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows by header name; quoted fields may hold commas, quotes and line ends. A row that doesn't fit the schema has
    ``bad_row``, its text, and blank rows are skipped."""
    whole = T.StructType([*schema.fields, T.StructField("bad_row", T.StringType())])
    return spark.read.csv(path, schema=whole, header=True, quote='"', escape='"', multiLine=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="bad_row")


def parse_csv(column: Column, ddl: str) -> Column:
    return F.from_csv(column, F.lit(ddl) if not isinstance(ddl, str) else ddl, {"quote": '"', "escape": '"'})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"', mode="overwrite", emptyValue="")


def csv_line(df: DataFrame) -> DataFrame:
    """One text column, ``line``: fields with a comma, a quote or a line end are quoted, quotes doubled, null is empty."""

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("line"))


def import_rows(current: DataFrame, given: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table after an upsert by key, and one row of counts: created, updated, skipped (bad rows or without a key).

    Of several given rows with one key the last in the order of their columns wins."""
    fine = given.where(F.col("bad_row").isNull() & F.col(key).isNotNull()).drop("bad_row")
    rest = [c for c in fine.columns if c != key]
    fine = fine.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*")
    after = current.join(fine, key, "left_anti").unionByName(fine.select(*current.columns))
    known = current.select(key, F.lit(True).alias("_known"))
    counts = fine.select(key).join(known, key, "left").agg(F.count_if(F.col("_known").isNull()).alias("created"), F.count("_known").alias("updated"))
    skipped = given.agg(F.count_if(F.col("bad_row").isNotNull() | F.col(key).isNull()).alias("skipped"))
    return after, counts.crossJoin(skipped)  # one row each


def to_json(df: DataFrame, alias: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(alias))


def nested(df: DataFrame, key: str, items: str) -> DataFrame:
    """A row for each item of a list of structs; a parent without items has one row of nulls."""
    return df.select(key, F.explode_outer(items).alias("_i")).select(key, "_i.*")


def export(df: DataFrame, path: str, form: str, key: str = "", items: str = "") -> None:
    """simple (csv of scalar fields), flat (csv, a row an item), sheets (two csv folders) or hierarchical (json)."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if form == "simple":
        write_csv(df.select(*plain), path)
    elif form == "flat":
        write_csv(df.select(*plain, F.explode_outer(items).alias("_i")).select(*plain, "_i.*"), path)
    elif form == "sheets":
        write_csv(df.select(*plain), f"{path}/rows")
        write_csv(nested(df, key, items), f"{path}/{items}")
    elif form == "hierarchical":
        df.write.json(path, mode="overwrite")
    else:
        raise ValueError(f"unknown export form {form!r}")


def append_text(spark: SparkSession, df: DataFrame, field: str, text: str, key: str, new_key: int) -> DataFrame:
    """The table with one more row that holds the text."""
    row = {f.name: None for f in df.schema.fields} | {field: text, key: new_key}
    return df.unionByName(spark.createDataFrame([tuple(row[f.name] for f in df.schema.fields)], T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])))


def command(log: DataFrame, key: object, op: str, seq: int, **fields: object) -> DataFrame:
    """The change log with one command more (upsert, delete)."""
    row = {"key": key, "op": op, "seq": seq, "fields": json.dumps(fields, sort_keys=True)}
    return log.unionByName(log.sparkSession.createDataFrame([tuple(row[f.name] for f in log.schema.fields)], log.schema))


def compact(log: DataFrame, path: str, key: str, seq: str, op: str) -> DataFrame:
    """The log without what newer entries supersede, written anew."""
    latest(log, key, seq, op).write.parquet(path, mode="overwrite")
    return log.sparkSession.read.parquet(path)


def snapshot(log: DataFrame, path: str, key: str, seq: str, op: str) -> DataFrame:
    """Live rows and, as ``upto``, the sequence number they stand at."""
    top = log.agg(F.max(seq).alias("upto"))
    latest(log, key, seq, op).crossJoin(F.broadcast(top)).write.parquet(path, mode="overwrite")
    return log.sparkSession.read.parquet(path)


def replay(kept: DataFrame, log: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """Live rows from a snapshot and the entries after it."""
    upto = kept.agg(F.max("upto").alias("_upto"))
    newer = log.crossJoin(F.broadcast(upto)).where(F.col(seq) > F.coalesce("_upto", F.lit(-1))).drop("_upto")
    return latest(kept.select(*log.columns).unionByName(newer), key, seq, op)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only: nothing, if a replay is right."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
