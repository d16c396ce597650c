"""Tables written: replaced, appended to, upserted by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _project(df: DataFrame, header: list[str]) -> DataFrame:
    """The header's columns as strings; missing columns and nulls are empty."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in header])


def overwrite(df: DataFrame, path: str, header: list[str]) -> None:
    """Replaces a table of strings."""
    _project(df, header).write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str, header: list[str]) -> None:
    """Adds rows; a table that is not there begins with them."""
    _project(df, header).write.mode("append").parquet(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Adds rows as JSON lines, never touching older files."""
    df.write.mode("append").json(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows whose key is not among the new ones, and the new ones. Null keys of old rows stay."""
    keys = new.select(key).filter(F.col(key).isNotNull()).distinct()
    return old.join(keys, key, "left_anti").unionByName(new, allowMissingColumns=True)


def merged(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """The base rows, and those of more whose key the base lacks; of more's rows with one key one stays. Null keys of more are left out."""
    fresh = more.filter(F.col(key).isNotNull()).join(base.select(key), key, "left_anti").dropDuplicates([key])
    return base.unionByName(fresh, allowMissingColumns=True)


def upsert(spark: SparkSession, new: DataFrame, path: str, key: str) -> str:
    """Writes the upserted table as a new version below path and returns that version's path.

    A version is a folder of its own: nothing is read and replaced in one job, and a job that dies leaves the
    last version whole. latest() finds it.
    """
    now = latest(spark, path)
    whole = upserted(spark.read.parquet(now), new, key) if now else new
    at = f"{path}/v={1 + (int(now.rsplit('v=', 1)[1].split('-')[0]) if now else 0):08d}-{uuid.uuid4().hex[:8]}"
    whole.write.parquet(at)
    return at


def latest(spark: SparkSession, path: str) -> str | None:
    """The path of the newest complete version, None if there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    done = [s.getPath() for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((x.toString() for x in done), default=None)


def audit(spark: SparkSession, path: str, action: str, symbol: str, reviewer: str, note: str = "") -> None:
    """Adds one line (at, action, symbol, reviewer, note) to an audit log; a reviewer must be named."""
    if not reviewer.strip():
        raise ValueError("a reviewer must be named")
    row = spark.createDataFrame([(action, symbol, reviewer, note)], "action string, symbol string, reviewer string, note string")
    append_lines(row.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "*"), path)
