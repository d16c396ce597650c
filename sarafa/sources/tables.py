"""Tables kept for a time, tables of strings read tolerantly, and models asked row by row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarafa.sources.sinks import latest


def kept(spark: SparkSession, path: str, build: Callable[[], DataFrame], most_seconds: float, force: bool = False) -> DataFrame:
    """The newest version of a table below path, built anew when it is older than that, absent, or forced."""
    at = None if force else latest(spark, path)
    if at is not None:
        jvm = spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")
        fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if time.time() - fs.getFileStatus(done).getModificationTime() / 1000 <= most_seconds:
            return spark.read.parquet(at)
    newest = latest(spark, path)
    number = 1 + int(newest.rsplit("v=", 1)[1]) if newest else 1
    build().write.mode("overwrite").parquet(f"{path}/v={number:08d}")
    return spark.read.parquet(f"{path}/v={number:08d}")


def tolerant(strings: DataFrame, kinds: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns of strings cast to kinds (name -> (type, default)); missing columns and bad cells become the default."""
    return strings.select(*[F.coalesce((F.col(f"`{c}`").try_cast(t) if c in strings.columns else F.lit(None).cast(t)), F.lit(d).cast(t)).alias(c) for c, (t, d) in kinds.items()])


def ask(prompts: DataFrame, client: Callable[[str, str], str], text_column: str = "prompt", system: str = "") -> DataFrame:
    """prompts with answer: what the client (system, prompt) -> text says; NULL where it fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for p in frame[text_column]:
                try:
                    answers.append(client(system, p))
                except Exception:  # one failed answer is an abstention
                    answers.append(None)
            yield frame.assign(answer=answers)

    fields = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes)
    return prompts.mapInPandas(run, f"{fields}, answer string")
