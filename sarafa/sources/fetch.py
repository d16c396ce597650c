"""A Spark data source over any fetcher: one partition per share of the keys, one row per key.

The fetcher is a function key -> text or None. A failed key gives a NULL body and the reason, so that one
bad key spoils nothing else; attempts and their pauses are options. Without network it serves files or canned answers.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "key string, body string, error string"


class _Share(InputPartition):
    def __init__(self, keys: list[str]) -> None:
        self.keys = keys


def source(name: str, fetch: Callable[[str], str | None], attempts: int = 3, pause: float = 2.0) -> type[DataSource]:
    """A data source class that reads the keys given in its option "keys", joined by commas."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.keys = [k for k in options.get("keys", "").split(",") if k]
            self.shares = max(1, int(options.get("partitions", "8")))

        def partitions(self) -> list[InputPartition]:
            return [_Share(self.keys[i :: self.shares]) for i in range(min(self.shares, max(len(self.keys), 1)))]

        def read(self, partition: _Share) -> Iterator[tuple]:
            for key in partition.keys:
                error = None
                for attempt in range(attempts):
                    try:
                        yield key, fetch(key), None
                        break
                    except Exception as e:  # any failure of a key is that key's result
                        error = f"{type(e).__name__}: {e}"
                        if attempt + 1 < attempts:
                            time.sleep(pause * (attempt + 1))
                else:
                    yield key, None, error

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Source


def read(spark: SparkSession, name: str, fetch: Callable[[str], str | None], keys: list[str], **options) -> DataFrame:
    """(key, body, error) of all keys."""
    spark.dataSource.register(source(name, fetch, int(options.pop("attempts", 3)), float(options.pop("pause", 2.0))))
    return spark.read.format(name).options(keys=",".join(keys), **{k: str(v) for k, v in options.items()}).load()
