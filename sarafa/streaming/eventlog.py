"""The event log as a stream: state per key instead of a window over history.

Late and undated events are kept: there is no watermark on them, since it would drop undated ones; the lateness rule
is a filter on the stated date. State is one digest a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sarafa.operators.eventlog import valid

OUT = "item_key string, event_id bigint, content_hash string, action string"


def _judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get[0] if state.exists else None
    for frame in frames:
        frame = frame.sort_values("event_id", kind="stable")
        acts = []
        for h in frame["content_hash"]:
            acts.append("new" if now is None else "skipped" if h == now else "superseded")
            now = h
        yield pd.DataFrame({"item_key": key[0], "event_id": frame["event_id"], "content_hash": frame["content_hash"], "action": acts})
    state.update((now,))


def actions(stream: DataFrame) -> DataFrame:
    """(item_key, event_id, content_hash, action) of a stream of events, judged against the current version of their key.

    Within a batch a key's events are taken in the order of event_id; invalid events are left out.
    """
    good = stream.filter(valid(F.col("item_key"), F.col("content_hash"))).select("item_key", F.col("event_id").cast("bigint").alias("event_id"), "content_hash")
    return good.groupBy("item_key").applyInPandasWithState(_judge, OUT, "current string", "append", GroupStateTimeout.NoTimeout)


def write_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the kept versions of a stream of events to a table, once for what is there."""
    kept = actions(stream).filter("action <> 'skipped'")
    return kept.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, event_type, n, total) of (ts, event_type, value), for events at most so late (an extension)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")
