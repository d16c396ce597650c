"""The event log: new, superseded and skipped versions per key, freshness, counts.

Rows are (item_key, content_hash, ord) and whatever else. Previous versions are found per key and block of the
order, and across blocks through a small table of each block's last version, so a key with a third of all rows is
spread over its blocks and not sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sarafa.functions import dates

#: Events in a block of the order.
BLOCK = 1_000_000


def valid(c_key: Column, c_hash: Column) -> Column:
    return F.coalesce((F.trim(c_key) != "") & (F.trim(c_hash) != ""), F.lit(False))


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with key and content, the others with the reason)."""
    ok = valid(F.col("item_key"), F.col("content_hash"))
    reason = F.when(F.coalesce(F.trim("item_key"), F.lit("")) == "", "no key").otherwise("no content")
    return events.filter(ok), events.filter(~ok).withColumn("reason", reason)


def boundary(events: DataFrame) -> DataFrame:
    """events with refused: the first reason an item may not enter the log by (no key, no source, no content, bad date), NULL if it may.

    A date may be missing; one that is stated must be in ISO form.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = (F.coalesce(F.col("as_of"), F.lit("")) != "") & dates.iso_date(F.col("as_of")).isNull()
    return events.withColumn("refused", F.when(blank("item_key"), "no key").when(blank("source_id"), "no source").when(blank("content_hash"), "no content").when(bad, "bad date"))


def with_previous(events: DataFrame, key: str, order: str, value: str, block: int = BLOCK) -> DataFrame:
    """events with prev, the value of the row before in its key; NULL for the first. Values are taken as not null; orders as unique in a key."""
    b = events.withColumn("_block", F.floor(F.col(order) / block))
    w = W.partitionBy(key, "_block").orderBy(order)
    inner = b.withColumn("_lag", F.lag(value).over(w))
    ends = b.groupBy(key, "_block").agg(F.max_by(value, order).alias("_end"))
    carried = ends.withColumn("_carry", F.lag("_end").over(W.partitionBy(key).orderBy("_block"))).drop("_end")
    return inner.join(carried, [key, "_block"], "left").withColumn("prev", F.coalesce("_lag", "_carry")).drop("_lag", "_carry", "_block")


def actions(events: DataFrame, order: str = "event_id") -> DataFrame:
    """Valid events with action: new for a key's first, skipped for content equal to the current one, superseded for a change.

    A skipped event leaves the current content as it is, so "equal to the current" is "equal to the row before".
    """
    good, _ = split_valid(events)
    p = with_previous(good, "item_key", order, "content_hash")
    return p.withColumn("action", F.when(F.col("prev").isNull(), "new").when(F.col("prev") == F.col("content_hash"), "skipped").otherwise("superseded")).drop("prev")


def current(events: DataFrame, order: str = "event_id") -> DataFrame:
    """(item_key, event_id, content_hash, as_of, n_versions): the last kept version of each key."""
    kept = actions(events, order).filter("action <> 'skipped'")
    return kept.groupBy("item_key").agg(F.max_by(F.struct("event_id", "content_hash", "as_of"), order).alias("c"), F.count("*").alias("n_versions")).select("item_key", "c.event_id", "c.content_hash", "c.as_of", "n_versions")


def fresh(events: DataFrame, today: str, most: int) -> DataFrame:
    """Current versions with age and verdict; undated ones are unknown, not old."""
    t, day = F.to_date(F.lit(today)), dates.any_date(F.col("as_of"))
    return current(events).select("item_key", "event_id", dates.age_days(day, t).alias("age"), dates.freshness(day, t, most).alias("verdict"))


def run_summary(events: DataFrame, today: str, *keys: str) -> DataFrame:
    """Counts by key: fetched, new, superseded, skipped, errors, old, undated and recent.

    Old events are dropped before the log; undated ones are kept, counted, and taken off the recent ones again.
    """
    day = dates.any_date(F.col("as_of"))
    e = events.withColumn("_day", day).withColumn("_old", F.coalesce(~dates.is_recent(F.col("_day"), F.to_date(F.lit(today))), F.lit(False)))
    logged = actions(e.filter("NOT _old"))
    g = e.groupBy(*keys).agg(F.count("*").alias("fetched"), F.count_if("_old").alias("old"), F.count_if(~F.col("_old") & ~valid(F.col("item_key"), F.col("content_hash"))).alias("errors"))
    a = logged.groupBy(*keys).agg(*[F.count_if(F.col("action") == x).alias(x) for x in ("new", "superseded", "skipped")], F.count_if(F.col("_day").isNull()).alias("undated"))
    on = [g[k].eqNullSafe(a[k]) for k in keys]
    zero = [F.coalesce(a[c], F.lit(0)).alias(c) for c in ("new", "superseded", "skipped", "undated")]
    out = g.join(a, on, "left").select(*(g[k] for k in keys), "fetched", "old", "errors", *zero)
    return out.withColumn("recent", F.greatest(F.lit(0), F.col("new") + F.col("superseded") + F.col("skipped") - F.col("undated")))




def latest_merge(persisted: DataFrame, session: DataFrame, key: str, order: str, keep) -> DataFrame:
    """Persisted rows overridden by the latest session row of their key; keys whose latest row fails keep are dropped.

    Both have the same columns; keep is a condition on them. Of equally late rows the first by all columns wins.
    """
    rest = [c for c in session.columns if c not in (key, order)]
    last = session.groupBy(key).agg(F.max(order).alias(order), F.min_by(F.struct(*rest), F.struct((-F.unix_micros(order) if dict(session.dtypes)[order] == "timestamp" else -F.col(order)).alias("o"), *rest)).alias("r")).select(key, order, *(f"r.{c}" for c in rest))
    stay = persisted.join(last.select(key), key, "left_anti")
    return stay.unionByName(last.filter(keep))
