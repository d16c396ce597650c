"""Figures from several sources: agreement, identities, years.

The long figure table is (entity, figure, source_id, value, ord) with one value per source, further with fy for yearly
figures. A value counts only when two sources agree; the status says why it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# ---- fixed values ----
VERIFIED, SINGLE, CONFLICT, UNVERIFIABLE = "verified", "single_source", "conflict", "unverifiable"
TOLERANCE = {"current_pe": 0.15, "dividend_yield_pct": 0.25}
DEFAULT_TOLERANCE, IDENTITY_TOLERANCE, EPS = 0.02, 0.01, 1e-9
# ---- end of fixed values ----


def tolerance(figure: Column) -> Column:
    """The relative difference within which two values of a figure agree."""
    out = F.lit(DEFAULT_TOLERANCE)
    for name, t in TOLERANCE.items():
        out = F.when(figure == name, t).otherwise(out)
    return out


def close(a: Column, b: Column, tol: Column) -> Column:
    return F.abs(a - b) <= tol * F.greatest(F.abs(a), F.abs(b), F.lit(EPS))


def consensus(values: DataFrame, *keys: str) -> DataFrame:
    """(keys, status, value, n_agree, outliers): the largest group of mutually close values, their median, the sources outside.

    With one value per source the largest such group is always {v >= m and close to m} for one of its members m, so
    each value gathers the values above it within the tolerance: a range of the sorted values of its key, taken as
    an array (a key has as many values as there are sources, a small number). Of equally large groups the one
    that comes first in input order wins. NULL values are dropped; a key with only NULLs is unverifiable.
    """
    tol = tolerance(F.col("figure")) if "figure" in keys else F.lit(DEFAULT_TOLERANCE)
    item = F.when(F.col("value").isNotNull(), F.struct("ord", "source_id", "value"))
    g = values.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("v"), F.count_distinct(F.when(F.col("value").isNotNull(), F.col("source_id"))).alias("n_sources"))

    def group_from(m: Column) -> Column:
        inside = F.filter("v", lambda x: (x["value"] >= m["value"]) & close(x["value"], m["value"], tol))
        return F.struct((-F.size(F.array_distinct(F.transform(inside, lambda x: x["source_id"])))).alias("size"), F.transform(inside, lambda x: x["ord"]).alias("ords"), inside.alias("in"))

    best = F.array_min(F.transform("v", group_from))
    g = g.withColumn("best", F.when(F.col("n_sources") >= 2, best))
    agree = F.coalesce(-F.col("best.size"), F.lit(0))
    status = F.when(F.size("v") == 0, UNVERIFIABLE).when(F.col("n_sources") < 2, SINGLE).when(agree >= 2, VERIFIED).otherwise(CONFLICT)
    sorted_values = F.array_sort(F.transform("best.in", lambda x: x["value"]))
    n = F.size(sorted_values)
    half = F.floor(n / 2).cast("int")
    median = F.when(n % 2 == 1, F.get(sorted_values, half)).otherwise((F.get(sorted_values, half - 1) + F.get(sorted_values, half)) / 2)
    outside = F.array_sort(F.array_except(F.array_distinct(F.transform("v", lambda x: x["source_id"])), F.transform("best.in", lambda x: x["source_id"])))
    value = F.when(status == VERIFIED, median).when(status == SINGLE, F.get("v", F.lit(0))["value"])
    return g.select(*keys, status.alias("status"), value.alias("value"), F.when(status == VERIFIED, agree).otherwise(0).cast("int").alias("n_agree"), F.when(status == VERIFIED, F.array_join(outside, ",")).otherwise("").alias("outliers"))


def trusted(status: Column, value: Column) -> Column:
    """The value of a verified figure, NULL for any other."""
    return F.when(status == VERIFIED, value)


def identity(parts: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """(key, total, parts, status): whether the parts sum to the total within 1 %. A missing or null side is unverifiable."""
    p = parts.groupBy(key).agg(F.when(F.count_if(F.col("part").isNull()) == 0, F.sum("part")).alias("parts"))
    off = F.abs(F.col("parts") - F.col("total")) / F.greatest(F.abs("total"), F.lit(EPS))
    return totals.select(key, "total").join(p, key, "left").withColumn("status", F.when(F.col("total").isNull() | F.col("parts").isNull(), UNVERIFIABLE).when(off <= IDENTITY_TOLERANCE, VERIFIED).otherwise(CONFLICT))


def verified_series(values: DataFrame) -> DataFrame:
    """(entity, figure, fy, value): the years whose values are verified."""
    return consensus(values, "entity", "figure", "fy").filter(F.col("status") == VERIFIED).select("entity", "figure", "fy", "value")


def latest_common_year(values: DataFrame) -> DataFrame:
    """(entity, figure, fy): the latest year that two sources hold, else the latest of all."""
    held = values.filter("value IS NOT NULL").groupBy("entity", "figure", "fy").agg(F.count_distinct("source_id").alias("n"))
    return held.groupBy("entity", "figure").agg(F.coalesce(F.max(F.when(F.col("n") >= 2, F.col("fy"))), F.max("fy")).alias("fy"))


def align(values: DataFrame, scalars: DataFrame) -> DataFrame:
    """(entity, figure, source_id, value, locator, ord): each source's value of the common year, and while these are fewer than two, undated values of other sources."""
    year = latest_common_year(values)
    dated = values.filter("value IS NOT NULL").join(year, ["entity", "figure", "fy"]).select("entity", "figure", "source_id", "value", F.concat(F.lit("FY"), "fy").alias("locator"), "ord")
    have = dated.groupBy("entity", "figure").agg(F.count("*").alias("n"))
    spare = scalars.filter("value IS NOT NULL").join(dated, ["entity", "figure", "source_id"], "left_anti").join(have, ["entity", "figure"], "left")
    r = F.row_number().over(W.partitionBy("entity", "figure").orderBy("ord"))
    fill = spare.withColumn("r", r).filter(F.col("r") <= 2 - F.coalesce("n", F.lit(0))).select("entity", "figure", "source_id", "value", F.lit("reported").alias("locator"), "ord")
    return dated.unionByName(fill)


def source_lists(values: DataFrame) -> DataFrame:
    """(entity, figure, sources): the sources that state a value, sorted, joined by commas."""
    return values.filter("value IS NOT NULL").groupBy("entity", "figure").agg(F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"))


def vintage(series: DataFrame) -> DataFrame:
    """(entity, fy): the latest year among the verified values (entity, figure, fy, value)."""
    return series.filter("value IS NOT NULL").groupBy("entity").agg(F.max("fy").alias("fy"))


def single_record_years(records: DataFrame, *keys: str) -> DataFrame:
    """The records of those years (keys, fy) that have exactly one: growth is never derived from a year with two."""
    rest = [c for c in records.columns if c not in (*keys, "fy")]
    one = records.groupBy(*keys, "fy").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    return one.filter("_n = 1").drop("_n")


def to_snapshot(values: DataFrame) -> DataFrame:
    """(entity, snapshot): figures as JSON, figure -> [[value, source, locator]...] in input order."""
    item = F.struct("ord", F.array(F.col("value").cast("string"), "source_id", F.coalesce("locator", F.lit(""))).alias("v"))
    f = values.groupBy("entity", "figure").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"]).alias("v"))
    return f.groupBy("entity").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("figure", "v"))))).alias("snapshot"))


def from_snapshot(snapshots: DataFrame) -> DataFrame:
    """(entity, figure, source_id, value, locator, ord) of such JSON; bad JSON gives none."""
    m = snapshots.select("entity", F.explode(F.from_json("snapshot", "map<string,array<array<string>>>")).alias("figure", "v"))
    e = m.select("entity", "figure", F.posexplode("v").alias("ord", "x"))
    return e.select("entity", "figure", F.get("x", F.lit(1)).alias("source_id"), F.get("x", F.lit(0)).try_cast("double").alias("value"), F.get("x", F.lit(2)).alias("locator"), F.col("ord").cast("bigint").alias("ord"))


def context_lines(figures: DataFrame) -> DataFrame:
    """(entity, text): an entity's figures as lines "name: value (status)", sorted, to be cited as one text."""
    line = F.concat(F.col("figure"), F.lit(": "), F.coalesce(F.format_number("value", 2), F.lit("unknown")), F.lit(" ("), F.col("status"), F.lit(")"))
    return figures.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
