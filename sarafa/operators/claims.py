"""Claims with citations, checked against the chunks and records they cite; checks only ever downgrade.

Claims are rows (claim_id, ord, text, kind, chunk_ids array<string>). Everything is joins on chunk ids and array
predicates on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sarafa.functions import dates, strings

# ---- fixed values ----
FACT, ESTIMATE, OPINION, UNVERIFIED = "fact", "estimate", "opinion", "unverified"
TIERS = {"primary": 1, "analyst": 2, "creator": 3}
PAYLOAD = "struct<abstain:boolean,claims:array<struct<text:string,kind:string,chunk_ids:array<string>>>>"
SCALED = r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(crore|lakh|lac|million|billion)"
# ---- end of fixed values ----


def parse_payload(answers: DataFrame, text_column: str = "answer") -> DataFrame:
    """(claim_id, ord, text, kind, chunk_ids) from answers in JSON, fenced or not; bad JSON and abstentions give none."""
    bare = F.regexp_replace(F.trim(text_column), r"^```(?:json)?\s*|\s*```$", "")
    p = answers.select("claim_id", F.from_json(bare, PAYLOAD, {"mode": "PERMISSIVE"}).alias("p")).filter("p IS NOT NULL AND NOT coalesce(p.abstain, false)")
    c = p.select("claim_id", F.posexplode("p.claims").alias("ord", "c")).select("claim_id", "ord", "c.text", F.lower("c.kind").alias("kind"), F.coalesce("c.chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
    known = F.when(F.col("kind").isin(FACT, ESTIMATE, OPINION), F.col("kind")).otherwise(OPINION)
    return c.filter("trim(text) <> ''").withColumn("kind", known)


def cite(claims: DataFrame, retrieved: DataFrame, registry: DataFrame) -> DataFrame:
    """Claims with their sources gathered: texts, records and tiers of the cited chunks that were retrieved and registered.

    retrieved: (chunk_id, source_id, text, records array<struct<key, scale, period>>). Chunk ids that were not
    retrieved and unregistered sources are dropped; a claim left without citation is dropped. Of claims of one
    answer that say the same, the first stays.
    """
    reg = registry.select("source_id", F.try_element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), F.lower("tier")).alias("tier"))
    c = claims.select("claim_id", "ord", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id")).join(retrieved, "chunk_id").join(reg, "source_id")
    got = c.groupBy("claim_id", "ord").agg(F.collect_list("text").alias("texts"), F.flatten(F.collect_list("records")).alias("records"), F.collect_list("tier").alias("tiers"))
    same = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    cited = claims.join(got, ["claim_id", "ord"]).withColumn("_same", same)
    first = cited.groupBy("claim_id", "_same").agg(F.min("ord").alias("ord"))
    return cited.join(first, ["claim_id", "_same", "ord"], "left_semi").drop("_same")


def grounded(keys: Column, texts: Column) -> Column:
    """Every number appears in the cited texts."""
    return F.size(F.array_except(keys, strings.numbers_in(F.array_join(texts, "\n")))) == 0


def span_supported(keys: Column, texts: Column) -> Column:
    """Every number stands in some sentence of a cited text."""
    spans = F.flatten(F.transform(texts, strings.fragments))
    return F.forall(keys, lambda k: F.exists(spans, lambda s: F.array_contains(strings.numbers_in(s), k)))


def record_backed(keys: Column, records: Column) -> Column:
    """Every number is that of a typed record."""
    return F.forall(keys, lambda k: F.exists(records, lambda r: r["key"] == k))


def unit_consistent(text: Column, records: Column) -> Column:
    """A number with a stated scale has that scale in some record of the same digits with a scale, if there is any."""
    keys = F.transform(F.regexp_extract_all(text, F.lit(SCALED), 1), strings.number_key)
    words = F.transform(F.regexp_extract_all(text, F.lit(SCALED), 2), lambda w: F.regexp_replace(F.lower(w), "lac$", "lakh"))
    said = F.zip_with(keys, words, lambda k, w: F.struct(k.alias("key"), w.alias("scale")))

    def fits(x: Column) -> Column:
        same = F.filter(records, lambda r: (r["key"] == x["key"]) & (r["scale"] != "none"))
        return (F.size(same) == 0) | F.exists(same, lambda r: r["scale"] == x["scale"])

    return F.forall(said, fits)


def period_consistent(keys: Column, text: Column, records: Column) -> Column:
    """Some record of the same digits has no period or the one the claim names; claims without period pass."""
    year = dates.period_tag(text)
    return year.isNull() | F.forall(keys, lambda k: ~F.exists(records, lambda r: r["key"] == k) | F.exists(records, lambda r: (r["key"] == k) & (r["period"].isNull() | (r["period"] == year))))


def judge(cited: DataFrame) -> DataFrame:
    """Cited claims with verdict and reason: the first failing check of grounded, span, record, unit and period makes a fact or opinion unverified.

    An estimate with a number needs a cited text with any number; a fact needs primary sources only. Claims
    without material numbers pass the number checks.
    """
    keys, texts, records = strings.material_numbers(F.col("text")), F.col("texts"), F.col("records")
    k = cited.withColumn("keys", keys)
    keys = F.col("keys")
    reason = F.when(~grounded(keys, texts), "grounded").when(~span_supported(keys, texts), "span").when(~record_backed(keys, records), "record").when(~unit_consistent(F.col("text"), records), "unit").when(~period_consistent(keys, F.col("text"), records), "period")
    basis = F.when((F.size(keys) > 0) & ~F.exists(texts, lambda t: F.size(strings.numbers_in(t)) > 0), "basis")
    why = F.when(F.col("kind") == ESTIMATE, basis).otherwise(F.when(F.size(keys) > 0, reason))
    primary = F.forall("tiers", lambda t: t == 1)
    why = F.coalesce(why, F.when((F.col("kind") == FACT) & ~primary, "tier"))
    return k.withColumn("reason", why).withColumn("verdict", F.when(F.col("reason").isNotNull(), UNVERIFIED).otherwise(F.col("kind"))).drop("keys")
