"""Typed numbers out of texts, on the JVM: value, unit, scale, currency, sign and where they stand.

A number is a figure when a unit or scale word follows it, when a rupee mark stands before it, or, in a table with a
stated scale, when it looks like an amount (grouped, with decimals, or of five digits and more). Dates, fiscal
years and ranges of years are blanked first. "(" before or an attached "-" makes it negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sarafa.functions.rows import keep

# ---- fixed values ----
FACTORS = {"crore": 1e7, "lakh": 1e5, "million": 1e6, "none": 1.0}
BLANKED = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9:]{8}Z?)?|(?i)\bFY\s?[0-9]{2,4}(?:\s?[-/]\s?[0-9]{2,4})?\b|\b(?:19|20)[0-9]{2}\s?[-/]\s?[0-9]{2,4}\b"
#: Groups: 1 rupee mark or 2 sign right before, 3 number, 4 what follows.
FIGURE = r"(?i)(?:((?:₹|inr|rs\.?)\s*)|(\(\s*|-))?([0-9][0-9,]*(?:\.[0-9]+)?)(\s*%|\s*per\s*cent|\s*bps\b|\s*basis\s*points?\b|\s*\)?\s*(?:crores?|lakhs?|lacs?|million|mn|cr)\b|x(?![a-z]))?"
# ---- end of fixed values ----


def _unit(after: Column) -> Column:
    return F.when(after.rlike("(?i)%|per"), "percent").when(after.rlike("(?i)bps|basis"), "bps").when(after.rlike(r"(?i)^x$"), "ratio").when(after != "", "rupees")


def _scale(after: Column) -> Column:
    return F.when(after.rlike(r"(?i)\bcr"), "crore").when(after.rlike(r"(?i)\bla[ck]"), "lakh").when(after.rlike(r"(?i)\bm(?:illion|n)"), "million").otherwise("none")


def extract(texts: DataFrame, id_column: str = "chunk_id", text_column: str = "text") -> DataFrame:
    """(id, pos, raw, value, unit, scale, currency, period, absolute) of each figure, in text order; pos counts the text's numbers.

    Optional columns unit_scale, currency and fiscal_period hold a table's stated scale, currency and period. Null and
    blank texts and numbers that overflow give nothing. No shuffle.
    """
    has = set(texts.columns)
    given = lambda c: F.col(c).cast("string") if c in has else F.lit(None).cast("string")
    stated = F.lower(F.trim(given("unit_scale")))
    stated = F.when(stated.isin(*FACTORS), stated)
    bare = F.regexp_replace(F.coalesce(F.col(text_column), F.lit("")), BLANKED, " ")
    t = texts.select(F.col(id_column).alias("id"), stated.alias("stated"), given("currency").alias("money"), given("fiscal_period").alias("period"), F.regexp_extract_all(bare, F.lit(FIGURE), 0).alias("found"))
    # The text is searched once; a match is short, and its groups are taken from it.
    hit = t.select("id", "stated", "money", "period", F.posexplode("found").alias("pos", "m"))
    group = lambda g: F.regexp_extract("m", FIGURE, g)
    parts = hit.select("id", "stated", "money", "period", "pos", (group(1) != "").alias("marked"), (group(2) != "").alias("neg"), group(3).alias("num"), group(4).alias("tail"))
    h = parts.select("*", F.trim(F.concat("num", "tail")).alias("raw"), F.trim(F.regexp_replace("tail", r"^\s*\)", "")).alias("after"))
    amount_like = F.contains("num", F.lit(",")) | F.contains("num", F.lit(".")) | (F.length("num") >= 5)
    unit = F.coalesce(_unit(F.col("after")), F.when(F.col("marked") | (F.col("stated").isNotNull() & amount_like), "rupees"))
    scale = F.when(F.col("after") != "", _scale(F.col("after"))).when(F.col("marked"), "none").otherwise(F.coalesce("stated", F.lit("none")))
    size = F.replace("num", F.lit(","), F.lit("")).try_cast("double")
    out = h.select("id", "pos", "raw", F.when(F.col("neg"), -size).otherwise(size).alias("value"), unit.alias("unit"), scale.alias("scale"), F.when(unit == "rupees", F.when(F.col("marked"), "INR").otherwise(F.col("money"))).alias("currency"), "period")
    factor = F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv])
    return keep(out, lambda r: r["unit"].isNotNull() & r["value"].isNotNull()).withColumn("absolute", F.col("value") * F.element_at(factor, F.col("scale"))).filter(F.abs("absolute") < float("inf"))


def grounded(extracted: DataFrame) -> DataFrame:
    """extracted (text, quote, value_text, year) with grounded: the quote stands in the text and holds the digits, or these are three or more and stand in the text; a stated year must be in the quote or text."""
    squeeze = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    text, quote, digits = squeeze(F.col("text")), squeeze(F.col("quote")), F.regexp_replace(F.coalesce("value_text", F.lit("")), "[^0-9]", "")
    bare = lambda c: F.regexp_replace(c, "[^0-9]", "")
    by_quote = (F.length(quote) > 0) & F.contains(text, quote) & F.contains(bare(quote), digits)
    by_text = (F.length(digits) >= 3) & F.contains(bare(text), digits)
    year = F.col("year").isNull() | F.contains(text, F.col("year").cast("string"))
    return extracted.withColumn("grounded", (F.length(digits) > 0) & (by_quote | by_text) & year)
