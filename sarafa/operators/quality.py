"""How good results are: outcomes against known values, match rates, and rules that texts must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarafa.operators.verify import VERIFIED

# ---- fixed values ----
MATCH, WITHHELD, WRONG, MISSING = "match", "withheld", "trusted_wrong", "missing"
NEGATIONS = r"(?i)\b(?:never|not|no|nor|neither|none|without|cannot|don't|won't|can't|isn't|aren't)\b"
CLAUSE_END = r"[.?!;\n]+"
# ---- end of fixed values ----


def outcomes(truth: DataFrame, figures: DataFrame, keys: list[str], tolerance: float = 0.02) -> DataFrame:
    """(keys, outcome): truth (keys, correct) against figures (keys, status, value); within tolerance of the larger is a match."""
    j = truth.join(figures.select(*keys, "status", "value"), keys, "left")
    near = F.abs(F.col("value") - F.col("correct")) <= tolerance * F.greatest(F.abs("value"), F.abs("correct"))
    return j.select(*keys, F.when(F.col("status").isNull(), MISSING).when((F.col("status") != VERIFIED) | F.col("value").isNull(), WITHHELD).when(near, MATCH).otherwise(WRONG).alias("outcome"))


def score(out: DataFrame) -> DataFrame:
    """One row: counts, accuracy over all (1 when there are none), and accuracy over the trusted."""
    c = out.agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in (MATCH, WITHHELD, WRONG, MISSING)])
    return c.select("*", F.coalesce(F.try_divide(MATCH, "total"), F.lit(1.0)).alias("accuracy"), F.coalesce(F.try_divide(F.col(MATCH), F.col(MATCH) + F.col(WRONG)), F.lit(1.0)).alias("trusted_accuracy"))


def exact_matches(golden: DataFrame, extracted: DataFrame) -> DataFrame:
    """golden (doc, key, period, value) with matched: a record of the same document, digits and period (or none) has the value to 1e-9."""
    g, e = golden.alias("g"), extracted.alias("e")
    on = (F.col("g.doc") == F.col("e.doc")) & (F.col("g.key") == F.col("e.key")) & (F.col("g.period").isNull() | F.col("e.period").isNull() | (F.col("g.period") == F.col("e.period")))
    hit = F.abs(F.col("g.value") - F.col("e.value")) <= 1e-9 * F.greatest(F.abs("g.value"), F.abs("e.value"), F.lit(1.0))
    return g.join(e, on, "left").groupBy("g.doc", "g.key", "g.period", "g.value").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("matched"))


def match_rate(matches: DataFrame) -> DataFrame:
    """One row: the part matched, 1 when there is nothing to match."""
    return matches.agg(F.coalesce(F.avg(F.col("matched").cast("double")), F.lit(1.0)).alias("rate"), F.count("*").alias("n"))


def lint(texts: DataFrame, rules: dict[str, str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, rule, clause, match): every match of a rule in a clause that holds no negation. rules: name -> pattern."""
    clause = texts.select(F.col(id_column).alias("id"), F.explode(F.split(text_column, CLAUSE_END)).alias("clause")).filter((F.trim("clause") != "") & ~F.col("clause").rlike(NEGATIONS))

    def found(rule: str, pattern: str):
        return F.transform(F.regexp_extract_all("clause", F.lit(pattern), 0), lambda m: F.struct(F.lit(rule).alias("rule"), F.trim(m).alias("match")))

    hits = F.array(*[found(r, p) for r, p in rules.items()])
    return clause.select("id", F.trim("clause").alias("clause"), F.explode(F.flatten(hits)).alias("h")).select("id", "h.rule", "clause", "h.match")
