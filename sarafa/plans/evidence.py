"""Queries on records in texts, elements, claims and the quality of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarafa.functions import dates, strings
from sarafa.operators import claims, quality, records, structure
from sarafa.operators import portfolio as P
from sarafa.operators import trends as T
from sarafa.operators import verify as V
from sarafa.plans.figures import ORACLES as FIGURE_SQL
from sarafa.plans.figures import _facts, _three, q21_signals
from sarafa.session import table

RULES = {"outlook": r"(?i)\b(?:expected|likely) to \w+", "guarantee": r"(?i)\b(?:guarantee[sd]?|assure[sd]?)\b", "share": r"(?i)\b[0-9]+(?:\.[0-9]+)?\s?% of\b"}


def q40_numeric_records(s: SparkSession, d: str) -> DataFrame:
    """Typed numbers of all chunks."""
    return records.extract(table(s, d, "chunks"))


def q42_claim_guards(s: SparkSession, d: str) -> DataFrame:
    """Each chunk's sentences as claims, judged against cited chunks and their typed records.

    Of every five sentences one is left as it is, one has its digits altered, one its scale words exchanged, one
    names a year of its own, and one cites the chunk after its own, so that every check has claims that fail it.
    """
    c = table(s, d, "chunks").filter("trim(text) <> ''")
    key = strings.number_key(F.regexp_extract("raw", "[0-9][0-9,.]*[0-9]|[0-9]", 0))
    recs = records.extract(c).groupBy("id").agg(F.collect_list(F.struct(key.alias("key"), "scale", "period")).alias("records"))
    retrieved = c.join(recs, c.chunk_id == recs.id, "left").select("chunk_id", "source_id", "text", F.coalesce("records", F.array().cast("array<struct<key:string,scale:string,period:string>>")).alias("records"))
    said = c.select(F.col("chunk_id").alias("claim_id"), F.posexplode(strings.fragments(F.col("text"))).alias("ord", "text"))
    exchanged = F.replace(F.replace(F.replace("text", F.lit("crore"), F.lit("\u0001")), F.lit("lakh"), F.lit("crore")), F.lit("\u0001"), F.lit("lakh"))
    way = F.col("ord") % 5
    text = F.when(way == 1, F.translate("text", "123456789", "234567891")).when(way == 2, exchanged).when(way == 3, F.concat("text", F.lit(" in FY1999"))).otherwise(F.col("text"))
    after = F.format_string("%s-%08d", F.substring_index("claim_id", "-", 1), F.substring_index("claim_id", "-", -1).try_cast("bigint") + 1)
    cited = F.array(F.when(way == 4, after).otherwise(F.col("claim_id")))
    kind = F.when(F.col("ord") % 3 == 2, "estimate").when(F.col("ord") % 3 == 1, "opinion").otherwise("fact")
    return claims.judge(claims.cite(said.select("claim_id", "ord", text.alias("text"), kind.alias("kind"), cited.alias("chunk_ids")), retrieved, table(s, d, "source_registry"))).select("claim_id", "ord", "kind", "verdict", "reason")


def q44_eval_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Agreed prices of parts against the true ones."""
    base = table(s, d, "part").select(F.col("p_partkey").alias("entity"), F.lit("price").alias("figure"), F.col("p_retailprice").alias("value"), F.col("p_partkey").alias("n"))
    found = V.consensus(_three(base, "entity", "figure"), "entity", "figure")
    truth = table(s, d, "part").filter("p_retailprice IS NOT NULL").select(F.col("p_partkey").alias("entity"), F.col("p_retailprice").alias("correct"))
    return P.rounded(quality.score(quality.outcomes(truth, found, ["entity"])), 9, "accuracy", "trusted_accuracy")


def q45_lint_matches(s: SparkSession, d: str) -> DataFrame:
    """Clauses of documents that break a rule, by document and rule."""
    return quality.lint(table(s, d, "documents"), RULES).groupBy("id", "rule").agg(F.count("*").alias("n"))


def q56_elements(s: SparkSession, d: str) -> DataFrame:
    """All chunks in elements."""
    return structure.split_elements(table(s, d, "chunks"))


def q57_periods_in_texts(s: SparkSession, d: str) -> DataFrame:
    """The fiscal year each document states first, and the latest of all it states."""
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", dates.period_tag(F.col("text")).alias("period"), dates.latest_year_stated(F.col("text")).cast("string").alias("latest"))


def q22_ranked(s: SparkSession, d: str) -> DataFrame:
    """Suppliers ranked by the signals they have, ties by key: a top-20 report."""
    r = q21_signals(s, d).withColumn("score", F.col("n_positive") * 2 - F.col("n_concern") + F.when(F.col("quality") == "strong", 1).otherwise(0))
    return r.orderBy(F.desc("score"), "entity").limit(20).select("entity", "quality", "score")


def q58_valuation(s: SparkSession, d: str) -> DataFrame:
    """Parts cheap or dear against the median price of their type."""
    p = table(s, d, "part")
    m = p.groupBy("p_type").agg(F.median("p_retailprice").alias("mid"))
    return p.join(m, "p_type").select("p_partkey", T.valuation(F.col("p_retailprice"), F.col("mid")).alias("verdict"))


def q59_common_size(s: SparkSession, d: str) -> DataFrame:
    """Each supplier's figures as parts of its revenue."""
    f = _facts(s, d)
    return f.unpivot("entity", ["profit", "interest", "assets", "debt"], "figure", "value").join(f.select("entity", "revenue"), "entity").select("entity", "figure", F.round(F.try_divide("value", "revenue"), 8).alias("share"))


QUERIES = {f.__name__: f for f in (q22_ranked, q40_numeric_records, q42_claim_guards, q44_eval_outcomes, q45_lint_matches, q56_elements, q57_periods_in_texts, q58_valuation, q59_common_size)}

_SIG = FIGURE_SQL["q21_signals"]
ORACLES = {
    "q22_ranked": f"WITH sig AS ({_SIG}), r AS (SELECT entity, quality, CAST(n_positive * 2 - n_concern + CASE WHEN quality = 'strong' THEN 1 ELSE 0 END AS INTEGER) AS score FROM sig) SELECT * FROM r ORDER BY score DESC, entity LIMIT 20",
    "q44_eval_outcomes": FIGURE_SQL["q10_verify_figures"].rsplit(" SELECT entity, figure, status", 1)[0] + ", o AS (SELECT CASE WHEN status IS NULL THEN 'missing' WHEN status <> 'verified' OR value IS NULL THEN 'withheld' WHEN abs(value - p_retailprice) <= 0.02 * greatest(abs(value), abs(p_retailprice)) THEN 'match' ELSE 'trusted_wrong' END AS o FROM part LEFT JOIN verdict ON entity = p_partkey WHERE p_retailprice IS NOT NULL) SELECT count(*) AS total, count(*) FILTER (WHERE o = 'match') AS match, count(*) FILTER (WHERE o = 'withheld') AS withheld, count(*) FILTER (WHERE o = 'trusted_wrong') AS trusted_wrong, count(*) FILTER (WHERE o = 'missing') AS missing, round(count(*) FILTER (WHERE o = 'match') / count(*), 9) AS accuracy, round(count(*) FILTER (WHERE o = 'match') / count(*) FILTER (WHERE o IN ('match', 'trusted_wrong')), 9) AS trusted_accuracy FROM o",
    "q45_lint_matches": r"""WITH c AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.?!;\n]+')) AS clause FROM documents), k AS (SELECT * FROM c WHERE trim(clause, ' ') <> '' AND NOT regexp_matches(clause, '(?i)\b(?:never|not|no|nor|neither|none|without|cannot|don''t|won''t|can''t|isn''t|aren''t)\b')),
m AS (SELECT doc_id, 'outlook' AS rule, len(regexp_extract_all(clause, '(?i)\b(?:expected|likely) to \w+')) AS n FROM k UNION ALL SELECT doc_id, 'guarantee', len(regexp_extract_all(clause, '(?i)\b(?:guarantee[sd]?|assure[sd]?)\b')) FROM k UNION ALL SELECT doc_id, 'share', len(regexp_extract_all(clause, '(?i)\b[0-9]+(?:\.[0-9]+)?\s?% of\b')) FROM k)
SELECT doc_id AS id, rule, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1, 2 HAVING sum(n) > 0""",
    "q58_valuation": "WITH m AS (SELECT p_type, median(p_retailprice) AS mid FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN p_retailprice > 0 AND mid > 0 THEN CASE WHEN p_retailprice / mid < 0.8 THEN 'cheap' WHEN p_retailprice / mid > 1.2 THEN 'expensive' ELSE 'fair' END END AS verdict FROM part JOIN m USING (p_type)",
    "q59_common_size": FIGURE_SQL["q20_ratio_suite"].split(",\nbases AS", 1)[0] + ", u AS (SELECT entity, revenue, unnest(['profit', 'interest', 'assets', 'debt']) AS figure, unnest([profit, interest, assets, debt]) AS value FROM facts) SELECT entity, figure, round(value / nullif(revenue, 0), 8) AS share FROM u",
    "q57_periods_in_texts": r"""WITH t AS (SELECT doc_id, text, regexp_extract(text, '(?i)\bFY\s?([0-9]{2,4})\b', 1) AS f, regexp_extract(text, '(?i)(year ended|as at|as on|as of)\s+[0-9]{1,2}\s+(march|mar)\.?\s+([0-9]{4})', 3) AS e, regexp_extract(text, '\b31[-/.]0?3[-/.]([0-9]{4})\b', 1) AS d,
  list_concat(regexp_extract_all(text, '(?i)year\s+ended[^.]{0,40}?march[,\s]+.{0,6}?(20[0-9]{2})', 1), regexp_extract_all(text, '(?i)march\s+31[,\s]+(20[0-9]{2})', 1), regexp_extract_all(text, '(?i)31\s*(?:st)?\s*march[,\s]+(20[0-9]{2})', 1)) AS sure,
  list_concat(regexp_extract_all(text, '(?i)\bFY\s?(20[0-9]{2})', 1), list_transform(list_concat(regexp_extract_all(text, '(?i)\bFY\s?''?([0-9]{2})\b', 1), regexp_extract_all(text, '20[0-9]{2}\s*[-/]\s*([0-9]{2})\b', 1)), lambda y: '20' || y)) AS loose FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'FY' || coalesce(CASE WHEN length(f) = 2 THEN '20' || f END, nullif(f, ''), nullif(e, ''), nullif(d, '')) AS period, coalesce(list_max(sure), list_max(loose)) AS latest FROM t""",
    "q40_numeric_records": r"""WITH t AS (SELECT chunk_id, CASE WHEN lower(trim(unit_scale)) IN ('crore', 'lakh', 'million', 'none') THEN lower(trim(unit_scale)) END AS stated, currency AS money, fiscal_period AS period,
  regexp_replace(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9:]{8}Z?)?|(?i:\bFY\s?[0-9]{2,4}(?:\s?[-/]\s?[0-9]{2,4})?\b|\b(?:19|20)[0-9]{2}\s?[-/]\s?[0-9]{2,4}\b)', ' ', 'g') AS t FROM chunks WHERE text IS NOT NULL),
g AS (SELECT chunk_id, stated, money, period, unnest(list_transform(regexp_extract_all(t, '@F', 0), lambda m, i: {'m': m, 'pos': CAST(i - 1 AS INTEGER)})) AS x FROM t),
p AS (SELECT chunk_id, stated, money, period, x.pos AS pos, regexp_extract(x.m, '@F', ['mark', 'sign', 'num', 'tail']) AS r FROM g),
h AS (SELECT chunk_id, pos, stated, money, period, r.num AS num, r.mark <> '' AS marked, r.sign <> '' AS neg, trim(r.num || r.tail) AS raw, lower(trim(regexp_replace(r.tail, '^\s*\)', ''))) AS a FROM p),
u AS (SELECT *, CASE WHEN regexp_matches(a, '%|per') THEN 'percent' WHEN regexp_matches(a, 'bps|basis') THEN 'bps' WHEN a = 'x' THEN 'ratio' WHEN a <> '' THEN 'rupees' WHEN marked OR (stated IS NOT NULL AND (contains(num, ',') OR contains(num, '.') OR length(num) >= 5)) THEN 'rupees' END AS unit,
  CASE WHEN a <> '' THEN CASE WHEN regexp_matches(a, '\bcr') THEN 'crore' WHEN regexp_matches(a, '\bla[ck]') THEN 'lakh' WHEN regexp_matches(a, '\bm(illion|n)') THEN 'million' ELSE 'none' END WHEN marked THEN 'none' ELSE coalesce(stated, 'none') END AS scale, (CASE WHEN neg THEN -1 ELSE 1 END) * CAST(replace(num, ',', '') AS DOUBLE) AS value FROM h)
SELECT chunk_id AS id, pos, raw, value, unit, scale, CASE WHEN unit = 'rupees' THEN CASE WHEN marked THEN 'INR' ELSE money END END AS currency, period, value * CASE scale WHEN 'crore' THEN 1e7 WHEN 'lakh' THEN 1e5 WHEN 'million' THEN 1e6 ELSE 1 END AS absolute FROM u WHERE unit IS NOT NULL""".replace(
        "@F", r"(?i)(?:((?:₹|inr|rs\.?)\s*)|(\(\s*|-))?([0-9][0-9,]*(?:\.[0-9]+)?)(\s*%|\s*per\s*cent|\s*bps\b|\s*basis\s*points?\b|\s*\)?\s*(?:crores?|lakhs?|lacs?|million|mn|cr)\b|x\b)?"
    ),
    "q56_elements": r"""WITH l AS (SELECT chunk_id AS id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'pos': CAST(i - 1 AS INTEGER), 'line': x}), recursive := true) FROM chunks WHERE text IS NOT NULL),
s AS (SELECT *, @STRIP(line)@ AS s FROM l),
w AS (SELECT *, lower(s) AS low, len(list_filter(regexp_split_to_array(s, '@W+'), lambda x: x <> '')) AS n, list_filter(regexp_extract_all(s, '[A-Za-z][A-Za-z''&]*'), lambda x: lower(x) NOT IN ('of', 'and', 'the', 'to', 'for', 'in', 'on', 'a', 'an', 'vs', '&')) AS main FROM s),
k AS (SELECT *, CASE WHEN s = '' THEN 'B'
  WHEN len(list_filter(string_split(line, '|'), lambda x: @STRIP(x)@ <> '')) >= 2 THEN 'T'
  WHEN len(regexp_extract_all(line, '[0-9][0-9,]*(\.[0-9]+)?')) >= 2 AND regexp_matches(line, '@N( {2,}|\t)@N') THEN 'T'
  WHEN regexp_matches(s, '(?i)\bin@W+(₹|rs\.?|inr)?@W*(crores?|lakhs?|lacs?|million|mn)\b') OR regexp_matches(s, '(?i)^\(?\s*(₹|rs\.?|inr).*(crores?|lakhs?|lacs?|million|mn)') THEN 'C'
  WHEN regexp_matches(s, '[A-Za-z]') AND (regexp_matches(low, 'management discussion|director''?s''? report|independent auditor|balance sheet|profit and loss|cash flow statement|notes to|risk management|key risks|corporate governance|related party|contingent liabilit|segment|business overview|financial highlights')
    OR (length(s) <= 80 AND n <= 10 AND right(s, 1) NOT IN ('.', '!', '?', ',', ';') AND ((right(s, 1) = ':' AND n <= 8) OR s = upper(s) OR (n <= 6 AND len(main) > 0 AND len(list_filter(main, lambda x: NOT regexp_matches(x, '^[A-Z]'))) = 0)))) THEN 'H' ELSE 'X' END AS k FROM w),
n1 AS (SELECT *, first_value(CASE WHEN k <> 'C' THEN k END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS past, lead(k) OVER (PARTITION BY id ORDER BY pos) AS nk FROM k),
n2 AS (SELECT *, lead(past) OVER (PARTITION BY id ORDER BY pos) AS npast FROM n1),
c AS (SELECT *, CASE WHEN k = 'C' THEN CASE WHEN past = 'T' THEN 'c' ELSE 'X' END WHEN k = 'H' AND (nk = 'T' OR (nk = 'C' AND npast = 'T')) THEN 'h' ELSE k END AS q FROM n2),
b AS (SELECT *, lag(q) OVER (PARTITION BY id ORDER BY pos) AS pq FROM c),
i AS (SELECT *, sum(CASE WHEN pq IS NULL OR NOT ((q = 'X' AND pq = 'X') OR (q = 'c' AND pq IN ('h', 'c')) OR (q = 'T' AND pq IN ('h', 'c', 'T')) OR (q = 'B' AND pq = 'B')) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS el,
  last_value(CASE WHEN q = 'H' THEN s END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM b),
e AS (SELECT id, el, min(pos) AS pos, CASE min_by(q, pos) WHEN 'H' THEN 'heading' WHEN 'X' THEN 'paragraph' ELSE 'table' END AS kind, string_agg(line, chr(10) ORDER BY pos) AS whole, min_by(section, pos) AS section FROM i WHERE q <> 'B' GROUP BY id, el),
f AS (SELECT *, array_to_string(list_slice(string_split(whole, chr(10)), 1, 3), chr(10)) AS head, @STRIP(whole)@ AS body FROM e),
m AS (SELECT *, lower(coalesce(nullif(regexp_extract(head, '(?i)\bin@W+(?:₹|rs\.?|inr)?@W*(crores?|lakhs?|lacs?|million|mn)\b', 1), ''), regexp_extract(head, '(?i)\b(crores?|lakhs?|lacs?|million|mn)\b', 1))) AS sw, regexp_matches(head, '(?i)₹|rs|inr') AS money FROM f)
SELECT id, pos, kind, body, section, CASE WHEN kind = 'table' THEN CASE WHEN sw LIKE 'cr%' THEN 'crore' WHEN sw LIKE 'la%' THEN 'lakh' WHEN sw LIKE 'm%' THEN 'million' WHEN money THEN 'absolute' END END AS scale, CASE WHEN kind = 'table' AND money THEN 'INR' END AS currency,
  'FY' || coalesce(nullif(CASE WHEN length(regexp_extract(body, '(?i)\bFY\s?([0-9]{2,4})\b', 1)) = 2 THEN '20' ELSE '' END || regexp_extract(body, '(?i)\bFY\s?([0-9]{2,4})\b', 1), ''), nullif(regexp_extract(body, '(?i)(year ended|as at|as on|as of)\s+[0-9]{1,2}\s+(march|mar)\.?\s+([0-9]{4})', 3), ''), nullif(regexp_extract(body, '\b31[-/.]0?3[-/.]([0-9]{4})\b', 1), '')) AS period FROM m""".replace("@STRIP(line)@", "regexp_replace(line, '^@W+|@W+$', '', 'g')")
    .replace("@STRIP(x)@", "regexp_replace(x, '^@W+|@W+$', '', 'g')")
    .replace("@STRIP(whole)@", "regexp_replace(whole, '^@W+|@W+$', '', 'g')")
    .replace("@W", r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
    .replace("@N", r"[^\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"),
}
