"""Queries of the core operators on dirty records: units and bad rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sarafa.operators import badrows, units
from sarafa.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's quantity in the common unit of its kind."""
    return units.convert(table(spark, sf_dir, "numeric_records"))


def p1_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measured conversions between notations."""
    return units.conversions(table(spark, sf_dir, "numeric_records"))


def p1_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's notations stand from what the other sources mean by them."""
    return units.source_shifts(table(spark, sf_dir, "numeric_records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no valid holding, with the reason."""
    return badrows.rejected(table(spark, sf_dir, "sample_portfolio_lines"))


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that load."""
    return badrows.loaded(table(spark, sf_dir, "sample_portfolio_lines"))


QUERIES = {"p1_found": p1_found, "p1_conversions": p1_conversions, "p1_sources": p1_sources, "p4_found": p4_found, "p4_loaded": p4_loaded}

_CELLS = r"""
WITH body AS (SELECT line_id, coalesce(regexp_replace(raw_line, '\r$', ''), '') AS line FROM sample_portfolio_lines WHERE line_no IS NULL OR line_no > 1),
good AS (SELECT line_id, line, regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS clean FROM body),
cells AS (SELECT line_id, clean, CASE WHEN clean THEN regexp_extract_all(line, '(?:^|,)("(?:[^"]|"")*"|[^",]*)', 1) END AS c FROM good),
bare AS (
  SELECT line_id, clean, len(c) AS n, c,
    list_transform(c, lambda x: trim(regexp_replace(replace(regexp_replace(CASE WHEN starts_with(x, '"') THEN replace(substring(x, 2, length(x) - 2), '""', '"') ELSE x END, '₹|[Rr][Ss]\.?|[Ii][Nn][Rr]', '', 'g'), ',', ''), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'))) AS v
  FROM cells),
nums AS (
  SELECT line_id, clean, n, c,
    CASE WHEN regexp_full_match(v[2], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(v[2] AS DOUBLE) END AS q,
    CASE WHEN regexp_full_match(v[3], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(v[3] AS DOUBLE) END AS p
  FROM bare),
judged AS (
  SELECT *, CASE WHEN NOT clean THEN 'quoting' WHEN n <> 4 THEN 'columns'
    WHEN q IS NULL OR isinf(q) OR isnan(q) OR q <= 0 THEN 'quantity' WHEN p IS NULL OR isinf(p) OR isnan(p) OR p < 0 THEN 'avg_cost' END AS reason
  FROM nums)
"""

_UNIT = r"""CASE WHEN regexp_matches({0}, '[$€£¥]|(^|[^a-z])(usd|eur|gbp|jpy|aed|sgd|chf|cny|aud|cad|hkd)($|[^a-z])') THEN 'foreign'
  WHEN regexp_matches({0}, '%|(^|[^a-z])(percent|per\s*cent|pct)($|[^a-z])') THEN 'percent'
  WHEN regexp_matches({0}, '(^|[^a-z])(bps?|basis\s*points?)($|[^a-z])') THEN 'bps'
  WHEN regexp_matches({0}, '₹|(^|[^a-z])(rs|inr|rupees?)($|[^a-z])') THEN 'rupee'
  WHEN regexp_matches({0}, '(^|[^a-z])({1})($|[^a-z])') THEN 'multiple' END"""
_SCALE = r"""CASE WHEN regexp_matches({0}, '(^|[^a-z])(lakhs?|lacs?)\s*(crores?|cr)($|[^a-z])') THEN 12
  WHEN regexp_matches({0}, '(^|[^a-z])(trillions?|trn|tn)($|[^a-z])') THEN 12
  WHEN regexp_matches({0}, '(^|[^a-z])(billions?|bl?n)($|[^a-z])') THEN 9
  WHEN regexp_matches({0}, '(^|[^a-z])(crores?|crs?)($|[^a-z])') THEN 7
  WHEN regexp_matches({0}, '(^|[^a-z])(millions?|ml?n|mio)($|[^a-z])') THEN 6
  WHEN regexp_matches({0}, '(^|[^a-z])(lakhs?|lacs?|l)($|[^a-z])') THEN 5
  WHEN regexp_matches({0}, '(^|[^a-z])(thousands?|k)($|[^a-z])') THEN 3
  WHEN regexp_matches({0}, '(^|[^a-z])(none|units?|absolute|actuals?{1})($|[^a-z])') THEN 0 END"""
_PLAIN = r"""regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[\s\x{{a0}}\x{{2007}}\x{{2009}}\x{{200a}}\x{{202f}}\x{{3000}}]', ' ', 'g'), '[''’`]\s?000s?', ' thousand ', 'g')"""
_P1 = (
    r"""
WITH t AS (SELECT record_id, value, regexp_replace(regexp_replace(trim("""
    + _PLAIN.format("raw_string")
    + r"""), '\(?\b(in )?fy\s?[0-9]{2,4}(\s?-\s?[0-9]{2,4})?\)?', ' ', 'g'), '\brs\.', ' rs ', 'g') AS raw, """
    + ", ".join(f"{_PLAIN.format(c)} AS {c[0]}c" for c in ("unit", "scale", "currency"))
    + r""" FROM numeric_records),
m AS (SELECT *, regexp_replace(raw, '[0-9][0-9,]*(\.[0-9]+)?|\.[0-9]+', ' ', 'g') AS rest, replace(regexp_extract(raw, '[0-9][0-9,]*(\.[0-9]+)?|\.[0-9]+'), ',', '') AS digits,
  regexp_matches(raw, '(^|[^0-9a-z])[-−–]\s*(₹|rs|inr)?\s*\.?[0-9]') OR regexp_matches(raw, '\(\s*[-−–]?\s*(₹|rs|inr)?\s*[0-9][0-9,]*(\.[0-9]+)?\s*\)') AS minus FROM t),
u AS (SELECT record_id, CASE WHEN trim(raw) = '' THEN CASE WHEN isfinite(value) AND abs(value) < 1e19 THEN CAST(value AS DECIMAL(28, 8)) END ELSE CASE WHEN minus THEN -1 ELSE 1 END * try_cast(nullif(digits, '') AS DECIMAL(28, 8)) END AS x,
  """
    + _UNIT.format("rest", "x|times")
    + " AS ru, "
    + _SCALE.format("rest", "")
    + " AS rs, coalesce(CASE WHEN "
    + _UNIT.format("cc", "x")
    + " = 'foreign' THEN 'foreign' END, "
    + _UNIT.format("uc", "x|times|ratio|multiple")
    + ") AS cu, coalesce("
    + _SCALE.format("regexp_replace(uc, 'rupees?', ' ', 'g')", "")
    + ", "
    + _SCALE.format("sc", "|rupees")
    + r""") AS cs FROM m),
k AS (SELECT record_id, x, CASE WHEN ru IN ('foreign', 'percent', 'bps', 'multiple') THEN ru WHEN rs IS NOT NULL THEN CASE WHEN ru IS NULL AND cu = 'foreign' THEN 'foreign' ELSE 'rupee' END ELSE coalesce(ru, cu) END AS unit,
  coalesce(rs, CASE WHEN ru = 'rupee' THEN 0 END, cs) AS scale FROM u),
f AS (SELECT record_id, CAST(x * 100000000 AS HUGEINT) AS n, CASE unit WHEN 'rupee' THEN 'money' WHEN 'multiple' THEN 'multiple' ELSE 'rate' END AS quantity_kind,
  CASE unit WHEN 'rupee' THEN CAST(pow(10, scale + 2) AS HUGEINT) WHEN 'bps' THEN 1 ELSE 100 END AS factor FROM k WHERE x IS NOT NULL AND unit <> 'foreign' AND (unit <> 'rupee' OR scale IS NOT NULL)),
a AS (SELECT record_id, quantity_kind, CASE WHEN n < 0 THEN -1 ELSE 1 END * ((abs(n) * factor * 2 + 100000000) // 200000000) AS amount FROM f)
SELECT record_id, quantity_kind, CAST(amount AS BIGINT) AS amount FROM a WHERE abs(amount) < 9223372036854775807"""
)

ORACLES = {
    "p1_found": _P1,
    "p4_found": _CELLS + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_loaded": _CELLS
    + r""", plain AS (SELECT *, list_transform(c, lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(substring(x, 2, length(x) - 2), '""', '"') ELSE x END, ' ')) AS f FROM judged WHERE reason IS NULL)
SELECT line_id, f[1] AS symbol, q AS quantity, p AS avg_cost, coalesce(nullif(f[4], ''), 'Unknown') AS sector FROM plain""",
}
