"""Queries on boundaries, openings, bands, registries and tables in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarafa.functions import strings
from sarafa.operators import eventlog as E
from sarafa.operators import portfolio as P
from sarafa.operators import trends as T
from sarafa.plans.figures import _YEARLY, _yearly
from sarafa.plans.portfolio import ORACLES as PORTFOLIO_SQL
from sarafa.plans.portfolio import _positions, _series
from sarafa.session import table
from sarafa.sources import documents, sinks

GLOSSARY = {"view": "a page was seen", "purchase": "something was bought", "Error ": "something failed"}


def q66_boundary(s: SparkSession, d: str) -> DataFrame:
    """Events that may not enter the log, with the reason."""
    return E.boundary(table(s, d, "ingestion_events")).filter("refused IS NOT NULL").select("event_id", "refused")


def q67_opening(s: SparkSession, d: str) -> DataFrame:
    """The revenue of the year before the latest, by part type."""
    return P.rounded(T.opening(_yearly(s, d).select("entity", "fy", "value")), 3, "value")


def q68_troughs(s: SparkSession, d: str) -> DataFrame:
    """Lows of revenue per unit between better years."""
    unit = (F.col("value") / F.col("quantity") / 1000).alias("value")
    return P.rounded(T.trough(_yearly(s, d).select("entity", "fy", unit), 0.01), 6, "trough")


def q69_sip_notes(s: SparkSession, d: str) -> DataFrame:
    """Assumed returns of customers against a benchmark that some nations lack."""
    r, bench = (F.col("c_custkey") % 20).cast("double"), F.when(F.col("c_nationkey") % 5 != 0, F.lit(10.0))
    return table(s, d, "customer").select("c_custkey", T.sip_note(r, bench).alias("note"))


def q70_pledge_bands(s: SparkSession, d: str) -> DataFrame:
    """Pledged parts as read from a sentence, in bands."""
    said = F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("Promoters have pledged "), (F.col("p_size") - 10).cast("string"), F.lit("% of their stake"))).otherwise(F.lit("Nothing said"))
    return documents.pledge(table(s, d, "part").select("p_partkey", said.alias("text"))).select("p_partkey", "pledged_pct", T.pledge_band(F.col("pledged_pct")).alias("band"))


def q71_registry_merge(s: SparkSession, d: str) -> DataFrame:
    """Primary sources, and the rest of a registry whose names were changed."""
    reg = table(s, d, "source_registry")
    return sinks.merged(reg.filter("tier = 'primary'"), reg.withColumn("name", F.concat(F.lit("feed "), "name")), "source_id").select("source_id", "name")


def q72_glossary(s: SparkSession, d: str) -> DataFrame:
    """Events explained, unknown types without a text."""
    return table(s, d, "events").select(strings.glossary(F.col("event_type"), GLOSSARY).alias("meaning")).groupBy("meaning").agg(F.count("*").alias("n"))


def q73_searchable(s: SparkSession, d: str) -> DataFrame:
    """Records whose company is named, by company."""
    return documents.searchable(table(s, d, "numeric_records"), "company").groupBy("company").agg(F.count("*").alias("n"))


def q74_median_pe_basis(s: SparkSession, d: str) -> DataFrame:
    """Median price over earnings by the first basis that gives one."""
    x = _series(s, d)
    prices = x.groupBy("symbol", F.year("date").alias("fy")).agg(F.max("close").alias("close"))
    mean = x.groupBy("symbol", F.year("date").alias("fy")).agg(F.avg("close").alias("profit"), (F.count("*") * 1.0).alias("shares"))
    stated = mean.filter("symbol < 'C'").select("symbol", "fy", (F.col("profit") / 20).alias("eps"))
    yearly = T.per_share(mean.select("symbol", "fy", "profit"), mean.filter("symbol < 'H'").select("symbol", "fy", "shares"))
    now = T.per_share(mean.select("symbol", "fy", "profit"), mean.groupBy("symbol").agg(F.max_by("shares", "fy").alias("shares")))
    return P.rounded(T.first_median_pe(prices, stated, yearly, now), 5, "median_pe")


def q75_top_sector(s: SparkSession, d: str) -> DataFrame:
    """The heaviest known sector, if it is above the warning level."""
    weights = P.sectors(_positions(s, d)).filter("weight > 0.4 OR sector < 'F'").withColumn("weight", F.col("weight") * 4)
    return P.rounded(P.top_sector(weights), 6, "weight")


def q76_worst_drawdown(s: SparkSession, d: str) -> DataFrame:
    """The segment with the deepest fall."""
    return P.rounded(P.worst_drawdown(P.drawdowns(_series(s, d))), 8, "max_drawdown")


def _pages(s: SparkSession, d: str) -> DataFrame:
    """A page for each supplier: a quarterly table, the annual one with the same labels, ratios and shareholders."""
    row = lambda *cells: F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>"))
    text = lambda v: F.format_string("%.2f", v)
    v, k = F.col("s_acctbal"), F.col("s_suppkey").cast("double")
    quarterly = F.concat(F.lit("<table><tr><th></th><th>Dec 2023</th><th>Mar 2024</th></tr>"), row(F.lit("Sales +"), text(v * 9), text(v * 8)), F.lit("</table>"))
    yearly = F.concat(F.lit("<table><tr><th></th><th>Mar 2023</th><th>Mar 2024</th></tr>"), row(F.lit("Sales\u00a0+"), text(v), text(v * 2)), row(F.lit("Reserves"), text(k), F.lit("")), row(F.lit("Equity Capital"), text(k * 2), text(k * 3)), row(F.lit("Cash Conversion Cycle"), text(-k), text(k)), F.lit("</table>"))
    holders = F.concat(F.lit("<table><tr><th></th><th>Sep 2023</th><th>Dec 2023</th></tr>"), row(F.lit("Promoters +"), F.concat(text(k / 2), F.lit("%")), F.lit("n.a.")), row(F.lit("Public"), F.lit("1%"), F.lit("2%")), F.lit("</table>"))
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.concat(quarterly, yearly, holders).alias("html"))


def q77_statement_series(s: SparkSession, d: str) -> DataFrame:
    """Sales, equity and cash cycle of suppliers out of pages: annual tables only."""
    cells = documents.html_cells(_pages(s, d))
    equity = documents.added(documents.yearly(cells, "equity capital", "capital"), documents.yearly(cells, "reserves", "reserves"), "equity")
    every = documents.yearly(cells, "sales", "revenue").unionByName(equity).unionByName(documents.cash_cycle(cells))
    return P.rounded(every, 2, "value")


def q78_holding_series(s: SparkSession, d: str) -> DataFrame:
    """The promoters' stakes of suppliers out of pages, by period."""
    return documents.holding_series(documents.html_cells(_pages(s, d)))


QUERIES = {f.__name__: f for f in (q66_boundary, q67_opening, q68_troughs, q69_sip_notes, q70_pledge_bands, q71_registry_merge, q72_glossary, q73_searchable, q74_median_pe_basis, q75_top_sector, q76_worst_drawdown, q77_statement_series, q78_holding_series)}

_S = PORTFOLIO_SQL["q06_max_drawdown"].split(", dd AS", 1)[0]
ORACLES = {
    "q66_boundary": r"SELECT event_id, refused FROM (SELECT event_id, CASE WHEN coalesce(trim(item_key, ' '), '') = '' THEN 'no key' WHEN coalesce(trim(source_id, ' '), '') = '' THEN 'no source' WHEN coalesce(trim(content_hash, ' '), '') = '' THEN 'no content' WHEN coalesce(as_of, '') <> '' AND (NOT regexp_full_match(left(trim(as_of, ' '), 10), '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR try_cast(left(trim(as_of, ' '), 10) AS DATE) IS NULL) THEN 'bad date' END AS refused FROM ingestion_events) WHERE refused IS NOT NULL",
    "q67_opening": "WITH " + _YEARLY + ", m AS (SELECT entity, max(fy) AS last FROM yearly GROUP BY 1) SELECT y.entity, y.fy, round(value, 3) AS value FROM yearly y JOIN m ON m.entity = y.entity AND y.fy = last - 1",
    "q68_troughs": "WITH " + _YEARLY + ", s AS (SELECT entity, fy, value / quantity / 1000 AS v FROM yearly), g AS (SELECT entity, arg_min(v, fy) AS a, arg_max(v, fy) AS b, min(fy) AS f0, max(fy) AS f1 FROM s GROUP BY 1), i AS (SELECT s.entity, min(v) AS low, arg_min(fy, v) AS tf FROM s JOIN g USING (entity) WHERE fy <> f0 AND fy <> f1 GROUP BY 1) SELECT g.entity, CASE WHEN low < least(a, b) - 0.01 THEN tf END AS trough_fy, CASE WHEN low < least(a, b) - 0.01 THEN round(low, 6) END AS trough FROM g LEFT JOIN i USING (entity)",
    "q69_sip_notes": "SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL WHEN c_custkey % 20 > 13 THEN 'well above' WHEN c_custkey % 20 < 7 THEN 'well below' ELSE 'in line with' END AS note FROM customer",
    "q70_pledge_bands": "SELECT p_partkey, CAST(p AS DOUBLE) AS pledged_pct, CASE WHEN p IS NULL THEN 'unknown' WHEN p = 0 THEN 'none' WHEN p >= 25 THEN 'high' ELSE 'watch' END AS band FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 AND p_size >= 10 THEN p_size - 10 END AS p FROM part)",
    "q71_registry_merge": "SELECT source_id, CASE WHEN tier = 'primary' THEN name ELSE 'feed ' || name END AS name FROM source_registry",
    "q72_glossary": "SELECT CASE event_type WHEN 'view' THEN 'a page was seen' WHEN 'purchase' THEN 'something was bought' WHEN 'error' THEN 'something failed' END AS meaning, count(*) AS n FROM events GROUP BY 1",
    "q73_searchable": "SELECT company, count(*) AS n FROM numeric_records WHERE trim(company, ' ') <> '' GROUP BY 1",
    "q74_median_pe_basis": _S + """, y AS (SELECT symbol, year(date) AS fy, max(close) AS close, avg(close) AS profit, count(*) AS shares FROM series GROUP BY 1, 2), n AS (SELECT symbol, arg_max(shares, fy) AS now FROM y GROUP BY 1),
e AS (SELECT symbol, fy, close, profit / 20 AS eps, 0 AS basis FROM y WHERE symbol < 'C' UNION ALL SELECT symbol, fy, close, profit / shares, 1 FROM y WHERE symbol < 'H' UNION ALL SELECT y.symbol, fy, close, profit / now, 2 FROM y JOIN n USING (symbol)),
m AS (SELECT symbol, basis, median(close / eps) AS pe, count(*) AS k FROM e WHERE close > 0 AND eps > 0 GROUP BY 1, 2), f AS (SELECT symbol, min(basis) AS basis FROM m WHERE k >= 2 GROUP BY 1) SELECT symbol, round(pe, 5) AS median_pe, basis FROM m JOIN f USING (symbol, basis)""",
    "q75_top_sector": "WITH w AS (" + PORTFOLIO_SQL["q03_sector_weights"].replace("round(sum(weight), 6)", "sum(weight)") + ") SELECT arg_max(sector, weight) AS sector, round(max(weight) * 4, 6) AS weight FROM w WHERE lower(trim(sector)) <> 'unknown' AND (weight > 0.4 OR sector < 'F') HAVING max(weight) * 4 > 0.40",
    "q76_worst_drawdown": "WITH d AS (" + PORTFOLIO_SQL["q06_max_drawdown"] + ") SELECT arg_min(symbol, max_drawdown) AS symbol, min(max_drawdown) AS max_drawdown FROM d",
    "q77_statement_series": "WITH p AS (SELECT s_suppkey AS entity, s_acctbal AS v, CAST(s_suppkey AS DOUBLE) AS k FROM supplier) SELECT entity, 'revenue' AS figure, 2023 AS fy, round(round(v, 2) * 1e7, 2) AS value FROM p UNION ALL SELECT entity, 'revenue', 2024, round(round(v * 2, 2) * 1e7, 2) FROM p UNION ALL SELECT entity, 'equity', 2023, round(k * 3 * 1e7, 2) FROM p UNION ALL SELECT entity, 'cash_cycle_days', 2023, -k FROM p UNION ALL SELECT entity, 'cash_cycle_days', 2024, k FROM p",
    "q78_holding_series": "SELECT s_suppkey AS entity, 0 AS ord, 'Sep 2023' AS period, s_suppkey / 2 AS value FROM supplier",
}
