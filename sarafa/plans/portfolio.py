"""Portfolio and risk queries. Holdings are order lines of parts; parts above a size have no price.

Price series are daily mean order totals of customers' market segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarafa.functions import dates, money
from sarafa.operators import portfolio as P
from sarafa.session import table


def _holdings(spark: SparkSession, d: str) -> DataFrame:
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    order = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    lots = line.select(F.col("l_partkey").cast("string").alias("symbol"), F.col("l_quantity").alias("quantity"), F.try_divide("l_extendedprice", "l_quantity").alias("avg_cost"), order.alias("ord"), F.col("l_partkey").alias("k"))
    return lots.join(part.select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("sector")), "k", "left").drop("k")


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_size <= 45").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_retailprice").alias("price"))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return P.positions(P.merge_lots(_holdings(spark, d)), _prices(spark, d))


def _series(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    x = o.join(c, o.o_custkey == c.c_custkey).filter("c_mktsegment IS NOT NULL")
    return x.groupBy(F.col("c_mktsegment").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))


def _bench(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close")).select(F.lit("all").alias("symbol"), "date", "close")


def q01_portfolio_positions(s: SparkSession, d: str) -> DataFrame:
    """Lots merged and priced."""
    return P.rounded(_positions(s, d), 4, "quantity", "avg_cost", "price", "invested", "value", "pnl", "pnl_pct").withColumn("weight", F.round("weight", 9)).drop("ord")


def q02_portfolio_summary(s: SparkSession, d: str) -> DataFrame:
    """Totals and concentration of the book."""
    return P.rounded(P.rounded(P.summary(_positions(s, d)), 2, "invested", "value", "pnl"), 6, "pnl_pct", "hhi", "top_weight", "effective_holdings")


def q02_missing_symbols(s: SparkSession, d: str) -> DataFrame:
    """Holdings without a price."""
    return P.missing(P.merge_lots(_holdings(s, d)), _prices(s, d))


def q03_sector_weights(s: SparkSession, d: str) -> DataFrame:
    """Weights by sector."""
    return P.rounded(P.sectors(_positions(s, d)), 6, "weight")


def q04_sector_enrich(s: SparkSession, d: str) -> DataFrame:
    """Blank sectors of uploaded holdings filled from the list of symbols."""
    h = table(s, d, "sample_portfolio").select("holding_id", money.normalize_symbol(F.col("symbol")).alias("symbol"), "sector")
    ref = table(s, d, "ref_symbols").select("symbol", F.col("sector").alias("industry"))
    return P.enrich_sectors(h, ref).select("holding_id", "symbol", "sector")


def q05_daily_returns(s: SparkSession, d: str) -> DataFrame:
    """Change from day to day of each segment."""
    return P.rounded(P.returns(_series(s, d)), 8, "ret").withColumn("date", F.col("date").cast("string"))


def q06_max_drawdown(s: SparkSession, d: str) -> DataFrame:
    """Deepest fall of each segment."""
    return P.rounded(P.drawdowns(_series(s, d)), 8, "max_drawdown")


def q07_volatility_beta(s: SparkSession, d: str) -> DataFrame:
    """Volatility and beta of the segments against all orders."""
    bench = P.returns(_bench(s, d)).select("date", F.col("ret").alias("bench"))
    return P.rounded(P.risk(P.returns(_series(s, d)), bench), 6, "volatility", "beta")


def q08_portfolio_returns(s: SparkSession, d: str) -> DataFrame:
    """Daily returns of a book weighted by the segments' order totals."""
    o, c = table(s, d, "orders"), table(s, d, "customer")
    w = o.join(c, o.o_custkey == c.c_custkey).filter("c_mktsegment IS NOT NULL").groupBy(F.col("c_mktsegment").alias("symbol")).agg(F.sum("o_totalprice").alias("weight"))
    return P.rounded(P.portfolio_returns(P.returns(_series(s, d)), w), 6, "ret").withColumn("date", F.col("date").cast("string"))


def q09_historical_cagr(s: SparkSession, d: str) -> DataFrame:
    """Yearly growth of each segment over its whole history."""
    return P.rounded(P.cagr_by_date(_series(s, d)), 6, "cagr_pct")


def q54_index_quote(s: SparkSession, d: str) -> DataFrame:
    """The last two closes of each segment."""
    return P.rounded(P.last_quote(_series(s, d)), 4, "last", "previous", "change_pct")


def q52_symbols_amounts(s: SparkSession, d: str) -> DataFrame:
    """Uploaded symbols and costs in their normal forms."""
    h, c = table(s, d, "sample_portfolio"), F.col("avg_cost")
    value = money.amount(c)
    return h.select("holding_id", money.normalize_symbol(F.col("symbol")).alias("symbol"), money.quote_symbol(money.normalize_symbol(F.col("symbol"))).alias("quote_symbol"), value.alias("cost"), money.indian_grouping(F.floor(value * 1000)).alias("grouped"))


def q53_dates_periods(s: SparkSession, d: str) -> DataFrame:
    """Dates of events as stated, and fiscal years of order dates."""
    e = table(s, d, "ingestion_events")
    day = dates.any_date(F.col("as_of"))
    return e.select("event_id", day.cast("string").alias("day"), dates.fiscal_year(day).cast("string").alias("fy"), dates.fiscal_year_end(dates.fiscal_year(day)).cast("string").alias("fy_end"), dates.first_year(F.col("as_of")).cast("string").alias("first_year"))


_LOTS = """
WITH h AS (
  SELECT CAST(l_partkey AS VARCHAR) AS symbol, l_quantity AS quantity, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS avg_cost,
    l_orderkey * 100 + l_linenumber AS ord, CASE WHEN p_size > 5 THEN trim(p_type) END AS sector
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
lots AS (
  SELECT symbol, sum(quantity) AS quantity, sum(quantity * avg_cost) / sum(quantity) AS avg_cost,
    coalesce(arg_min(sector, ord) FILTER (WHERE coalesce(sector, '') <> '' AND lower(sector) <> 'unknown'), 'Unknown') AS sector, min(ord) AS ord
  FROM h WHERE quantity > 0 AND avg_cost >= 0 GROUP BY symbol),
prices AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_retailprice AS price FROM part WHERE p_size <= 45),
base AS (SELECT l.*, price, quantity * avg_cost AS invested, quantity * price AS value FROM lots l JOIN prices USING (symbol) WHERE price IS NOT NULL),
pos AS (SELECT *, value - invested AS pnl, CASE WHEN invested <> 0 THEN (value - invested) / invested * 100 END AS pnl_pct, coalesce(value / nullif(sum(value) OVER (), 0), 0) AS weight FROM base)
"""
_SERIES = """
WITH series AS (
  SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IS NOT NULL GROUP BY 1, 2),
rets AS (SELECT * FROM (SELECT symbol, date, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS ret FROM series) WHERE ret IS NOT NULL)
"""
_STRIP = r"regexp_replace({}, '^[\s\x{{a0}}\x{{2007}}\x{{202f}}\x{{3000}}\x{{feff}}\x{{200b}}]+|[\s\x{{a0}}\x{{2007}}\x{{202f}}\x{{3000}}\x{{feff}}\x{{200b}}]+$', '', 'g')"
_NORMAL = _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(split_part(upper(" + _STRIP.format("symbol") + r"), ':', -1), '\.NS$', ''), '\.BO$', ''), '-EQ$', '')")
_AMOUNT = _STRIP.format(r"replace(regexp_replace(avg_cost, '(?i)₹|rs\.?|inr', '', 'g'), ',', '')")

QUERIES = {f.__name__: f for f in (q01_portfolio_positions, q02_portfolio_summary, q02_missing_symbols, q03_sector_weights, q04_sector_enrich, q05_daily_returns, q06_max_drawdown, q07_volatility_beta, q08_portfolio_returns, q09_historical_cagr, q52_symbols_amounts, q53_dates_periods, q54_index_quote)}

ORACLES = {
    "q01_portfolio_positions": _LOTS + "SELECT symbol, sector, round(quantity, 4) AS quantity, round(avg_cost, 4) AS avg_cost, round(price, 4) AS price, round(invested, 4) AS invested, round(value, 4) AS value, round(pnl, 4) AS pnl, round(pnl_pct, 4) AS pnl_pct, round(weight, 9) AS weight FROM pos",
    "q02_portfolio_summary": _LOTS + """, s AS (SELECT count(*) AS n_positions, sum(invested) AS invested, sum(value) AS value, sum(weight * weight) AS hhi, max(weight) AS top_weight FROM pos)
SELECT n_positions, round(invested, 2) AS invested, round(value, 2) AS value, round(value - invested, 2) AS pnl, round((value - invested) / invested * 100, 6) AS pnl_pct, round(hhi, 6) AS hhi, round(top_weight, 6) AS top_weight, round(1 / hhi, 6) AS effective_holdings, top_weight > 0.25 AS top_warn, hhi > 0.20 AS hhi_warn FROM s""",
    "q02_missing_symbols": _LOTS + "SELECT symbol, ord FROM lots WHERE symbol NOT IN (SELECT symbol FROM prices WHERE price IS NOT NULL)",
    "q03_sector_weights": _LOTS + "SELECT sector, round(sum(weight), 6) AS weight, count(*) AS n_positions, lower(sector) <> 'unknown' AND sum(weight) > 0.40 AS concentrated FROM pos GROUP BY sector",
    "q04_sector_enrich": f"""WITH h AS (SELECT holding_id, {_NORMAL} AS symbol, sector FROM sample_portfolio)
SELECT holding_id, h.symbol, CASE WHEN lower({_STRIP.format("coalesce(h.sector, '')")}) IN ('', 'unknown') THEN coalesce(nullif({_STRIP.format('r.sector')}, ''), 'Unknown') ELSE {_STRIP.format('h.sector')} END AS sector FROM h LEFT JOIN ref_symbols r ON r.symbol = h.symbol""",
    "q05_daily_returns": _SERIES + "SELECT symbol, CAST(date AS VARCHAR) AS date, round(ret, 8) AS ret FROM rets",
    "q06_max_drawdown": _SERIES + ", dd AS (SELECT symbol, (close - max(close) OVER w) / max(close) OVER w AS dd FROM series WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) SELECT symbol, round(least(min(dd), 0), 8) AS max_drawdown FROM dd GROUP BY symbol",
    "q07_volatility_beta": _SERIES + """, allday AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1),
bench AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS bench FROM allday),
b AS (SELECT symbol, count(*) AS n, covar_samp(ret, bench) / var_samp(bench) AS beta FROM rets JOIN bench USING (date) WHERE bench IS NOT NULL GROUP BY symbol),
v AS (SELECT symbol, stddev_samp(ret) * sqrt(252) AS volatility FROM rets GROUP BY symbol)
SELECT symbol, round(volatility, 6) AS volatility, round(beta, 6) AS beta, coalesce(n, 0) AS n FROM v LEFT JOIN b USING (symbol)""",
    "q08_portfolio_returns": _SERIES + """, w AS (SELECT c_mktsegment AS symbol, sum(o_totalprice) AS weight FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IS NOT NULL GROUP BY 1)
SELECT CAST(date AS VARCHAR) AS date, round(sum(ret * weight) / (SELECT sum(weight) FROM w), 6) AS ret FROM rets JOIN w USING (symbol) GROUP BY date HAVING count(*) = (SELECT count(*) FROM w)""",
    "q09_historical_cagr": _SERIES + """, g AS (SELECT symbol, arg_min(close, date) AS c0, arg_max(close, date) AS c1, date_diff('day', min(date), max(date)) / 365.25 AS years FROM series GROUP BY symbol)
SELECT symbol, CASE WHEN years >= 3 AND c0 > 0 AND c1 > 0 THEN round((pow(c1 / c0, 1 / years) - 1) * 100, 6) END AS cagr_pct FROM g""",
    "q54_index_quote": _SERIES + """, r AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM series), t AS (SELECT symbol, max(close) FILTER (WHERE r = 1) AS l, max(close) FILTER (WHERE r = 2) AS p FROM r GROUP BY symbol)
SELECT symbol, round(l, 4) AS last, round(coalesce(p, l), 4) AS previous, round(CASE WHEN coalesce(p, l) = 0 THEN 0 ELSE (l - coalesce(p, l)) / coalesce(p, l) * 100 END, 4) AS change_pct FROM t""",
    "q52_symbols_amounts": f"""WITH n AS (SELECT holding_id, {_NORMAL} AS symbol, {_AMOUNT} AS bare FROM sample_portfolio),
v AS (SELECT holding_id, symbol, CASE WHEN regexp_full_match(bare, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(bare AS DOUBLE) END AS cost FROM n),
g AS (SELECT *, CAST(abs(CAST(floor(cost * 1000) AS BIGINT)) AS VARCHAR) AS dg FROM v)
SELECT holding_id, symbol, CASE WHEN starts_with(symbol, '^') OR ends_with(symbol, '.NS') OR ends_with(symbol, '.BO') THEN symbol WHEN regexp_full_match(symbol, '[0-9]+') THEN symbol || '.BO' ELSE symbol || '.NS' END AS quote_symbol, cost,
  CASE WHEN cost < 0 THEN '-' ELSE '' END || CASE WHEN length(dg) > 3 THEN reverse(regexp_replace(regexp_replace(reverse(left(dg, length(dg) - 3)), '([0-9][0-9])', '\\1,', 'g'), ',$', '')) || ',' || right(dg, 3) ELSE dg END AS grouped FROM g""",
    "q53_dates_periods": """WITH p AS (SELECT event_id, as_of, coalesce(CASE WHEN regexp_matches(trim(as_of), '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(left(trim(as_of), 10) AS DATE) END,
  CAST(try_strptime(trim(as_of), '%d-%b-%Y %H:%M:%S') AS DATE), CAST(try_strptime(trim(as_of), '%d-%b-%Y') AS DATE), CAST(try_strptime(trim(as_of), '%d %b %Y') AS DATE), CAST(try_strptime(trim(as_of), '%d/%m/%Y') AS DATE)) AS day FROM ingestion_events),
f AS (SELECT event_id, as_of, day, CAST(year(day) + CASE WHEN month(day) > 3 THEN 1 ELSE 0 END AS INTEGER) AS fy FROM p)
SELECT event_id, CAST(day AS VARCHAR) AS day, CAST(fy AS VARCHAR) AS fy, CAST(make_date(fy, 3, 31) AS VARCHAR) AS fy_end, nullif(regexp_extract(as_of, '([0-9]{4})', 1), '') AS first_year FROM f""",
}
