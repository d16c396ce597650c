"""Queries on figures from several sources and on yearly series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarafa.operators import portfolio as P
from sarafa.operators import trends as T
from sarafa.operators import verify as V
from sarafa.plans.portfolio import _series
from sarafa.session import table


def _three(base: DataFrame, *keys: str) -> DataFrame:
    """Three sources of a value, the second and third off by a few percent and sometimes silent."""
    n = F.col("n")
    b = F.when(n % 13 != 0, F.col("value") * (1 + ((n % 7) - 3) / 100))
    c = F.when(n % 17 != 0, F.col("value") * (1 + ((n % 11) - 5) / 100))
    parts = [base.select(*keys, F.lit(s).alias("source_id"), v.alias("value"), F.lit(i).cast("bigint").alias("ord")) for i, (s, v) in enumerate((("a", F.col("value")), ("b", F.when(n % 17 != 0, b)), ("c", c)))]
    return reduce(DataFrame.unionByName, parts)


def q10_verify_figures(s: SparkSession, d: str) -> DataFrame:
    """Retail prices of parts as three sources state them."""
    base = table(s, d, "part").select(F.col("p_partkey").alias("entity"), F.lit("price").alias("figure"), F.col("p_retailprice").alias("value"), F.col("p_partkey").alias("n"))
    return P.rounded(V.consensus(_three(base, "entity", "figure"), "entity", "figure"), 6, "value")


def q11_verify_identity(s: SparkSession, d: str) -> DataFrame:
    """Order totals against the sum of their lines."""
    parts = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("part"))
    totals = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    return P.rounded(V.identity(parts, totals, "k"), 4, "total", "parts")


def _yearly(s: SparkSession, d: str) -> DataFrame:
    line = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return line.groupBy(F.col("p_type").alias("entity"), F.year("l_shipdate").alias("fy")).agg(F.sum("l_extendedprice").alias("value"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"), F.sum("l_quantity").alias("quantity"))


def _sources(s: SparkSession, d: str) -> DataFrame:
    base = _yearly(s, d).select("entity", F.lit("revenue").alias("figure"), "fy", "value", (F.length("entity") + F.col("fy")).alias("n"))
    return _three(base, "entity", "figure", "fy")


def q12_verified_series(s: SparkSession, d: str) -> DataFrame:
    """Yearly revenue by part type where two sources agree."""
    return P.rounded(V.verified_series(_sources(s, d)), 3, "value")


def q13_latest_common_year(s: SparkSession, d: str) -> DataFrame:
    """The latest year held by two sources."""
    return V.latest_common_year(_sources(s, d))


def q13_aligned(s: SparkSession, d: str) -> DataFrame:
    """Values of the common year, filled up from undated ones."""
    x = _sources(s, d)
    scalars = x.groupBy("entity", "figure", "source_id").agg(F.max_by("value", "fy").alias("value"), F.min("ord").alias("ord"))
    return P.rounded(V.align(x.filter("source_id <> 'c'"), scalars), 3, "value")


def q14_fy_cagr_trend(s: SparkSession, d: str) -> DataFrame:
    """Growth of revenue and of what is left after discounts and tax."""
    y = _yearly(s, d)
    return P.rounded(T.margin_direction(y.select("entity", "fy", "value"), y.select("entity", "fy", (F.col("net") - F.col("tax")).alias("value"))), 6, "revenue_cagr", "profit_cagr")


def q15_yoy_swing(s: SparkSession, d: str) -> DataFrame:
    """Range of yearly growth by part type."""
    return P.rounded(T.swing(_yearly(s, d).select("entity", "fy", "value")), 5, "swing")


def q15_latest_growth(s: SparkSession, d: str) -> DataFrame:
    """Growth of the latest year."""
    return P.rounded(T.latest_growth(_yearly(s, d).select("entity", "fy", "value")), 5, "growth_pct")


def q16_cash_conversion(s: SparkSession, d: str) -> DataFrame:
    """Net over gross revenue of all years."""
    y = _yearly(s, d)
    return P.rounded(T.cash_conversion(y.select("entity", "fy", F.col("net").alias("value")), y.select("entity", "fy", "value")), 6, "ratio")


def q17_turning_points(s: SparkSession, d: str) -> DataFrame:
    """Peaks of revenue per unit."""
    return P.rounded(T.turning_point(_yearly(s, d).select("entity", "fy", (F.col("value") / F.col("quantity") / 1000).alias("value")), 0.01), 6, "first", "last", "peak").withColumn("peak_fy", F.col("peak_fy").cast("string"))


def _year_ends(s: SparkSession, d: str) -> DataFrame:
    x = _series(s, d)
    return x.select("symbol", F.make_date(F.year("date"), F.lit(3), F.lit(31)).alias("at")).distinct()


def q18_asof_price(s: SparkSession, d: str) -> DataFrame:
    """The last close on or before 31 March of each year."""
    return P.rounded(T.asof(_year_ends(s, d), _series(s, d)), 4, "close").select("symbol", F.col("at").cast("string").alias("at_date"), "close")


def q19_median_pe(s: SparkSession, d: str) -> DataFrame:
    """Median of price over yearly mean, by segment."""
    prices = T.asof(_year_ends(s, d), _series(s, d)).select("symbol", F.year("at").alias("fy"), "close")
    eps = _series(s, d).groupBy("symbol", F.year("date").alias("fy")).agg((F.avg("close") / 20).alias("eps"))
    return P.rounded(T.median_pe(prices, eps), 5, "median_pe")


def _facts(s: SparkSession, d: str) -> DataFrame:
    """Balance-like figures of suppliers: this year's and the last's."""
    l = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("profit"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("interest"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") * F.col("l_discount"))).alias("ocf"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))).alias("assets"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice") / 10)).alias("debt"))
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") * 10).alias("equity"), F.col("s_acctbal").alias("opening_equity"))
    return l.join(sup, "entity").withColumn("ebit", F.col("profit") + F.col("interest")).withColumn("opening_assets", F.col("assets") / 2)


_RATIOS = ("roe", "roce", "roa", "net_margin", "op_margin", "asset_turnover", "debt_equity", "cover", "ocf_profit")


def q20_ratio_suite(s: SparkSession, d: str) -> DataFrame:
    """Ratios of suppliers and their bands."""
    r = P.rounded(T.ratios(_facts(s, d)), 5, *_RATIOS)
    return r.select("entity", *_RATIOS, *(f"{n}_band" for n in T.GOOD_WEAK), "leverage_band", "cash_band", "severe")


def q21_signals(s: SparkSession, d: str) -> DataFrame:
    """The bands counted to a quality tier."""
    return T.signals(T.ratios(_facts(s, d)))


def q24_allocation(s: SparkSession, d: str) -> DataFrame:
    """A fixed amount spread over suppliers by tier, nobody above the room."""
    c = table(s, d, "supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_nationkey") % 3).alias("tier"), F.greatest("s_acctbal", F.lit(0.0)).alias("room"))
    return P.rounded(T.water_fill(c, 150000.0), 5, "take", "room")


def q26_sip_projection(s: SparkSession, d: str) -> DataFrame:
    """What monthly payments of a customer's balance come to, nominal and real."""
    c = table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("m"), (F.col("c_nationkey") % 15).cast("double").alias("r"), (F.col("c_custkey") % 20 + 1).cast("double").alias("y"))
    return c.select("k", F.round(T.sip_value(F.col("m"), F.col("r"), F.col("y")), 3).alias("nominal"), F.round(T.real_value(T.sip_value(F.col("m"), F.col("r"), F.col("y")), F.col("y")), 3).alias("real"))


def q60_source_lists(s: SparkSession, d: str) -> DataFrame:
    """The sources that state each yearly revenue."""
    return V.source_lists(_sources(s, d))


def q61_vintage(s: SparkSession, d: str) -> DataFrame:
    """The latest verified year by part type."""
    return V.vintage(V.verified_series(_sources(s, d)))


def q62_single_record_years(s: SparkSession, d: str) -> DataFrame:
    """Figures of companies that one record alone states for a year."""
    n = table(s, d, "numeric_records").filter("company IS NOT NULL AND figure IS NOT NULL AND period IS NOT NULL")
    return V.single_record_years(n.select("company", "figure", F.col("period").alias("fy"), "record_id"), "company", "figure")


def q63_share_of_revenue(s: SparkSession, d: str) -> DataFrame:
    """Tax as a part of net revenue, latest and how often high."""
    y = _yearly(s, d)
    return P.rounded(T.share_of(y.select("entity", "fy", F.col("tax").alias("value")), y.select("entity", "fy", F.col("net").alias("value")), 0.042), 8, "share")


def q64_trend_lines(s: SparkSession, d: str) -> DataFrame:
    """What the trends say, in words."""
    y = _yearly(s, d)
    return T.trend_lines(y.select("entity", "fy", "value"), y.select("entity", "fy", F.col("net").alias("value")))


QUERIES = {f.__name__: f for f in (q60_source_lists, q61_vintage, q62_single_record_years, q63_share_of_revenue, q64_trend_lines, q10_verify_figures, q11_verify_identity, q12_verified_series, q13_latest_common_year, q13_aligned, q14_fy_cagr_trend, q15_yoy_swing, q15_latest_growth, q16_cash_conversion, q17_turning_points, q18_asof_price, q19_median_pe, q20_ratio_suite, q21_signals, q24_allocation, q26_sip_projection)}

_YEARLY = "yearly AS (SELECT p_type AS entity, CAST(year(l_shipdate) AS INTEGER) AS fy, sum(l_extendedprice) AS value, sum(l_extendedprice * (1 - l_discount)) AS net, sum(l_extendedprice * l_tax) AS tax, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def _three_sql(base: str, keys: str) -> str:
    return f"""base AS ({base}), vals AS (
  SELECT {keys}, 'a' AS source_id, value, 0 AS ord FROM base
  UNION ALL SELECT {keys}, 'b', CASE WHEN n % 17 <> 0 AND n % 13 <> 0 THEN value * (1 + ((n % 7) - 3) / 100.0) END, 1 FROM base
  UNION ALL SELECT {keys}, 'c', CASE WHEN n % 17 <> 0 THEN value * (1 + ((n % 11) - 5) / 100.0) END, 2 FROM base)"""


def _consensus_sql(keys: str) -> str:
    on = " AND ".join(f"a.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    mkeys = ", ".join(f"m.{k.strip()}" for k in keys.split(","))
    return f"""known AS (SELECT * FROM vals WHERE value IS NOT NULL),
grp AS (SELECT {mkeys}, m.ord AS m, count(*) AS size, list(a.ord ORDER BY a.ord) AS ords, median(a.value) AS med, list(a.source_id ORDER BY a.source_id) AS srcs
  FROM known m JOIN known a ON {on} AND a.value >= m.value AND abs(a.value - m.value) <= 0.02 * greatest(abs(a.value), abs(m.value), 1e-9) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY size DESC, ords) AS r FROM grp) WHERE r = 1),
cnt AS (SELECT {keys}, count(value) AS n, list(source_id ORDER BY source_id) FILTER (WHERE value IS NOT NULL) AS allsrc, arg_min(value, ord) FILTER (WHERE value IS NOT NULL) AS firstv FROM vals GROUP BY {keys}),
verdict AS (SELECT {keys}, CASE WHEN n = 0 THEN 'unverifiable' WHEN n < 2 THEN 'single_source' WHEN size >= 2 THEN 'verified' ELSE 'conflict' END AS status,
  CASE WHEN n >= 2 AND size >= 2 THEN med WHEN n = 1 THEN firstv END AS value, CAST(CASE WHEN n >= 2 AND size >= 2 THEN size ELSE 0 END AS INTEGER) AS n_agree,
  CASE WHEN n >= 2 AND size >= 2 THEN array_to_string(list_filter(allsrc, lambda x: NOT list_contains(srcs, x)), ',') ELSE '' END AS outliers FROM cnt LEFT JOIN best USING ({keys}))"""


_YEAR_SOURCES = "WITH " + _YEARLY + ", " + _three_sql("SELECT entity, 'revenue' AS figure, fy, value, length(entity) + fy AS n FROM yearly", "entity, figure, fy")
_CAGR = "CASE WHEN count({v}) >= 3 AND arg_min({v}, fy) > 0 AND arg_max({v}, fy) > 0 THEN (pow(arg_max({v}, fy) / arg_min({v}, fy), 1.0 / (max(fy) - min(fy))) - 1) * 100 END"
_GROWTH = "growth AS (SELECT * FROM (SELECT entity, fy, CASE WHEN abs(p) > 1e-9 THEN (value - p) / abs(p) * 100 END AS growth_pct, pf, last FROM (SELECT entity, fy, value, lag(value) OVER w AS p, lag(fy) OVER w AS pf, max(fy) OVER (PARTITION BY entity) AS last FROM yearly WINDOW w AS (PARTITION BY entity ORDER BY fy))) WHERE growth_pct IS NOT NULL)"
_SEG = "series AS (SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IS NOT NULL GROUP BY 1, 2), ends AS (SELECT DISTINCT symbol, make_date(CAST(year(date) AS INTEGER), 3, 31) AS at FROM series), asofs AS (SELECT e.symbol, e.at, s.close FROM ends e ASOF LEFT JOIN series s ON e.symbol = s.symbol AND e.at >= s.date)"
_FACTS = """facts AS (SELECT l.*, CASE WHEN s_acctbal > 0 THEN s_acctbal * 10 END AS equity, s_acctbal AS opening_equity, profit + interest AS ebit, assets / 2 AS opening_assets FROM (
  SELECT l_suppkey AS entity, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (l_discount - l_tax)) AS profit, sum(l_extendedprice * l_tax) AS interest, sum(l_extendedprice * l_discount) FILTER (WHERE l_returnflag = 'R') AS ocf, sum(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS assets, sum(l_extendedprice / 10) FILTER (WHERE l_linestatus = 'F') AS debt FROM lineitem GROUP BY 1) l JOIN supplier ON s_suppkey = entity),
bases AS (SELECT *, CASE WHEN opening_equity > 0 THEN (equity + opening_equity) / 2 ELSE equity END AS be, CASE WHEN opening_assets > 0 THEN (assets + opening_assets) / 2 ELSE assets END AS ba, equity + debt AS cap FROM facts),
r AS (SELECT entity, ebit, interest, CASE WHEN be > 0 THEN profit / be * 100 END AS roe, CASE WHEN cap > 0 THEN ebit / cap * 100 END AS roce, CASE WHEN ba > 0 THEN profit / ba * 100 END AS roa, CASE WHEN revenue > 0 THEN profit / revenue * 100 END AS net_margin, CASE WHEN revenue > 0 THEN ebit / revenue * 100 END AS op_margin, CASE WHEN ba > 0 THEN revenue / ba END AS asset_turnover, CASE WHEN equity > 0 THEN debt / equity END AS debt_equity, CASE WHEN ebit > 0 AND interest > 0 THEN ebit / interest END AS cover, CASE WHEN profit > 0 THEN ocf / profit END AS ocf_profit FROM bases),
banded AS (SELECT *, """ + ", ".join(f"CASE WHEN {n} IS NULL THEN 'unknown' " + (f"WHEN {n} > 100 THEN 'unusual' " if n.endswith("margin") else "") + f"WHEN {n} >= {g} THEN 'good' WHEN {n} < {w} THEN 'weak' ELSE 'fair' END AS {n}_band" for n, (g, w) in T.GOOD_WEAK.items()) + """,
  coalesce(interest > 0 AND ebit < 0, false) OR coalesce(cover < 1, false) AS cannot FROM r),
rated AS (SELECT *, CASE WHEN debt_equity IS NULL THEN 'unknown' WHEN debt_equity > 1 OR cannot OR coalesce(cover < 3, false) THEN 'stretched' WHEN debt_equity < 0.5 THEN 'healthy' ELSE 'moderate' END AS leverage_band,
  CASE WHEN ocf_profit IS NULL THEN 'unknown' WHEN ocf_profit < 0 THEN 'red_flag' WHEN ocf_profit >= 0.8 THEN 'strong' WHEN ocf_profit < 0.5 THEN 'weak' ELSE 'mixed' END AS cash_band, cannot OR coalesce(ocf_profit < 0, false) AS severe FROM banded)"""

ORACLES = {
    "q60_source_lists": _YEAR_SOURCES + " SELECT entity, figure, array_to_string(list_sort(list_distinct(list(source_id))), ',') AS sources FROM vals WHERE value IS NOT NULL GROUP BY 1, 2",
    "q61_vintage": _YEAR_SOURCES + ", " + _consensus_sql("entity, figure, fy") + " SELECT entity, max(fy) AS fy FROM verdict WHERE status = 'verified' GROUP BY 1",
    "q62_single_record_years": "SELECT company, figure, period AS fy, min(record_id) AS record_id FROM numeric_records WHERE company IS NOT NULL AND figure IS NOT NULL AND period IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1",
    "q63_share_of_revenue": "WITH " + _YEARLY + " SELECT entity, max(fy) AS fy, round(arg_max(tax / net, fy), 8) AS share, count(*) FILTER (WHERE tax / net >= 0.042) AS n_high, count(*) AS n_years FROM yearly WHERE net > 0 GROUP BY 1",
    "q10_verify_figures": "WITH " + _three_sql("SELECT p_partkey AS entity, 'price' AS figure, p_retailprice AS value, p_partkey AS n FROM part", "entity, figure") + ", " + _consensus_sql("entity, figure") + " SELECT entity, figure, status, round(value, 6) AS value, n_agree, outliers FROM verdict",
    "q11_verify_identity": "WITH p AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS parts FROM lineitem GROUP BY 1) SELECT o_orderkey AS k, round(o_totalprice, 4) AS total, round(parts, 4) AS parts, CASE WHEN o_totalprice IS NULL OR parts IS NULL THEN 'unverifiable' WHEN abs(parts - o_totalprice) / greatest(abs(o_totalprice), 1e-9) <= 0.01 THEN 'verified' ELSE 'conflict' END AS status FROM orders LEFT JOIN p ON k = o_orderkey",
    "q12_verified_series": _YEAR_SOURCES + ", " + _consensus_sql("entity, figure, fy") + " SELECT entity, figure, fy, round(value, 3) AS value FROM verdict WHERE status = 'verified'",
    "q13_latest_common_year": _YEAR_SOURCES + ", held AS (SELECT entity, figure, fy, count(DISTINCT source_id) AS n FROM vals WHERE value IS NOT NULL GROUP BY ALL) SELECT entity, figure, coalesce(max(fy) FILTER (WHERE n >= 2), max(fy)) AS fy FROM held GROUP BY 1, 2",
    "q13_aligned": _YEAR_SOURCES + """, two AS (SELECT * FROM vals WHERE source_id <> 'c' AND value IS NOT NULL), held AS (SELECT entity, figure, fy, count(DISTINCT source_id) AS n FROM two GROUP BY ALL),
y AS (SELECT entity, figure, coalesce(max(fy) FILTER (WHERE n >= 2), max(fy)) AS fy FROM held GROUP BY 1, 2), dated AS (SELECT t.entity, t.figure, t.source_id, t.value, 'FY' || t.fy AS locator, t.ord FROM two t JOIN y USING (entity, figure, fy)),
sc AS (SELECT entity, figure, source_id, arg_max(value, fy) AS value, min(ord) AS ord FROM vals GROUP BY 1, 2, 3),
sp AS (SELECT sc.*, row_number() OVER (PARTITION BY entity, figure ORDER BY ord) AS r, (SELECT count(*) FROM dated d WHERE d.entity = sc.entity) AS n FROM sc WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dated d WHERE d.entity = sc.entity AND d.source_id = sc.source_id)),
u AS (SELECT * FROM dated UNION ALL SELECT entity, figure, source_id, value, 'reported', ord FROM sp WHERE r <= 2 - n) SELECT entity, figure, source_id, round(value, 3) AS value, locator, CAST(ord AS BIGINT) AS ord FROM u""",
    "q14_fy_cagr_trend": "WITH " + _YEARLY + f", g AS (SELECT entity, {_CAGR.format(v='value')} AS r, {_CAGR.format(v='(net - tax)')} AS p FROM yearly GROUP BY 1) SELECT entity, round(r, 6) AS revenue_cagr, round(p, 6) AS profit_cagr, CASE WHEN p - r > 2 THEN 'expanding' WHEN p - r < -2 THEN 'shrinking' WHEN p - r IS NOT NULL THEN 'stable' END AS margin FROM g",
    "q15_yoy_swing": "WITH " + _YEARLY + ", " + _GROWTH + ", g AS (SELECT entity, count(*) AS n_growths, CASE WHEN count(*) >= 2 THEN max(growth_pct) - min(growth_pct) END AS s FROM growth GROUP BY 1) SELECT entity, n_growths, round(s, 5) AS swing, CASE WHEN s >= 500 THEN 'erratic' WHEN s >= 40 THEN 'volatile' WHEN s IS NOT NULL THEN 'steady' END AS verdict FROM g",
    "q15_latest_growth": "WITH " + _YEARLY + ", " + _GROWTH + " SELECT entity, fy, round(growth_pct, 5) AS growth_pct FROM growth WHERE fy = last AND pf = fy - 1",
    "q16_cash_conversion": "WITH " + _YEARLY + ", g AS (SELECT entity, count(*) AS n_years, CASE WHEN count(*) >= 3 AND bool_and(value > 0) THEN sum(net) / sum(value) END AS ratio FROM yearly GROUP BY 1) SELECT entity, n_years, round(ratio, 6) AS ratio, CASE WHEN ratio < 0 THEN 'burning' WHEN ratio < 0.5 THEN 'weak' WHEN ratio >= 0.8 THEN 'strong' WHEN ratio IS NOT NULL THEN 'mixed' END AS verdict FROM g",
    "q17_turning_points": "WITH " + _YEARLY + ", s AS (SELECT entity, fy, value / quantity / 1000 AS v FROM yearly), g AS (SELECT entity, arg_min(v, fy) AS a, arg_max(v, fy) AS b, min(fy) AS f0, max(fy) AS f1 FROM s GROUP BY 1), i AS (SELECT s.entity, max(v) AS top, arg_max(fy, v) AS tf FROM s JOIN g USING (entity) WHERE fy <> f0 AND fy <> f1 GROUP BY 1) SELECT g.entity, round(a, 6) AS first, round(b, 6) AS last, CASE WHEN top > greatest(a, b) + 0.01 THEN CAST(tf AS VARCHAR) END AS peak_fy, CASE WHEN top > greatest(a, b) + 0.01 THEN round(top, 6) END AS peak FROM g LEFT JOIN i USING (entity)",
    "q18_asof_price": "WITH " + _SEG + " SELECT symbol, CAST(asofs.at AS VARCHAR) AS at_date, round(close, 4) AS close FROM asofs",
    "q19_median_pe": "WITH " + _SEG + ", eps AS (SELECT symbol, year(date) AS fy, avg(close) / 20 AS eps FROM series GROUP BY 1, 2), pe AS (SELECT a.symbol, close / eps AS pe FROM asofs a JOIN eps e ON a.symbol = e.symbol AND year(a.at) = e.fy WHERE close > 0 AND eps > 0) SELECT symbol, count(*) AS n_years, CASE WHEN count(*) >= 2 THEN round(median(pe), 5) END AS median_pe FROM pe GROUP BY 1",
    "q20_ratio_suite": "WITH " + _FACTS + " SELECT entity, " + ", ".join(f"round({n}, 5) AS {n}" for n in _RATIOS) + ", " + ", ".join(f"{n}_band" for n in T.GOOD_WEAK) + ", leverage_band, cash_band, severe FROM rated",
    "q21_signals": "WITH " + _FACTS + """, n AS (SELECT entity, severe, CAST(3 - (cash_band = 'unknown')::INT - (leverage_band = 'unknown')::INT - (roce_band = 'unknown')::INT AS INTEGER) AS n_known,
  CAST((cash_band IN ('red_flag', 'weak'))::INT + (leverage_band = 'stretched')::INT + (roce_band = 'weak')::INT AS INTEGER) AS n_concern, CAST((cash_band = 'strong')::INT + (leverage_band = 'healthy')::INT + (roce_band = 'good')::INT AS INTEGER) AS n_positive, leverage_band = 'unknown' AS critical_unknown FROM rated)
SELECT *, CASE WHEN n_known = 0 THEN 'unknown' WHEN severe OR n_concern >= 2 THEN 'weak' WHEN n_concern = 1 THEN 'mixed' WHEN n_known >= 2 AND NOT critical_unknown AND n_positive >= 1 THEN 'strong' ELSE 'mixed' END AS quality FROM n""",
    "q24_allocation": """WITH c AS (SELECT s_suppkey AS symbol, s_nationkey % 3 AS tier, greatest(s_acctbal, 0.0) AS room FROM supplier WHERE s_acctbal > 0), t AS (SELECT tier, sum(room) AS total FROM c GROUP BY 1),
b AS (SELECT tier, total, greatest(150000.0 - coalesce(sum(total) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS lft FROM t),
s AS (SELECT c.*, total, lft, coalesce(sum(room) OVER (PARTITION BY tier ORDER BY room, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, row_number() OVER (PARTITION BY tier ORDER BY room, symbol) AS k, count(*) OVER (PARTITION BY tier) AS n FROM c JOIN b USING (tier)),
l AS (SELECT *, (lft - below) / (n - k + 1) AS lh FROM s), v AS (SELECT tier, arg_min(lh, k) AS level FROM l WHERE lh <= room GROUP BY 1)
SELECT symbol, tier, round(room, 5) AS room, round(CASE WHEN lft >= total THEN room ELSE least(room, level) END, 5) AS take FROM l LEFT JOIN v USING (tier)""",
    "q26_sip_projection": """WITH c AS (SELECT c_custkey AS k, c_acctbal AS m, CAST(c_nationkey % 15 AS DOUBLE) / 1200 AS i, CAST(c_custkey % 20 + 1 AS DOUBLE) AS y FROM customer WHERE c_acctbal > 0),
v AS (SELECT k, y, CASE WHEN i = 0 THEN m * y * 12 ELSE m * ((pow(1 + i, y * 12) - 1) / i) * (1 + i) END AS v FROM c) SELECT k, round(v, 3) AS nominal, round(v / pow(1.06, y), 3) AS real FROM v""",
}
