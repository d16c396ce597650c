import datetime as dt
import math
import random

from pyspark.sql import functions as F

from sarafa.functions import dates, money, strings
from sarafa.operators import portfolio as P

LOTS = "symbol string, quantity double, avg_cost double, sector string, ord bigint"


def test_positions_and_summary(spark):
    h = spark.createDataFrame([("A", 10.0, 100.0, "Tech", 0), ("B", 5.0, 200.0, "Bank", 1)], LOTS)
    px = spark.createDataFrame([("A", 150.0), ("B", 200.0)], "symbol string, price double")
    pos = P.positions(P.merge_lots(h), px)
    s = P.summary(pos).first()
    assert (s.invested, s.value, s.pnl, s.pnl_pct) == (2000.0, 2500.0, 500.0, 25.0)
    assert math.isclose(s.hhi, 0.52) and math.isclose(s.effective_holdings, 1 / 0.52) and s.top_warn
    assert P.summary(pos.limit(0)).first().value == 0.0


def test_lots_merge_and_missing(spark, rows):
    h = spark.createDataFrame([("R", 10.0, 2000.0, None, 0), ("R", 10.0, 2400.0, " Energy ", 1), ("T", 5.0, 3000.0, "Unknown", 2), ("Z", 0.0, 1.0, "x", 3), ("", 1.0, 1.0, "x", 4), ("N", None, 1.0, "x", 5)], LOTS)
    lots = P.merge_lots(h)
    assert rows(lots, "symbol", "quantity", "avg_cost", "sector") == [("R", 20.0, 2200.0, "Energy"), ("T", 5.0, 3000.0, "Unknown")]
    px = spark.createDataFrame([("R", 2500.0), ("T", None)], "symbol string, price double")
    assert rows(P.missing(lots, px), "symbol") == [("T",)]


def test_gain_is_null_on_nothing_invested(spark):
    pos = P.positions(P.merge_lots(spark.createDataFrame([("A", 1.0, 0.0, "x", 0)], LOTS)), spark.createDataFrame([("A", 5.0)], "symbol string, price double"))
    assert pos.first().pnl_pct is None and P.summary(pos).first().pnl_pct is None


def series(spark, name, closes, start=dt.date(2020, 1, 1)):
    return spark.createDataFrame([(name, start + dt.timedelta(days=i), float(c)) for i, c in enumerate(closes)], "symbol string, date date, close double")


def test_drawdown(spark):
    assert P.drawdowns(series(spark, "A", [100, 120, 90, 95, 60, 100])).first().max_drawdown == -0.5


def test_beta(spark):
    rng = random.Random(0)
    bench = [rng.gauss(0, 0.01) for _ in range(200)]
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    r = spark.createDataFrame([("A", day(i), 2 * b) for i, b in enumerate(bench)] + [("S", day(0), 0.1)], "symbol string, date date, ret double")
    b = spark.createDataFrame([(day(i), b) for i, b in enumerate(bench)], "date date, bench double")
    got = {x.symbol: x for x in P.risk(r, b).collect()}
    assert math.isclose(got["A"].beta, 2.0) and got["S"].beta is None and got["S"].volatility is None
    flat = b.withColumn("bench", F.lit(0.01))
    assert all(x.beta is None for x in P.risk(r, flat).collect())


def test_portfolio_returns_cancel(spark, rows):
    px = series(spark, "A", [100, 110, 121]).union(series(spark, "B", [100, 90, 81]))
    w = spark.createDataFrame([("A", 0.5), ("B", 0.5), ("none", 3.0)], "symbol string, weight double")
    assert [round(r[1], 12) for r in rows(P.portfolio_returns(P.returns(px), w))] == [0.0, 0.0]


def test_cagr(spark):
    px = spark.createDataFrame([("A", dt.date(2010, 1, 1), 100.0), ("A", dt.date(2010, 1, 1) + dt.timedelta(days=3650), 200.0), ("B", dt.date(2020, 1, 1), 1.0), ("B", dt.date(2021, 1, 1), 2.0)], "symbol string, date date, close double")
    got = {r.symbol: r.cagr_pct for r in P.cagr_by_date(px).collect()}
    assert abs(got["A"] - 7.18) < 0.01 and got["B"] is None


def test_last_quote(spark):
    got = P.last_quote(series(spark, "A", [100, 110]).union(series(spark, "B", [5]))).collect()
    assert {(r.symbol, r.last, r.previous, round(r.change_pct, 9)) for r in got} == {("A", 110.0, 100.0, 10.0), ("B", 5.0, 5.0, 0.0)}


def test_written_forms(spark):
    df = spark.createDataFrame([("NSE:TCS", "2,450.50", 12345678.0), (" infy-eq ", "₹ 1,520", 150000.0), ("500325.BO", "Rs.1,520.75", 999.0), (None, "nan", -1234567.0), ("RELIANCE.NS ", "INR 1e3", 0.0)], "s string, a string, v double")
    got = df.select(money.normalize_symbol(F.col("s")), money.quote_symbol(money.normalize_symbol(F.col("s"))), money.amount(F.col("a")), money.short_amount(F.col("v")), money.indian_grouping(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("TCS", "TCS.NS", 2450.5, "1.23 crore", "1,23,45,678"), ("INFY", "INFY.NS", 1520.0, "1.5 lakh", "1,50,000"), ("500325", "500325.BO", 1520.75, "999", "999"), (None, None, None, "-12.35 lakh", "-12,34,567"), ("RELIANCE", "RELIANCE.NS", 1000.0, "0", "0")]


def test_dates(spark):
    df = spark.createDataFrame([("2024-07-19 18:32:00", "FY24"), ("20-Jul-2024 09:00:00", "year ended 31 March 2023"), ("31 Mar 2020", "as at 31-03-2022"), ("", "none"), (None, None)], "d string, p string")
    got = [tuple(r) for r in df.select(dates.any_date(F.col("d")).cast("string"), dates.period_tag(F.col("p"))).collect()]
    assert got == [("2024-07-19", "FY2024"), ("2024-07-20", "FY2023"), ("2020-03-31", "FY2022"), (None, None), (None, None)]
    t = F.lit("2024-05-01").cast("date")
    edge = spark.createDataFrame([("2024-01-02",), ("2024-01-01",), ("2025-01-01",), (None,)], "d string").select(dates.is_recent(F.col("d").cast("date"), t), dates.freshness(F.col("d").cast("date"), t, 120))
    assert [tuple(r) for r in edge.collect()] == [(True, "fresh"), (False, "stale"), (True, "fresh"), (None, "unknown")]
    assert spark.sql("SELECT 'Mar 2024' AS p").select(dates.period_order(F.col("p"))).first()[0] == 202403


def test_strings(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(strings.clean_html(F.lit("<p>a&amp;b</p>\n <i>c</i>"))) == "a&b c"
    assert one(strings.title_tokens(F.lit("The Board's and Co."))) == ["boards", "co"]
    assert one(strings.title_tokens(F.lit("The and of"))) == ["the", "and", "of"]
    assert one(strings.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 1.0
    assert one(strings.first_sentence(F.lit("One. Two."))) == "One."
    assert one(strings.fragments(F.lit("A b. C\nd; e"))) == ["A b.", "C", "d;", "e"]
    assert one(strings.material_numbers(F.lit("In FY2024 sales of 12 crore rose 5 from 2024-01-02 to 1,234"))) == ["12", "1234"]
    assert one(F.size(strings.windows(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(220)), lambda i: i.cast("string")), " ")))) == 2
    assert [one(strings.truthy(F.lit(x))) for x in ("", "0", "off", "yes", None)] == [False, False, False, True, False]
    assert one(strings.dedup_key(F.lit("  भारत "))) == "भारत" and one(strings.number_key(F.lit("Rs 1,234.5"))) == "1234.5"
    assert one(strings.supporting_fragment(F.lit("No. It was 450 crore. Yes"), F.lit("450"))) == "It was 450 crore."
