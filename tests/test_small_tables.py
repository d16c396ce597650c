import time

from pyspark.sql import functions as F

from sarafa.functions import strings
from sarafa.operators import eventlog, records
from sarafa.operators import trends as T
from sarafa.operators import verify as V
from sarafa.sources import tables


def test_snapshot_round_trip(spark, rows):
    v = spark.createDataFrame([("e", "pe", "a", 20.5, "FY2024", 0), ("e", "pe", "b", None, None, 1), ("e", "debt", "a", 1e9, "p. 3", 0)], "entity string, figure string, source_id string, value double, locator string, ord bigint")
    back = V.from_snapshot(V.to_snapshot(v))
    assert rows(back) == [("e", "debt", "a", 1e9, "p. 3", 0), ("e", "pe", "a", 20.5, "FY2024", 0), ("e", "pe", "b", None, "", 1)]
    assert V.from_snapshot(spark.createDataFrame([("e", "{bad")], "entity string, snapshot string")).count() == 0


def test_single_years_and_context(spark, rows):
    r = spark.createDataFrame([("a", 2020, 1.0), ("a", 2021, 2.0), ("a", 2021, 2.0), ("a", None, 3.0)], "entity string, fy int, value double")
    assert rows(V.single_record_years(r, "entity"), "fy", "value") == [(2020, 1.0), (None, 3.0)]
    f = spark.createDataFrame([("e", "pe", 20.0, "verified"), ("e", "debt", None, "conflict")], "entity string, figure string, value double, status string")
    assert V.context_lines(f).first().text == "debt: unknown (conflict)\npe: 20.00 (verified)"


def test_share_and_lines(spark):
    y = lambda *v: spark.createDataFrame([("e", 2020 + i, x) for i, x in enumerate(v)], "entity string, fy int, value double")
    s = T.share_of(y(30.0, 10.0, 5.0), y(100.0, 100.0, 0.0)).first()
    assert (s.fy, s.share, s.n_high, s.n_years) == (2021, 0.1, 1, 2)
    assert T.trend_lines(y(100.0, 110.0, 121.0), y(10.0, 12.0, 14.4)).first().lines == "revenue growing at 10.0% a year; profit growing at 20.0% a year; margins expanding; profit growth steady"


def test_grounding_of_extractions(spark):
    df = spark.createDataFrame([("Net profit was 620 crore in 2024", "profit was 620 crore", "620", 2024), ("Net profit was 620 crore", "invented 620", "62", None), ("Net profit was 620 crore", None, "620", 2023), ("x", "x", "", None)], "text string, quote string, value_text string, year int")
    assert [r.grounded for r in records.grounded(df).collect()] == [True, False, False, False]


def test_latest_merge(spark, rows):
    kind = "symbol string, at bigint, status string"
    old = spark.createDataFrame([("A", 1, "ok"), ("B", 1, "ok"), ("C", 1, "ok")], kind)
    new = spark.createDataFrame([("B", 2, "draft"), ("B", 3, "ok"), ("C", 2, "ok"), ("C", 5, "draft"), ("D", 1, "ok")], kind)
    assert rows(eventlog.latest_merge(old, new, "symbol", "at", F.col("status") == "ok")) == [("A", 1, "ok"), ("B", 3, "ok"), ("D", 1, "ok")]


def test_kept_tables(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    at = str(tmp_path / "t")
    assert [tables.kept(spark, at, build, 60).count() for _ in range(2)] == [1, 1]
    assert tables.kept(spark, at, build, 60, force=True).count() == 2
    time.sleep(1.1)
    assert tables.kept(spark, at, build, 1).count() == 3 and len(calls) == 3


def test_tolerant_rows_and_answers(spark, rows):
    s = spark.createDataFrame([("A", "5"), ("B", "x"), (None, None)], "symbol string, n string")
    assert rows(tables.tolerant(s, {"symbol": ("string", ""), "n": ("int", 0), "day": ("date", None)})) == [("", 0, None), ("A", 5, None), ("B", 0, None)]

    def client(system, prompt):
        if prompt == "bad":
            raise ValueError
        return prompt.upper()

    p = spark.createDataFrame([("hi",), ("bad",)], "prompt string")
    assert rows(tables.ask(p, client), "prompt", "answer") == [("bad", None), ("hi", "HI")]


def test_words_and_kinds(spark):
    df = spark.createDataFrame([("HDFC Bank Growth",), (None,)], "n string")
    assert [tuple(r) for r in df.select(strings.all_words(F.col("n"), "bank-growth"), strings.sector_kind(F.col("n"))).collect()] == [(True, "bank"), (None, "other")]


def test_bands_notes_and_glossary(spark):
    from sarafa.functions import strings
    from sarafa.operators import trends

    df = spark.sql("SELECT * FROM VALUES (15.0D, 10.0D, 0.0D), (13.0D, 10.0D, 25.0D), (6.9D, 10.0D, 24.9D), (5.0D, NULL, NULL) AS t(a, b, p)")
    got = [tuple(r) for r in df.select(trends.sip_note(F.col("a"), F.col("b")), trends.pledge_band(F.col("p"))).collect()]
    assert got == [("well above", "none"), ("in line with", "high"), ("well below", "watch"), (None, "unknown")]
    words = spark.createDataFrame([(" ROE ",), ("p/e",), (None,)], "t string").select(strings.glossary(F.col("t"), {"Roe": "return"}), strings.glossary(F.col("t"), {}))
    assert [tuple(r) for r in words.collect()] == [("return", None), (None, None), (None, None)]


def test_series_openings_troughs_and_signs(spark):
    from sarafa.operators import trends

    s = spark.createDataFrame([("a", 2020, 5.0, 0), ("a", 2021, 1.0, 0), ("a", 2022, 6.0, 0), ("b", 2020, 1.0, 0), ("b", 2022, 2.0, 0), ("c", 2020, -1.0, 0), ("c", 2021, 1.0, 0), ("c", 2022, -5.0, 0), ("d", 2021, None, 0)], "entity string, fy int, value double, prior int").drop("prior")
    assert [tuple(r) for r in trends.opening(s).orderBy("entity").collect()] == [("a", 2021, 1.0), ("c", 2021, 1.0)]
    assert {r.entity: (r.trough_fy, r.trough) for r in trends.trough(s).collect()} == {"a": (2021, 1.0), "b": (None, None), "c": (None, None)}
    assert {r.entity: r.verdict for r in trends.swing(s).collect()} == {"a": "erratic", "b": None, "c": "sign_change"}
    assert trends.swing(s.limit(0)).count() == trends.trough(s.limit(0)).count() == trends.opening(s.limit(0)).count() == 0


def test_boundary_and_merge(spark):
    from sarafa.operators import eventlog
    from sarafa.sources import sinks

    ev = spark.createDataFrame([(1, "k", "s", "h", ""), (2, " ", "s", "h", None), (3, "k", None, "h", None), (4, "k", "s", "", None), (5, "k", "s", "h", "31/12/2024"), (6, "k", "s", "h", "2024-12-31T10:00:00")], "event_id int, item_key string, source_id string, content_hash string, as_of string")
    assert [r.refused for r in eventlog.boundary(ev).orderBy("event_id").collect()] == [None, "no key", "no source", "no content", "bad date", None]
    base = spark.createDataFrame([("a", 1), (None, 2)], "id string, n int")
    more = spark.createDataFrame([("a", 3), ("b", 4), ("b", 4), (None, 5)], "id string, n int")
    assert sorted(((r.id or "", r.n) for r in sinks.merged(base, more, "id").collect())) == [("", 2), ("a", 1), ("b", 4)]


def test_white_space_of_every_kind(spark):
    from sarafa.functions import strings

    df = spark.createDataFrame([("a b  c",), ("a b c",)], "t string")
    assert df.select(strings.content_hash(F.col("t"))).distinct().count() == 1
    assert [r[0] for r in df.select(strings.windows(F.col("t"))).collect()] == [["a b c"], ["a b c"]]


def test_prices_across_months_and_nulls(spark):
    from sarafa.operators import portfolio

    p = spark.createDataFrame([("a", "2024-01-30", 100.0), ("a", "2024-01-31", 120.0), ("a", "2024-02-01", 60.0), ("a", "2024-03-05", None), ("a", "2024-03-06", 90.0), ("b", "2024-01-01", 5.0)], "symbol string, date string, close double").withColumn("date", F.to_date("date"))
    got = {(r.symbol, str(r.date)): r.ret for r in portfolio.returns(p).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {("a", "2024-01-31"): 0.2, ("a", "2024-02-01"): -0.5}
    assert {r.symbol: round(r.max_drawdown, 6) for r in portfolio.drawdowns(p).collect()} == {"a": -0.5, "b": 0.0}
    assert {r.symbol: (r.last, r.previous) for r in portfolio.last_quote(p).collect()} == {"a": (90.0, 60.0), "b": (5.0, 5.0)}
    assert tuple(portfolio.worst_drawdown(portfolio.drawdowns(p)).first()) == ("a", -0.5) and portfolio.worst_drawdown(portfolio.drawdowns(p.limit(0))).count() == 0
