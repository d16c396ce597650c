import json

import pytest
from pyspark.sql import functions as F

from sarafa.operators import eventlog
from sarafa.sources import documents, feeds, fetch, holdings, sinks
from sarafa.streaming import eventlog as stream


def body(spark, text):
    return spark.createDataFrame([(text,)], "body string")


def test_holdings_csv(spark, rows, tmp_path):
    (tmp_path / "h.csv").write_text('Stock Name,Ticker, QTY. ,Avg Cost,Cost,Industry\nAcme Ltd,NSE:ACME,10,"2,450.50",9,\nX,INFY-EQ,5,Rs.1520,9,IT\nBad,BAD,0,1,1,IT\nBad,NAN,1,1,1,x\nBad,C,x,1,1,x\n')
    assert rows(holdings.read_csv(spark, str(tmp_path / "h.csv")), "symbol", "quantity", "avg_cost", "sector") == [("ACME", 10.0, 2450.5, "Unknown"), ("INFY", 5.0, 1520.0, "IT")]
    with pytest.raises(ValueError, match="quantity"):
        holdings.resolve(["symbol", "avg cost"])


def test_nav(spark, rows):
    lines = ["Scheme Code;ISIN;ISIN2;Name;NAV;Date", "", "Open Ended", "119551;INF1;-;Fund A;101.5;01-Jan-2024", "119552;-;-;Fund B;N.A.;01-Jan-2024", "119553;-;-;Fund C;-1;x", "12;1"]
    assert rows(feeds.nav_lines(spark.createDataFrame([(x,) for x in lines], "value string")), "code", "isin", "nav") == [("119551", "INF1", 101.5)]


def test_announcements(spark, rows):
    nse = [{"symbol": "A", "desc": "Outcome", "attchmntFile": "f.pdf", "attchmntText": "Board met", "an_dt": "20-Jul-2024 09:00:00", "sort_date": "2024-07-19 18:32:00"}, {"symbol": "A", "desc": " ", "attchmntText": ""}]
    for text in (json.dumps(nse), json.dumps({"data": nse})):
        assert rows(feeds.nse_announcements(body(spark, text)).withColumn("date", F.col("date").cast("string")), "title", "category", "date") == [("Board met", "Outcome", "2024-07-19")]
    bse = {"Table": [{"SCRIP_CD": "500", "CATEGORYNAME": "Result", "NEWSSUB": "", "HEADLINE": "Q1", "NEWS_DT": "2024-07-19T10:00:00", "ATTACHMENTNAME": "x.pdf"}]}
    assert rows(feeds.bse_announcements(body(spark, json.dumps(bse))), "symbol", "title") == [("500", "Q1")]
    assert feeds.nse_announcements(body(spark, "<html>")).count() == feeds.bse_announcements(body(spark, "")).count() == 0


def test_news(spark, rows):
    rss = "<rss><channel><item><title>Acme wins - The Paper</title><link>u</link><pubDate>Fri, 19 Jul 2024 10:00:00 GMT</pubDate><description>&lt;b&gt;Hi&lt;/b&gt; all</description><source>The Paper</source></item><item><title>Second</title><link>v</link></item></channel></rss>"
    r = feeds.news_rss(body(spark, rss)).withColumn("published", F.col("published").cast("string"))
    assert rows(r, "title", "publisher", "published", "summary") == [("Acme wins", "The Paper", "2024-07-19", "Hi all"), ("Second", None, None, None)]
    js = [{"id": "1", "content": {"title": "ACME wins!", "summary": "", "description": "d", "pubDate": "2024-07-18T01:00:00Z", "provider": {"displayName": "P"}, "canonicalUrl": {"url": "w"}}}]
    j = feeds.news_json(body(spark, json.dumps(js)))
    assert rows(feeds.merge_news(feeds.news_rss(body(spark, rss)), j), "title", "url") == [("Acme wins", "u"), ("Second", "v")]
    assert feeds.not_stale(feeds.news_rss(body(spark, rss)), "2026-01-01").count() == 1 and feeds.news_rss(body(spark, "junk")).count() == 0


def test_reports_codes_and_lines(spark, rows):
    listing = spark.createDataFrame([("A", json.dumps({"data": [{"fileName": "a22.pdf", "toYr": "2022"}, {"fileName": "a23.PDF", "toYr": "2023"}, {"fileName": "a24.zip", "toYr": "2024"}]}))], "symbol string, body string")
    assert [(r.url, r.fy, str(r.as_of)) for r in feeds.newest_report(listing).collect()] == [("a23.PDF", 2023, "2023-03-31")]
    s = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    seed = spark.createDataFrame([("A", "1")], "symbol string, code string")
    found = spark.createDataFrame([("B", "b", "2"), ("C", "CX", "3")], "symbol string, ticker string, code string")
    assert rows(feeds.resolve_codes(s, seed, found)) == [("A", "1"), ("B", "2"), ("C", None)]
    lines = spark.createDataFrame([('{"item_key":"k","source_id":"s","content_hash":"h"}',), ("{broken",), ('{"item_key":"k"}',)], "value string")
    assert feeds.event_lines(lines).count() == 1


def test_registry_and_library(spark, rows, tmp_path):
    (tmp_path / "r.yaml").write_text("# sources\nprimary:\n  - id: acme\n    name: Acme AR\n    url: http://x\nanalyst:\n  - id: note\n    name: 'A note'\ncreator: []\n")
    reg = documents.registry(spark, str(tmp_path / "r.yaml"))
    assert rows(reg, "source_id", "rank", "name") == [("acme", 1, "Acme AR"), ("note", 2, "A note")]
    for bad in ("primary:\n  - id: a\n  - id: a\n", "other:\n  - id: a\n"):
        with pytest.raises(ValueError):
            documents.read_registry(bad)
    lib = tmp_path / "lib"
    lib.mkdir()
    for name, text in (("acme.html", "<p>Net &amp; gross</p>"), ("note.pdf", "x"), ("stray.txt", "y")):
        (lib / name).write_text(text)
    good, bad = documents.library(spark, str(lib), reg)
    assert rows(good) == [("acme", "Net & gross")] and sorted(r.why for r in bad.collect()) == ["not registered", "unreadable"]


PAGE = "<table><tr><th></th><th>Mar 2023</th><th>Mar 2024</th></tr><tr><td>Sales&nbsp;+</td><td>1,000</td><td>1,200</td></tr><tr><td>Interest</td><td>10</td><td></td></tr><tr><td>Profit before tax</td><td>90</td><td>110</td></tr></table><table><tr><th>x</th><th>Mar 2024</th></tr><tr><td>Sales</td><td>5</td></tr></table>"


def test_statement_tables(spark, rows):
    cells = documents.html_cells(spark.createDataFrame([("A", PAGE), ("B", None)], "symbol string, html string"))
    assert rows(documents.yearly(cells, "sales", "revenue"), "fy", "value") == [(2023, 1e10), (2024, 1.2e10)]
    ebit = documents.added(documents.yearly(cells, "Profit before tax", "pbt"), documents.yearly(cells, "Interest", "interest"), "ebit")
    assert rows(ebit, "fy", "value") == [(2023, 1e9)]
    p = documents.pledge(spark.createDataFrame([("Promoters have pledged 12.5% of it",), ("nothing",)], "text string"))
    assert rows(p, "pledged_pct") == [(12.5,), (None,)]


def test_fetch_source(spark, rows):
    def get(key):
        if key == "bad":
            raise TimeoutError("slow")
        return key.upper()

    assert rows(fetch.read(spark, "canned", get, ["a", "bad", "b"], pause=0, attempts=2)) == [("a", "A", None), ("b", "B", None), ("bad", None, "TimeoutError: slow")]
    assert fetch.read(spark, "canned", get, []).count() == 0


def test_sinks(spark, rows, tmp_path):
    one = spark.createDataFrame([("A", 1, None)], "symbol string, n int, note string")
    sinks.overwrite(one, f"{tmp_path}/t", ["symbol", "note", "more"])
    sinks.append(one, f"{tmp_path}/t", ["symbol", "note", "more"])
    assert rows(spark.read.parquet(f"{tmp_path}/t")) == [("A", "", "")] * 2
    at = f"{tmp_path}/v"
    assert sinks.latest(spark, at) is None
    sinks.upsert(spark, spark.createDataFrame([("A", 1), ("B", 1), (None, 9)], "k string, v int"), at, "k")
    sinks.upsert(spark, spark.createDataFrame([("B", 2), ("C", 2)], "k string, v int"), at, "k")
    assert rows(spark.read.parquet(sinks.latest(spark, at))) == [("A", 1), ("B", 2), ("C", 2), (None, 9)]
    sinks.audit(spark, f"{tmp_path}/a", "approve", "A", "me")
    assert spark.read.json(f"{tmp_path}/a").first().reviewer == "me"
    with pytest.raises(ValueError):
        sinks.audit(spark, f"{tmp_path}/a", "approve", "A", " ")


EVENTS = "event_id bigint, item_key string, content_hash string, as_of string"


def test_stream_equals_batch(spark, rows, tmp_path):
    src = f"{tmp_path}/in"
    batches = [[(1, "k", "A", ""), (2, "k", "A", ""), (3, "q", "A", None)], [(4, "k", "B", ""), (5, "k", "B", ""), (6, None, "B", "")], [(7, "k", "A", ""), (8, "q", "A", "")]]
    for b in batches:
        spark.createDataFrame(b, EVENTS).coalesce(1).write.mode("append").parquet(src)
        q = stream.write_log(spark.readStream.schema(EVENTS).parquet(src), f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination(120)
    every = spark.createDataFrame([x for b in batches for x in b], EVENTS)
    want = rows(eventlog.actions(every).filter("action <> 'skipped'"), "item_key", "event_id", "action")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "item_key", "event_id", "action") == want


def test_hourly_stream(spark, tmp_path):
    src = f"{tmp_path}/ev"
    spark.sql("SELECT TIMESTAMP '2024-01-01 00:10:00' + make_interval(0,0,0,0,0,i*20) AS ts, 'click' AS event_type, 1.5D AS value FROM (SELECT explode(sequence(0, 8)) AS i)").write.parquet(src)
    df = stream.hourly(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(src))
    q = df.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("hourly").collect()) == [3, 3, 3]
