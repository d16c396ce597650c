import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from sarafa.operators import claims, clusters, eventlog, quality, records, retrieval, structure
from sarafa.operators.pipeline import State, run


def test_bm25_numbers(spark):
    c = spark.createDataFrame([("d0", "profit profit growth"), ("d1", "revenue growth"), ("d2", None)][:2], "chunk_id string, text string")
    q = spark.createDataFrame([("q", "profit profit")], "query_id string, text string")
    got = {r.id: r.bm25 for r in retrieval.bm25(c, q).collect()}
    assert math.isclose(got["d0"], 0.9303989000804636) and "d1" not in got


def test_tfidf_against_brute_force(spark):
    texts = {"a": "cash flow from operations rose", "b": "cash cash cash", "c": "operations", "d": "", "e": None}
    import re

    tok = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    n = len(texts)
    idf = lambda w: math.log((1 + n) / (1 + sum(w in tok(t) for t in texts.values()))) + 1
    vec = lambda t: {w: tok(t).count(w) / len(tok(t)) * idf(w) for w in set(tok(t))}
    q = "cash flow cash"
    want = {}
    for k, t in texts.items():
        v, u = vec(t), vec(q)
        if set(v) & set(u):
            want[k] = sum(v[w] * u[w] for w in set(v) & set(u)) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in u.values()))
    c = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    got = {r.id: r.cosine for r in retrieval.tfidf(c, spark.createDataFrame([("q", q)], "query_id string, text string")).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k]) for k in want)


def test_hybrid_pins_and_floor(spark):
    c = spark.createDataFrame([("both", "cash flow statement cash flow"), ("stuffed", "cash cash cash cash debt"), ("pin", "unrelated words with cash among very many others that say nothing at all"), ("none", "zebra")], "chunk_id string, text string")
    q = spark.createDataFrame([("q", "cash flow"), ("x", "absent")], "query_id string, text string")
    got = retrieval.hybrid(c, q, spark.createDataFrame([("pin",)], "id string"), k=1).collect()
    assert {(r.id, r.is_pinned) for r in got} == {("pin", True), ("both", False)} and {r.query_id for r in got} == {"q"}


def test_greedy_clusters(spark, rows):
    t = spark.createDataFrame([("f", 1, "Alpha wins big order", 1), ("f", 2, "Big order for Alpha", 2), ("f", 3, "Zeta rating cut", 3), ("g", 4, "Alpha wins big order", 4), ("f", 5, None, 5)], "feed string, id int, title string, ord int")
    c = clusters.greedy(t, "feed")
    assert rows(c) == [("f", 1, 0), ("f", 2, 0), ("f", 3, 2), ("f", 5, 3), ("g", 4, 0)]
    dated = c.join(spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 2, 1)), (3, None), (4, None), (5, None)], "id int, published date"), "id")
    assert rows(clusters.representatives(dated, "feed"), "feed", "cluster", "id") == [("f", 0, 2), ("f", 2, 3), ("f", 3, 5), ("g", 0, 4)]


def test_event_actions_over_blocks(spark):
    ev = spark.createDataFrame([(i, "k", h, None) for i, h in enumerate("AABBA")] + [(9, None, "A", None), (10, "k2", " ", None)], "event_id bigint, item_key string, content_hash string, as_of string")
    want = ["new", "skipped", "superseded", "skipped", "superseded"]
    assert [r.action for r in eventlog.actions(ev).orderBy("event_id").collect()] == want
    p = eventlog.with_previous(ev.filter("item_key = 'k'"), "item_key", "event_id", "content_hash", block=2)
    assert [r.prev for r in p.orderBy("event_id").collect()] == [None, "A", "A", "B", "B"]
    cur = eventlog.current(ev).collect()
    assert [(r.event_id, r.n_versions) for r in cur] == [(4, 3)]
    assert eventlog.split_valid(ev)[1].count() == 2


def test_records(spark):
    text = "P&L FY2024: Rs 4,50,000 lakh, (1,234) crore, -100 crore, 18.2x, 12.5% and 35 bps; 5 x 3 on 2024-03-31, 2023-24; Rs. 77 paid; 12,345 bare"
    df = spark.createDataFrame([("a", text, None, None), ("t", "Revenue 9,00,000 73,670 31", "crore", "INR"), ("n", None, None, None), ("e", " ", "crore", None)], "chunk_id string, text string, unit_scale string, currency string")
    got = [(r.id, r.value, r.unit, r.scale, r.currency, r.absolute) for r in records.extract(df).orderBy("id", "pos").collect()]
    assert got == [("a", 450000.0, "rupees", "lakh", "INR", 4.5e10), ("a", -1234.0, "rupees", "crore", None, -1.234e10), ("a", -100.0, "rupees", "crore", None, -1e9), ("a", 18.2, "ratio", "none", None, 18.2), ("a", 12.5, "percent", "none", None, 12.5), ("a", 35.0, "bps", "none", None, 35.0), ("a", 77.0, "rupees", "none", "INR", 77.0), ("t", 900000.0, "rupees", "crore", "INR", 9e12), ("t", 73670.0, "rupees", "crore", "INR", 7.367e11)]


def test_elements(spark):
    text = "Balance Sheet\n(Rs in crore)\nItem  2024  2023\nCash  10  20\n\nSome words here.\n(Rs in lakh)\nMore words as at 31 March 2024.\n\nRisk Factors\nOne risk.\n\nIn ₹ lakh\n|a|1|\n|b|2|\nKEY NOTE:\n"
    df = spark.createDataFrame([("a", text, "junk"), ("b", None, ""), ("c", " \n\t", ""), ("d", "plain", "")], "chunk_id string, text string, kind string")
    got = [tuple(r)[:2] + tuple(r)[2:3] + tuple(r)[4:] for r in structure.split_elements(df).orderBy("id", "pos").collect()]
    assert got == [
        ("a", 0, "table", None, "crore", "INR", None),
        ("a", 5, "paragraph", None, None, None, "FY2024"),
        ("a", 9, "heading", "Risk Factors", None, None, None),
        ("a", 10, "paragraph", "Risk Factors", None, None, None),
        ("a", 12, "table", "Risk Factors", "lakh", "INR", None),
        ("a", 15, "heading", "KEY NOTE:", None, None, None),
        ("d", 0, "paragraph", None, None, None, None),
    ]
    assert structure.split_elements(df.limit(0)).count() == 0


def test_elements_of_a_very_long_text(spark):
    text = "\n".join(["Heading Here", "words and words", ""] * 30_000)
    assert structure.split_elements(spark.createDataFrame([("a", text)], "chunk_id string, text string")).groupBy("kind").count().orderBy("kind").collect()[0][1] == 30_000


def test_claims_fail_for_every_reason(spark):
    from sarafa.plans.evidence import q42_claim_guards

    seen = {r.reason for r in q42_claim_guards(spark, "/root/testdata/sf0.01").select("reason").distinct().collect()}
    assert {"grounded", "unit", "period", "tier", None} <= seen


RETRIEVED = "chunk_id string, source_id string, text string, records array<struct<key:string,scale:string,period:string>>"


@pytest.mark.parametrize(
    "text,kind,verdict,reason",
    [
        ("Profit was 620 crore", "fact", "fact", None), ("Profit was 999 crore", "fact", "unverified", "grounded"), ("Profit was 620 lakh", "fact", "unverified", "unit"), ("In FY2024 profit was 620 crore", "fact", "unverified", "period"),
        ("In FY2023 profit was 620 crore", "fact", "fact", None), ("Prices were 450 in all", "fact", "unverified", "record"), ("It may be 10 crore", "estimate", "estimate", None), ("It is good", "opinion", "opinion", None),
    ],
)
def test_claims(spark, text, kind, verdict, reason):
    chunk = spark.createDataFrame([("c1", "p", "Profit was Rs 620 crore. Prices were 450 in all", [("620", "crore", "FY2023")]), ("c2", "a", "x", [])], RETRIEVED)
    reg = spark.createDataFrame([("p", "primary"), ("a", "analyst")], "source_id string, tier string")
    answer = json.dumps({"claims": [{"text": text, "kind": kind, "chunk_ids": ["c1", "made up"]}, {"text": text.upper(), "kind": kind, "chunk_ids": ["c1"]}, {"text": "no source", "kind": "fact", "chunk_ids": ["zz"]}, {"text": " ", "kind": "fact", "chunk_ids": ["c1"]}]})
    answers = spark.createDataFrame([(1, f"```json\n{answer}\n```"), (2, "not json"), (3, '{"abstain": true}')], "claim_id int, answer string")
    got = claims.judge(claims.cite(claims.parse_payload(answers), chunk, reg)).collect()
    assert [(r.verdict, r.reason) for r in got] == [(verdict, reason)]


def test_fact_needs_primary_sources(spark):
    chunk = spark.createDataFrame([("c2", "a", "All went well", [])], RETRIEVED)
    reg = spark.createDataFrame([("a", "analyst")], "source_id string, tier string")
    said = spark.createDataFrame([(1, 0, "All went well", "fact", ["c2"])], "claim_id int, ord int, text string, kind string, chunk_ids array<string>")
    assert claims.judge(claims.cite(said, chunk, reg)).first().reason == "tier"


def test_outcomes_and_rates(spark, rows):
    truth = spark.createDataFrame([(1, 80050.0), (2, 95000.0), (3, 1.0), (4, 1.0)], "entity int, correct double")
    fig = spark.createDataFrame([(1, "verified", 80050.0), (2, "verified", 80050.0), (3, "conflict", None)], "entity int, status string, value double")
    out = quality.outcomes(truth, fig, ["entity"])
    assert rows(out) == [(1, "match"), (2, "trusted_wrong"), (3, "withheld"), (4, "missing")]
    s = quality.score(out).first()
    assert (s.accuracy, s.trusted_accuracy) == (0.25, 0.5) and quality.score(out.limit(0)).first().accuracy == 1.0
    g = spark.createDataFrame([("d", "620", "FY2023", 6.2e9), ("d", "5", None, 5.0)], "doc string, key string, period string, value double")
    e = spark.createDataFrame([("d", "620", None, 6.2e9), ("d", "5", "FY2024", 6.0)], "doc string, key string, period string, value double")
    m = quality.exact_matches(g, e)
    assert rows(m, "key", "matched") == [("5", False), ("620", True)] and quality.match_rate(m).first().rate == 0.5


def test_lint_spares_negated_clauses(spark, rows):
    t = spark.createDataFrame([(1, "We guarantee gains. We never guarantee gains; guaranteed!"), (2, None)], "doc_id int, text string")
    assert rows(quality.lint(t, {"g": r"(?i)\bguarantee[sd]?\b"}), "id", "rule", "match") == [(1, "g", "guarantee"), (1, "g", "guaranteed")]


def test_staged_run_stops(spark):
    start = State({"a": spark.range(3)})
    end = run(start, [("double", lambda s: s.put("double", "2x", b=s.tables["a"].selectExpr("id * 2 AS id"))), ("check", lambda s: s.stop("check", "nothing found")), ("never", lambda s: s.put("never", "no"))])
    assert end.abstained == "nothing found" and [t[0] for t in end.trace] == ["double", "check"] and end.tables["b"].agg(F.sum("id")).first()[0] == 6
