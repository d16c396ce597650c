import math

from sarafa.operators import units

SCHEMA = "record_id bigint, figure string, value double, raw_string string, unit string, scale string, currency string, period string, company string, source_doc string, locator string, quantity_kind string"


def table(spark, *rows):
    """rows: (id, value, raw, unit, scale, currency); quantity_kind is a clashing extra column."""
    return spark.createDataFrame([(i, "revenue", v, r, u, s, c, "FY2020", "A", "d", None, "junk") for i, v, r, u, s, c in rows], SCHEMA)


def test_texts_and_columns(spark, rows):
    cases = [
        (1, 1.0, "₹3.09 crore in FY2020", "Rs", "lakh", "INR", ("money", 3_090_000_000)),
        (2, None, "Rs 308.89 lacs", None, None, None, ("money", 3_088_900_000)),
        (3, 5.0, "(115) CR", None, None, None, ("money", -115 * 10**9)),
        (4, 5.0, "Rs. 7,942,210,694/-", "rupees", "crore", None, ("money", 794_221_069_400)),
        (5, 1.99, None, "INR in crore", None, None, ("money", 1_990_000_000)),
        (6, 1.99, "", "rupees", "Cr", None, ("money", 1_990_000_000)),
        (7, 2.0, "2,50,000", "₹", "'000", None, ("money", 25_000_000_000)),
        (8, 9.0, "7,565bps", "percent", None, None, ("rate", 7565)),
        (9, 9.0, "−3.33% p.a.", None, None, None, ("rate", -333)),
        (10, 9.0, "20.22x", "rupees", None, None, ("multiple", 2022)),
        (11, 9.0, "2.5", "times", "none", None, ("multiple", 250)),
        (12, 9.0, "-0.014  lakh crore", None, None, None, ("money", -140_000_000 * 10_000 // 1000 * 100)),
        (13, 9.0, "Rs. Mn. 41", None, None, None, ("money", 41 * 10**8)),
        (14, 9.0, "9 (₹ in '000)", None, None, None, ("money", 900_000)),
        (15, 9.0, "INR −41  crore", None, None, None, ("money", -41 * 10**9)),
        (16, 9.0, "Rs. 32646329 k", None, None, None, ("money", 3_264_632_900_000)),
        (17, 9.0, "about 12 per cent", "bps", None, None, ("rate", 1200)),
        (18, 9.0, "0.0015", "%", None, None, ("rate", 0)),
        (19, 9.0, "Rs.19,477 L", None, None, None, ("money", 19_477 * 10**7)),
        (20, 9.0, "Rs.1,979,589,347", None, None, None, ("money", 197_958_934_700)),
        (21, 9.0, "-Rs.47 cr", None, None, None, ("money", -47 * 10**9)),
        (22, 9.0, "(Rs.5)", None, None, None, ("money", -500)),
        (23, 9.0, "₹.5 cr", None, None, None, ("money", 5 * 10**8)),
        (24, 9.0, "rs.5/-", None, None, None, ("money", 500)),
        (25, 9.0, "INR5", None, None, None, ("money", 500)),
        (26, 9.0, "₹5", None, None, None, ("money", 500)),
        (27, 9.0, "Rs5lakh", None, None, None, ("money", 5 * 10**7)),
        (28, 9.0, ".5%", None, None, None, ("rate", 50)),
    ]
    cases[11] = (*cases[11][:6], ("money", -14_000_000_000 * 100 * 10 // 10))
    got = {r[0]: (r[1], r[2]) for r in rows(units.convert(table(spark, *[c[:6] for c in cases]), learn=False))}
    assert got == {c[0]: c[6] for c in cases}


def test_no_cases(spark):
    none = table(spark, (1, 5.0, "n.a.", "rupees", "crore", "INR"), (2, 5.0, "5", None, None, None), (3, 5.0, "5", "rupees", None, None), (4, 5.0, "US$ 5 million", "rupees", "million", "INR"), (5, 5.0, "5 million", None, None, "EUR"), (6, None, None, "percent", None, None), (7, math.nan, None, "percent", None, None), (8, math.inf, " ", "percent", None, None), (9, None, "5", "currency", "million", None), (10, None, "9" * 30, "rupees", "crore", None))
    assert units.convert(none).count() == 0
    assert units.convert(none.limit(0)).count() == 0


def test_repeated_rows_each_count(spark):
    assert units.convert(table(spark, (1, None, "5%", None, None, None), (1, None, "5%", None, None, None))).count() == 2


def figures(n, *ways):
    """ways: (source, raw text of the i-th figure in crores + .5, unit, scale)."""
    return [(len(ways) * i + k, "revenue", None, raw(round(1.5 + 0.37 * i, 2)), unit, scale, "INR", f"FY{2000 + i % 20}", f"C{i // 20}", source, None, "") for i in range(n) for k, (source, raw, unit, scale) in enumerate(ways)]


def test_graph_learns_an_unknown_word(spark):
    """A word no lexicon has takes its worth from other sources' records of the same figures."""
    table = spark.createDataFrame(figures(12, ("d", lambda x: f"{x} crore", None, None), ("e", lambda x: f"{x * 100:.1f}", "rupees", "padma")), SCHEMA)
    got = {r.record_id: r.amount for r in units.convert(table).collect()}
    assert got[0] == got[1] == 1_500_000_000 and got[2] == got[3] == 1_870_000_000 and len(got) == 24
    assert units.convert(table, learn=False).count() == 12


def test_one_source_alone_links_nothing(spark):
    table = spark.createDataFrame(figures(12, ("d", lambda x: f"{x} crore", None, None), ("d", lambda x: f"{x * 100:.1f}", "rupees", "padma")), SCHEMA)
    assert units.convert(table).count() == 12


def test_graph_shifts_a_mislabelled_source(spark):
    """A source that says lakh where all others' figures are crores is put right, and only that source."""
    lakh = lambda x: f"{x * 100:.1f} lakh"
    ways = [("d", lambda x: f"{x} crore", None, None), ("e", lakh, None, None), ("g", lakh, None, None), ("h", lambda x: f"{x * 10:.2f} million", None, None), ("f", lambda x: f"{x} lakh", None, None)]
    table = spark.createDataFrame(figures(40, *ways), SCHEMA)
    got = {r.record_id: r.amount for r in units.convert(table).collect()}
    assert all(len({got[5 * i + k] for k in range(5)}) == 1 for i in range(40))
    plain = {r.record_id: r.amount for r in units.convert(table, learn=False).collect()}
    assert plain[4] * 100 == got[4] and all(plain[k] == got[k] for k in range(4))
    assert {(r.source, r.note): r["shift"] for r in units.source_shifts(table).collect() if r["shift"]} == {("f", "rupee:lakh"): 2.0}


def test_weak_evidence_shifts_nothing(spark):
    ways = [("d", lambda x: f"{x} crore", None, None), ("e", lambda x: f"{x * 100:.1f} lakh", None, None), ("f", lambda x: f"{x} lakh", None, None)]
    table = spark.createDataFrame(figures(9, *ways), SCHEMA)
    assert sorted(units.convert(table).collect()) == sorted(units.convert(table, learn=False).collect())


def test_a_unit_without_scale_is_no_case_even_with_links(spark):
    table = spark.createDataFrame(figures(40, ("d", lambda x: f"{x} crore", None, None), ("e", lambda x: f"{x}", "rupees", None)), SCHEMA)
    assert units.convert(table).count() == 40


def test_spread_follows_support_and_keeps_anchors():
    edges = [("a", "b", 10, 2.0), ("b", "c", 5, -5.01), ("a", "c", 2, 1.0), ("c", "d", 9, 0.4)]
    assert {k: round(v, 6) for k, v in units.spread(edges, {"a": 2.0}).items()} == {"a": 2.0, "b": 4.0, "c": -1.0}


def test_conversions_agree_with_the_lexicon(spark):
    ways = [("d", lambda x: f"{x} crore", None, None), ("e", lambda x: f"{x * 100:.1f} lakh", None, None)]
    edge = units.conversions(spark.createDataFrame(figures(6, *ways), SCHEMA)).first()
    assert (edge.a, edge.b, edge.n_links, edge.log10_scale, edge.expected_log10) == ("rupee:crore", "rupee:lakh", 6, -2.0, -2.0)
    assert edge.share == 1.0 and abs(edge.offset_part) < 1e-9


def test_an_offset_keeps_an_edge_from_counting(spark):
    """Numbers that differ by a constant beside the scale are no pure conversion, so nothing is learnt from them."""
    ways = [("d", lambda x: f"{x} crore", None, None), ("e", lambda x: f"{x * 100 + 3000:.1f}", "rupees", "padma")]
    assert units.convert(spark.createDataFrame(figures(40, *ways), SCHEMA)).count() == 40
