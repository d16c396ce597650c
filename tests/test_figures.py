import itertools
import math
import random
import statistics

from sarafa.operators import trends as T
from sarafa.operators import verify as V

VALUES = "entity string, figure string, source_id string, value double, ord bigint"


def consensus(spark, *values, figure="f"):
    rows = [("e", figure, s, v, i) for i, (s, v) in enumerate(values)]
    return V.consensus(spark.createDataFrame(rows, VALUES), "entity", "figure").first()


def test_consensus_cases(spark):
    def get(*v):
        r = consensus(spark, *[(f"s{i}", x) for i, x in enumerate(v)])
        return r.status, r.value

    assert get(79000.0, 79010.0) == ("verified", 79005.0)
    assert get(100.0, 140.0) == ("conflict", None)
    assert get(110.0) == ("single_source", 110.0)
    assert get(None, None) == ("unverifiable", None)
    assert get(-500.0, -501.0) == ("verified", -500.5)
    r = consensus(spark, ("a", 80000.0), ("b", 95000.0), ("c", 80100.0))
    assert (r.status, r.value, r.outliers) == ("verified", 80050.0, "b")
    assert get(100.0, 101.0, 102.0) == ("verified", 101.0)
    assert get(100.0, 101.9, 103.8)[1] != 101.9
    assert consensus(spark, ("a", 12.0), ("a", 12.0)).status == "single_source"
    assert consensus(spark, ("a", 20.0), ("b", 22.0), figure="current_pe").status == "verified"


def test_consensus_is_the_largest_clique(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for e in range(150):
        vs = [round(rng.choice((100, -50)) * (1 + rng.uniform(-0.03, 0.03)), 3) for _ in range(rng.randint(2, 5))]
        rows += [(f"e{e}", "f", f"s{i}", v, i) for i, v in enumerate(vs)]
        near = lambda a, b: abs(a - b) <= 0.02 * max(abs(a), abs(b), 1e-9)
        best = ()
        for n in range(2, len(vs) + 1):
            for c in itertools.combinations(range(len(vs)), n):
                if n > len(best) and all(near(vs[i], vs[j]) for i, j in itertools.combinations(c, 2)):
                    best = c
        want[f"e{e}"] = statistics.median(vs[i] for i in best) if best else None
    got = {r.entity: r.value for r in V.consensus(spark.createDataFrame(rows, VALUES), "entity", "figure").collect()}
    assert all((got[k] is None) == (w is None) and (w is None or math.isclose(got[k], w)) for k, w in want.items())


def test_identity(spark, rows):
    parts = spark.createDataFrame([(1, 50.0), (1, 50.5), (2, 10.0), (3, None)], "k int, part double")
    totals = spark.createDataFrame([(1, 100.0), (2, 20.0), (3, 1.0), (4, 1.0)], "k int, total double")
    assert rows(V.identity(parts, totals, "k"), "k", "status") == [(1, "verified"), (2, "conflict"), (3, "unverifiable"), (4, "unverifiable")]


def yearly(spark, *values, entity="e"):
    return spark.createDataFrame([(entity, 2020 + i, v) for i, v in enumerate(values) if v is not Ellipsis], "entity string, fy int, value double")


def test_growth(spark):
    assert math.isclose(T.cagr(yearly(spark, 100.0, 110.0, 121.0)).first().cagr_pct, 10.0)
    assert T.cagr(yearly(spark, 100.0, 110.0)).first().cagr_pct is None
    assert T.cagr(yearly(spark, -1.0, 1.0, 2.0)).first().cagr_pct is None
    assert [round(r.growth_pct, 9) for r in T.yearly_growth(yearly(spark, 100.0, ..., 50.0, 0.0, 5.0)).orderBy("fy").collect()] == [-50.0, -100.0]
    assert T.latest_growth(yearly(spark, 100.0, ..., 50.0)).count() == 0
    assert T.swing(yearly(spark, 100.0, 150.0, 75.0)).first().verdict == "volatile"


def test_cash_and_peaks(spark):
    assert T.cash_conversion(yearly(spark, 8.0, 8.0, 8.0), yearly(spark, 10.0, 10.0, 10.0)).first().verdict == "strong"
    assert T.cash_conversion(yearly(spark, 8.0, 8.0, 8.0), yearly(spark, 10.0, -1.0, 10.0)).first().ratio is None
    assert T.turning_point(yearly(spark, 0.5, 1.2, 0.6)).first().peak_fy == 2021
    assert T.turning_point(yearly(spark, 0.5, 0.6, 0.7)).first().peak is None


def test_water_fill(spark, rows):
    c = spark.createDataFrame([("N", 1, 25.0), ("F", 0, 12.5)], "symbol string, tier int, room double")
    assert rows(T.water_fill(c, 30.0), "symbol", "take") == [("F", 12.5), ("N", 17.5)]
    rng = random.Random(1)
    for _ in range(4):
        room = [(f"s{i}", 0, round(rng.uniform(1, 9), 2)) for i in range(7)]
        got = {r.symbol: r.take for r in T.water_fill(spark.createDataFrame(room, "symbol string, tier int, room double"), 20.0).collect()}
        assert math.isclose(sum(got.values()), min(20.0, sum(r[2] for r in room)))
        level = max(got.values())
        assert all(math.isclose(got[s], min(r, level)) for s, _, r in room)


def test_sip(spark):
    from pyspark.sql import functions as F

    v = spark.range(1).select(T.sip_value(F.lit(100.0), F.lit(12.0), F.lit(1.0)), T.sip_value(F.lit(100.0), F.lit(0.0), F.lit(2.0))).first()
    assert math.isclose(v[0], 100 * ((1.01**12 - 1) / 0.01) * 1.01) and v[1] == 2400.0


def test_ratio_bands(spark):
    f = spark.createDataFrame([("a", 20.0, 100.0, 100.0, 10.0, 200.0, 30.0, 5.0, 18.0, 100.0, 200.0), ("b", -1.0, 100.0, -5.0, 10.0, 200.0, -3.0, 5.0, None, None, None)], "entity string, profit double, revenue double, equity double, debt double, assets double, ebit double, interest double, ocf double, opening_equity double, opening_assets double")
    a, b = T.ratios(f).orderBy("entity").collect()
    assert (a.roe, a.leverage_band, a.cash_band, a.roe_band, a.severe) == (20.0, "healthy", "strong", "good", False)
    assert (b.roe, b.debt_equity, b.leverage_band, b.cash_band, b.severe) == (None, None, "unknown", "unknown", True)
    q = {r.entity: r.quality for r in T.signals(T.ratios(f)).collect()}
    assert q == {"a": "strong", "b": "weak"}
