"""Yearly series: growth, swings, cash conversion, turning points, price multiples, ratios.

Inputs are long (entity, fy, value) tables with one verified value a year, or one column per figure. Missing years stay
missing; a rule that lacks its inputs gives NULL or "unknown".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# ---- fixed values: bands ----
LEAST_YEARS, GROWTH_BAND, MARGIN_BAND = 3, 3.0, 2.0
CASH_STRONG, CASH_WEAK = 0.80, 0.50
PEAK_BAND = 0.15
SWING_PROFIT, SWING_REVENUE, SWING_ABSURD = 40.0, 25.0, 500.0
PE_CHEAP, PE_DEAR = 0.80, 1.20
DEBT_LOW, DEBT_HIGH, COVER_LEAST, COVER_NONE = 0.50, 1.00, 3.0, 1.0
GOOD_WEAK = {"roe": (15.0, 8.0), "roce": (15.0, 10.0), "roa": (6.0, 2.0), "net_margin": (12.0, 3.0), "op_margin": (15.0, 5.0), "asset_turnover": (1.0, 0.4)}
TROUGH_BAND, SIP_BAND, PLEDGE_HIGH = 0.5, 3.0, 25.0
# ---- end of fixed values ----

#: Tiers an allocation may have.
MAX_TIERS = 1000


def cagr(series: DataFrame) -> DataFrame:
    """(entity, n_years, cagr_pct): yearly growth from the first to the last year; NULL under three entries or unless both are positive."""
    g = series.filter("value IS NOT NULL").groupBy("entity").agg(F.count("*").alias("n_years"), F.min_by("value", "fy").alias("v0"), F.max_by("value", "fy").alias("v1"), (F.max("fy") - F.min("fy")).alias("span"))
    ok = (F.col("n_years") >= LEAST_YEARS) & (F.col("v0") > 0) & (F.col("v1") > 0) & (F.col("span") > 0)
    return g.select("entity", "n_years", F.when(ok, (F.pow(F.col("v1") / F.col("v0"), F.lit(1.0) / F.col("span")) - 1) * 100).alias("cagr_pct"))


def direction(change: Column, band: float = GROWTH_BAND) -> Column:
    return F.when(change > band, "growing").when(change < -band, "shrinking").when(change.isNotNull(), "flat")


def margin_direction(revenue: DataFrame, profit: DataFrame) -> DataFrame:
    """(entity, revenue_cagr, profit_cagr, margin): growth over the shared years only, and whether profit outgrows revenue."""
    both = revenue.filter("value IS NOT NULL").withColumnRenamed("value", "r").join(profit.filter("value IS NOT NULL").withColumnRenamed("value", "p"), ["entity", "fy"])
    r = cagr(both.select("entity", "fy", F.col("r").alias("value"))).select("entity", F.col("cagr_pct").alias("revenue_cagr"))
    p = cagr(both.select("entity", "fy", F.col("p").alias("value"))).select("entity", F.col("cagr_pct").alias("profit_cagr"))
    d = F.col("profit_cagr") - F.col("revenue_cagr")
    return r.join(p, "entity").withColumn("margin", F.when(d > MARGIN_BAND, "expanding").when(d < -MARGIN_BAND, "shrinking").when(d.isNotNull(), "stable"))


def yearly_growth(series: DataFrame) -> DataFrame:
    """(entity, fy, growth_pct) against the year available before, on its absolute value; a zero base is skipped."""
    w = W.partitionBy("entity").orderBy("fy")
    prior = F.lag("value").over(w)
    return series.filter("value IS NOT NULL").select("entity", "fy", F.when(F.abs(prior) > 1e-9, (F.col("value") - prior) / F.abs(prior) * 100).alias("growth_pct")).filter("growth_pct IS NOT NULL")


def latest_growth(series: DataFrame) -> DataFrame:
    """(entity, fy, growth_pct) of the latest year, only where the year just before it is there."""
    w = W.partitionBy("entity").orderBy("fy")
    s = series.filter("value IS NOT NULL").select("entity", "fy", "value", F.lag("value").over(w).alias("prior"), F.lag("fy").over(w).alias("prior_fy"), F.max("fy").over(W.partitionBy("entity")).alias("last"))
    return s.filter("fy = last AND prior_fy = fy - 1 AND abs(prior) > 1e-9").select("entity", "fy", ((F.col("value") - F.col("prior")) / F.abs("prior") * 100).alias("growth_pct"))


def opening(series: DataFrame) -> DataFrame:
    """(entity, fy, value): the value of the year right before the latest one; none where that year is missing."""
    s = series.filter("value IS NOT NULL")
    last = s.groupBy("entity").agg(F.max("fy").alias("last"))
    return s.join(last, "entity").filter("fy = last - 1").select("entity", "fy", "value")


def swing(series: DataFrame, volatile: float = SWING_PROFIT) -> DataFrame:
    """(entity, n_growths, swing, verdict): the range of yearly growth; NULL below two growths.

    Growth through a change of sign means nothing, so such a series is told as sign_change, whatever its range.
    """
    g = yearly_growth(series).groupBy("entity").agg(F.count("*").alias("n_growths"), F.when(F.count("*") >= 2, F.max("growth_pct") - F.min("growth_pct")).alias("swing"))
    g = g.join(series.groupBy("entity").agg((F.bool_or(F.col("value") < 0) & F.bool_or(F.col("value") > 0)).alias("crossed")), "entity")
    return g.select("entity", "n_growths", "swing", F.when(F.col("swing").isNotNull() & F.col("crossed"), "sign_change").when(F.col("swing") >= SWING_ABSURD, "erratic").when(F.col("swing") >= volatile, "volatile").when(F.col("swing").isNotNull(), "steady").alias("verdict"))


def cash_conversion(cash: DataFrame, profit: DataFrame) -> DataFrame:
    """(entity, n_years, ratio, verdict): all cash over all profit of the shared years; NULL unless three years and every profit is positive."""
    both = cash.withColumnRenamed("value", "c").join(profit.withColumnRenamed("value", "p"), ["entity", "fy"]).filter("c IS NOT NULL AND p IS NOT NULL")
    g = both.groupBy("entity").agg(F.count("*").alias("n_years"), F.when((F.count("*") >= LEAST_YEARS) & F.bool_and(F.col("p") > 0), F.sum("c") / F.sum("p")).alias("ratio"))
    return g.withColumn("verdict", F.when(F.col("ratio") < 0, "burning").when(F.col("ratio") < CASH_WEAK, "weak").when(F.col("ratio") >= CASH_STRONG, "strong").when(F.col("ratio").isNotNull(), "mixed"))


def turning_point(series: DataFrame, band: float = PEAK_BAND) -> DataFrame:
    """(entity, first, last, peak_fy, peak): a peak that is neither end and stands above both by more than the band; else NULL."""
    g = series.filter("value IS NOT NULL").groupBy("entity").agg(F.min_by("value", "fy").alias("first"), F.max_by("value", "fy").alias("last"), F.min("fy").alias("fy0"), F.max("fy").alias("fy1"))
    inner = series.filter("value IS NOT NULL").join(g, "entity").filter("fy <> fy0 AND fy <> fy1").groupBy("entity").agg(F.max("value").alias("top"), F.max_by("fy", F.struct("value", -F.col("fy"))).alias("top_fy"))
    high = F.col("top") > F.greatest("first", "last") + band
    return g.join(inner, "entity", "left").select("entity", "first", "last", F.when(high, F.col("top_fy")).alias("peak_fy"), F.when(high, F.col("top")).alias("peak"))


def trough(series: DataFrame, band: float = TROUGH_BAND) -> DataFrame:
    """(entity, trough_fy, trough): a low that is neither end and lies below both by more than the band; else NULL."""
    low = turning_point(series.withColumn("value", -F.col("value")), band)
    return low.select("entity", F.col("peak_fy").alias("trough_fy"), (-F.col("peak")).alias("trough"))


def asof(left: DataFrame, prices: DataFrame) -> DataFrame:
    """(symbol, at, close): for each (symbol, at) the last close on or before at.

    Both sides are united and the last close is carried forward, within each month of a symbol by a window and
    across months through a small table of their last closes: one shuffle instead of a range join, and a symbol
    with a third of all rows is spread over its months.
    """
    both = left.select("symbol", F.col("at").alias("t"), F.lit(None).cast("double").alias("close"), F.lit(1).alias("ask")).unionByName(prices.select("symbol", F.col("date").alias("t"), "close", F.lit(0).alias("ask")))
    both = both.withColumn("month", F.year("t") * 12 + F.month("t"))
    inside = W.partitionBy("symbol", "month").orderBy("t", "ask").rowsBetween(W.unboundedPreceding, 0)
    ends = both.groupBy("symbol", "month").agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.struct("t", "ask"))).alias("end"))
    before = W.partitionBy("symbol").orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("symbol", "month", F.last("end", ignorenulls=True).over(before).alias("carry"))
    found = both.withColumn("here", F.last("close", ignorenulls=True).over(inside)).filter("ask = 1").join(carried, ["symbol", "month"])
    return found.select("symbol", F.col("t").alias("at"), F.coalesce("here", "carry").alias("close"))


def median_pe(prices: DataFrame, eps: DataFrame) -> DataFrame:
    """(symbol, n_years, median_pe) of (symbol, fy, close) and (symbol, fy, eps), positive years only; NULL below two."""
    pe = prices.join(eps, ["symbol", "fy"]).filter("close > 0 AND eps > 0").select("symbol", (F.col("close") / F.col("eps")).alias("pe"))
    return pe.groupBy("symbol").agg(F.count("*").alias("n_years"), F.when(F.count("*") >= 2, F.median("pe")).alias("median_pe"))


def first_median_pe(prices: DataFrame, *eps: DataFrame) -> DataFrame:
    """(symbol, median_pe, basis) by the first of several tables of earnings a share that gives one; basis counts from 0.

    In order: stated earnings a share, profit over each year's average shares, profit over today's shares.
    """
    found = None
    for i, e in enumerate(eps):
        one = median_pe(prices, e).filter("median_pe IS NOT NULL").select("symbol", "median_pe", F.lit(i).alias("basis"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("symbol").agg(F.min_by("median_pe", "basis").alias("median_pe"), F.min("basis").alias("basis"))


def per_share(profit: DataFrame, shares: DataFrame) -> DataFrame:
    """(symbol, fy, eps) of (symbol, fy, profit) and shares, which are by symbol and year or by symbol alone; shares must be positive."""
    on = ["symbol", "fy"] if "fy" in shares.columns else ["symbol"]
    return profit.join(shares.filter("shares > 0"), on).select("symbol", "fy", (F.col("profit") / F.col("shares")).alias("eps"))


def average_base(closing: Column, opening: Column) -> Column:
    """The mean of closing and opening balance; the closing one where there is no positive opening."""
    return F.when(opening > 0, (closing + opening) / 2).otherwise(closing)


def band(name: str, value: Column) -> Column:
    good, weak = GOOD_WEAK[name]
    return F.when(value.isNull(), "unknown").when(value >= good, "good").when(value < weak, "weak").otherwise("fair")


def ratios(f: DataFrame) -> DataFrame:
    """Ratios and their bands from one row per entity with profit, revenue, equity, debt, assets, ebit, interest, ocf and the openings.

    A base that is not positive makes a ratio unknown; margins above 100 % are unusual.
    """
    def over(n: Column, base: Column, by: float = 100.0) -> Column:
        return F.when(base > 0, n / base * by)

    equity, assets = average_base(F.col("equity"), F.col("opening_equity")), average_base(F.col("assets"), F.col("opening_assets"))
    capital = F.col("equity") + F.col("debt")
    out = f.select("*", over(F.col("profit"), equity).alias("roe"), over(F.col("ebit"), capital).alias("roce"), over(F.col("profit"), assets).alias("roa"), over(F.col("profit"), F.col("revenue")).alias("net_margin"), over(F.col("ebit"), F.col("revenue")).alias("op_margin"), over(F.col("revenue"), assets, 1.0).alias("asset_turnover"), F.when(F.col("equity") > 0, F.col("debt") / F.col("equity")).alias("debt_equity"), F.when((F.col("ebit") > 0) & (F.col("interest") > 0), F.col("ebit") / F.col("interest")).alias("cover"), F.when(F.col("profit") > 0, F.col("ocf") / F.col("profit")).alias("ocf_profit"))
    for name in GOOD_WEAK:
        v = band(name, F.col(name))
        out = out.withColumn(f"{name}_band", F.when(F.col(name) > 100, "unusual").otherwise(v) if name.endswith("margin") else v)
    cannot = F.coalesce((F.col("interest") > 0) & (F.col("ebit") < 0), F.lit(False)) | F.coalesce(F.col("cover") < COVER_NONE, F.lit(False))
    weak = cannot | F.coalesce(F.col("cover") < COVER_LEAST, F.lit(False))
    leverage = F.when(F.col("debt_equity").isNull(), "unknown").when((F.col("debt_equity") > DEBT_HIGH) | weak, "stretched").when(F.col("debt_equity") < DEBT_LOW, "healthy").otherwise("moderate")
    cash = F.when(F.col("ocf_profit").isNull(), "unknown").when(F.col("ocf_profit") < 0, "red_flag").when(F.col("ocf_profit") >= CASH_STRONG, "strong").when(F.col("ocf_profit") < CASH_WEAK, "weak").otherwise("mixed")
    return out.withColumn("leverage_band", leverage).withColumn("cash_band", cash).withColumn("severe", cannot | (F.col("cash_band") == "red_flag"))


def valuation(current: Column, median: Column) -> Column:
    """cheap, fair or expensive against its own median; NULL unless both are positive."""
    r = F.when((current > 0) & (median > 0), current / median)
    return F.when(r < PE_CHEAP, "cheap").when(r > PE_DEAR, "expensive").when(r.isNotNull(), "fair")


def signals(rated: DataFrame) -> DataFrame:
    """(entity, n_known, n_concern, n_positive, quality): the bands of cash, leverage and return on capital counted."""
    bands = ("cash_band", "leverage_band", "roce_band")
    count = lambda *values: sum((F.col(b).isin(*values).cast("int") for b in bands), F.lit(0))
    out = rated.select("entity", "severe", (F.lit(len(bands)) - count("unknown")).alias("n_known"), count("red_flag", "weak", "stretched").alias("n_concern"), count("strong", "healthy", "good").alias("n_positive"), (F.col("leverage_band") == "unknown").alias("critical_unknown"))
    quality = F.when(F.col("n_known") == 0, "unknown").when(F.col("severe") | (F.col("n_concern") >= 2), "weak").when(F.col("n_concern") == 1, "mixed").when((F.col("n_known") >= 2) & ~F.col("critical_unknown") & (F.col("n_positive") >= 1), "strong").otherwise("mixed")
    return out.withColumn("quality", quality)


def sip_value(monthly: Column, rate_pct: Column, years: Column) -> Column:
    """The value of equal monthly payments at the start of each month."""
    i, n = rate_pct / 1200, years * 12
    return F.when(i == 0, monthly * n).otherwise(monthly * ((F.pow(1 + i, n) - 1) / F.when(i != 0, i)) * (1 + i))


def real_value(nominal: Column, years: Column, inflation: float = 0.06) -> Column:
    return nominal / F.pow(F.lit(1 + inflation), years)


def water_fill(candidates: DataFrame, amount: float) -> DataFrame:
    """candidates (symbol, tier, room) with take: tiers in order, each filled to one level, nobody above the room.

    The level of a tier is the root of sum(least(room, level)) = what is left for it. From a level too low, the next is
    (left - the rooms up to it) / how many are above it; this rises to the root in a few steps. A step is one sum per
    tier over all candidates, without sorting them; tiers are few by meaning, and more than MAX_TIERS are refused.
    """
    room = candidates.filter("room > 0")
    tiers = room.groupBy("tier").agg(F.sum("room").alias("total"), F.count("*").alias("n")).orderBy("tier").limit(MAX_TIERS + 1).collect()
    if len(tiers) > MAX_TIERS:
        raise ValueError(f"more than {MAX_TIERS} tiers")
    left, levels, rest = {}, {}, amount
    for t in tiers:
        left[t.tier] = max(rest, 0.0)
        rest -= t.total
        levels[t.tier] = float("inf") if left[t.tier] >= t.total else left[t.tier] / t.n
    open_ = {k for k, v in levels.items() if v != float("inf")}
    while open_:
        at = F.element_at(F.create_map(*[F.lit(x) for k in sorted(open_) for x in (k, levels[k])]), F.col("tier"))
        sums = room.filter(F.col("tier").isin(sorted(open_))).groupBy("tier").agg(F.coalesce(F.sum(F.when(F.col("room") <= at, F.col("room"))), F.lit(0.0)).alias("low"), F.count_if(F.col("room") > at).alias("high")).collect()
        for s in sums:
            new = (left[s.tier] - s.low) / s.high if s.high else levels[s.tier]
            if new <= levels[s.tier] * (1 + 1e-15):
                open_.discard(s.tier)
            levels[s.tier] = max(new, levels[s.tier])
    if not levels:
        return room.withColumn("take", F.lit(0.0))
    level = F.element_at(F.create_map(*[F.lit(x) for k, v in levels.items() for x in (k, v)]), F.col("tier"))
    return room.withColumn("take", F.least("room", level))



def share_of(part: DataFrame, whole: DataFrame, high: float = 0.25) -> DataFrame:
    """(entity, fy, share, n_high, n_years): the latest year's part of the whole, and in how many years it was high."""
    both = part.withColumnRenamed("value", "p").join(whole.withColumnRenamed("value", "w"), ["entity", "fy"]).filter("p IS NOT NULL AND w > 0").withColumn("share", F.col("p") / F.col("w"))
    return both.groupBy("entity").agg(F.max("fy").alias("fy"), F.max_by("share", "fy").alias("share"), F.count_if(F.col("share") >= high).alias("n_high"), F.count("*").alias("n_years"))


def trend_lines(revenue: DataFrame, profit: DataFrame) -> DataFrame:
    """(entity, lines): what growth, margin and swing say, in that order; a line whose inputs are missing is left out."""
    m = margin_direction(revenue, profit)
    s = swing(profit).select("entity", F.col("swing"), F.col("verdict"))
    pct = lambda c: F.format_number(c, 1)
    lines = F.array_compact(F.array(
        F.when(F.col("revenue_cagr").isNotNull(), F.concat(F.lit("revenue "), direction(F.col("revenue_cagr")), F.lit(" at "), pct("revenue_cagr"), F.lit("% a year"))),
        F.when(F.col("profit_cagr").isNotNull(), F.concat(F.lit("profit "), direction(F.col("profit_cagr")), F.lit(" at "), pct("profit_cagr"), F.lit("% a year"))),
        F.when(F.greatest("revenue_cagr", "profit_cagr") <= 100, F.concat(F.lit("margins "), F.col("margin"))),
        F.when(F.col("verdict").isNotNull(), F.concat(F.lit("profit growth "), F.col("verdict"))),
    ))
    return m.join(s, "entity", "left").select("entity", F.array_join(lines, "; ").alias("lines"))


def sip_note(assumed_pct: Column, benchmark_pct: Column) -> Column:
    """How an assumed return stands to the benchmark's: well above or below by more than three points, else in line; NULL without one."""
    d = assumed_pct - benchmark_pct
    return F.when(d > SIP_BAND, "well above").when(d < -SIP_BAND, "well below").when(d.isNotNull(), "in line with")


def pledge_band(pct: Column) -> Column:
    """none, watch or high (from PLEDGE_HIGH on); unknown where nothing is stated."""
    return F.when(pct.isNull(), "unknown").when(pct <= 0, "none").when(pct >= PLEDGE_HIGH, "high").otherwise("watch")
