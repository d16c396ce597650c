"""Holdings: lots to positions, weights, sectors, returns and risk.

Inputs are DataFrames with the named columns; further columns are ignored. What is undefined is NULL (gain on
nothing invested, beta of a constant, volatility of one return), an empty drawdown and an empty weight are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sarafa.functions.money import strip

# ---- fixed values ----
TRADING_DAYS, DAYS_IN_YEAR, LEAST_YEARS = 252, 365.25, 3
TOP_WARN, HHI_WARN, SECTOR_WARN = 0.25, 0.20, 0.40
UNKNOWN = "Unknown"
# ---- end of fixed values ----


def merge_lots(holdings: DataFrame) -> DataFrame:
    """(symbol, quantity, avg_cost, sector, ord) from (symbol, quantity, avg_cost, sector, ord): one row a symbol.

    Costs are weighted by quantity; the sector is the first known one in input order. Rows without quantity or
    cost, with a quantity that is not positive or a negative cost are no holdings.
    """
    good = holdings.filter("quantity > 0 AND avg_cost >= 0 AND trim(symbol) <> '' AND upper(trim(symbol)) <> 'NAN'")
    known = F.lower(F.trim(F.coalesce("sector", F.lit("")))).isin("", UNKNOWN.lower())
    return good.groupBy("symbol").agg(
        F.sum("quantity").alias("quantity"), F.try_divide(F.sum(F.col("quantity") * F.col("avg_cost")), F.sum("quantity")).alias("avg_cost"),
        F.coalesce(F.min_by(F.when(~known, F.trim("sector")), F.when(~known, F.col("ord"))), F.lit(UNKNOWN)).alias("sector"), F.min("ord").alias("ord"),
    )


def priced(lots: DataFrame, prices: DataFrame) -> DataFrame:
    """Lots with the price of (symbol, price), NULL where there is none."""
    return lots.join(prices.select("symbol", "price"), "symbol", "left")


def missing(lots: DataFrame, prices: DataFrame) -> DataFrame:
    """Symbols without a price, in the order they first appeared."""
    return lots.join(prices.filter("price IS NOT NULL"), "symbol", "left_anti").groupBy("symbol").agg(F.min("ord").alias("ord"))


def positions(lots: DataFrame, prices: DataFrame) -> DataFrame:
    """Priced positions with invested, value, pnl, pnl_pct and weight.

    The total is a scalar subquery, so no window gathers all positions in one task.
    """
    p = priced(lots, prices).filter("price IS NOT NULL")
    p = p.select("*", (F.col("quantity") * F.col("avg_cost")).alias("invested"), (F.col("quantity") * F.col("price")).alias("value"))
    total = p.agg(F.sum("value").alias("total")).scalar()
    pnl = F.col("value") - F.col("invested")
    gain = F.when(F.col("invested") != 0, pnl / F.col("invested") * 100)
    weight = F.coalesce(F.try_divide(F.col("value"), total), F.lit(0.0))
    return p.select("symbol", "sector", "quantity", "avg_cost", "price", "invested", "value", pnl.alias("pnl"), gain.alias("pnl_pct"), weight.alias("weight"), "ord")


def summary(pos: DataFrame) -> DataFrame:
    """One row: totals, concentration and its warnings."""
    s = pos.agg(F.count("*").alias("n_positions"), F.coalesce(F.sum("invested"), F.lit(0.0)).alias("invested"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"), F.coalesce(F.sum(F.col("weight") * F.col("weight")), F.lit(0.0)).alias("hhi"), F.coalesce(F.max("weight"), F.lit(0.0)).alias("top_weight"))
    pnl = F.col("value") - F.col("invested")
    return s.select("*", pnl.alias("pnl"), F.when(F.col("invested") != 0, pnl / F.col("invested") * 100).alias("pnl_pct"), F.coalesce(F.try_divide(F.lit(1.0), F.col("hhi")), F.lit(0.0)).alias("effective_holdings"), (F.col("top_weight") > TOP_WARN).alias("top_warn"), (F.col("hhi") > HHI_WARN).alias("hhi_warn"))


def sectors(pos: DataFrame) -> DataFrame:
    """(sector, weight, n_positions, concentrated): the flag leaves Unknown out."""
    g = pos.groupBy("sector").agg(F.sum("weight").alias("weight"), F.count("*").alias("n_positions"))
    return g.withColumn("concentrated", (F.lower(F.trim("sector")) != UNKNOWN.lower()) & (F.col("weight") > SECTOR_WARN))


def top_sector(sector_weights: DataFrame) -> DataFrame:
    """The heaviest known sector if it is above the warning level; no row otherwise."""
    return sector_weights.filter(F.lower(F.trim("sector")) != UNKNOWN.lower()).agg(F.max_by("sector", F.struct("weight", "sector")).alias("sector"), F.max("weight").alias("weight")).filter(F.col("weight") > SECTOR_WARN)


def enrich_sectors(holdings: DataFrame, reference: DataFrame) -> DataFrame:
    """Unknown sectors filled from (symbol, industry); known ones are never overwritten.

    The reference is a dimension with one row a symbol; Spark broadcasts it while its size allows.
    """
    blank = F.lower(strip(F.coalesce("sector", F.lit("")))).isin("", UNKNOWN.lower())
    found = F.nullif(strip(F.col("industry")), F.lit(""))
    joined = holdings.join(reference.select("symbol", "industry"), "symbol", "left")
    return joined.withColumn("sector", F.when(blank, F.coalesce(found, F.lit(UNKNOWN))).otherwise(strip(F.col("sector")))).drop("industry")


def _months(prices: DataFrame) -> DataFrame:
    """prices with month: the blocks a symbol's history is handled in, so that one symbol never sorts in one task."""
    return prices.withColumn("month", F.year("date") * 12 + F.month("date"))


def returns(prices: DataFrame) -> DataFrame:
    """(symbol, date, ret) of (symbol, date, close): change against the previous row of the symbol; the first has none.

    A month's first row takes the last close before it from a small table of the months' ends.
    """
    p = _months(prices)
    ends = p.groupBy("symbol", "month").agg(F.max_by(F.struct("close"), "date").alias("end"))
    before = ends.select("symbol", "month", F.lag("end").over(W.partitionBy("symbol").orderBy("month")).alias("carry"))
    inside = F.lag(F.struct("close")).over(W.partitionBy("symbol", "month").orderBy("date"))
    both = p.withColumn("prior", inside).join(before, ["symbol", "month"], "left")
    prior = F.when(F.col("prior").isNotNull(), F.col("prior.close")).otherwise(F.col("carry.close"))
    return both.select("symbol", "date", (F.try_divide("close", prior) - 1).alias("ret")).filter("ret IS NOT NULL")


def drawdowns(prices: DataFrame) -> DataFrame:
    """(symbol, max_drawdown): the deepest fall below the running maximum, 0 or negative.

    The maximum runs within a month and over the months before it, which are one row each.
    """
    p = _months(prices)
    tops = p.groupBy("symbol", "month").agg(F.max("close").alias("top"))
    earlier = tops.select("symbol", "month", F.max("top").over(W.partitionBy("symbol").orderBy("month").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    inside = F.max("close").over(W.partitionBy("symbol", "month").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    both = p.withColumn("inside", inside).join(earlier, ["symbol", "month"], "left")
    peak = F.greatest("inside", "before")
    return both.select("symbol", F.try_divide(F.col("close") - peak, peak).alias("dd")).groupBy("symbol").agg(F.coalesce(F.least(F.min("dd"), F.lit(0.0)), F.lit(0.0)).alias("max_drawdown"))


def worst_drawdown(falls: DataFrame) -> DataFrame:
    """The symbol with the deepest fall and that fall: one row, ties by symbol; none without symbols."""
    worst = F.min_by(F.struct("symbol", "max_drawdown"), F.struct("max_drawdown", "symbol"))
    return falls.agg(worst.alias("w")).filter("w IS NOT NULL").select("w.*")


def risk(rets: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(symbol, volatility, beta, n): annualised sample deviation, and covariance over variance on shared dates.

    benchmark: (date, bench). NULL below two returns or for a benchmark without variance.
    """
    vol = rets.groupBy("symbol").agg(F.when(F.count("ret") >= 2, F.stddev_samp("ret") * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("volatility"))
    shared = rets.join(benchmark, "date").filter("bench IS NOT NULL")
    beta = shared.groupBy("symbol").agg(F.count("*").alias("n"), F.when((F.count("*") >= 2) & (F.var_samp("bench") > 0), F.covar_samp("ret", "bench") / F.var_samp("bench")).alias("beta"))
    return vol.join(beta, "symbol", "left").select("symbol", "volatility", "beta", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def portfolio_returns(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """(date, ret) on the dates for which every weighted symbol with a history has a return.

    Weights (symbol, weight) are renormalised over the symbols that have prices; no row if they sum to nothing.
    """
    has = weights.join(rets.select("symbol").distinct(), "symbol", "left_semi")
    total = has.agg(F.struct(F.sum("weight").alias("weight"), F.count("*").alias("n")).alias("total")).scalar()
    day = rets.join(has, "symbol").groupBy("date").agg(F.sum(F.col("ret") * F.col("weight")).alias("sum"), F.count("*").alias("k"))
    return day.withColumn("total", total).filter("k = total.n AND total.weight <> 0").select("date", (F.col("sum") / F.col("total.weight")).alias("ret"))


def cagr_by_date(prices: DataFrame) -> DataFrame:
    """(symbol, cagr_pct) from the first to the last close; NULL under three years or unless both are positive."""
    g = prices.groupBy("symbol").agg(F.min_by("close", "date").alias("c0"), F.max_by("close", "date").alias("c1"), (F.datediff(F.max("date"), F.min("date")) / DAYS_IN_YEAR).alias("years"))
    return g.select("symbol", F.when((F.col("years") >= LEAST_YEARS) & (F.col("c0") > 0) & (F.col("c1") > 0), (F.pow(F.col("c1") / F.col("c0"), 1 / F.col("years")) - 1) * 100).alias("cagr_pct"))


def last_quote(prices: DataFrame) -> DataFrame:
    """(symbol, last, previous, change_pct) of the last two closes; a single one is its own previous, change 0.

    Two aggregates, each combined before its shuffle, in place of ranking a symbol's history.
    """
    known = prices.filter("close IS NOT NULL")
    last = known.groupBy("symbol").agg(F.max("date").alias("at"), F.max_by("close", "date").alias("last"))
    prior = known.join(last, "symbol").filter("date < at").groupBy("symbol").agg(F.max_by("close", "date").alias("p"))
    previous = F.coalesce("p", "last")
    two = last.join(prior, "symbol", "left")
    return two.select("symbol", "last", previous.alias("previous"), F.when(previous == 0, 0.0).otherwise((F.col("last") - previous) / previous * 100).alias("change_pct"))


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """The named columns rounded, for comparison across engines that add in another order."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


