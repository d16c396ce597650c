"""Holdings files whose headers are spelled in many ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarafa.functions import money
from sarafa.functions.rows import keep

# ---- fixed values: header names per role, the most specific first ----
SYMBOL = ("symbol", "ticker", "ticker symbol", "nse symbol", "nse code", "bse code", "yahoo symbol", "stock formula name", "formula name", "instrument", "scrip name", "scrip", "stock name", "stock", "company", "name")
QUANTITY = ("quantity", "qty.", "qty", "net qty", "holding qty", "shares", "units")
COST = ("avg. cost", "avg cost", "average cost", "average buy price", "avg buy price", "buy avg", "avg price", "average price", "per unit cost", "unit cost", "cost per unit", "cost")
SECTOR = ("sector", "industry")
# ---- end of fixed values ----


def resolve(columns: list[str]) -> dict[str, str]:
    """Role -> column: the first name of a role's list that some column has; raises where symbol, quantity or cost is missing."""
    known = {}
    for c in columns:
        known.setdefault(c.strip().lower(), c)
    out = {role: next((known[n] for n in names if n in known), None) for role, names in (("symbol", SYMBOL), ("quantity", QUANTITY), ("avg_cost", COST), ("sector", SECTOR))}
    lacking = [r for r in ("symbol", "quantity", "avg_cost") if out[r] is None]
    if lacking:
        raise ValueError(f"no column for {', '.join(lacking)} among {columns}")
    return {k: v for k, v in out.items() if v}


def normalize(raw: DataFrame) -> DataFrame:
    """(symbol, quantity, avg_cost, sector, ord) of the valid rows; ord is the row's place, blank sectors are Unknown.

    An input column named ord is kept as the order; without one the order is that of the files' partitions.
    """
    role = resolve([c for c in raw.columns if c != "ord"])
    quoted = {r: F.col(f"`{c}`").cast("string") for r, c in role.items()}
    order = F.col("ord").cast("bigint") if "ord" in raw.columns else F.monotonically_increasing_id()
    sector = F.coalesce(F.nullif(money.strip(quoted["sector"]), F.lit("")), F.lit("Unknown")) if "sector" in role else F.lit("Unknown")
    rows = raw.select(money.normalize_symbol(quoted["symbol"]).alias("symbol"), money.amount(quoted["quantity"]).alias("quantity"), money.amount(quoted["avg_cost"]).alias("avg_cost"), sector.alias("sector"), order.alias("ord"))
    return keep(rows, lambda r: (r["symbol"] != "") & (r["symbol"] != "NAN") & (r["quantity"] > 0) & (r["avg_cost"] >= 0))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Holdings of one CSV file or a folder of files with one header."""
    return normalize(spark.read.csv(path, header=True, inferSchema=False, escape='"'))
