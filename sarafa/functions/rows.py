"""Rows kept by computed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame, condition: Callable[[Column], Column]) -> DataFrame:
    """The rows for which condition(row struct) holds, with every computed column evaluated once.

    A plain filter is pushed below the projections that compute its columns, so that costly expressions are
    evaluated in the filter and again in the projection, and once more for each use in between. A generator
    over an array of at most one row is not crossed by that rule. For filters on stored columns use filter().
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.explode_outer(F.filter(F.array(row), condition)).alias("_row")).filter("_row IS NOT NULL").select("_row.*")
