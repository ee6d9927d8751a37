"""Straight-line trend of yearly totals and its projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adega.sources.statements import COUNTRY, VALUE, YEAR


def linear_trend(yearly: DataFrame, measure: str = VALUE, by: Sequence[str] = (COUNTRY,), ahead: int = 1) -> DataFrame:
    """``*by, years, slope, last_year, projected_year, projected`` from a table of
    yearly totals: the least-squares line through (year, measure) of each group and
    its value ``ahead`` years after the group's last one.

    A group with a single year has no line: slope and projection are null.  Null
    measures are left out.  One aggregate with a partial step; a group has a row
    per year."""
    y, x = F.col(measure).cast("double"), F.col(YEAR).cast("double")
    lines = yearly.where(F.col(measure).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("years"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("_intercept"),
        F.max(YEAR).alias("last_year"))
    target = F.col("last_year") + F.lit(ahead)
    return lines.select(*by, "years", "slope", "last_year", target.alias("projected_year"),
                        (F.col("_intercept") + F.col("slope") * target).alias("projected"))
