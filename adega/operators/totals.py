"""Sums of quantity and value by country, year and both.

All are plain hash aggregates: Spark combines map-side (partial aggregate)
before the shuffle, so a country or year holding a large share of the rows
costs one partial row per task, not a hot reducer.  Sums of doubles don't depend on the
order in which tasks meet the rows (:mod:`adega.functions.sums`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adega.functions.sums import exact_sum
from adega.operators.clean import drop_totals
from adega.sources.statements import COUNTRY, PRODUCT, QUANTITY, VALUE, YEAR


def sum_of(df: DataFrame, measure: str) -> Column:
    """The sum of a measure: order-independent for doubles, decimals are exact anyway."""
    total = exact_sum(measure) if dict(df.dtypes)[measure] == "double" else F.sum(measure)
    return total.alias(measure)


def _sums(df: DataFrame, quantity: str, value: str) -> list[Column]:
    return [sum_of(df, quantity), sum_of(df, value)]


def totals_by_year_country(facts: DataFrame, quantity: str = QUANTITY, value: str = VALUE) -> DataFrame:
    """``year, country, quantity_kg, value_usd`` summed over products."""
    return facts.groupBy(YEAR, COUNTRY).agg(*_sums(facts, quantity, value))


def totals_by_country(facts: DataFrame, quantity: str = QUANTITY, value: str = VALUE) -> DataFrame:
    """``country, quantity_kg, value_usd`` over all years and products; the total
    line is excluded (the filter is applied on the key, so Catalyst evaluates it
    before the aggregate, at the scan)."""
    return drop_totals(facts.groupBy(COUNTRY).agg(*_sums(facts, quantity, value)))


def totals_by_year(facts: DataFrame, quantity: str = QUANTITY, value: str = VALUE,
                   ordered: bool = True) -> DataFrame:
    """``year, quantity_kg, value_usd``, ordered by year."""
    out = facts.groupBy(YEAR).agg(*_sums(facts, quantity, value))
    return out.orderBy(YEAR) if ordered else out


def totals_by_product_year(facts: DataFrame, quantity: str = QUANTITY, value: str = VALUE) -> DataFrame:
    """``product, year, quantity_kg, value_usd, rows`` (one line per statement)."""
    return facts.groupBy(PRODUCT, YEAR).agg(*_sums(facts, quantity, value), F.count(F.lit(1)).alias("rows"))


def value_by_year_country(parsed: DataFrame, value: str = VALUE) -> DataFrame:
    """``year, country, value_usd`` from rows whose missing values were *kept*:
    a (year, country) whose every value is missing survives with a null sum."""
    return drop_totals(parsed).groupBy(YEAR, COUNTRY).agg(sum_of(parsed, value))


def mean_value(facts: DataFrame, col: str = VALUE, alias: str = "mean_value_usd") -> DataFrame:
    """One row: the mean of ``col`` over non-null rows."""
    return facts.agg(F.avg(col).alias(alias))


def distinct_years(facts: DataFrame) -> DataFrame:
    """Years present, ascending."""
    return facts.select(YEAR).distinct().orderBy(YEAR)
