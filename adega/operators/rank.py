"""Top-k and rankings over aggregated totals.

Orders are total (measure, then the other measure, then country), so ties at a
cut-off are resolved the same way on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adega.operators.totals import totals_by_country
from adega.sources.statements import COUNTRY, PRODUCT, QUANTITY, VALUE, YEAR


def _other(measure: str) -> str:
    return QUANTITY if measure == VALUE else VALUE


def display_order(df: DataFrame, measure: str):
    """Total order of a ranking: measure desc, the other measure desc (when the
    frame has it), country asc."""
    keys = [F.desc_nulls_last(measure)]
    if _other(measure) in df.columns:
        keys.append(F.desc_nulls_last(_other(measure)))
    return keys + [F.asc(COUNTRY)]


def top_countries(totals: DataFrame, n: int = 30, by: str = VALUE) -> DataFrame:
    """First ``n`` countries of a per-country totals table by ``by``.

    ``orderBy + limit`` plans as ``TakeOrderedAndProject``: each task keeps its
    own top ``n`` and only those rows travel, whatever the input size.
    """
    return totals.orderBy(*display_order(totals, by)).limit(n)


def top_per_year(yearly: DataFrame, measure: str = VALUE, n: int = 15) -> DataFrame:
    """First ``n`` countries of every year of a (year, country) totals table,
    with a 1-based ``rank``.

    ``row_number() <= n`` lets Spark add a partial ``WindowGroupLimit`` before
    the shuffle, so at most ``n`` rows per year and task are exchanged.
    """
    w = Window.partitionBy(YEAR).orderBy(*display_order(yearly, measure))
    return yearly.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_country_series(annual: DataFrame, n: int = 10, value: str = VALUE) -> DataFrame:
    """All yearly rows of the ``n`` countries with the largest cumulative value
    (a missing yearly value counts as zero).

    One pass over ``annual``: the cumulative value is a window partitioned by
    country, and countries are ranked with ``dense_rank`` over (cumulative desc,
    country), so every year of a country shares its rank.  ``annual`` is already
    aggregated to one row per (year, country), so the ranking window holds at most
    countries x years rows whatever the size of the statements behind it; the
    input is scanned and shuffled once (a broadcast top-N join would read it twice).
    """
    cumulative = F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(Window.partitionBy(COUNTRY)),
                            F.lit(0.0))
    ranked = annual.withColumn("_cumulative", cumulative).withColumn(
        "_rank", F.dense_rank().over(Window.orderBy(F.desc("_cumulative"), F.asc(COUNTRY))))
    return ranked.filter(F.col("_rank") <= n).select(*annual.columns)


def rank_year(facts: DataFrame, year: int, product: str | None = None,
              measure: str = VALUE) -> DataFrame:
    """All countries of one year (and product) ranked by ``measure`` (1-based
    ``rank``).  The year/product filter is pushed to the scan; the window runs on
    one row per country."""
    cond = F.col(YEAR) == F.lit(year)
    if product is not None:
        cond = cond & (F.col(PRODUCT) == F.lit(product))
    totals = totals_by_country(facts.filter(cond))
    return totals.withColumn("rank", F.row_number().over(Window.orderBy(*display_order(totals, measure))))
