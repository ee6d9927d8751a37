"""Unions of statement frames, the expected (product, year) grid and its gaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adega.sources.pages import page_keys
from adega.sources.statements import PRODUCT, YEAR


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name (duplicates kept).  Prefer one brace-glob
    scan when the frames are products of one root; this is for frames that
    really come from different places."""
    if not frames:
        raise ValueError("union_all needs at least one frame")
    return reduce(lambda a, b: a.unionByName(b), frames)


def expected_grid(products: DataFrame, first_year: int | Column, last_year: int | Column,
                  descending: bool = False) -> DataFrame:
    """Every (product, year) between two years for each row of ``products``.

    Built with ``sequence`` + ``explode`` per product row (no cross join); its
    size is products x years.
    """
    lo, hi = (F.lit(first_year) if isinstance(first_year, int) else first_year,
              F.lit(last_year) if isinstance(last_year, int) else last_year)
    years = F.sequence(hi, lo, F.lit(-1)) if descending else F.sequence(lo, hi)
    return products.select(PRODUCT, F.explode(years).alias(YEAR))


def missing_periods(facts: DataFrame, first_year: int, last_year: int | None = None,
                    products: DataFrame | None = None) -> DataFrame:
    """(product, year) pairs of the expected grid with no statement row.

    One pass over ``facts``: the years present are gathered per product
    (``collect_set``, combined map-side; a set holds at most one entry per year),
    the expected years are ``first_year`` to ``last_year`` and the gaps are their
    ``array_except``.  ``last_year`` defaults to the latest year in ``facts`` (a
    scalar subquery over the year column); nothing is expected if it lies before
    ``first_year`` or ``facts`` has no year.  ``products`` adds products to those of
    ``facts``: one without any row misses every year.
    """
    rows = facts.select(PRODUCT, YEAR)
    if products is not None:
        rows = rows.unionByName(products.select(PRODUCT, F.lit(None).cast("int").alias(YEAR)))
    present = rows.groupBy(PRODUCT).agg(F.collect_set(YEAR).alias("_years"))  # a set leaves nulls out
    last = F.lit(last_year) if last_year is not None else facts.agg(F.max(YEAR)).scalar()
    bounded = present.select(PRODUCT, "_years", last.alias("_last")).where(F.col("_last") >= F.lit(first_year))
    expected = F.sequence(F.lit(first_year), F.greatest(F.col("_last"), F.lit(first_year)))
    return bounded.select(PRODUCT, F.explode(F.array_except(expected, "_years")).alias(YEAR))


def request_grid(spark: SparkSession, first_year: int, last_year: int, product_codes: dict[str, str],
                 base_url: str, option: str) -> DataFrame:
    """Download plan of the statistics site: one row per (year, product) from the
    latest year down, with the page URL.  Input is configuration, not data."""
    products = spark.createDataFrame([(option, c, p) for c, p in product_codes.items()], "option string, code string, product string")
    return request_urls(products, first_year, last_year, base_url).select(YEAR, PRODUCT, "code", "url")


def request_urls(products: DataFrame, first_year: int | Column, last_year: int | Column, base_url: str) -> DataFrame:
    """Every page that should exist: ``option, code, product, year, url``, for each row of
    ``products`` (``option``, ``code``, ``product``) from the latest year down."""
    lo, hi = (F.lit(y) if isinstance(y, int) else y for y in (first_year, last_year))
    years = F.when(hi >= lo, F.sequence(F.greatest(hi, lo), lo, F.lit(-1)))  # explode of null: no rows
    grid = products.select("option", "code", PRODUCT, F.explode(years).alias(YEAR))
    url = F.format_string("%s?ano=%d&opcao=%s&subopcao=subopt_%s", F.lit(base_url), F.col(YEAR), F.col("option"), F.col("code"))
    return grid.withColumn("url", url)


def fetch_plan(products: DataFrame, landed: DataFrame, first_year: int | Column, last_year: int | Column, base_url: str,
               empty: Column | None = None) -> DataFrame:
    """Pages still to be fetched: :func:`request_urls` without those that ``landed``
    (rows with a ``url``) has, whatever the order or number of its URL's parameters.

    Keys are read from the landed URLs and made distinct before the anti join, so
    that a product whose pages landed many times costs one key; URLs that name no page
    are passed over.  ``empty`` marks landed rows that don't count (a page of
    length 0, an error page): their page is fetched again unless another copy landed."""
    rows = landed if empty is None else landed.where(~F.coalesce(empty, F.lit(False)))
    keys = dict(zip(("option", "code", YEAR), page_keys(F.col("url"))))
    have = rows.select(*[c.alias(name) for name, c in keys.items()]).dropna().distinct()
    return request_urls(products, first_year, last_year, base_url).join(have, ["option", "code", YEAR], "left_anti").select(
        "option", "code", PRODUCT, YEAR, "url")
