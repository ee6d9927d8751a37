"""End-to-end reports: compositions of scans, cleaning, totals and rankings.

Each report returns lazy DataFrames; nothing is collected.  The inputs are the
text statements (``scan_statements`` / ``pages_to_statements`` output) or raw
lines (``scan_lines``), so one function serves every flow, product list and
country instead of one script per combination.  ``dtype`` is the measures' type:
``double`` (whole-number sums exact below 2^53) or a decimal type, whose sums don't
depend on task order at any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adega.functions.labels import (
    label_for, label_grouped, label_quantity_millions, label_value_millions)
from adega.operators.clean import (
    clean_statements, filter_country, filter_country_like, filter_customs, require_rows, split_line)
from adega.operators.present import chart_table
from adega.operators.price import price_scatter_rows, unit_price_by_mode, with_unit_price
from adega.operators.rank import rank_year, top_countries, top_country_series, top_per_year
from adega.operators.totals import (
    mean_value, totals_by_country, totals_by_product_year, totals_by_year, totals_by_year_country,
    value_by_year_country)
from adega.operators.trend import linear_trend
from adega.sources.statement_files import latest_years
from adega.sources.statements import COUNTRY, PRODUCT, QUANTITY, VALUE, YEAR, scan_statements


def _products(df: DataFrame, products: Sequence[str] | None) -> DataFrame:
    return df.filter(F.col(PRODUCT).isin(list(products))) if products else df


def country_product_report(lines: DataFrame, country: str, products: Sequence[str] | None = None, *,
                           quote_aware: bool = True, check: bool = False, dtype: str = "double") -> DataFrame:
    """One country (case-insensitive substring), given products: yearly
    quantity and value where both are positive, with compact labels.

    ``lines`` is a raw-line table (``product, year, raw_data``).
    """
    lines = _products(lines, products)
    if '"' not in country:
        # a line whose country field contains the needle contains it too: cheap
        # pre-filter on the raw text before any field is parsed
        lines = lines.filter(F.lower(F.col("raw_data")).contains(country.lower()))
    fields = split_line(lines, quote_aware=quote_aware)
    facts = clean_statements(fields, parse="digits", missing="positive", totals=True, dtype=dtype)
    facts = filter_country_like(facts, country)
    if check:
        require_rows(facts, f"no positive rows for country like {country!r}")
    return (totals_by_year(facts, ordered=False)
            .select(YEAR, QUANTITY, VALUE,
                    label_for(QUANTITY).alias("quantity_label"),
                    label_for(VALUE).alias("value_label"))
            .orderBy(YEAR))


def country_series(statements: DataFrame, country: str, products: Sequence[str] | None = None,
                   check: bool = False, label_lift: float = 0.05, dtype: str = "double") -> DataFrame:
    """Yearly quantity and value of one exact country over the products, with
    million/billion labels and the height of the value label on the line chart
    (value x 1.05).  The country filter runs before the aggregate (and reaches
    the scan)."""
    facts = filter_country(clean_statements(_products(statements, products), dtype=dtype), country)
    if check:
        require_rows(facts, f"no rows for country {country!r}")
    return (totals_by_year(facts, ordered=False)
            .select(YEAR, QUANTITY, VALUE,
                    label_quantity_millions(QUANTITY).alias("quantity_label"),
                    label_value_millions(VALUE).alias("value_label"),
                    (F.col(VALUE) * F.lit(1.0 + label_lift)).alias("value_label_y"))
            .orderBy(YEAR))


def annual_top(statements: DataFrame, measure: str = VALUE, n: int = 15, dtype: str = "double") -> DataFrame:
    """Top ``n`` countries of every year by ``measure`` with chart columns:
    ``bar_index``, label position (+1 %), axis bound (max x 1.2) and label."""
    yearly = totals_by_year_country(clean_statements(statements, dtype=dtype))
    return chart_table(top_per_year(yearly, measure, n), measure, label_for(measure, "millions"), partition_by=[YEAR],
                       label_offset=0.01, bound_factor=1.2)


def top_country_value_series(statements: DataFrame, n: int = 10, dtype: str = "double") -> DataFrame:
    """Yearly value of the ``n`` countries with the largest cumulative value;
    missing values are kept (a year with only missing values has a null)."""
    parsed = clean_statements(statements, missing="keep", dtype=dtype)
    return top_country_series(value_by_year_country(parsed), n)


def overall_top(statements: DataFrame, n: int = 30, by: str = VALUE, dtype: str = "double") -> DataFrame:
    """Top ``n`` countries over all years and products by ``by``, with bar
    index, axis bound (x 1.1) and the grouped bar label."""
    top = top_countries(totals_by_country(clean_statements(statements, dtype=dtype)), n, by)
    label = label_grouped(VALUE, "value_bar") if by == VALUE else label_grouped(QUANTITY, "quantity_table")
    return chart_table(top, by, label, label_offset=0.0, bound_factor=1.1)


def year_ranking(statements: DataFrame, year: int, product: str | None = None,
                 dtype: str = "double") -> tuple[DataFrame, DataFrame]:
    """(ranking of the countries of one year by value, one-row mean value).
    Numbers read with the pt-BR meaning (``.`` thousands, ``,`` decimals)."""
    facts = clean_statements(statements, decimal=",", dtype=dtype)
    ranked = rank_year(facts, year, product)
    return ranked, mean_value(ranked)


def product_year_table(statements: DataFrame, products: Sequence[str] | None = None, dtype: str = "double") -> DataFrame:
    """Yearly totals per product with the printed-table labels (``US$ 1,234.00``
    and ``1,234 Kg``); numbers read with the pt-BR meaning."""
    facts = clean_statements(_products(statements, products), decimal=",", dtype=dtype)
    return (totals_by_product_year(facts)
            .select(PRODUCT, YEAR, VALUE, QUANTITY,
                    label_grouped(VALUE, "value_table").alias("value_label"),
                    label_grouped(QUANTITY, "quantity_table").alias("quantity_label"))
            .orderBy(PRODUCT, YEAR))


def unit_price_report(customs: DataFrame, country: str | None, state: str | None,
                      group_codes: Sequence[int] | None, colours: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(scatter rows with colours, mean unit price per mode with label)."""
    rows = with_unit_price(filter_customs(customs, country, state, group_codes))
    means = unit_price_by_mode(rows)
    return (price_scatter_rows(rows, colours),
            means.withColumn("label", label_grouped("mean_unit_price", "unit_price")))


def export_summary(statements: DataFrame, origin: str = "Brasil", dtype: str = "double") -> DataFrame:
    """Origin, destination, litres (1 kg = 1 L) and US$ per destination."""
    totals = totals_by_country(clean_statements(statements, dtype=dtype))
    return totals.select(F.lit(origin).alias("origin"), F.col(COUNTRY).alias("destination"),
                         F.col(QUANTITY).alias("litres"), F.col(VALUE).alias(VALUE))


def value_trend(statements: DataFrame, measure: str = VALUE, ahead: int = 1, dtype: str = "double") -> DataFrame:
    """Least-squares trend of each country's yearly totals and its projection."""
    return linear_trend(totals_by_year_country(clean_statements(statements, dtype=dtype)), measure, ahead=ahead)


def last_n_years(statements: DataFrame, n: int = 15, dtype: str = "double") -> DataFrame:
    """Per-country totals over the latest ``n`` statement years.  The latest
    year is a scalar subquery over the statements' year column alone (a
    partition column in the hive layout, so no data column is read); it is
    evaluated once and the year predicate is applied at the scan."""
    latest = statements.agg(F.max(YEAR)).scalar()
    facts = clean_statements(statements.filter(F.col(YEAR) > latest - F.lit(n)), dtype=dtype)
    return totals_by_country(facts)


def last_n_years_of_files(spark: SparkSession, root: str, n: int = 15, products: Sequence[str] | None = None,
                          dtype: str = "double") -> DataFrame:
    """:func:`last_n_years` of a flat root: the years are found in the file listing and
    only their files are scanned, ``n`` a product."""
    years, present = latest_years(spark, root, n, products)
    if not years:
        return totals_by_country(clean_statements(scan_statements(spark, root, products).limit(0), dtype=dtype))
    return totals_by_country(clean_statements(scan_statements(spark, root, present, years=years), dtype=dtype))
