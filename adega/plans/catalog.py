"""Catalog of the benchmark queries: name -> (Spark query, DuckDB oracle SQL).

Every query reads the benchmark tables under ``sf_dir`` in full (through the
statement adapter in :mod:`adega.sources.driver_tables`) and returns a lazy
DataFrame.  Computed columns carry the same names as in the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adega.functions import labels as L
from adega.operators.clean import clean_statements, split_line, unreadable_cells
from adega.operators.coverage import expected_grid, fetch_plan, missing_periods, request_urls, union_all
from adega.operators.positions import with_positions
from adega.operators.present import preview, series_table
from adega.operators.rank import top_countries, top_per_year
from adega.operators.totals import (
    distinct_years, totals_by_country, totals_by_product_year, totals_by_year, totals_by_year_country,
    value_by_year_country)
from adega.plans import oracle as O
from adega.plans import reports as R
from adega.sources.customs import scan_customs
from adega.sources.driver_tables import (
    PAGE_CODES, PAGE_URL, customs_rows, customs_sheet, derived_path, page_code, statement_lines, statement_pages,
    statement_table, table)
from adega.sources.pages import cells_to_columns, extract_rows, pages_to_statements
from adega.sources.statement_files import missing_statements, statement_presence
from adega.sources.statements import COUNTRY, PRODUCT, QUANTITY, VALUE, YEAR, scan_lines, scan_statements
from adega.sources.writers import write_statement_files, write_statements

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}

# Parameters of the catalog queries (the reports take them as arguments).
COUNTRY_LIKE = "nation_1"
MICRO_PRODUCTS = ("PROMO", "STANDARD")
SERIES_COUNTRY = "NATION_7"
RANK_YEAR, RANK_PRODUCT = 1998, "ECONOMY"
CUSTOMS_COUNTRY, CUSTOMS_STATE, CUSTOMS_GROUPS = "NATION_3", "EUROPE", (48, 57, 58, 59)
SCATTER_COLOURS = {"R": "navy", "A": "crimson"}
FIRST_EXPECTED_YEAR = 1992
RECENT_YEARS = 3
HOLE_PRODUCT, HOLE_YEAR = "PROMO", 1995
AFTER_THE_DATA = 2010


def register(name: str, oracle: str | None):
    def wrap(fn: Query) -> Query:
        CATALOG[name] = (fn, oracle)
        return fn
    return wrap


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_statements(statement_table(spark, sf_dir))


# --- cleaning and parsing -------------------------------------------------------------------------

@register("clean_statements", O.sql("SELECT product, year, country, quantity_kg, value_usd FROM facts"))
def q_clean_statements(spark, sf_dir):
    return facts(spark, sf_dir).select(PRODUCT, YEAR, COUNTRY, QUANTITY, VALUE)


@register("parse_digits_lines", O.sql("SELECT product, year, country, quantity_kg, value_usd FROM line_fields"))
def q_parse_digits_lines(spark, sf_dir):
    fields = split_line(statement_lines(spark, sf_dir), quote_aware=False)
    return clean_statements(fields, parse="digits", missing="keep", totals=True)


@register("totals_reconciliation", O.sql("""
SELECT product, year,
       sum(quantity_kg) FILTER (WHERE country <> 'Total') AS quantity_kg,
       sum(value_usd) FILTER (WHERE country <> 'Total') AS value_usd,
       max(quantity_kg) FILTER (WHERE country = 'Total') AS total_quantity_kg,
       max(value_usd) FILTER (WHERE country = 'Total') AS total_value_usd
FROM parsed WHERE quantity_kg IS NOT NULL AND value_usd IS NOT NULL GROUP BY product, year"""))
def q_totals_reconciliation(spark, sf_dir):
    typed = clean_statements(statement_table(spark, sf_dir), totals=True)
    is_total = F.col(COUNTRY) == "Total"
    return typed.groupBy(PRODUCT, YEAR).agg(
        F.sum(F.when(~is_total, F.col(QUANTITY))).alias(QUANTITY),
        F.sum(F.when(~is_total, F.col(VALUE))).alias(VALUE),
        F.max(F.when(is_total, F.col(QUANTITY))).alias("total_quantity_kg"),
        F.max(F.when(is_total, F.col(VALUE))).alias("total_value_usd"))


# --- scans, sinks, unions -------------------------------------------------------------------------

@register("csv_roundtrip_totals", O.sql("""
SELECT product, year, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd, count(*) AS rows
FROM facts GROUP BY product, year"""))
def q_csv_roundtrip_totals(spark, sf_dir):
    path = derived_path(spark, sf_dir, "roundtrip-csv", write_statements)
    scanned = scan_statements(spark, path, layout="hive")
    return totals_by_product_year(clean_statements(scanned))


@register("flat_files_roundtrip_totals", O.sql("""
SELECT product, year, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd, count(*) AS rows
FROM facts GROUP BY product, year"""))
def q_flat_files_roundtrip_totals(spark, sf_dir):
    root = derived_path(spark, sf_dir, "roundtrip-flat", write_statement_files)
    return totals_by_product_year(clean_statements(scan_statements(spark, root)))


@register("lines_roundtrip_totals", O.sql("""
SELECT product, year, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd, count(*) AS rows
FROM facts GROUP BY product, year"""))
def q_lines_roundtrip_totals(spark, sf_dir):
    path = derived_path(spark, sf_dir, "roundtrip-lines", write_statements)
    fields = split_line(scan_lines(spark, path, layout="hive"))
    return totals_by_product_year(clean_statements(fields, parse="digits"))


@register("latin1_lines_totals", O.sql("""
SELECT replace(country, 'NATION_', 'NAÇÃO_') AS country, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd
FROM facts GROUP BY ALL"""))
def q_latin1_lines_totals(spark, sf_dir):
    accented = F.replace(F.col(COUNTRY), F.lit("NATION_"), F.lit("NAÇÃO_"))
    path = derived_path(spark, sf_dir, "roundtrip-latin1", lambda df, to: write_statements(
        df.withColumn(COUNTRY, accented), to, encoding="ISO-8859-1"))
    fields = split_line(scan_lines(spark, path, layout="hive", encoding="ISO-8859-1"))
    return totals_by_country(clean_statements(fields, parse="digits"))


#: statements left out of the flat copy, and statements whose file has no row
_HOLLOW = ((HOLE_PRODUCT, HOLE_YEAR), ("SMALL", HOLE_YEAR + 1)), (("ECONOMY", HOLE_YEAR), ("LARGE", HOLE_YEAR + 2))


def _hollow_files(df: DataFrame, root: str) -> str:
    absent, empty = _HOLLOW
    left_out = F.concat_ws("/", PRODUCT, YEAR).isin([f"{p}/{y}" for p, y in absent + empty])
    keys = df.sparkSession.createDataFrame(list(empty), f"{PRODUCT} string, {YEAR} int")
    return write_statement_files(df.filter(~left_out), root, statements=keys)


@register("missing_statement_files", O.sql(f"""
, present AS (SELECT DISTINCT product, year FROM raw WHERE (product, year) NOT IN (VALUES {', '.join(map(str, _HOLLOW[0]))})
              UNION VALUES {', '.join(map(str, _HOLLOW[1]))}),
  grid AS (SELECT product, CAST(unnest(generate_series({FIRST_EXPECTED_YEAR - 1}, m)) AS INTEGER) AS year
           FROM (SELECT DISTINCT product FROM raw), (SELECT max(year) AS m FROM raw))
SELECT product, year, 'absent' AS state FROM (SELECT * FROM grid EXCEPT SELECT * FROM present)
UNION ALL VALUES {', '.join(str((*k, 'empty')) for k in _HOLLOW[1])}"""))
def q_missing_statement_files(spark, sf_dir):
    root = derived_path(spark, sf_dir, "hollow-files", _hollow_files)
    return missing_statements(statement_presence(spark, root), scan_statements(spark, root), FIRST_EXPECTED_YEAR - 1)


@register("union_products", O.sql("""
SELECT * FROM facts WHERE product < 'N' UNION ALL SELECT * FROM facts WHERE product >= 'N'"""))
def q_union_products(spark, sf_dir):
    return union_all([facts(spark, sf_dir).filter(F.col(PRODUCT) < "N"),
                      facts(spark, sf_dir).filter(F.col(PRODUCT) >= "N")])


# --- totals -----------------------------------------------------------------------------------------

@register("totals_by_country", O.sql("""
SELECT country, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd FROM facts GROUP BY country"""))
def q_totals_by_country(spark, sf_dir):
    return totals_by_country(facts(spark, sf_dir))


@register("totals_by_year_country", O.sql("SELECT year, country, quantity_kg, value_usd FROM yearly"))
def q_totals_by_year_country(spark, sf_dir):
    return totals_by_year_country(facts(spark, sf_dir))


@register("value_by_year_country_keep_missing", O.sql("""
SELECT year, country, sum(value_usd) AS value_usd FROM parsed WHERE country <> 'Total' GROUP BY year, country"""))
def q_value_keep_missing(spark, sf_dir):
    return value_by_year_country(clean_statements(statement_table(spark, sf_dir), missing="keep", totals=True))


@register("distinct_years", O.sql("SELECT DISTINCT year FROM facts"))
def q_distinct_years(spark, sf_dir):
    return distinct_years(facts(spark, sf_dir))


# --- reports ----------------------------------------------------------------------------------------

@register("country_products_by_year", O.sql(f"""
SELECT year, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd,
       {O.quantity('sum(quantity_kg)')} AS quantity_label, {O.currency('sum(value_usd)')} AS value_label
FROM line_fields
WHERE product IN {MICRO_PRODUCTS!r} AND contains(lower(country), '{COUNTRY_LIKE}')
  AND quantity_kg > 0 AND value_usd > 0
GROUP BY year"""))
def q_country_products_by_year(spark, sf_dir):
    return R.country_product_report(statement_lines(spark, sf_dir), COUNTRY_LIKE, MICRO_PRODUCTS)


@register("country_series", O.sql(f"""
SELECT year, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd,
       {O.quantity_millions('sum(quantity_kg)')} AS quantity_label,
       {O.value_millions('sum(value_usd)')} AS value_label, sum(value_usd) * 1.05 AS value_label_y
FROM facts WHERE country = '{SERIES_COUNTRY}' GROUP BY year"""))
def q_country_series(spark, sf_dir):
    return R.country_series(statement_table(spark, sf_dir), SERIES_COUNTRY)


@register("country_series_long", O.sql(f"""
, series AS (SELECT year, sum(quantity_kg) AS q, sum(value_usd) AS v FROM facts
             WHERE country = '{SERIES_COUNTRY}' GROUP BY year)
SELECT year, 'quantity_kg' AS measure, q AS amount, {O.quantity_millions('q')} AS label FROM series
UNION ALL
SELECT year, 'value_usd' AS measure, v AS amount, {O.value_millions('v')} AS label FROM series"""))
def q_country_series_long(spark, sf_dir):
    series = R.country_series(statement_table(spark, sf_dir), SERIES_COUNTRY)
    return series_table(series, [QUANTITY, VALUE], {QUANTITY: L.label_quantity_millions(QUANTITY),
                                                    VALUE: L.label_value_millions(VALUE)})


@register("top30_value", O.sql("""
SELECT country, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd FROM facts GROUP BY country
ORDER BY value_usd DESC, quantity_kg DESC, country LIMIT 30"""))
def q_top30_value(spark, sf_dir):
    return top_countries(totals_by_country(facts(spark, sf_dir)), 30, VALUE)


@register("top30_quantity", O.sql("""
SELECT country, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd FROM facts GROUP BY country
ORDER BY quantity_kg DESC, value_usd DESC, country LIMIT 30"""))
def q_top30_quantity(spark, sf_dir):
    return top_countries(totals_by_country(facts(spark, sf_dir)), 30, QUANTITY)


@register("top30_value_chart", O.sql(f"""
SELECT country, quantity_kg, value_usd,
       CAST(row_number() OVER (ORDER BY value_usd DESC, quantity_kg DESC, country) - 1 AS INTEGER) AS bar_index,
       value_usd * 1.0 AS label_x, max(value_usd) OVER () * 1.1 AS axis_max,
       {O.grouped('value_usd', 'value_bar')} AS label
FROM (SELECT country, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd FROM facts GROUP BY country
      ORDER BY value_usd DESC, quantity_kg DESC, country LIMIT 30)"""))
def q_top30_value_chart(spark, sf_dir):
    return R.overall_top(statement_table(spark, sf_dir), 30, VALUE)


@register("top30_quantity_chart", O.sql(f"""
SELECT country, quantity_kg, value_usd,
       CAST(row_number() OVER (ORDER BY quantity_kg DESC, value_usd DESC, country) - 1 AS INTEGER) AS bar_index,
       quantity_kg * 1.0 AS label_x, max(quantity_kg) OVER () * 1.1 AS axis_max,
       {O.grouped('quantity_kg', 'quantity_table')} AS label
FROM (SELECT country, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd FROM facts GROUP BY country
      ORDER BY quantity_kg DESC, value_usd DESC, country LIMIT 30)"""))
def q_top30_quantity_chart(spark, sf_dir):
    return R.overall_top(statement_table(spark, sf_dir), 30, QUANTITY)


def _top15_sql(measure: str, other: str) -> str:
    return O.sql(f"""
SELECT year, country, quantity_kg, value_usd,
       CAST(row_number() OVER (PARTITION BY year ORDER BY {measure} DESC, {other} DESC, country) AS INTEGER) AS rank
FROM yearly QUALIFY rank <= 15""")


@register("top15_value_per_year", _top15_sql(VALUE, QUANTITY))
def q_top15_value(spark, sf_dir):
    return top_per_year(totals_by_year_country(facts(spark, sf_dir)), VALUE, 15)


@register("top15_quantity_per_year", _top15_sql(QUANTITY, VALUE))
def q_top15_quantity(spark, sf_dir):
    return top_per_year(totals_by_year_country(facts(spark, sf_dir)), QUANTITY, 15)


@register("chart_rank_table", O.sql(f"""
SELECT year, country, quantity_kg, value_usd, rank, CAST(rank - 1 AS INTEGER) AS bar_index,
       value_usd * 1.01 AS label_x, max(value_usd) OVER (PARTITION BY year) * 1.2 AS axis_max,
       {O.value_millions('value_usd')} AS label
FROM (SELECT year, country, quantity_kg, value_usd,
             CAST(row_number() OVER (PARTITION BY year ORDER BY value_usd DESC, quantity_kg DESC, country)
                  AS INTEGER) AS rank
      FROM yearly QUALIFY rank <= 15)"""))
def q_chart_rank_table(spark, sf_dir):
    return R.annual_top(statement_table(spark, sf_dir), VALUE, 15)


@register("chart_rank_table_quantity", O.sql(f"""
SELECT year, country, quantity_kg, value_usd, rank, CAST(rank - 1 AS INTEGER) AS bar_index,
       quantity_kg * 1.01 AS label_x, max(quantity_kg) OVER (PARTITION BY year) * 1.2 AS axis_max,
       {O.quantity_millions('quantity_kg')} AS label
FROM (SELECT year, country, quantity_kg, value_usd,
             CAST(row_number() OVER (PARTITION BY year ORDER BY quantity_kg DESC, value_usd DESC, country)
                  AS INTEGER) AS rank
      FROM yearly QUALIFY rank <= 15)"""))
def q_chart_rank_table_quantity(spark, sf_dir):
    return R.annual_top(statement_table(spark, sf_dir), QUANTITY, 15)


@register("top10_series", O.sql("""
, annual AS (SELECT year, country, sum(value_usd) AS value_usd FROM parsed WHERE country <> 'Total'
             GROUP BY year, country),
  top AS (SELECT country FROM annual GROUP BY country
          ORDER BY coalesce(sum(value_usd), 0) DESC, country LIMIT 10)
SELECT year, country, value_usd FROM annual WHERE country IN (SELECT country FROM top)"""))
def q_top10_series(spark, sf_dir):
    return R.top_country_value_series(statement_table(spark, sf_dir), 10)


@register("rank_year", O.sql(f"""
SELECT country, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd,
       CAST(row_number() OVER (ORDER BY sum(value_usd) DESC, sum(quantity_kg) DESC, country) AS INTEGER) AS rank
FROM facts WHERE year = {RANK_YEAR} AND product = '{RANK_PRODUCT}' GROUP BY country"""))
def q_rank_year(spark, sf_dir):
    return R.year_ranking(statement_table(spark, sf_dir), RANK_YEAR, RANK_PRODUCT)[0]


@register("mean_value", O.sql(f"""
SELECT round(avg(value_usd), 6) AS mean_value_usd FROM (
  SELECT country, sum(value_usd) AS value_usd FROM facts
  WHERE year = {RANK_YEAR} AND product = '{RANK_PRODUCT}' GROUP BY country)"""))
def q_mean_value(spark, sf_dir):
    mean = R.year_ranking(statement_table(spark, sf_dir), RANK_YEAR, RANK_PRODUCT)[1]
    return mean.select(F.round("mean_value_usd", 6).alias("mean_value_usd"))


@register("product_totals_by_year", O.sql(f"""
SELECT product, year, sum(value_usd) AS value_usd, sum(quantity_kg) AS quantity_kg,
       {O.grouped('sum(value_usd)', 'value_table')} AS value_label,
       {O.grouped('sum(quantity_kg)', 'quantity_table')} AS quantity_label
FROM facts GROUP BY product, year"""))
def q_product_totals_by_year(spark, sf_dir):
    return R.product_year_table(statement_table(spark, sf_dir))


# --- unit price -------------------------------------------------------------------------------------

_CUSTOMS_FILTER = (f"country = '{CUSTOMS_COUNTRY}' AND state = '{CUSTOMS_STATE}' "
                   f"AND group_code IN {CUSTOMS_GROUPS!r}")


def _unit_price_sql(where: str) -> str:
    return O.sql(f"""
SELECT via, round(avg(CASE WHEN net_kg = 0 THEN NULL ELSE fob_usd / net_kg END), 6) AS mean_unit_price,
       {O.grouped('avg(CASE WHEN net_kg = 0 THEN NULL ELSE fob_usd / net_kg END)', 'unit_price')} AS label
FROM customs WHERE via IS NOT NULL AND {where} GROUP BY via""")


def _unit_price(spark, sf_dir, country, state, groups):
    means = R.unit_price_report(customs_rows(spark, sf_dir), country, state, groups, SCATTER_COLOURS)[1]
    return means.select("via", F.round("mean_unit_price", 6).alias("mean_unit_price"), "label")


@register("unit_price_by_mode", _unit_price_sql("TRUE"))
def q_unit_price_by_mode(spark, sf_dir):
    return _unit_price(spark, sf_dir, None, None, None)


@register("unit_price_filtered", _unit_price_sql(_CUSTOMS_FILTER))
def q_unit_price_filtered(spark, sf_dir):
    return _unit_price(spark, sf_dir, CUSTOMS_COUNTRY, CUSTOMS_STATE, CUSTOMS_GROUPS)


@register("price_scatter_rows", O.sql(f"""
SELECT net_kg, fob_usd, via,
       CASE via {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SCATTER_COLOURS.items())} END AS colour
FROM customs WHERE {_CUSTOMS_FILTER}"""))
def q_price_scatter_rows(spark, sf_dir):
    return R.unit_price_report(customs_rows(spark, sf_dir), CUSTOMS_COUNTRY, CUSTOMS_STATE, CUSTOMS_GROUPS,
                               SCATTER_COLOURS)[0]


# --- labels -----------------------------------------------------------------------------------------

@register("labels_currency", O.sql(f"""
SELECT product, year, country, value_usd, {O.currency('value_usd')} AS label FROM facts"""))
def q_labels_currency(spark, sf_dir):
    return facts(spark, sf_dir).select(PRODUCT, YEAR, COUNTRY, VALUE, L.label_currency(VALUE).alias("label"))


@register("labels_quantity", O.sql(f"""
SELECT year, country, quantity_kg, {O.quantity('quantity_kg')} AS label FROM yearly"""))
def q_labels_quantity(spark, sf_dir):
    yearly = totals_by_year_country(facts(spark, sf_dir))
    return yearly.select(YEAR, COUNTRY, QUANTITY, L.label_quantity(QUANTITY).alias("label"))


@register("labels_millions", O.sql(f"""
SELECT year, country, {O.value_millions('value_usd')} AS value_label,
       {O.quantity_millions('quantity_kg')} AS quantity_label FROM yearly"""))
def q_labels_millions(spark, sf_dir):
    yearly = totals_by_year_country(facts(spark, sf_dir))
    return yearly.select(YEAR, COUNTRY, L.label_value_millions(VALUE).alias("value_label"),
                         L.label_quantity_millions(QUANTITY).alias("quantity_label"))


@register("labels_axis", O.sql(f"""
SELECT year, sum(value_usd) AS value_usd, {O.axis_millions('sum(value_usd)')} AS label
FROM facts GROUP BY year"""))
def q_labels_axis(spark, sf_dir):
    yearly = totals_by_year(facts(spark, sf_dir), ordered=False)
    return yearly.select(YEAR, VALUE, L.label_axis_millions(VALUE).alias("label"))


@register("labels_grouped", O.sql(f"""
SELECT country, {O.grouped('sum(value_usd)', 'value_table')} AS value_table,
       {O.grouped('sum(quantity_kg)', 'quantity_table')} AS quantity_table,
       {O.grouped('sum(value_usd)', 'value_bar')} AS value_bar
FROM facts GROUP BY country"""))
def q_labels_grouped(spark, sf_dir):
    totals = totals_by_country(facts(spark, sf_dir))
    return totals.select(COUNTRY, *[L.label_grouped(col, style).alias(style) for col, style in
                                    ((VALUE, "value_table"), (QUANTITY, "quantity_table"), (VALUE, "value_bar"))])


# --- coverage, pages, brief -------------------------------------------------------------------------

@register("missing_periods", O.sql(f"""
, observed AS (SELECT DISTINCT product, year FROM raw),
  grid AS (SELECT product, CAST(unnest(generate_series({FIRST_EXPECTED_YEAR}, m)) AS INTEGER) AS year
           FROM (SELECT DISTINCT product FROM observed), (SELECT max(year) AS m FROM raw))
SELECT product, year FROM grid EXCEPT SELECT product, year FROM observed"""))
def q_missing_periods(spark, sf_dir):
    return missing_periods(statement_table(spark, sf_dir), FIRST_EXPECTED_YEAR)


_GRID = """
, observed AS (SELECT DISTINCT product, year FROM raw WHERE NOT ({hole})),
  grid AS (SELECT product, CAST(unnest(generate_series({first}, m)) AS INTEGER) AS year
           FROM (SELECT DISTINCT product FROM raw), (SELECT max(year) AS m FROM raw))
SELECT product, year FROM grid EXCEPT SELECT product, year FROM observed"""


@register("missing_periods_hole", O.sql(_GRID.format(first=FIRST_EXPECTED_YEAR, hole=f"product = '{HOLE_PRODUCT}' AND year = {HOLE_YEAR}")))
def q_missing_periods_hole(spark, sf_dir):
    statements = statement_table(spark, sf_dir)
    hole = (F.col(PRODUCT) == HOLE_PRODUCT) & (F.col(YEAR) == HOLE_YEAR)
    return missing_periods(statements.filter(~hole), FIRST_EXPECTED_YEAR, products=statements.select(PRODUCT).distinct())


@register("missing_periods_after_data", O.sql(_GRID.format(first=AFTER_THE_DATA, hole="FALSE")))
def q_missing_periods_after_data(spark, sf_dir):
    return missing_periods(statement_table(spark, sf_dir), AFTER_THE_DATA)


@register("expected_grid", O.sql(f"""
SELECT product, CAST(unnest(generate_series({FIRST_EXPECTED_YEAR}, 1998)) AS INTEGER) AS year
FROM (SELECT DISTINCT product FROM raw)"""))
def q_expected_grid(spark, sf_dir):
    products = statement_table(spark, sf_dir).select(PRODUCT).distinct()
    return expected_grid(products, FIRST_EXPECTED_YEAR, 1998, descending=True)


@register("preview_top_values", O.sql("""
SELECT country, sum(value_usd) AS value_usd FROM facts GROUP BY country ORDER BY value_usd DESC, country LIMIT 5"""))
def q_preview_top_values(spark, sf_dir):
    return preview(totals_by_country(facts(spark, sf_dir)).select(COUNTRY, VALUE).orderBy(F.desc(VALUE), COUNTRY), 5)


@register("country_series_checked", O.sql(f"""
SELECT year, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd
FROM facts WHERE country = '{SERIES_COUNTRY}' GROUP BY year"""))
def q_country_series_checked(spark, sf_dir):
    return R.country_series(statement_table(spark, sf_dir), SERIES_COUNTRY, check=True).select(YEAR, QUANTITY, VALUE)


@register("label_for_measures", O.sql(f"""
SELECT year, country, {O.currency('value_usd')} AS value_label, {O.quantity('quantity_kg')} AS quantity_label,
       {O.value_millions('value_usd')} AS value_millions, {O.quantity_millions('quantity_kg')} AS quantity_millions
FROM yearly"""))
def q_label_for_measures(spark, sf_dir):
    yearly = totals_by_year_country(facts(spark, sf_dir))
    return yearly.select(YEAR, COUNTRY, L.label_for(VALUE).alias("value_label"), L.label_for(QUANTITY).alias("quantity_label"),
                         L.label_for(VALUE, "millions").alias("value_millions"),
                         L.label_for(QUANTITY, "millions").alias("quantity_millions"))


@register("top30_value_decimal", O.sql("""
SELECT country, CAST(sum(TRY_CAST(replace(quantity_kg, '.', '') AS DECIMAL(20,2))) AS BIGINT) AS quantity_kg,
       CAST(sum(TRY_CAST(replace(value_usd, '.', '') AS DECIMAL(20,2))) AS BIGINT) AS value_usd
FROM raw WHERE quantity_kg <> '-' AND value_usd <> '-' AND country <> 'Total' GROUP BY country
ORDER BY value_usd DESC, quantity_kg DESC, country LIMIT 30"""))
def q_top30_value_decimal(spark, sf_dir):
    top = R.overall_top(statement_table(spark, sf_dir), 30, VALUE, dtype="decimal(20,2)")
    return top.select(COUNTRY, F.col(QUANTITY).cast("bigint").alias(QUANTITY), F.col(VALUE).cast("bigint").alias(VALUE))


def _sheet_unit_price(fmt: str):
    def query(spark, sf_dir):
        customs = scan_customs(spark, customs_sheet(spark, sf_dir, fmt), fmt, original_headers=True)
        means = R.unit_price_report(customs, CUSTOMS_COUNTRY, CUSTOMS_STATE, CUSTOMS_GROUPS, SCATTER_COLOURS)[1]
        return means.select("via", F.round("mean_unit_price", 6).alias("mean_unit_price"), "label")
    return query


for _fmt in ("csv", "parquet"):
    register(f"unit_price_sheet_{_fmt}", _unit_price_sql(_CUSTOMS_FILTER))(_sheet_unit_price(_fmt))


@register("pages_to_statements_totals", O.sql("""
SELECT product, year, country, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd
FROM facts GROUP BY product, year, country"""))
def q_pages_to_statements_totals(spark, sf_dir):
    facts_of_pages = clean_statements(pages_to_statements(statement_pages(spark, sf_dir), PAGE_CODES))
    return facts_of_pages.groupBy(PRODUCT, YEAR, COUNTRY).agg(F.sum(QUANTITY).alias(QUANTITY), F.sum(VALUE).alias(VALUE))


#: option, code and product of every page, in SQL
_CODES = ", ".join(f"('{o}', '{c}', '{p}')" for (o, c), p in PAGE_CODES.items())
_REQUESTS = f"""
, codes AS (SELECT * FROM (VALUES {_CODES}) AS t(option, code, product) WHERE product IN (SELECT product FROM raw)),
  requests AS (SELECT option, code, product, CAST(unnest(generate_series({FIRST_EXPECTED_YEAR - 2}, (SELECT max(year) FROM raw))) AS INTEGER) AS year
               FROM codes),
  urls AS (SELECT *, printf('http://statistics.example/index.php?ano=%d&opcao=%s&subopcao=subopt_%s', year, option, code) AS url FROM requests)"""


def _requests(spark, sf_dir):
    """(products with their codes, latest year) of the statement table."""
    statements = statement_table(spark, sf_dir)
    names = statements.select(PRODUCT).distinct()
    codes = spark.createDataFrame([(o, c, p) for (o, c), p in PAGE_CODES.items()], "option string, code string, product string")
    return codes.join(names, PRODUCT), statements.agg(F.max(YEAR)).scalar()


@register("request_grid_urls", O.sql(_REQUESTS + " SELECT option, code, product, year, url FROM urls"))
def q_request_grid_urls(spark, sf_dir):
    products, last = _requests(spark, sf_dir)
    return request_urls(products, FIRST_EXPECTED_YEAR - 2, last, PAGE_URL.split("?")[0])


@register("fetch_plan_missing_pages", O.sql(_REQUESTS + f""",
  landed AS (SELECT DISTINCT product, year, CASE WHEN year % 2 = 0 THEN 'opt_06' ELSE 'opt_05' END AS option FROM raw
             WHERE NOT (product = '{HOLE_PRODUCT}' AND year = {HOLE_YEAR}))
SELECT option, code, product, year, url FROM urls ANTI JOIN landed USING (option, product, year)"""))
def q_fetch_plan(spark, sf_dir):
    products, last = _requests(spark, sf_dir)
    option, code = page_code(F.lit(HOLE_PRODUCT), F.lit(HOLE_YEAR))
    lost = F.col("url").contains(F.format_string("ano=%d&opcao=%s&subopcao=subopt_%s&", F.lit(HOLE_YEAR), option, code))
    return fetch_plan(products, statement_pages(spark, sf_dir), FIRST_EXPECTED_YEAR - 2, last, PAGE_URL.split("?")[0], empty=lost)


@register("page_list_columns", """
SELECT page_id, cells[1] AS first, cells[2] AS second
FROM (SELECT page_id,
             list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1),
                            lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))) AS cells
      FROM pages)""")
def q_page_list_columns(spark, sf_dir):
    rows = extract_rows(table(spark, sf_dir, "pages"), "ul", ("li",))
    return cells_to_columns(rows, ["first", "second"]).select("page_id", "first", "second")


@register("page_list_rows", """
SELECT page_id, CAST(0 AS INTEGER) AS row_no, CAST(generate_subscripts(cells, 1) - 1 AS INTEGER) AS cell_no,
       unnest(cells) AS cell
FROM (SELECT page_id,
             list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1),
                            lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))) AS cells
      FROM pages)""")
def q_page_list_rows(spark, sf_dir):
    rows = extract_rows(table(spark, sf_dir, "pages"), "ul", ("li",))
    return rows.select("page_id", "row_no", F.posexplode("cells").alias("cell_no", "cell"))


@register("export_summary", O.sql("""
SELECT 'Brasil' AS origin, country AS destination, sum(quantity_kg) AS litres, sum(value_usd) AS value_usd
FROM facts GROUP BY country"""))
def q_export_summary(spark, sf_dir):
    return R.export_summary(statement_table(spark, sf_dir))


@register("value_trend", O.sql("""
SELECT country, count(*) AS years, round(regr_slope(value_usd, CAST(year AS DOUBLE)), 2) AS slope,
       max(year) AS last_year, max(year) + 1 AS projected_year,
       round(regr_intercept(value_usd, CAST(year AS DOUBLE))
             + regr_slope(value_usd, CAST(year AS DOUBLE)) * (max(year) + 1), 2) AS projected
FROM yearly GROUP BY country"""))
def q_value_trend(spark, sf_dir):
    trend = R.value_trend(statement_table(spark, sf_dir))
    return trend.select(COUNTRY, "years", F.round("slope", 2).alias("slope"), "last_year", "projected_year",
                        F.round("projected", 2).alias("projected"))


@register("last_n_years", O.sql(f"""
SELECT country, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd FROM facts
WHERE year > (SELECT max(year) FROM raw) - {RECENT_YEARS} GROUP BY country"""))
def q_last_n_years(spark, sf_dir):
    return R.last_n_years(statement_table(spark, sf_dir), RECENT_YEARS)


@register("annual_top_positions", O.sql("""
SELECT year, country, rank, row_number() OVER (ORDER BY year, rank) - 1 AS position
FROM (SELECT year, country, row_number() OVER (PARTITION BY year ORDER BY value_usd DESC, quantity_kg DESC, country)::INTEGER AS rank FROM yearly)
WHERE rank <= 15"""))
def q_annual_top_positions(spark, sf_dir):
    top = R.annual_top(statement_table(spark, sf_dir), VALUE, 15)
    return with_positions(top.select(YEAR, COUNTRY, "rank"), YEAR, "rank")


@register("statement_positions", O.sql("""
SELECT product, year, country, value_usd,
       row_number() OVER (ORDER BY value_usd DESC, product, year, country) AS position
FROM (SELECT product, year, country, sum(value_usd) AS value_usd FROM facts GROUP BY ALL)"""))
def q_statement_positions(spark, sf_dir):
    totals = facts(spark, sf_dir).groupBy(PRODUCT, YEAR, COUNTRY).agg(F.sum(VALUE).alias(VALUE))
    return with_positions(totals, F.desc(VALUE), PRODUCT, YEAR, COUNTRY, first=1)


@register("unreadable_cells", O.sql("""
, spoilt AS (SELECT product, year, country, CASE WHEN quantity_kg LIKE '%3' THEN quantity_kg || 'x' ELSE quantity_kg END AS quantity_kg,
                    CASE WHEN value_usd LIKE '%77' THEN 'n/d' ELSE value_usd END AS value_usd FROM raw)
SELECT product, year, 'quantity_kg' AS measure, quantity_kg AS cell, count(*) AS rows FROM spoilt WHERE quantity_kg LIKE '%x' GROUP BY ALL
UNION ALL
SELECT product, year, 'value_usd', value_usd, count(*) FROM spoilt WHERE value_usd = 'n/d' GROUP BY ALL"""))
def q_unreadable_cells(spark, sf_dir):
    spoilt = statement_table(spark, sf_dir).select(
        PRODUCT, YEAR, COUNTRY, F.when(F.col(QUANTITY).endswith("3"), F.concat(QUANTITY, F.lit("x"))).otherwise(F.col(QUANTITY)).alias(QUANTITY),
        F.when(F.col(VALUE).endswith("77"), "n/d").otherwise(F.col(VALUE)).alias(VALUE))
    return unreadable_cells(spoilt)


@register("last_n_years_of_files", O.sql(f"""
SELECT country, sum(quantity_kg) AS quantity_kg, sum(value_usd) AS value_usd FROM facts
WHERE year > (SELECT max(year) FROM raw) - {RECENT_YEARS} GROUP BY country"""))
def q_last_n_years_of_files(spark, sf_dir):
    return R.last_n_years_of_files(spark, derived_path(spark, sf_dir, "roundtrip-flat", write_statement_files), RECENT_YEARS)


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql is not None}
