"""adega -- trade-statement analytics on Spark DataFrames.

Layout: ``sources`` (scans, pages, writers, benchmark adapter), ``functions``
(Column expressions: number parsing, labels, lookups), ``operators``
(DataFrame -> DataFrame steps), ``plans`` (reports, the benchmark catalog and
the command line), ``streaming`` (incremental ingestion of statement files).
The most used entry points are re-exported here.
"""

from adega.functions.labels import (  # noqa: F401
    label_axis_millions, label_currency, label_for, label_grouped, label_quantity, label_quantity_millions,
    label_value_millions)
from adega.functions.lookup import map_values  # noqa: F401
from adega.functions.numbers import parse_digits, parse_locale_number  # noqa: F401
from adega.operators.clean import (  # noqa: F401
    clean_statements, drop_totals, filter_country, filter_country_like, filter_customs, filter_positive,
    require_rows, split_line)
from adega.operators.coverage import expected_grid, missing_periods, request_grid, union_all  # noqa: F401
from adega.operators.present import chart_table, preview, series_table  # noqa: F401
from adega.operators.price import price_scatter_rows, unit_price_by_mode, with_unit_price  # noqa: F401
from adega.operators.rank import rank_year, top_countries, top_country_series, top_per_year  # noqa: F401
from adega.operators.totals import (  # noqa: F401
    distinct_years, mean_value, totals_by_country, totals_by_product_year, totals_by_year, totals_by_year_country,
    value_by_year_country)
from adega.plans.reports import (  # noqa: F401
    annual_top, country_product_report, country_series, export_summary, last_n_years, overall_top,
    product_year_table, top_country_value_series, unit_price_report, year_ranking)
from adega.session import build_session, scratch_dir  # noqa: F401
from adega.sources.customs import scan_customs  # noqa: F401
from adega.sources.pages import cells_to_columns, extract_rows, pages_to_statements  # noqa: F401
from adega.sources.statements import product_from_path, scan_lines, scan_statements, year_from_path  # noqa: F401
from adega.sources.writers import write_statements  # noqa: F401
from adega.streaming import ingest_statement_files, stream_statements  # noqa: F401

__version__ = "0.1.0"
