"""Command line for the reports: ``spark-submit -m adega <report> [options]``
(or ``python -m adega`` locally).

Each subcommand reads statement files (``--root``: one folder per product with
``dados_<year>.csv`` files, or a hive-layout copy with ``--layout hive``), runs
one report and either writes the result (``--out``, parquet or CSV, distributed
write) or prints all its rows (``--show`` prints fewer; reports with a row per
input row need ``--out`` or ``--show``).
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from adega.functions.lookup import MODE_COLOURS_ARGENTINA, MODE_COLOURS_SPAIN
from adega.operators.coverage import missing_periods
from adega.plans import reports as R
from adega.session import build_session
from adega.sources.customs import scan_customs
from adega.sources.pages import pages_to_statements
from adega.sources.statement_files import missing_statements, statement_presence
from adega.sources.statements import as_lines, scan_lines, scan_statements
from adega.sources.writers import write_statements
from adega.streaming import ingest_statement_files

COLOURS = {"argentina": MODE_COLOURS_ARGENTINA, "spain": MODE_COLOURS_SPAIN}
#: options a report can't do without
REQUIRED = {
    "country-products": ("root", "country"), "country-series": ("root", "country"), "annual-top": ("root",),
    "top-series": ("root",), "overall-top": ("root",), "year-ranking": ("root", "year"), "year-mean": ("root", "year"),
    "product-table": ("root",), "summary": ("root",), "last-years": ("root",), "trend": ("root",), "missing": ("root",),
    "unit-price": ("customs",), "price-scatter": ("customs",), "pages": ("pages",), "ingest": ("root", "target"),
    "all": ("root", "out"),
}
#: reports with a row per input row
UNBOUNDED = ("price-scatter", "pages")


def _statements(spark: SparkSession, a) -> DataFrame:
    fmt = "parquet" if a.layout == "hive-parquet" else "csv"
    layout = "hive" if a.layout.startswith("hive") else "files"
    return scan_statements(spark, a.root, a.products, layout=layout, fmt=fmt)


def _lines(spark: SparkSession, a) -> DataFrame:
    if a.layout == "hive-parquet":  # a columnar copy: its cells as the lines they came from
        return as_lines(_statements(spark, a))
    return scan_lines(spark, a.root, a.products, encoding=a.encoding,
                      layout="hive" if a.layout == "hive" else "files")


REPORTS = {
    "country-products": lambda s, a: R.country_product_report(_lines(s, a), a.country, a.products,
                                                              quote_aware=not a.plain_split, check=True, dtype=a.dtype),
    "country-series": lambda s, a: R.country_series(_statements(s, a), a.country, check=True, dtype=a.dtype),
    "annual-top": lambda s, a: R.annual_top(_statements(s, a), a.measure, a.n or 15, dtype=a.dtype),
    "top-series": lambda s, a: R.top_country_value_series(_statements(s, a), a.n or 10, dtype=a.dtype),
    "overall-top": lambda s, a: R.overall_top(_statements(s, a), a.n or 30, a.measure, dtype=a.dtype),
    "year-ranking": lambda s, a: R.year_ranking(_statements(s, a), a.year, a.product, dtype=a.dtype)[0],
    "year-mean": lambda s, a: R.year_ranking(_statements(s, a), a.year, a.product, dtype=a.dtype)[1],
    "product-table": lambda s, a: R.product_year_table(_statements(s, a), a.products, dtype=a.dtype),
    "summary": lambda s, a: R.export_summary(_statements(s, a), a.origin, dtype=a.dtype),
    "last-years": lambda s, a: (R.last_n_years_of_files(s, a.root, a.n or 15, a.products, dtype=a.dtype) if a.layout == "files"
                                else R.last_n_years(_statements(s, a), a.n or 15, dtype=a.dtype)),
    "trend": lambda s, a: R.value_trend(_statements(s, a), a.measure, a.n or 1, dtype=a.dtype),
    "missing": lambda s, a: (missing_statements(statement_presence(s, a.root, a.products), _statements(s, a), a.first_year, a.last_year)
                             if a.layout == "files" else missing_periods(_statements(s, a), a.first_year, a.last_year)),
    "unit-price": lambda s, a: R.unit_price_report(
        scan_customs(s, a.customs, a.customs_format, original_headers=a.original_headers),
        a.country, a.state, a.groups, COLOURS[a.colours])[1],
    "price-scatter": lambda s, a: R.unit_price_report(
        scan_customs(s, a.customs, a.customs_format, original_headers=a.original_headers),
        a.country, a.state, a.groups, COLOURS[a.colours])[0],
    "pages": lambda s, a: pages_to_statements(s.read.parquet(a.pages), **({"header": a.header} if a.header else {})),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="adega", description=__doc__.splitlines()[0])
    p.add_argument("report", choices=sorted([*REPORTS, "ingest", "all"]))
    p.add_argument("--root", help="statement folder (one sub-folder per product)")
    p.add_argument("--layout", default="files", choices=["files", "hive", "hive-parquet"])
    p.add_argument("--products", nargs="*", help="product folders to read (default: all)")
    p.add_argument("--encoding", default="UTF-8")
    p.add_argument("--plain-split", action="store_true", help="split raw lines on every comma")
    p.add_argument("--country")
    p.add_argument("--product")
    p.add_argument("--year", type=int)
    p.add_argument("--first-year", type=int, default=2009)
    p.add_argument("--last-year", type=int)
    p.add_argument("--n", type=int)
    p.add_argument("--measure", default="value_usd", choices=["value_usd", "quantity_kg"])
    p.add_argument("--origin", default="Brasil")
    p.add_argument("--customs", help="customs table path")
    p.add_argument("--customs-format", default="parquet")
    p.add_argument("--original-headers", action="store_true")
    p.add_argument("--state")
    p.add_argument("--groups", nargs="*", type=int)
    p.add_argument("--colours", default="spain", choices=sorted(COLOURS))
    p.add_argument("--pages", help="parquet table page_id, url, html")
    p.add_argument("--header", nargs="+", help="pages: cells of the statement tables' header row")
    p.add_argument("--flow", help="ingest: flow written with every row")
    p.add_argument("--target", help="ingest: facts table path")
    p.add_argument("--checkpoint", help="ingest: streaming checkpoint path")
    p.add_argument("--out", help="write the result here instead of printing it")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    p.add_argument("--show", type=int, help="rows to print when --out is not given (default: all)")
    p.add_argument("--dtype", default="double", help="type of the measures, e.g. decimal(20,2)")
    p.add_argument("--explain", action="store_true", help="print the formatted physical plan instead of running")
    p.add_argument("--master", help="Spark master (spark-submit normally provides it)")
    return p


# Reports that need no country/year/customs argument, written by ``all``.
ALL_REPORTS = {
    "annual_top_value": ("annual-top", ["--measure", "value_usd"]),
    "annual_top_quantity": ("annual-top", ["--measure", "quantity_kg"]),
    "top_series": ("top-series", []),
    "overall_top_value": ("overall-top", ["--measure", "value_usd"]),
    "overall_top_quantity": ("overall-top", ["--measure", "quantity_kg"]),
    "product_table": ("product-table", []),
    "summary": ("summary", []),
    "last_years": ("last-years", []),
    "missing": ("missing", []),
}


def _write(df: DataFrame, out: str, fmt: str) -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(out) if fmt == "csv" else writer.parquet(out)


def parse(argv: Sequence[str]) -> argparse.Namespace:
    """Arguments with the report's required options checked."""
    p = parser()
    a = p.parse_args(list(argv))
    for option in REQUIRED[a.report]:
        if getattr(a, option) is None:
            p.error(f"{a.report}: --{option} is required")
    return a


def run(spark: SparkSession, argv: Sequence[str]) -> DataFrame | None:
    """Build the report DataFrame for ``argv`` (and write it when ``--out``)."""
    a = parse(argv)
    if a.report == "ingest":
        ingest_statement_files(spark, a.root, a.target, products=a.products, checkpoint=a.checkpoint,
                               flow=a.flow).awaitTermination()
        return None
    if a.report == "all":
        for name, (report, extra) in ALL_REPORTS.items():
            sub = parser().parse_args([report, *extra], argparse.Namespace(**{**vars(a), "report": report}))
            _write(REPORTS[report](spark, sub), f"{a.out.rstrip('/')}/{name}", a.format)
        return None
    df = REPORTS[a.report](spark, a)
    if a.explain:
        df.explain("formatted")
        return df
    if a.out:
        if a.report == "pages":  # statement files, one folder per product and year
            write_statements(df, a.out, mode="overwrite", fmt=a.format)
        else:
            _write(df, a.out, a.format)
    return df


def main(argv: Sequence[str] | None = None) -> None:
    import sys
    args = list(sys.argv[1:] if argv is None else argv)
    a = parse(args)
    if a.report in UNBOUNDED and not (a.out or a.show or a.explain):
        raise SystemExit(f"{a.report}: --out or --show is required, it has a row per input row")
    spark = build_session(a.master, app_name=f"adega-{a.report}")
    df = run(spark, args)
    if df is not None and not a.out and not a.explain:
        df.show(a.show or max(1, df.count()), truncate=False)
