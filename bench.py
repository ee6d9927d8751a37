"""Benchmark: run every catalog query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row is produced,
nothing is pulled to the driver), $BENCH_REPEAT times (default 3); the median
is reported.  A warm-up query on the smallest tables runs
first so JVM start-up and code generation are not charged to the timings; the
one-time ingest of the statement and customs tables is timed as its own entry, and so is
what the first run of a round trip writes (``ingest_for_<query>``).  Prints one JSON line:
``{"metric", "value" (sum of query seconds), "unit", "queries", "sf", ...}``;
``reference_scale`` adds the report families timed over the original statement
files (not part of ``value``).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import tempfile
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from adega.plans import catalog  # noqa: E402
from adega.session import build_session  # noqa: E402
from adega.plans import reports as R  # noqa: E402
from adega.sources.driver_tables import cells_table, statement_files, statement_table  # noqa: E402
from adega.sources.statements import scan_lines, scan_statements  # noqa: E402

#: queries whose first run writes a copy of the statements through a sink
WRITES_ONCE = ("csv_roundtrip_totals", "flat_files_roundtrip_totals", "lines_roundtrip_totals", "latin1_lines_totals",
               "missing_statement_files", "unit_price_sheet_csv", "unit_price_sheet_parquet", "pages_to_statements_totals",
               "last_n_years_of_files", "fetch_plan_missing_pages")
FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests", "fixtures")


def reference_scale_reports(spark):
    """The report families over the original statement files (tests/fixtures:
    144 CSVs, 11,552 rows): the data scale the original scripts run at."""
    exp, imp = os.path.join(FIXTURES, "export"), os.path.join(FIXTURES, "import")
    ex = lambda: scan_statements(spark, exp)
    im = lambda: scan_statements(spark, imp)
    return {
        "r1_country_products": lambda: R.country_product_report(scan_lines(spark, exp), "argentina",
                                                                ["fresh_grapes", "grape_juice"]),
        "r2_country_series": lambda: R.country_series(ex(), "Países Baixos"),
        "r3_country_series": lambda: R.country_series(im(), "Chile"),
        "r4_annual_top_value": lambda: R.annual_top(ex(), "value_usd", 15),
        "r4_annual_top_quantity": lambda: R.annual_top(ex(), "quantity_kg", 15),
        "r5_top_series": lambda: R.top_country_value_series(ex(), 10),
        "r6_top_series": lambda: R.top_country_value_series(im(), 10),
        "r7_overall_top": lambda: R.overall_top(ex(), 30, "value_usd"),
        "r8_overall_top": lambda: R.overall_top(im(), 30, "value_usd"),
        "r9_year_ranking": lambda: R.year_ranking(ex(), 2024, "table_wine")[0],
        "r10_product_table": lambda: R.product_year_table(ex(), ["table_wine"]),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(f"local[{cpus}]", app_name="adega-bench", shuffle_partitions=int(cpus) * 2,
                          conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="adega-bench-"))
    queries = catalog.queries()
    names = only or list(queries)

    # warm-up on the smallest tables, so JVM start-up and code generation are not
    # charged to the timed work
    smoke = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(smoke):
        queries["top30_value"](spark, smoke).write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    # ingest: the joined cells, the statement text rendered from them (parquet) and
    # the same text as CSV statement files, each written once to the scratch
    # folder; every query below scans these tables
    for name, ingest in (("ingest_cells", cells_table), ("ingest_statements", statement_table),
                         ("ingest_statement_files", statement_files)):
        t0 = time.perf_counter()
        ingest(spark, sf_dir, refresh=True)
        timings[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)

    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(runs), 3)
        if name in WRITES_ONCE and repeat > 1:
            # the first run also wrote the copy that the others only read
            timings[f"ingest_for_{name}"] = round(max(0.0, runs[0] - statistics.median(runs[1:])), 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)

    reference_scale: dict[str, float] = {}
    if os.environ.get("BENCH_REFERENCE_SCALE", "1") == "1" and os.path.isdir(FIXTURES):
        for name, build in reference_scale_reports(spark).items():
            runs = []
            for _ in range(repeat):
                t0 = time.perf_counter()
                build().write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - t0)
            reference_scale[name] = round(statistics.median(runs), 3)
            print(f"{name}: {reference_scale[name]}s", file=sys.stderr, flush=True)

    match = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({
        "metric": "catalog_total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(match.group(1)) if match else sf_dir,
        "cpus": int(cpus),
        "repeat": repeat,
        "reference_scale": reference_scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
