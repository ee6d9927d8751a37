import tempfile

from adega.plans.cli import run
from tests.conftest import EXPORT_ROOT, IMPORT_ROOT, rows


def test_cli_reports(spark):
    top = run(spark, ["overall-top", "--root", IMPORT_ROOT, "--n", "3"])
    assert [r[0] for r in top.select("country").collect()] == ["Chile", "Argentina", "Portugal"]
    series = run(spark, ["country-series", "--root", EXPORT_ROOT, "--country", "Países Baixos"])
    assert rows(series.filter("year = 2024"), "value_usd") == [(49359083.0,)]
    micro = run(spark, ["country-products", "--root", EXPORT_ROOT, "--country", "argentina",
                        "--products", "foaming_wine", "table_wine"])
    assert rows(micro.filter("year = 2009"), "quantity_kg", "value_usd") == [(162.0, 4523.0)]
    missing = run(spark, ["missing", "--root", EXPORT_ROOT, "--first-year", "2007"])
    assert sorted(rows(missing, "product", "year")) == [(p, y) for p in ("foaming_wine", "fresh_grapes",
                                                                           "grape_juice", "table_wine")
                                                         for y in (2007, 2008)]


def test_cli_writes_output(spark):
    out = tempfile.mkdtemp(prefix="adega-cli-") + "/top"
    run(spark, ["annual-top", "--root", IMPORT_ROOT, "--n", "5", "--out", out])
    assert spark.read.parquet(out).count() == 16 * 5


def test_cli_all_writes_every_report(spark):
    import os
    out = tempfile.mkdtemp(prefix="adega-cli-all-")
    run(spark, ["all", "--root", IMPORT_ROOT, "--out", out, "--first-year", "2009"])
    assert sorted(os.listdir(out)) == sorted(["annual_top_value", "annual_top_quantity", "top_series",
                                              "overall_top_value", "overall_top_quantity", "product_table",
                                              "summary", "last_years", "missing"])
    assert spark.read.parquet(f"{out}/overall_top_value").count() == 30
    assert spark.read.parquet(f"{out}/missing").count() == 0


def test_cli_checks_required_options():
    import pytest
    from adega.plans.cli import main, parse
    for argv in (["year-ranking", "--root", "x"], ["all", "--root", "x"], ["country-series", "--root", "x"], ["ingest", "--root", "x"]):
        with pytest.raises(SystemExit):
            parse(argv)
    with pytest.raises(SystemExit, match="row per input row"):
        main(["price-scatter", "--customs", "x"])


def test_cli_reads_lines_from_a_columnar_copy(spark):
    from adega.sources.statements import scan_statements
    from adega.sources.writers import write_statements
    root = write_statements(scan_statements(spark, EXPORT_ROOT), tempfile.mkdtemp(prefix="adega-cli-") + "/copy", fmt="parquet")
    micro = run(spark, ["country-products", "--root", root, "--layout", "hive-parquet", "--country", "argentina",
                        "--products", "foaming_wine", "table_wine"])
    assert rows(micro.filter("year = 2009"), "quantity_kg", "value_usd") == [(162.0, 4523.0)]


def test_cli_all_keeps_an_argument_that_is_called_all(spark):
    out = tempfile.mkdtemp(prefix="adega-cli-all-")
    run(spark, ["all", "--root", IMPORT_ROOT, "--out", out, "--origin", "all", "--dtype", "decimal(20,2)"])
    assert {r["origin"] for r in spark.read.parquet(f"{out}/summary").collect()} == {"all"}
    assert dict(spark.read.parquet(f"{out}/summary").dtypes)["value_usd"].startswith("decimal")


def test_cli_prints_every_row_of_a_report(spark, capsys):
    from adega.plans.cli import main
    main(["top-series", "--root", IMPORT_ROOT])
    assert capsys.readouterr().out.count("\n|") - 1 == 160
