import os
import shutil
import tempfile

from pyspark.sql import functions as F

from adega.operators.clean import clean_statements
from adega.operators.coverage import expected_grid, missing_periods, request_grid
from adega.operators.present import chart_table, preview, series_table
from adega.operators.rank import rank_year, top_countries, top_country_series, top_per_year
from adega.operators.totals import distinct_years, totals_by_country, totals_by_year, totals_by_year_country
from adega.functions.labels import label_value_millions, label_quantity_millions
from adega.sources.pages import EXPORT_OPTION, EXPORT_PRODUCT_CODES
from adega.sources.statements import scan_statements
from tests.conftest import EXPORT_ROOT, IMPORT_PRODUCTS, IMPORT_ROOT, rows


def test_missing_periods_reports_absent_year(spark):
    root = tempfile.mkdtemp(prefix="adega-missing-")
    shutil.copytree(f"{EXPORT_ROOT}/table_wine", f"{root}/table_wine")
    os.remove(f"{root}/table_wine/dados_2015.csv")
    facts = scan_statements(spark, root)
    assert rows(missing_periods(facts, 2009)) == [("table_wine", 2015)]
    assert sorted(rows(missing_periods(facts, 2007, 2024))) == [("table_wine", 2007), ("table_wine", 2008),
                                                                ("table_wine", 2015)]


def test_expected_and_request_grid(spark):
    products = spark.createDataFrame([("a",), ("b",)], "product string")
    assert expected_grid(products, 2023, 2024).count() == 4
    grid = request_grid(spark, 2009, 2024, EXPORT_PRODUCT_CODES, "http://site.example/index.php", EXPORT_OPTION)
    assert grid.count() == 64
    first = rows(grid.filter("product = 'grape_juice' AND year = 2024"), "url")
    assert first == [("http://site.example/index.php?ano=2024&opcao=opt_06&subopcao=subopt_04",)]


def imports_yearly(spark):
    return totals_by_year_country(clean_statements(scan_statements(spark, IMPORT_ROOT, IMPORT_PRODUCTS)))


def test_top_per_year_prefix_property(spark):
    yearly = imports_yearly(spark)
    for n in (3, 7):
        small = set(rows(top_per_year(yearly, "value_usd", n), "year", "country", "rank"))
        big = set(rows(top_per_year(yearly, "value_usd", n + 1), "year", "country", "rank"))
        assert small < big


def test_top_countries_tie_break_by_country(spark):
    df = spark.createDataFrame([("b", 1.0, 5.0), ("a", 1.0, 5.0), ("c", 2.0, 5.0)],
                               "country string, quantity_kg double, value_usd double")
    assert [r[0] for r in top_countries(df, 3, "value_usd").collect()] == ["c", "a", "b"]


def test_top_country_series_counts_missing_as_zero(spark):
    annual = spark.createDataFrame([(2020, "x", None), (2021, "x", None), (2020, "y", 1.0), (2020, "z", 3.0)],
                                   "year int, country string, value_usd double")
    assert sorted(rows(top_country_series(annual, 2))) == [(2020, "y", 1.0), (2020, "z", 3.0)]
    assert top_country_series(annual, 3).count() == 4


def test_country_series_metamorphic(spark):
    from adega.plans.reports import country_series
    statements = scan_statements(spark, IMPORT_ROOT, IMPORT_PRODUCTS)
    direct = rows(country_series(statements, "Chile"), "year", "quantity_kg", "value_usd")
    via_totals = imports_yearly(spark).filter(F.col("country") == "Chile").orderBy("year")
    assert direct == rows(via_totals, "year", "quantity_kg", "value_usd")


def test_rank_year_and_distinct_years(spark):
    facts = clean_statements(scan_statements(spark, IMPORT_ROOT, IMPORT_PRODUCTS))
    ranked = rank_year(facts, 2024, "table_wine")
    assert rows(ranked.orderBy("rank").limit(1), "country", "rank") == [("Chile", 1)]
    assert [r[0] for r in distinct_years(facts).collect()] == list(range(2009, 2025))
    assert [r[0] for r in totals_by_year(facts).collect()] == list(range(2009, 2025))


def test_chart_and_series_tables(spark):
    yearly = imports_yearly(spark)
    top = top_per_year(yearly, "value_usd", 15)
    chart = chart_table(top, "value_usd", label_value_millions("value_usd"), partition_by=["year"])
    row = chart.filter("year = 2024 AND bar_index = 0").collect()[0]
    assert row["country"] == "Chile" and row["rank"] == 1
    assert abs(row["label_x"] - row["value_usd"] * 1.01) < 1e-6
    assert abs(row["axis_max"] - row["value_usd"] * 1.2) < 1e-6
    overall = chart_table(top_countries(totals_by_country(clean_statements(
        scan_statements(spark, IMPORT_ROOT, IMPORT_PRODUCTS))), 30), "value_usd", label_value_millions("value_usd"))
    assert sorted(r[0] for r in overall.select("bar_index").collect()) == list(range(30))
    long = series_table(totals_by_year(yearly, ordered=False), ["quantity_kg", "value_usd"],
                        {"quantity_kg": label_quantity_millions("quantity_kg"),
                         "value_usd": label_value_millions("value_usd")})
    assert long.columns == ["year", "measure", "amount", "label"] and long.count() == 32
    assert preview(yearly, 5).count() == 5


def test_missing_periods_lists_products_without_any_row(spark):
    facts = scan_statements(spark, IMPORT_ROOT, ["table_wine"])
    products = spark.createDataFrame([("table_wine",), ("brandy",)], "product string")
    got = sorted(rows(missing_periods(facts, 2023, 2024, products=products)))
    assert got == [("brandy", 2023), ("brandy", 2024)]


def test_missing_periods_adds_products_and_never_counts_down(spark):
    facts = spark.createDataFrame([("x", 2005), ("x", 2007), ("y", 2006), ("y", None)], "product string, year int")
    z = spark.createDataFrame([("z",)], "product string")
    assert sorted(rows(missing_periods(facts, 2005))) == [("x", 2006), ("y", 2005), ("y", 2007)]
    assert sorted(rows(missing_periods(facts, 2006, products=z))) == [("x", 2006), ("y", 2007), ("z", 2006), ("z", 2007)]
    assert rows(missing_periods(facts, 2010)) == rows(missing_periods(facts, 2010, products=z)) == []
    assert rows(missing_periods(facts, 2008, 2007)) == [] and rows(missing_periods(facts.limit(0), 2000, products=z)) == []
    assert rows(missing_periods(facts.limit(0), 2000, 2000, products=z)) == [("z", 2000)]


def test_linear_trend_against_least_squares(spark):
    import numpy as np
    from adega.operators.trend import linear_trend
    data = {"a": [(2000, 1.0), (2001, 3.0), (2002, 4.0), (2005, 9.0)], "b": [(2001, 5.0)], "c": [(2000, 2.0), (2001, None), (2002, 2.0)]}
    df = spark.createDataFrame([(c, y, v) for c, own in data.items() for y, v in own], "country string, year int, value_usd double")
    got = {r["country"]: r for r in linear_trend(df, ahead=2).collect()}
    slope, level = np.polyfit(*zip(*data["a"]), 1)
    assert abs(got["a"]["slope"] - slope) < 1e-9 and abs(got["a"]["projected"] - (slope * 2007 + level)) < 1e-6
    assert got["a"]["projected_year"] == 2007 and got["b"]["slope"] is None and got["b"]["projected"] is None
    assert got["c"]["years"] == 2 and got["c"]["slope"] == 0 and got["c"]["projected"] == 2
