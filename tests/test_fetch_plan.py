"""The download plan against landed pages, and pages that grow with the line items."""

import re

from pyspark.sql import functions as F

from adega.operators.coverage import fetch_plan, request_urls
from adega.plans.catalog import PAGE_CODES
from adega.sources.driver_tables import statement_pages
from adega.sources.pages import page_keys, pages_to_statements, statement_rows_of_page
from tests.conftest import SMOKE_DIR, rows

BASE = "http://site.example/index.php"


def products(spark):
    return spark.createDataFrame([("opt_06", "01", "table_wine"), ("opt_06", "04", "grape_juice"), ("opt_05", "01", "table_wine")],
                                 "option string, code string, product string")


def test_urls_of_every_product_and_year_from_the_latest_down(spark):
    grid = request_urls(products(spark), 2009, 2024, BASE)
    assert grid.columns == ["option", "code", "product", "year", "url"] and grid.count() == 48
    one = rows(grid.where("option = 'opt_05'"), "year", "url")
    assert [y for y, _ in one] == list(range(2024, 2008, -1))
    assert one[0][1] == BASE + "?ano=2024&opcao=opt_05&subopcao=subopt_01"
    assert request_urls(products(spark), 2009, 2008, BASE).count() == 0


def test_plan_lists_what_has_not_landed(spark):
    landed = spark.createDataFrame([
        (BASE + "?ano=2024&opcao=opt_06&subopcao=subopt_01&pagina=1", "x"), (BASE + "?ano=2024&opcao=opt_06&subopcao=subopt_01&pagina=2", "x"),
        (BASE + "?subopcao=subopt_04&opcao=opt_06&ano=2023", "x"),       # another order of parameters
        (BASE + "?ano=2024&opcao=opt_05&subopcao=subopt_01", ""),        # an empty page
        (BASE + "?ano=2023&opcao=opt_05", "x"), (BASE + "?ano=20240&opcao=opt_06&subopcao=subopt_04", "x"), (None, "x"), ("", "x"),
        (BASE + "?ano=2030&opcao=opt_06&subopcao=subopt_01", "x")], "url string, html string")
    plan = fetch_plan(products(spark), landed, 2023, 2024, BASE, empty=F.length("html") == 0)
    assert sorted(rows(plan, "option", "code", "year")) == [
        ("opt_05", "01", 2023), ("opt_05", "01", 2024), ("opt_06", "01", 2023), ("opt_06", "04", 2024)]
    assert all(f"ano={y}&opcao={o}&subopcao=subopt_{c}" in u for o, c, y, u in rows(plan, "option", "code", "year", "url"))
    assert fetch_plan(products(spark), landed, 2023, 2024, BASE).where("option = 'opt_05' AND year = 2024").count() == 0
    assert fetch_plan(products(spark), landed.limit(0), 2023, 2024, BASE).count() == 6


def test_a_fetched_plan_leaves_nothing_to_fetch(spark):
    grid = request_urls(products(spark), 2009, 2024, BASE)
    assert fetch_plan(products(spark), grid, 2009, 2024, BASE).count() == 0


def test_keys_of_urls(spark):
    one = spark.createDataFrame([("a?ano=2009&opcao=opt_06&subopcao=subopt_02",), ("a?opcao=x",), (None,)], "url string")
    assert rows(one.select(*page_keys(F.col("url")))) == [("opt_06", "02", 2009), (None, None, None), (None, None, None)]


def test_statement_rows_of_one_page():
    head = "<tr><th>Países</th><th> quantidade (kg)</th><th>Valor (US$)</th><th>more</th></tr>"
    table = f"<table>{head}<tr><td>a</td><td>1</td></tr></table>"
    other = "<table><tr><td>menu</td></tr><tr><td>b</td></tr></table>"
    assert statement_rows_of_page(other + table + table) == ([["a", "1"], ["a", "1"]], None)
    assert statement_rows_of_page(other) == ([], "no statement table")
    assert statement_rows_of_page(other, header=None) == ([["b"]], None)
    assert statement_rows_of_page(f"<table>{head}</table>") == ([], None)
    assert statement_rows_of_page("<tr><td>no table</td></tr>", header=None) == ([], "no statement table")
    seen = []
    assert statement_rows_of_page(5, on_error=seen.append)[0] == [] and len(seen) == 1


def test_no_exchange_between_page_scan_and_statement_rows(spark):
    df = pages_to_statements(statement_pages(spark, SMOKE_DIR), PAGE_CODES)
    df.write.format("noop").mode("overwrite").save()
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())
    assert "Exchange" not in plan and "Window" not in plan and "MapInPandas" in plan


def test_pages_grow_with_the_line_items(spark):
    small, large = (statement_pages(spark, f"/root/testdata/{sf}") for sf in ("sf0.001", "sf0.01"))
    assert large.count() > 5 * small.count() and large.select("page_id").distinct().count() == large.count()
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    assert pages_to_statements(large, PAGE_CODES).count() == lines  # a table row per line item
