import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adega.sources.pages import ROWS_OUT, cells_to_columns, extract_rows, pages_to_statements, rows_of_page
from adega.operators.clean import clean_statements
from tests.conftest import rows

TABLE = """<html><body><script>var x = "<tr><td>not a row</td></tr>";</script>
<table><thead><tr><th>Países</th><th>Quantidade (Kg)</th><th>Valor (US$)</th></tr></thead>
<tbody>
<tr><td> <b>Alemanha</b>, República Democrática </td><td>6.666</td><td>48.095</td></tr>
<tr><td>Bósnia &amp; Herzegovina</td><td></td><td>-</td></tr>
<tr><td>Argélia<td>6<td>87</tr>
<tr><td>Só um</td></tr>
<tr><td>Total</td><td>6.672</td><td>48.182</td></tr>
</tbody></table></body></html>"""


def test_rows_of_page_tolerates_markup():
    got = rows_of_page(TABLE)
    assert got == [["Países", "Quantidade (Kg)", "Valor (US$)"],
                   ["Alemanha, República Democrática", "6.666", "48.095"],  # nested tag, strip per text node
                   ["Bósnia & Herzegovina", "", "-"],                        # entity, empty cell
                   ["Argélia", "6", "87"],                                   # unclosed td
                   ["Só um"],                                                # ragged row
                   ["Total", "6.672", "48.182"]]


def test_no_table_and_bad_input():
    assert rows_of_page("<p>nothing here</p>") == []
    assert rows_of_page(None) == []
    assert rows_of_page("") == []


def test_nested_table_rows_belong_to_inner_row():
    html = "<table><tr><td>outer<table><tr><td>inner</td></tr></table></td><td>b</td></tr></table>"
    assert rows_of_page(html) == [["outer", "b"], ["inner"]]


def test_list_rows():
    html = '<ul><li><a href="/x">x</a></li><li> y </li></ul><ul><li>z</li></ul>'
    assert rows_of_page(html, "ul", ("li",)) == [["x", "y"], ["z"]]


def test_extract_rows_and_cells_to_columns(spark):
    pages = spark.createDataFrame([(1, "u", TABLE), (2, "v", "<p>none</p>")], "page_id long, url string, html string")
    extracted = extract_rows(pages)
    assert extracted.columns == ["page_id", "row_no", "table_no", "table_row_no", "cells", "page_error"]
    assert rows(extracted.select("table_no").distinct()) == [(0,)]
    assert extracted.count() == 6
    cols = cells_to_columns(extracted.filter("row_no = 4"), ["country", "quantity_kg", "value_usd"])
    assert rows(cols, "country", "quantity_kg", "value_usd") == [("Só um", None, None)]


def test_pages_to_statements(spark):
    url = "http://site.example/index.php?ano=2024&opcao=opt_06&subopcao=subopt_04"
    pages = spark.createDataFrame([(7, url, TABLE)], "page_id long, url string, html string")
    st = pages_to_statements(pages)
    assert rows(st.select("product", "year").distinct()) == [("grape_juice", 2024)]
    facts = clean_statements(st)
    assert rows(facts, "country", "quantity_kg", "value_usd") == [
        ("Alemanha, República Democrática", 6666.0, 48095.0), ("Argélia", 6.0, 87.0)]


def test_page_list_rows_on_driver_pages(spark):
    from adega.plans.catalog import q_page_list_rows
    df = q_page_list_rows(spark, "/root/testdata/sf0.001")
    assert df.columns == ["page_id", "row_no", "cell_no", "cell"]
    assert df.count() > 0 and df.filter("row_no <> 0").count() == 0


def test_table_numbers_and_table_choice(spark):
    from adega.sources.pages import table_rows_of_page
    html = ("<table><tr><td>menu</td></tr></table>"
            "<table><tr><th>Países</th><th>Q</th><th>V</th></tr><tr><td>Chile</td><td>1.000</td><td>2.000</td></tr>"
            "</table><ul><li>x</li></ul>")
    assert table_rows_of_page(html) == [(0, ["menu"]), (1, ["Países", "Q", "V"]), (1, ["Chile", "1.000", "2.000"])]
    assert table_rows_of_page(html, "ul", ("li",)) == [(None, ["x"])]
    url = "http://site.example/index.php?ano=2020&opcao=opt_05&subopcao=subopt_01"
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    st = pages_to_statements(pages, header=("Países", "Q", "V"))
    assert rows(st) == [("table_wine", 2020, "Chile", "1.000", "2.000")]


def test_parse_failures_are_counted():
    from adega.sources.pages import table_rows_of_page
    seen = []
    assert table_rows_of_page(12345, on_error=seen.append) == []  # not text: parser raises
    assert len(seen) == 1


def test_failure_accumulator_on_spark(spark):
    acc = spark.sparkContext.accumulator(0)
    pages = spark.createDataFrame([(1, "u", TABLE)], "page_id long, url string, html string")
    assert extract_rows(pages, failures=acc).count() == 6
    assert acc.value == 0


def page_frame(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def test_rows_before_broken_markup_are_kept_and_the_page_is_marked(spark):
    table = "<table><tr><td>a</td><td>b</td></tr></table>"
    assert rows_of_page(table + "<![foo>z" + table) == [["a", "b"], ["a", "b"]]
    got = extract_rows(page_frame(spark, [(1, "u", table), (2, "u", table + "<![foo>z")])).collect()
    assert [(r["page_id"], r["cells"], r["page_error"]) for r in got] == [(1, ["a", "b"], None), (2, ["a", "b"], None)]


def test_unclosed_template_ends_with_its_cell():
    html = "<table><tr><td>a<template>x</td><td>b</td></tr><tr><td>c</td></tr></table>"
    assert rows_of_page(html) == [["a", "b"], ["c"]]


def test_statement_table_is_found_by_its_header_in_a_layout_table(spark):
    html = ("<table><tr><td><table><tr><td>Menu</td><td>1</td><td>2</td></tr><tr><td>Home</td><td>3</td><td>4</td></tr></table></td></tr>"
            "<tr><td>" + TABLE + "</td></tr><tr><td><table><tr><td>Foot</td></tr><tr><td>Line</td><td>5</td><td>6</td></tr></table></td></tr></table>")
    url = "http://site.example/index.php?ano=2024&opcao={}&subopcao=subopt_0{}"
    pages = page_frame(spark, [(1, url.format("opt_06", 4), html), (2, url.format("opt_05", 4), html), (3, url.format("opt_05", 5), html)])
    facts = clean_statements(pages_to_statements(pages))
    assert sorted(set(rows(facts, "product"))) == [("grape_juice",), ("raisins_grapes",)]
    assert sorted(set(rows(facts, "country"))) == [("Alemanha, República Democrática",), ("Argélia",)] and facts.count() == 6


def test_unknown_product_code_fails(spark):
    import pytest
    pages = page_frame(spark, [(1, "http://site.example/index.php?ano=2024&opcao=opt_06&subopcao=subopt_09", TABLE)])
    with pytest.raises(Exception, match="no product for the page"):
        pages_to_statements(pages).collect()


def test_pages_without_a_statement_table_or_read_in_part_are_not_lost(spark, monkeypatch):
    import pytest
    url = "http://site.example/index.php?ano=2024&opcao=opt_06&subopcao=subopt_0"
    other = TABLE.replace("Quantidade (Kg)", "Quantidade").replace("Países", "País")
    two = TABLE + TABLE.replace("Argélia", "Chile")
    good = page_frame(spark, [(1, url + "1", two)])
    assert sorted(r[0] for r in rows(clean_statements(pages_to_statements(good)), "country")) == [
        "Alemanha, República Democrática", "Alemanha, República Democrática", "Argélia", "Chile"]
    for bad in (other, "<table><caption>x</caption><tr><td>Exports</td></tr></table>", "<p>Error 500</p>", None):
        pages = page_frame(spark, [(1, url + "1", two), (1, url + "1", bad)])  # the same page, stored twice
        with pytest.raises(Exception, match="no statement table in the page"):
            pages_to_statements(pages).collect()
        kept = pages_to_statements(pages, errors="keep").where("page_error is not null")
        assert rows(kept) == [("table_wine", 2024, None, None, None, "no statement table")]
    assert pages_to_statements(page_frame(spark, [(1, url + "1", other)]), header=("País", "Quantidade", "Valor (US$)")).count() == 5


def test_broken_pages_carry_their_error_into_statements(spark):
    import pytest
    url = "http://site.example/index.php?ano=2024&opcao=opt_06&subopcao=subopt_01"
    pages = page_frame(spark, [(1, url, TABLE)]).select("page_id", "url", F.lit(5).alias("html"))  # not text: parser raises
    with pytest.raises(Exception, match="in the page http"):
        pages_to_statements(pages).collect()
    (row,) = pages_to_statements(pages, errors="keep").collect()
    assert row["country"] is None and row["page_error"] and row["page_error"] != "no statement table"


class _Asked(Exception):
    pass


class _Pages:
    """Stands for a table of pages and hands out the function that its tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, fn, schema):
        raise _Asked(fn)


@pytest.mark.parametrize("ask", [pages_to_statements, extract_rows])
def test_rows_leave_python_before_a_whole_batch_of_pages_is_parsed(spark, ask):
    html = "<table><tr><td>Países</td><td>Quantidade (Kg)</td><td>Valor (US$)</td></tr>" + "<tr><td>X</td><td>1</td><td>2</td></tr>" * 199 + "</table>"
    n = 300
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["u"] * n, "html": [html] * n})
    with pytest.raises(_Asked) as asked:
        ask(_Pages())
    sizes = [b.num_rows for b in asked.value.args[0](iter([batch]))]
    assert sum(sizes) == n * (199 if ask is pages_to_statements else 200) and max(sizes) < ROWS_OUT + 200
