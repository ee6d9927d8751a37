"""The flat sink: names given by tasks, one rename, nothing left by a failed job; the listing."""

import os
import re
import shutil
import tempfile
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adega.operators.totals import totals_by_country
from adega.operators.clean import clean_statements
from adega.plans.reports import last_n_years, last_n_years_of_files
from adega.sources.statement_files import (
    StatementFilesWriter, csv_cell, file_system, latest_years, missing_statements, qualified, statement_presence)
from adega.sources.statements import scan_lines, scan_statements
from adega.sources.writers import write_statement_files, write_statements
from tests.conftest import EXPORT_PRODUCTS, EXPORT_ROOT, rows

SCHEMA = "product string, year int, country string, quantity_kg string, value_usd string"


def fresh(name):
    return tempfile.mkdtemp(prefix=f"adega-{name}-") + "/files"


def test_one_file_a_statement_and_nothing_else(spark):
    src = scan_statements(spark, EXPORT_ROOT)
    root = write_statement_files(src, fresh("sink"))
    assert sorted(os.listdir(root)) == sorted(EXPORT_PRODUCTS) and os.listdir(os.path.dirname(root)) == ["files"]
    for product in EXPORT_PRODUCTS:
        assert sorted(os.listdir(f"{root}/{product}")) == [f"dados_{y}.csv" for y in range(2009, 2025)]
    assert sorted(rows(scan_statements(spark, root))) == sorted(rows(src))


def test_cells_come_back_as_they_were(spark):
    cells = ["", " ", None, 'a "quoted" one', "a,b", " blank ends ", "é ç ã", "'", "\\", "#x"]
    df = spark.createDataFrame([("p", 2000, c, q, "1") for c in cells for q in ("2", None, "")], SCHEMA)
    back = rows(scan_statements(spark, write_statement_files(df, fresh("cells"))))
    want = [tuple(x if x != "" else None for x in r) for r in rows(df)]  # the scan reads empty cells as null
    assert sorted(back, key=str) == sorted(want, key=str)
    assert [csv_cell(c) for c in (None, "", "a", 'a"b', "a\rb")] == ["", '""', "a", '"a""b"', '"a\rb"']


def test_a_failed_job_leaves_no_file(spark):
    root = fresh("failed")
    df = spark.range(4000, numPartitions=4).select(
        F.lit("p").alias("product"), (2000 + F.col("id") % 20).cast("int").alias("year"), F.col("id").cast("string").alias("country"),
        F.when(F.col("id") == 3999, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.lit("1")).alias("quantity_kg"), F.lit("2").alias("value_usd"))
    with pytest.raises(Exception, match="broken row"):
        write_statement_files(df, root)
    assert os.listdir(os.path.dirname(root)) == []


def test_a_task_that_fails_while_it_writes_leaves_no_file(spark):
    root = fresh("charset")
    df = spark.createDataFrame([("p", 2000 + k, "中" if k == 5 else "é", "1", "2") for k in range(10)], SCHEMA)
    with pytest.raises(Exception):  # noqa: B017  (a character that Latin-1 doesn't have)
        write_statement_files(df, root, encoding="ISO-8859-1")
    assert os.listdir(os.path.dirname(root)) == []


def test_latin1_files_are_read_in_their_charset(spark):
    df = spark.createDataFrame([("p", 2000, "Bósnia, Grã", "1", "2")], SCHEMA)
    for path, layout in ((write_statement_files(df, fresh("latin"), encoding="ISO-8859-1"), "files"),
                         (write_statements(df, fresh("latin"), encoding="ISO-8859-1"), "hive")):
        assert rows(scan_statements(spark, path, layout=layout, encoding="ISO-8859-1"), "country") == [("Bósnia, Grã",)]
        assert rows(scan_lines(spark, path, layout=layout, encoding="ISO-8859-1"), "raw_data") == [('"Bósnia, Grã",1,2',)]
        assert rows(scan_lines(spark, path, layout=layout), "raw_data") != [('"Bósnia, Grã",1,2',)]


def test_what_is_there_is_never_mixed_with_new_files(spark):
    df = spark.createDataFrame([("p", 2000, "x", "1", "2")], SCHEMA)
    root = fresh("twice")
    os.makedirs(root)
    write_statement_files(df, root)  # an empty folder is as good as none
    with pytest.raises(FileExistsError):
        write_statement_files(df, root)
    with pytest.raises(ValueError, match="rename"):
        file_system("s3a://bucket/files")
    for name in ("", ".", ".."):
        with pytest.raises(Exception, match="no statement file"):
            write_statement_files(df.withColumn("product", F.lit(name)), fresh("dots"))


def test_a_task_that_runs_twice_leaves_one_whole_file(spark):
    import pyarrow as pa
    base = qualified(spark, fresh("attempts"))
    writer = StatementFilesWriter(f"{base}-root", base, "UTF-8")
    batch = pa.RecordBatch.from_pydict({"product": ["p", "p"], "file": ["dados_2000.csv"] * 2, "is_row": [True, True], "c": ["a", "b"], "q": ["1", "2"], "v": ["3", None]})

    def dies():
        yield batch
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dies())
    writer.write(iter([batch]))
    writer.write(iter([batch]))
    writer.commit([None])
    folder = f"{base}-root".removeprefix("file:")
    assert os.listdir(f"{folder}/p") == ["dados_2000.csv"] and open(f"{folder}/p/dados_2000.csv").read() == "country,quantity_kg,value_usd\na,1,3\nb,2,\n"


def test_large_statements_and_repeated_rows_are_dealt_to_several_files(spark):
    df = spark.range(20_000, numPartitions=8).select(F.lit("p").alias("product"), F.lit(2000).alias("year"), F.lit("same").alias("country"),
                                                     F.lit("1").alias("quantity_kg"), F.lit("2").alias("value_usd"))
    from adega.sources.statement_files import write_flat
    root = fresh("parts")
    write_flat(df, root, file_bytes=40_000)
    sizes = [os.path.getsize(f"{root}/p/{n}") for n in os.listdir(f"{root}/p")]
    assert len(sizes) > 2 and max(sizes) < 100_000
    assert scan_statements(spark, root).where("year = 2000").count() == 20_000


def test_no_rows_give_an_empty_root(spark):
    root = write_statement_files(spark.createDataFrame([], SCHEMA), fresh("none"))
    assert os.listdir(root) == []


@pytest.fixture()
def hollow(spark):
    """Table wine without 2015, and with 2012 as a file without rows."""
    root = tempfile.mkdtemp(prefix="adega-hollow-")
    for product in ("table_wine", "fresh_grapes"):
        shutil.copytree(f"{EXPORT_ROOT}/{product}", f"{root}/{product}")
    os.remove(f"{root}/table_wine/dados_2015.csv")
    with open(f"{root}/table_wine/dados_2012.csv", "w") as f:
        f.write("Países,Quantidade (Kg),Valor (US$)\n")
    return root


def test_absent_and_empty_statements_are_told_apart(spark, hollow):
    presence = statement_presence(spark, hollow)
    assert presence.where("product = 'table_wine' AND year = 2012").first()["bytes"] == 36 and presence.count() == 31
    gone = spark.createDataFrame([("brandy",)], "product string")
    got = missing_statements(presence, scan_statements(spark, hollow), 2009, 2024)
    assert sorted(rows(got)) == [("table_wine", 2012, "empty"), ("table_wine", 2015, "absent")]
    more = missing_statements(presence, scan_statements(spark, hollow), 2023, products=gone)
    assert sorted(rows(more)) == [("brandy", 2023, "absent"), ("brandy", 2024, "absent"), ("table_wine", 2012, "empty")]


def test_listing_opens_no_file(spark, hollow):
    plan = statement_presence(spark, hollow)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<>", plan), plan


def test_statements_written_without_rows_are_empty_files(spark):
    df = spark.createDataFrame([("p", 2000, "x", "1", "2")], SCHEMA)
    keys = spark.createDataFrame([("p", 2000), ("p", 2002), ("q", 2000), ("q", 2000)], "product string, year int")
    root = write_statement_files(df, fresh("keys"), statements=keys)
    got = missing_statements(statement_presence(spark, root), scan_statements(spark, root), 2000, 2002)
    assert sorted(rows(got)) == [("p", 2001, "absent"), ("p", 2002, "empty"), ("q", 2000, "empty"), ("q", 2001, "absent"), ("q", 2002, "absent")]


def test_last_years_of_the_flat_layout_scan_their_files_only(spark, hollow):
    assert latest_years(spark, hollow, 3) == ([2022, 2023, 2024], ["fresh_grapes", "table_wine"])
    scan = scan_statements(spark, hollow, ["table_wine"], years=[2014, 2015, 2016])
    assert sorted(os.path.basename(f) for f in scan.inputFiles()) == ["dados_2014.csv", "dados_2016.csv"]
    n = len(last_n_years_of_files(spark, hollow, 3).inputFiles())
    assert n == 3 * 2
    for products in (None, ["table_wine"]):
        want = last_n_years(scan_statements(spark, hollow, products), 3)
        assert sorted(rows(last_n_years_of_files(spark, hollow, 3, products))) == sorted(rows(want))


def test_last_years_with_numbered_files_and_late_products(spark):
    df = spark.createDataFrame([("old", 2001, "x", "1", "2"), ("new", 2010, "y", "3", "4"), ("new", 2009, "y", "5", "6")], SCHEMA)
    root = write_statement_files(df, fresh("late"))
    os.rename(f"{root}/new/dados_2010.csv", f"{root}/new/dados_2010_1.csv")
    assert rows(last_n_years_of_files(spark, root, 2)) == [("y", 8.0, 10.0)]
    assert rows(last_n_years_of_files(spark, root, 2, ["old", "new"])) == [("y", 8.0, 10.0)]
    empty = write_statement_files(df.limit(0), fresh("late"), statements=df.select("product", "year"))
    assert rows(last_n_years_of_files(spark, empty, 2)) == [] == rows(totals_by_country(clean_statements(scan_statements(spark, empty))))


def test_the_time_of_a_file_follows_its_rows():
    base = tempfile.mkdtemp(prefix="adega-long-")
    n = 60_000
    batch = pa.RecordBatch.from_pydict({
        "product": ["p"] * n, "file": ["dados_2000.csv"] * n, "is_row": [True] * n, "c": ["c"] * n, "q": ["1"] * n, "v": ["2"] * n})
    before = time.process_time()
    StatementFilesWriter(f"{base}-root", f"file://{base}/staging", "UTF-8").write(iter([batch]))
    assert time.process_time() - before < 5  # adding up the held lines at each row took a minute
    assert sum(1 for _ in open(f"{base}/staging/p/dados_2000.csv", encoding="utf-8")) == n + 1
