import os
import shutil
import tempfile

from pyspark.sql import functions as F

from adega.operators.coverage import union_all
from adega.sources.statements import scan_lines, scan_statements
from adega.sources.writers import write_statements
from tests.conftest import EXPORT_PRODUCTS, EXPORT_ROOT, IMPORT_PRODUCTS, IMPORT_ROOT, rows


def test_scan_counts_rows_of_every_file(spark):
    assert scan_statements(spark, EXPORT_ROOT, EXPORT_PRODUCTS).count() == 8272
    assert scan_statements(spark, IMPORT_ROOT, IMPORT_PRODUCTS).count() == 3280


def test_scan_path_columns(spark):
    df = scan_statements(spark, EXPORT_ROOT, ["table_wine"], flow="export")
    assert df.columns == ["product", "year", "country", "quantity_kg", "value_usd", "flow"]
    years = sorted(r[0] for r in df.select("year").distinct().collect())
    assert years == list(range(2009, 2025))
    assert rows(df.select("product").distinct()) == [("table_wine",)]
    assert rows(df.select("flow").distinct()) == [("export",)]


def test_scan_honours_quoted_commas_and_accents(spark):
    df = scan_statements(spark, EXPORT_ROOT, ["table_wine"]).filter("year = 2024")
    got = dict((c, (q, v)) for c, q, v in rows(df, "country", "quantity_kg", "value_usd"))
    assert got["Alemanha, República Democrática"] == ("6.666", "48.095")
    assert got["África do Sul"] == ("103", "1.783")
    assert got["Afeganistão"] == ("-", "-")
    assert got["Total"] == ("5.324.465", "8.751.275")


def test_brace_glob_scan_equals_union_fold(spark):
    one = scan_statements(spark, IMPORT_ROOT, IMPORT_PRODUCTS)
    fold = union_all([scan_statements(spark, IMPORT_ROOT, [p]) for p in IMPORT_PRODUCTS])
    assert sorted(rows(one)) == sorted(rows(fold))


def test_unmatched_file_name_gives_null_year(spark):
    root = tempfile.mkdtemp(prefix="adega-scan-")
    os.makedirs(f"{root}/table_wine")
    shutil.copy(f"{EXPORT_ROOT}/table_wine/dados_2024.csv", f"{root}/table_wine/notes.csv")
    df = scan_statements(spark, root, ["table_wine"])
    assert rows(df.select("year").distinct()) == [(None,)]


def test_scan_lines_keeps_whole_line(spark):
    df = scan_lines(spark, EXPORT_ROOT, ["table_wine"]).filter("year = 2024")
    lines = [r[0] for r in df.select("raw_data").collect()]
    assert len(lines) == 142  # header skipped
    assert '"Alemanha, República Democrática",6.666,48.095' in lines
    assert "Afeganistão,-,-" in lines


def test_scan_lines_latin1_reading_garbles_accents(spark):
    df = scan_lines(spark, EXPORT_ROOT, ["table_wine"], encoding="ISO-8859-1").filter("year = 2024")
    lines = [r[0] for r in df.select("raw_data").collect()]
    assert "Afeganistão,-,-" not in lines and "Argentina,21.015,167.696" in lines


def test_write_then_scan_hive_layout_roundtrip(spark):
    src = scan_statements(spark, IMPORT_ROOT, IMPORT_PRODUCTS)
    for fmt in ("csv", "parquet"):
        path = write_statements(src, tempfile.mkdtemp(prefix="adega-sink-") + "/out", fmt=fmt)
        back = scan_statements(spark, path, layout="hive", fmt=fmt)
        assert sorted(rows(back)) == sorted(rows(src))
        pruned = scan_statements(spark, path, ["table_wine"], layout="hive", fmt=fmt).filter(F.col("year") == 2024)
        assert pruned.count() == 70


def test_path_columns_survive_spaces_and_plus(spark):
    root = tempfile.mkdtemp(prefix="adega-names-")
    for name in ("vinho fino", "suco+uva"):
        os.makedirs(f"{root}/{name}")
        shutil.copy(f"{EXPORT_ROOT}/table_wine/dados_2024.csv", f"{root}/{name}/dados_2024.csv")
    df = scan_statements(spark, root)
    assert sorted(rows(df.select("product", "year").distinct())) == [("suco+uva", 2024), ("vinho fino", 2024)]


def test_write_statement_files_flat_layout_roundtrip(spark):
    from adega.sources.writers import write_statement_files
    src = scan_statements(spark, IMPORT_ROOT, IMPORT_PRODUCTS)
    root = write_statement_files(src, tempfile.mkdtemp(prefix="adega-flat-") + "/files")
    assert sorted(p for p in os.listdir(root) if not p.startswith("_")) == sorted(IMPORT_PRODUCTS)
    assert sorted(p for p in os.listdir(f"{root}/table_wine") if not p.startswith(".")) == \
        [f"dados_{y}.csv" for y in range(2009, 2025)]
    back = scan_statements(spark, root)
    assert sorted(rows(back)) == sorted(rows(src))


def test_product_names_are_taken_literally(spark):
    import pytest
    from adega.sources.writers import write_statement_files
    names = ["a,b", "c", "{d}", "e*", "[f]"]
    df = spark.createDataFrame([(n, 2000, "X", "1", "2") for n in names], "product string, year int, country string, quantity_kg string, value_usd string")
    root = write_statement_files(df, tempfile.mkdtemp(prefix="adega-names-") + "/files")
    for asked in (["a,b", "c"], ["{d}"], ["e*", "[f]"], names):
        assert sorted(r["product"] for r in scan_statements(spark, root, asked).collect()) == sorted(asked)
    for asked in (["nothing"], ["c", "nothing"]):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            scan_statements(spark, root, asked)


def test_flat_writer_refuses_what_the_layout_cannot_hold(spark):
    import pytest
    from adega.sources.writers import write_statement_files, write_statements
    schema = "product string, year int, country string, quantity_kg string, value_usd string"
    folder = tempfile.mkdtemp(prefix="adega-refuse-")
    for k, row in enumerate([("a/b", 2000, "X", "1", "2"), (None, 2000, "X", "1", "2"), ("a", None, "X", "1", "2"), ("a", 2000, "X\nY", "1", "2")]):
        with pytest.raises(Exception):
            write_statement_files(spark.createDataFrame([row], schema), f"{folder}/{k}")
    hive = write_statements(spark.createDataFrame([("a/b", 2000, " X ", "1", "2"), (None, 2000, "Y", "1", "2")], schema), f"{folder}/hive")
    assert sorted(rows(scan_statements(spark, hive, layout="hive"), "product", "country"), key=str) == sorted([("a/b", " X "), (None, "Y")], key=str)
    broken = spark.createDataFrame([("a", 2000, "X\nY", "1", "2")], schema)
    with pytest.raises(Exception, match="line break"):
        write_statements(broken, f"{folder}/hive2")
    lines = write_statements(broken, f"{folder}/hive3", line_breaks=True)
    assert rows(scan_statements(spark, lines, layout="hive", multi_line=True), "country") == [("X\nY",)]


def test_flat_writer_numbers_the_parts_of_a_large_statement(spark):
    import os
    from pyspark.sql import functions as F
    from adega.sources.writers import write_statement_files
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(60000).select(F.lit("p").alias("product"), F.lit(2000).alias("year"), F.concat(F.lit("C"), F.sha2(F.col("id").cast("string"), 256)).alias("country"),
                                       F.lit("1").alias("quantity_kg"), F.lit("2").alias("value_usd"))
        root = write_statement_files(df, tempfile.mkdtemp(prefix="adega-parts-") + "/files")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    names = [n for n in os.listdir(f"{root}/p") if n.endswith(".csv")]
    assert len(names) > 1 and "dados_2000_1.csv" in names and os.listdir(root) == ["p"]
    assert scan_statements(spark, root).groupBy("product", "year").count().collect()[0][2] == 60000
