from pyspark.sql import functions as F

from adega.operators.clean import (
    clean_statements, drop_totals, filter_country_like, filter_customs, filter_positive, require_rows, split_line)
from adega.sources.statements import scan_lines, scan_statements
from tests.conftest import EXPORT_PRODUCTS, EXPORT_ROOT, IMPORT_PRODUCTS, IMPORT_ROOT, rows
import pytest

EDGE = [
    ("Afeganistão", "-", "-"),
    ("Alemanha, República Democrática", "6.666", "48.095"),
    ("Argélia", "6", "87"),
    ("Bermudas", "0", "13"),
    ("Outros", "-", "-"),
    ("Total", "5.324.465", "8.751.275"),
]


def edge_frame(spark):
    return spark.createDataFrame([(2024, "p") + r for r in EDGE],
                                 "year int, product string, country string, quantity_kg string, value_usd string")


def test_missing_policies(spark):
    df = edge_frame(spark)
    drop = rows(clean_statements(df), "country", "quantity_kg", "value_usd")
    assert drop == [("Alemanha, República Democrática", 6666.0, 48095.0), ("Argélia", 6.0, 87.0),
                    ("Bermudas", 0.0, 13.0)]
    positive = rows(clean_statements(df, missing="positive"), "country")
    assert positive == [("Alemanha, República Democrática",), ("Argélia",)]
    keep = rows(clean_statements(df, missing="keep"), "country", "quantity_kg")
    assert ("Afeganistão", None) in keep and ("Outros", None) in keep and len(keep) == 5
    with_totals = rows(clean_statements(df, totals=True), "country")
    assert ("Total",) in with_totals


def test_drop_totals_is_exact_and_drops_null_country(spark):
    df = spark.createDataFrame([("Total",), ("total",), (None,), ("Totalidade",)], "country string")
    assert rows(drop_totals(df)) == [("total",), ("Totalidade",)]


def test_split_line_quote_aware_and_plain(spark):
    df = spark.createDataFrame([('"Alemanha, República Democrática",6.666,48.095',), ("Argélia ,6,87",),
                                ("Só,1",)], "raw_data string")
    aware = rows(split_line(df))
    assert aware == [("Alemanha, República Democrática", "6.666", "48.095"), ("Argélia", "6", "87"),
                     ("Só", "1", None)]
    plain = rows(split_line(df, quote_aware=False))
    assert plain[0] == ('"Alemanha', " República Democrática\"", "6.666")


def test_filters(spark):
    df = spark.createDataFrame([("Países Baixos", 1.0, 1.0), ("Países Baixos (Holanda)", 0.0, 5.0),
                                ("itália", None, 2.0)], "country string, quantity_kg double, value_usd double")
    assert rows(filter_country_like(df, "PAÍSES baixos"), "country") == [("Países Baixos",),
                                                                        ("Países Baixos (Holanda)",)]
    assert rows(filter_positive(df), "country") == [("Países Baixos",)]


def test_filter_customs_conjunction(spark):
    df = spark.createDataFrame([("Espanha", "Rio Grande do Sul", 48), ("Espanha", "Rio Grande do Sul", 12),
                                ("Espanha", "Bahia", 57), ("Argentina", "Rio Grande do Sul", 59)],
                               "country string, state string, group_code int")
    got = filter_customs(df, "Espanha", "Rio Grande do Sul", [48, 57, 58, 59])
    assert rows(got) == [("Espanha", "Rio Grande do Sul", 48)]
    assert filter_customs(df).count() == 4


def test_require_rows(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert require_rows(df) is df
    with pytest.raises(ValueError, match="nothing"):
        require_rows(df.filter("a > 1"), "nothing")


def test_invariant_rows_sum_to_total_in_every_file(spark):
    for root, products in ((EXPORT_ROOT, EXPORT_PRODUCTS), (IMPORT_ROOT, IMPORT_PRODUCTS)):
        typed = clean_statements(scan_statements(spark, root, products), missing="keep", totals=True)
        is_total = F.col("country") == "Total"
        check = typed.groupBy("product", "year").agg(
            F.sum(F.when(~is_total, F.col("quantity_kg"))).alias("q"),
            F.sum(F.when(~is_total, F.col("value_usd"))).alias("v"),
            F.max(F.when(is_total, F.col("quantity_kg"))).alias("tq"),
            F.max(F.when(is_total, F.col("value_usd"))).alias("tv"))
        assert check.count() == 16 * len(products)
        assert check.filter("q <=> tq AND v <=> tv").count() == check.count()


def test_cleaned_row_counts(spark):
    assert clean_statements(scan_statements(spark, EXPORT_ROOT, EXPORT_PRODUCTS)).count() == 2647
    assert clean_statements(scan_statements(spark, IMPORT_ROOT, IMPORT_PRODUCTS)).count() == 1145


def test_line_path_matches_csv_path_for_plain_names(spark):
    lines = split_line(scan_lines(spark, EXPORT_ROOT, ["table_wine"]))
    via_lines = clean_statements(lines, parse="digits")
    via_csv = clean_statements(scan_statements(spark, EXPORT_ROOT, ["table_wine"]))
    assert sorted(rows(via_lines, "year", "country", "quantity_kg", "value_usd")) == \
        sorted(rows(via_csv, "year", "country", "quantity_kg", "value_usd"))
