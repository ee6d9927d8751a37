import pytest

from adega.functions.numbers import parse_digits, parse_locale_number
from tests.conftest import rows


@pytest.mark.parametrize("text, expected", [
    ("6.666", 6666.0),             # thousands separator
    ("48.095", 48095.0),
    ("5.324.465", 5324465.0),      # several separators
    ("6", 6.0),                    # no separator
    ("0", 0.0),
    ("-", None),                   # missing mark
    ("", None),
    (None, None),
    ("abc", None),
])
def test_parse_locale_number(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert rows(df.select(parse_locale_number("t"))) == [(expected,)]


def test_parse_locale_number_with_decimal_comma(spark):
    df = spark.createDataFrame([("1.234,5",), ("48.095",), ("0,25",)], "t string")
    assert rows(df.select(parse_locale_number("t", ".", ","))) == [(1234.5,), (48095.0,), (0.25,)]


@pytest.mark.parametrize("text, expected", [
    ("1.783", 1783.0), (" 12,5 ", 12.5), ("-", None), ("", None), ("US$ 1.234", 1234.0), (None, None),
])
def test_parse_digits(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert rows(df.select(parse_digits("t"))) == [(expected,)]


def test_parse_is_ansi_safe(spark):
    # ANSI mode is on: a plain cast of '-' would raise; the parsers never do
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = spark.createDataFrame([("-",), ("x.y",)], "t string")
    assert rows(df.select(parse_locale_number("t").alias("a"), parse_digits("t").alias("b"))) == \
        [(None, None), (None, None)]


def test_decimal_measures(spark):
    from decimal import Decimal
    from adega.operators.clean import clean_statements
    df = spark.createDataFrame([("p", 2000, "A", "9.007.199.254.740.993", "1.234,5"), ("p", 2000, "B", "1", "-")],
                               "product string, year int, country string, quantity_kg string, value_usd string")
    typed = clean_statements(df, missing="keep", decimal=",", dtype="decimal(20,2)")
    assert dict(typed.dtypes)["quantity_kg"] == "decimal(20,2)"
    got = rows(typed.agg({"quantity_kg": "sum"}))
    assert got == [(Decimal("9007199254740994.00"),)]  # exact beyond 2^53
    assert rows(typed.filter("country = 'A'"), "value_usd") == [(Decimal("1234.50"),)]


def test_the_missing_mark_is_not_cast(spark):
    # a failed cast raises and catches an exception per row
    df = spark.createDataFrame([("-",), ("1.5",), (" - ",), ("--",), ("-7",)], "t string")
    parsed = df.select(parse_locale_number("t").alias("a"), parse_digits("t").alias("b"))
    assert rows(parsed) == [(None, None), (15.0, 15.0), (None, None), (None, None), (-7.0, 7.0)]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("= -)") == 2
