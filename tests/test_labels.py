import pytest

from adega.functions import labels as L
from tests.conftest import rows


def label_of(spark, fn, value):
    df = spark.createDataFrame([(value,)], "v double")
    return rows(df.select(fn("v")))[0][0]


@pytest.mark.parametrize("value, expected", [
    (999.0, "$999.00"), (1000.0, "$1.0K"), (999999.0, "$1000.0K"), (1e6, "$1.00M"),
    (2500000.0, "$2.50M"), (1e9, "$1.00B"), (1234567890.0, "$1.23B"), (1250.0, "$1.2K"), (1350.0, "$1.4K"),
    (0.0, "$0.00"), (None, None),
])
def test_label_currency(spark, value, expected):
    assert label_of(spark, L.label_currency, value) == expected


@pytest.mark.parametrize("value, expected", [
    (999.0, "999 Kg"), (1000.0, "1.0K Kg"), (999999.0, "1000.0K Kg"), (1e6, "1.00M Kg"), (2.5, "2 Kg"),
    (3.5, "4 Kg"), (1e9, "1000.00M Kg"),
])
def test_label_quantity(spark, value, expected):
    assert label_of(spark, L.label_quantity, value) == expected


@pytest.mark.parametrize("value, expected", [
    (2500000.0, "$2M"), (3500000.0, "$4M"), (999999.0, "$1M"), (400000.0, "$0M"), (1e9, "$1.0B"),
    (1234567890123.0, "$1,234.6B"), (987654321.0, "$988M"), (12345678901.0, "$12.3B"),
])
def test_label_value_millions(spark, value, expected):
    assert label_of(spark, L.label_value_millions, value) == expected


@pytest.mark.parametrize("value, expected", [
    (2500000.0, "2M Kg"), (1e9, "1.0B Kg"), (1499999999.0, "1.5B Kg"), (987654321.0, "988M Kg"),
])
def test_label_quantity_millions(spark, value, expected):
    assert label_of(spark, L.label_quantity_millions, value) == expected


@pytest.mark.parametrize("value, expected", [(1234567890123.0, "$1234.6B"), (25e6, "$25M")])
def test_label_axis_millions(spark, value, expected):
    assert label_of(spark, L.label_axis_millions, value) == expected


def test_label_grouped(spark):
    df = spark.createDataFrame([(1234567.125,)], "v double")
    got = rows(df.select(*[L.label_grouped("v", s) for s in ("value_table", "quantity_table", "value_bar",
                                                             "unit_price")]))
    assert got == [("US$ 1,234,567.12", "1,234,567 Kg", "$1,234,567", "US$ 1234567.12")]


def test_label_for_picks_by_name(spark):
    df = spark.createDataFrame([(2500000.0, 2500000.0)], "value_usd double, quantity_kg double")
    assert rows(df.select(L.label_for("value_usd"), L.label_for("quantity_kg"),
                          L.label_for("value_usd", "millions"), L.label_for("quantity_kg", "millions"))) == \
        [("$2.50M", "2.50M Kg", "$2M", "2M Kg")]


@pytest.mark.parametrize("value", [1150.0, 2450.0, 1015000.0, 2675000.0, 1250.0, 0.125, 2.675, 1.005, 999.995, 0.5, 1.5, 2.5, 1e15 + 50,
                                   4503599627370497.5, 123456789.0, 1005000000.0, 1e9 + 5e6, 49.999999999999996])
def test_labels_round_as_the_double_quotient_does(spark, value):
    """Ties and near ties against Python's formatter on the same quotient."""
    def tier(tiers):
        return next((d, n, f) for bound, d, n, f in tiers if bound is None or value >= bound)

    for fn, tiers in ((L.label_currency, L.CURRENCY_TIERS), (L.label_quantity, L.QUANTITY_TIERS),
                      (L.label_value_millions, L.VALUE_MILLIONS_TIERS), (L.label_axis_millions, L.AXIS_MILLIONS_TIERS)):
        divisor, digits, fmt = tier(tiers)
        number = f"{value / divisor:,.{digits}f}" if "," in fmt else f"{value / divisor:.{digits}f}"
        assert label_of(spark, fn, value) == fmt.replace(f"%,.{digits}f", number).replace(f"%.{digits}f", number)
