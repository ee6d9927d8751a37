"""Order-independent sums, positions of a global order, accounts of unreadable cells."""

import math
import random
import struct
from decimal import Decimal

from pyspark.sql import Observation
from pyspark.sql import functions as F

from adega.functions.sums import exact_sum
from adega.operators.clean import clean_statements, unreadable_cells
from adega.operators.positions import with_positions
from adega.operators.totals import totals_by_country, totals_by_product_year, totals_by_year, totals_by_year_country, value_by_year_country
from tests.conftest import rows


def total(spark, values, partitions=1):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(partitions)
    return df.agg(exact_sum("v").alias("v")).first()[0]


def test_shuffled_rows_give_equal_bits(spark):
    rng = random.Random(1)
    wholes = [float(rng.randint(-2 ** 52, 2 ** 52)) for _ in range(3000)]
    cents = [rng.randint(0, 10 ** 9) / 100 for _ in range(3000)]
    for values, want in ((wholes, float(sum(map(int, wholes)))), (cents, float(sum(Decimal(f"{c:.2f}") for c in cents)))):
        seen = set()
        for parts in (1, 3, 7):
            rng.shuffle(values)
            seen.add(struct.pack("<d", total(spark, values, parts)))
        assert seen == {struct.pack("<d", want)}
    assert total(spark, [0.1] * 10) == 1.0 and total(spark, [-0.1] * 10 + [2.0 ** 52] + [1.0]) == 2.0 ** 52


def test_totals_beyond_2_53_and_odd_values(spark):
    big = [float(2 ** 52 + 1)] * 2001  # exact in 63 bits, not in doubles added one by one
    assert total(spark, big) == float(2001 * (2 ** 52 + 1))
    assert total(spark, []) is None and total(spark, [None, None]) is None and total(spark, [None, 2.5]) == 2.5
    assert total(spark, [math.inf, 1.0]) == math.inf and math.isnan(total(spark, [math.nan, 1.0])) and total(spark, [1e300, 1.0]) == 1e300
    assert total(spark, [0.25, -0.75]) == -0.5 and total(spark, [-0.0]) == 0.0


def test_every_total_uses_them(spark):
    rng = random.Random(2)
    data = [("p", 2000 + k % 2, "c", v, v) for k, v in enumerate(rng.randint(0, 10 ** 6) / 10 for _ in range(500))]
    schema = "product string, year int, country string, quantity_kg double, value_usd double"
    totals = (totals_by_country, totals_by_year_country, totals_by_year, totals_by_product_year, value_by_year_country)
    first = [sorted(rows(t(spark.createDataFrame(data, schema)))) for t in totals]
    for _ in range(2):
        rng.shuffle(data)
        assert [sorted(rows(t(spark.createDataFrame(data, schema).repartition(3)))) for t in totals] == first
    exact = spark.createDataFrame(data, schema).select("country", *[F.col(c).cast("decimal(20,2)").alias(c) for c in ("quantity_kg", "value_usd")])
    assert dict(totals_by_country(exact).dtypes)["value_usd"].startswith("decimal")


def test_positions_follow_the_order_over_many_ranges(spark):
    rng = random.Random(3)
    values = [rng.choice([None, rng.random(), 0.5]) for _ in range(5000)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double").repartition(5)
    got = with_positions(df, F.desc_nulls_last("v"), "k", first=1)
    want = sorted(range(5000), key=lambda k: (values[k] is None, -(values[k] or 0), k))
    assert [r["k"] for r in got.orderBy("position").collect()] == want
    assert sorted(r["position"] for r in got.collect()) == list(range(1, 5001))
    assert with_positions(df.limit(0), "k").count() == 0 and rows(with_positions(df.where("k = 7"), "k"), "k", "position") == [(7, 0)]


SPOILT = [("p", 2000, "a", "12x", "1"), ("p", 2000, "b", "-", "1.000"), ("p", 2000, "c", "", None), ("p", 2001, "d", "12x", "n/d"),
          ("p", 2001, "Total", "??", "5"), ("p", 2001, "e", " - ", "7"), ("p", 2001, "f", "3", "4")]
TEXT = "product string, year int, country string, quantity_kg string, value_usd string"


def test_unreadable_numbers_are_counted_with_the_facts(spark):
    seen = Observation()
    facts = clean_statements(spark.createDataFrame(SPOILT, TEXT), seen=seen)
    assert rows(facts, "country") == [("f",)]
    assert seen.get == {"rows": 6, "unreadable_quantity_kg": 2, "unreadable_value_usd": 1}
    kept = Observation()
    assert clean_statements(spark.createDataFrame(SPOILT, TEXT), missing="keep", totals=True, seen=kept).count() == 7
    assert kept.get == {"rows": 7, "unreadable_quantity_kg": 3, "unreadable_value_usd": 1}


def test_unreadable_cells_are_listed(spark):
    got = sorted(rows(unreadable_cells(spark.createDataFrame(SPOILT, TEXT))))
    assert got == [("p", 2000, "quantity_kg", "12x", 1), ("p", 2001, "quantity_kg", "12x", 1), ("p", 2001, "quantity_kg", "??", 1), ("p", 2001, "value_usd", "n/d", 1)]
    digits = sorted(rows(unreadable_cells(spark.createDataFrame(SPOILT, TEXT), parse="digits")))
    assert digits == [("p", 2001, "quantity_kg", "??", 1), ("p", 2001, "value_usd", "n/d", 1)]  # digits are picked out of 12x
