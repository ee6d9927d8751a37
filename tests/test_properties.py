"""Property tests: each drawn example set is checked in one Spark job."""

import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adega.functions.numbers import parse_digits, parse_locale_number
from adega.operators.clean import split_line
from adega.sources.driver_tables import pt_br

INTS = st.lists(st.integers(min_value=0, max_value=2**63 - 1), min_size=1, max_size=200)
NAMES = st.lists(st.text(alphabet=st.sampled_from(list('abcÁçãõ ,"-()')), min_size=1, max_size=20)
                 .filter(lambda s: s.strip() == s and s.strip()), min_size=1, max_size=50)


@settings(max_examples=5, deadline=None)
@given(INTS)
def test_pt_br_text_parses_back(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = df.select(pt_br(F.col("v")).alias("t")).select(
        parse_locale_number("t").alias("a"), parse_digits("t").alias("b")).collect()
    for v, (a, b) in zip(values, got):
        assert a == float(v) and b == float(v)


@settings(max_examples=5, deadline=None)
@given(NAMES)
def test_quote_aware_split_recovers_csv_fields(spark, names):
    lines = []
    for name in names:
        buf = io.StringIO()
        csv.writer(buf, lineterminator="").writerow([name, "1.234", "5"])
        lines.append((buf.getvalue(),))
    got = split_line(spark.createDataFrame(lines, "raw_data string")).collect()
    assert [tuple(r) for r in got] == [(n, "1.234", "5") for n in names]


@settings(max_examples=3, deadline=None)
@given(NAMES)
def test_written_statement_files_scan_back(spark, names):
    import tempfile
    from adega.sources.statements import scan_lines, scan_statements
    from adega.sources.writers import write_statements
    src = spark.createDataFrame([("p", 2000, n, "1.234", "5") for n in names],
                                "product string, year int, country string, quantity_kg string, value_usd string")
    path = write_statements(src, tempfile.mkdtemp(prefix="adega-prop-") + "/out")
    back = scan_statements(spark, path, layout="hive")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in src.collect())
    lines = split_line(scan_lines(spark, path, layout="hive")).select("country").collect()
    assert sorted(r[0] for r in lines) == sorted(names)


@settings(max_examples=2, deadline=None)
@given(NAMES)
def test_flat_statement_files_scan_back(spark, names):
    import tempfile
    from adega.sources.statements import scan_lines, scan_statements
    from adega.sources.writers import write_statement_files
    src = spark.createDataFrame([("p", 2001, n, "7", "8") for n in names],
                                "product string, year int, country string, quantity_kg string, value_usd string")
    root = write_statement_files(src, tempfile.mkdtemp(prefix="adega-flatprop-") + "/files")
    back = scan_statements(spark, root)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in src.collect())
    fields = split_line(scan_lines(spark, root)).select("year", "country").collect()
    assert sorted(r[1] for r in fields) == sorted(names) and {r[0] for r in fields} == {2001}
