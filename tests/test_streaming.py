import os
import shutil
import tempfile

from adega.operators.clean import clean_statements
from adega.sources.statements import scan_statements
from adega.streaming import ingest_statement_files
from tests.conftest import EXPORT_ROOT, rows


def _copy(landing, product, year):
    os.makedirs(f"{landing}/{product}", exist_ok=True)
    shutil.copy(f"{EXPORT_ROOT}/{product}/dados_{year}.csv", f"{landing}/{product}/dados_{year}.csv")


def test_incremental_ingest_is_exactly_once(spark):
    base = tempfile.mkdtemp(prefix="adega-stream-")
    landing, target, checkpoint = f"{base}/landing", f"{base}/facts", f"{base}/checkpoint"
    _copy(landing, "table_wine", 2023)
    _copy(landing, "table_wine", 2024)
    ingest_statement_files(spark, landing, target, checkpoint=checkpoint).awaitTermination()
    first = spark.read.parquet(target)
    expected = clean_statements(scan_statements(spark, landing))
    assert first.count() == expected.count() > 0

    _copy(landing, "grape_juice", 2024)  # a new file arrives
    ingest_statement_files(spark, landing, target, checkpoint=checkpoint).awaitTermination()
    second = spark.read.parquet(target)
    expected = clean_statements(scan_statements(spark, landing))
    assert second.count() == expected.count()
    assert sorted(rows(second, "product", "year", "country", "quantity_kg", "value_usd")) == \
        sorted(rows(expected, "product", "year", "country", "quantity_kg", "value_usd"))

    ingest_statement_files(spark, landing, target, checkpoint=checkpoint).awaitTermination()  # nothing new
    assert spark.read.parquet(target).count() == expected.count()


def test_default_checkpoint_continues_where_the_last_run_stopped(spark):
    base = tempfile.mkdtemp(prefix="adega-stream-")
    landing, target = f"{base}/landing", f"{base}/facts"
    for year in (2023, 2024):
        _copy(landing, "table_wine", year)
        ingest_statement_files(spark, landing, target).awaitTermination()
        assert spark.read.parquet(target).count() == clean_statements(scan_statements(spark, landing)).count()
