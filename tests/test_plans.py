"""The physical plans keep their at-scale properties (checked on the smallest tables)."""

import re

import pytest

from adega.plans import catalog
from tests.conftest import SMOKE_DIR


def plan(spark, name):
    df = catalog.queries()[name](spark, SMOKE_DIR)
    df.write.format("noop").mode("overwrite").save()
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_top30_is_take_ordered(spark):
    p = plan(spark, "top30_value")
    assert "TakeOrderedAndProject(limit=30" in p
    assert p.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["top15_value_per_year", "top15_quantity_per_year", "chart_rank_table"])
def test_per_year_top_k_has_partial_window_group_limit(spark, name):
    p = plan(spark, name)
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p


def test_country_filter_reaches_parquet(spark):
    assert "EqualTo(country,NATION_7)" in plan(spark, "country_series")


def test_year_and_product_prune_partitions(spark):
    p = plan(spark, "rank_year")
    assert re.search(r"PartitionFilters: \[[^\]]*\(year = 1998\)", p)
    assert re.search(r"PartitionFilters: \[[^\]]*\(product = ECONOMY\)", p)


def test_latest_year_bound_prunes_partitions(spark):
    assert re.search(r"PartitionFilters: \[[^\]]*\(year > \(Subquery", plan(spark, "last_n_years"))


def test_top_country_series_scans_once(spark):
    p = plan(spark, "top10_series")
    assert p.count("FileScan") == 1 and "BroadcastExchange" not in p


def test_totals_aggregate_map_side(spark):
    p = plan(spark, "totals_by_country")
    assert "partial_sum" in p and p.count("Exchange hashpartitioning") == 1


def test_page_extraction_runs_in_arrow_batches_without_shuffle_by_key(spark):
    p = plan(spark, "page_list_rows")
    assert "MapInPandas" in p or "MapInArrow" in p
    assert "Exchange hashpartitioning" not in p


@pytest.mark.parametrize("name", ["totals_by_country", "country_products_by_year"])
def test_each_measure_is_parsed_once(spark, name):
    p = plan(spark, name).split("Initial Plan")[0]
    assert p.count("try_cast") == 2 or p.lower().count("cast(") <= 4, p


def test_flat_writer_rebalances_instead_of_one_task_per_statement():
    import inspect
    from adega.sources import writers
    assert "repartition(" not in inspect.getsource(writers) and 'hint("rebalance"' in inspect.getsource(writers)


def test_round_trips_are_written_once(spark):
    from adega.sources import materialize
    for name in ("csv_roundtrip_totals", "flat_files_roundtrip_totals", "lines_roundtrip_totals"):
        catalog.queries()[name](spark, SMOKE_DIR)
    import os
    from adega.session import scratch_dir
    folder = scratch_dir(spark).removeprefix("file:")
    before = sorted(os.listdir(folder))
    for name in ("csv_roundtrip_totals", "flat_files_roundtrip_totals", "lines_roundtrip_totals"):
        catalog.queries()[name](spark, SMOKE_DIR)
    assert sorted(os.listdir(folder)) == before and materialize
