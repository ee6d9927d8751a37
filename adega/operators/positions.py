"""Row numbers of a global order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adega.session import scratch_path

#: monotonically_increasing_id: the partition's number above these bits, the row's below
_ROW_BITS = 33


def with_positions(df: DataFrame, *order: Column | str, name: str = "position", first: int = 0) -> DataFrame:
    """``df`` with the position (from ``first``) of each row in the order.

    Rows are range-sorted by the order and written to the shared folder with their
    place in their range; a range's offset is the number of rows in the ranges before it, one
    row per range.  ``order`` should be total: rows that tie are numbered in any order,
    and all rows with one key lie in one range.  The sort runs when this function is called."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    spark = df.sparkSession
    path = scratch_path(spark, "positions")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    part, row = F.shiftright("_place", _ROW_BITS), F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    # as many rows as ranges: the planner broadcasts them
    met = placed.join(starts, part == F.col("_part"))
    return met.select(*df.columns, (F.col("_start") + row + first).alias(name))
