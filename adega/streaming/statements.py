"""Statement files arriving over time -> cleaned facts table, exactly once.

Statement files land one per (product, year) in a folder (the download step
writes them there).  Rather than rescanning the folder for every report, a
streaming query picks up only the files it has not seen (file-source log in
the checkpoint), cleans them with the same functions as the batch scan and
appends them to a parquet facts table partitioned by product and year (file
sink: exactly-once, even if the job is restarted or executors are lost).
``trigger(availableNow=True)`` processes the backlog and stops, so it can run
as a scheduled batch job.

Spark's streaming file source cannot expand brace globs, so the stream watches
``<root>/*/*.csv`` and products are kept with a filter on the path column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adega.operators.clean import clean_statements
from adega.sources.statements import (
    COUNTRY, FILE_HEADER, FILE_SCHEMA, FLOW, PRODUCT, QUANTITY, VALUE, YEAR, product_from_path, year_from_path)


def stream_statements(spark: SparkSession, root: str, products: Sequence[str] | None = None, *,
                      flow: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming counterpart of ``scan_statements(layout='files')``: text
    statements ``product, year, country, quantity_kg, value_usd`` (+ ``flow``)."""
    reader = spark.readStream.schema(FILE_SCHEMA).option("header", True).option("escape", '"')
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(f"{root.rstrip('/')}/*/*.csv")
    df = raw.select(product_from_path().alias(PRODUCT), year_from_path().alias(YEAR),
                    F.col(f"`{FILE_HEADER[0]}`").alias(COUNTRY), F.col(f"`{FILE_HEADER[1]}`").alias(QUANTITY),
                    F.col(f"`{FILE_HEADER[2]}`").alias(VALUE))
    if products:
        df = df.filter(F.col(PRODUCT).isin(list(products)))
    return df.withColumn(FLOW, F.lit(flow)) if flow else df


def ingest_statement_files(spark: SparkSession, root: str, target: str, *,
                           products: Sequence[str] | None = None, flow: str | None = None,
                           checkpoint: str | None = None, missing: str = "drop",
                           available_now: bool = True) -> StreamingQuery:
    """Start the ingest query: new statement files under ``root`` -> cleaned
    facts appended to the parquet table at ``target``.  The checkpoint
    defaults to the folder ``<target>-checkpoint`` beside the table, the same on
    every run, so a later run continues where the previous one stopped."""
    facts = clean_statements(stream_statements(spark, root, products, flow=flow), missing=missing)
    writer = (facts.writeStream.format("parquet")
              .option("checkpointLocation", checkpoint or f"{target.rstrip('/')}-checkpoint")
              .partitionBy(PRODUCT, YEAR)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(target)
