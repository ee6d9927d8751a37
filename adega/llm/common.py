"""Small helpers shared by the operators: tables, shared storage, expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adega.session import scratch_path

#: the characters that separate words: space and tab to carriage return
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends at files
    that every executor can read again."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`stored`, with the folder, so that the caller can remove it."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Removes a stored table that nothing refers to any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def constant_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table as one JSON literal of the plan: no file, no Python worker."""
    names = [part.strip().split(" ", 1)[0] for part in schema.split(", ")]
    fields = ", ".join(": ".join(part.strip().split(" ", 1)) for part in schema.split(", "))
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def one_by_one(batches: Iterator) -> Iterator:
    """Batches of a Python stage; what Arrow's pool holds of earlier ones goes back to the
    system after each, so that a waiting worker doesn't keep it."""
    for batch in batches:
        yield batch
        del batch
        arrow_trimmed()


def arrow_trimmed() -> None:
    pa.default_memory_pool().release_unused()


_KEPT: dict = {}


def kept_by_process(name, make):
    """What ``make()`` built, kept for the next task of this Python worker.  A worker
    keeps one such thing: a stage that asks for another, or for none (``name`` None), ends the
    last one's, so that memory doesn't add up over the stages of a pipeline."""
    if name not in _KEPT:
        _KEPT.clear()
        if name is not None:
            _KEPT[name] = make()
    return _KEPT.get(name)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often
    ``body`` uses it (the optimiser may otherwise copy it to each use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept.  A text without multi-byte
    characters takes the built-in ``lower``, which then changes nothing else."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def hash128(value: Column, first: str, second: str) -> list[Column]:
    """Two independent 64-bit hashes of a value as columns (null and the empty
    string differ only by the caller's choice)."""
    return [F.xxhash64(value).alias(first), F.xxhash64(F.lit(7_046_029), value).alias(second)]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (column
    names are compared without case, as Spark resolves them)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
