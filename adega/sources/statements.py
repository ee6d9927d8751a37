"""Scans of trade-statement files.

A statement is one CSV per (flow, product, year) with three text columns
(country, quantity in kg, value in US$).  Two on-disk layouts are read:

* ``files`` -- ``<root>/<product>/dados_<year>.csv`` (or numbered parts of a large
  statement, ``dados_<year>_<n>.csv``): product and year live only in the path, so they are recovered from ``_metadata.file_path``;
* ``hive``  -- ``<root>/product=<p>/year=<y>/part-*.csv`` as written by
  :func:`adega.sources.writers.write_statements`; Spark's partition discovery
  supplies both columns and a filter on them prunes whole directories.

All products of a root are read by **one** scan over a list of paths instead of a
union of per-product scans, so Catalyst plans one file listing and one set of
splits, and later filters are pushed into that single scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# ---------------------------------------------------------------------------
# Fixed values of the statement files.
# ---------------------------------------------------------------------------
FILE_HEADER = ("Países", "Quantidade (Kg)", "Valor (US$)")
YEAR_FILE_PATTERN = r"dados_(\d{4})(?:_\d+)?\.csv"
MISSING_MARK = "-"
TOTAL_LABEL = "Total"
# ---------------------------------------------------------------------------

COUNTRY, QUANTITY, VALUE, YEAR, PRODUCT, FLOW = (
    "country", "quantity_kg", "value_usd", "year", "product", "flow")

FILE_SCHEMA = StructType([StructField(name, StringType(), True) for name in FILE_HEADER])
STATEMENT_SCHEMA = StructType([
    StructField(COUNTRY, StringType(), True),
    StructField(QUANTITY, StringType(), True),
    StructField(VALUE, StringType(), True),
])
LINE_SCHEMA = StructType([StructField("raw_data", StringType(), True)])


def product_paths(root: str, products: Sequence[str] | None, leaf: str) -> list[str]:
    """One path per product, names taken literally (glob characters escaped); a
    product without a folder fails the scan, alone or in a list."""
    root = root.rstrip("/")
    if not products:
        return [f"{root}/*/{leaf}"]
    return [f"{root}/{re.sub(r'([][{}*?,^])', r'\\\1', p)}/{leaf}" for p in dict.fromkeys(products)]


def _files_of(years: Sequence[int] | None) -> str:
    """Glob of a product's statement files, of all years or of some."""
    if years is None:
        return "*.csv"
    return "{" + ",".join(f"dados_{y:04d}.csv,dados_{y:04d}_*.csv" for y in years) + "}"


def _decoded(text: Column) -> Column:
    """URI escapes decoded; a literal ``+`` is kept (escaped first, because URL
    decoding would turn it into a space)."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _path_parts() -> tuple[Column, Column]:
    """(folder name, file name) of the row's file: split once, then only the two
    short components are handled per row, never the whole path."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return F.element_at(parts, -2), F.element_at(parts, -1)


def year_from_path(path: Column | None = None, pattern: str = YEAR_FILE_PATTERN) -> Column:
    """Year taken from the file name (``dados_2024.csv`` -> 2024); null when the
    name does not match (no error under ANSI mode).  ``path`` may be a full path
    or just the file name."""
    name = _path_parts()[1] if path is None else path
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).try_cast("int")


def product_from_path(path: Column | None = None) -> Column:
    """Product = name of the directory holding the file."""
    if path is None:
        return _decoded(_path_parts()[0])
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _with_flow(df: DataFrame, flow: str | None) -> DataFrame:
    return df.withColumn(FLOW, F.lit(flow)) if flow else df


def scan_statements(spark: SparkSession, root: str, products: Sequence[str] | None = None, *,
                    flow: str | None = None, layout: str = "files",
                    encoding: str = "UTF-8", fmt: str = "csv", multi_line: bool = False,
                    years: Sequence[int] | None = None) -> DataFrame:
    """Read statement CSVs into ``product, year, country, quantity_kg, value_usd``
    (measures still text; see :func:`adega.operators.clean.clean_statements`).

    The schema is fixed (no inference pass over the files); quoted country names
    that contain commas are honoured by the CSV reader.  ``fmt='parquet'``
    reads a columnar copy in the ``hive`` layout.  ``multi_line`` reads quoted
    fields with line breaks (files are then not split, so it is off by default).
    ``years`` reads the statements of these years only: in the flat layout the other
    years' files aren't listed as input, in the hive layout their folders are pruned.
    """
    reader = (spark.read.option("header", True).option("encoding", encoding)
              .option("escape", '"')  # RFC 4180: a quote inside a quoted field is doubled
              .option("mode", "PERMISSIVE").option("multiLine", multi_line)
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if layout == "hive":
        schema = StructType(STATEMENT_SCHEMA.fields + [
            StructField(PRODUCT, StringType(), True), StructField(YEAR, IntegerType(), True)])
        # the root itself, not a glob: partition discovery finds product=/year=
        # folders and a product list becomes a partition filter (directory pruning)
        if fmt == "csv":
            df = reader.schema(schema).csv(root)
        else:
            df = spark.read.schema(schema).format(fmt).load(root)
        if products:
            df = df.filter(F.col(PRODUCT).isin(list(products)))
        if years is not None:
            df = df.filter(F.col(YEAR).isin(list(years)))
        df = df.select(PRODUCT, YEAR, COUNTRY, QUANTITY, VALUE)
    elif layout == "files":
        raw = reader.schema(FILE_SCHEMA).csv(product_paths(root, products, _files_of(years)))
        df = raw.select(
            product_from_path().alias(PRODUCT),
            year_from_path().alias(YEAR),
            F.col(f"`{FILE_HEADER[0]}`").alias(COUNTRY),
            F.col(f"`{FILE_HEADER[1]}`").alias(QUANTITY),
            F.col(f"`{FILE_HEADER[2]}`").alias(VALUE),
        )
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return _with_flow(df, flow)


def scan_lines(spark: SparkSession, root: str, products: Sequence[str] | None = None, *,
               encoding: str = "UTF-8", flow: str | None = None, layout: str = "files") -> DataFrame:
    """Each data line of the statement files as one string ``raw_data`` (header
    skipped, quotes kept verbatim), with ``product`` and ``year`` from the path
    (``layout='files'``) or from hive partitions (``layout='hive'``).

    ``encoding`` defaults to UTF-8, which is what the files are; pass
    ``"ISO-8859-1"`` to reproduce a Latin-1 reading.
    """
    reader = (spark.read.option("header", True).option("sep", "\n")
              .option("quote", "").option("encoding", encoding))
    if layout == "hive":
        schema = StructType(LINE_SCHEMA.fields + [
            StructField(PRODUCT, StringType(), True), StructField(YEAR, IntegerType(), True)])
        raw = reader.schema(schema).csv(root)
        if products:
            raw = raw.filter(F.col(PRODUCT).isin(list(products)))
        df = raw.select(PRODUCT, YEAR, "raw_data")
    elif layout == "files":
        raw = reader.schema(LINE_SCHEMA).csv(product_paths(root, products, "*.csv"))
        df = raw.select(product_from_path().alias(PRODUCT), year_from_path().alias(YEAR), "raw_data")
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return _with_flow(df, flow)


def as_lines(statements: DataFrame) -> DataFrame:
    """Statement columns as raw lines ``product, year, raw_data``, the country
    quoted where it holds a comma or a quote (for reports that read lines)."""
    quoted = F.concat(F.lit('"'), F.replace(F.col(COUNTRY), F.lit('"'), F.lit('""')), F.lit('"'))
    country = F.when(F.col(COUNTRY).rlike('[",]'), quoted).otherwise(F.col(COUNTRY))
    cells = [F.coalesce(c, F.lit("")) for c in (country, F.col(QUANTITY), F.col(VALUE))]
    return statements.select(PRODUCT, YEAR, F.concat_ws(",", *cells).alias("raw_data"))
