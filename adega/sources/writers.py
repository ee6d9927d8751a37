"""Statement sinks: partitioned CSV or parquet, and flat statement files, that
:func:`scan_statements` reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adega.sources.statement_files import write_flat
from adega.sources.statements import COUNTRY, PRODUCT, QUANTITY, VALUE, YEAR


def _csv_rows(df: DataFrame, line_breaks: bool) -> DataFrame:
    """The statement columns; a line break inside a cell, which a line-by-line
    reader would take for a row's end, fails the job unless ``line_breaks``."""
    rows = df.select(PRODUCT, YEAR, COUNTRY, QUANTITY, VALUE)
    if line_breaks:
        return rows
    broken = F.col(COUNTRY).rlike(r"[\r\n]")
    message = F.concat(F.lit("line break in a country name (write with line_breaks=True, read with multi_line=True): "),
                       F.col(COUNTRY))
    return rows.withColumn(COUNTRY, F.when(broken, F.raise_error(message).cast("string")).otherwise(F.col(COUNTRY)))


def _csv_options(writer, encoding: str = "UTF-8"):
    return (writer.option("header", True).option("encoding", encoding).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


#: pieces a statement is dealt in
PIECES = 16


def _partitioned(rows: DataFrame, pieces: int):
    if pieces == 1:
        dealt = rows.hint("rebalance", PRODUCT, YEAR)
    else:
        piece = F.pmod(F.xxhash64(COUNTRY, QUANTITY, VALUE, F.spark_partition_id()), F.lit(pieces))
        dealt = rows.withColumn("_piece", piece).hint("rebalance", PRODUCT, YEAR, "_piece").drop("_piece")
    return dealt.sortWithinPartitions(PRODUCT, YEAR, COUNTRY).write.partitionBy(PRODUCT, YEAR)


def write_statements(df: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "csv",
                     line_breaks: bool = False, encoding: str = "UTF-8", pieces: int = PIECES) -> str:
    """Write ``product, year, country, quantity_kg, value_usd`` under
    ``path/product=<p>/year=<y>/``: CSV (``encoding``, header line) like the source
    files, or ``fmt='parquet'`` for a columnar copy that later scans prune by
    column and by row-group statistics.

    Partitioning by product and year gives one directory per statement, and a
    later year or product filter prunes directories instead of reading them.
    Rows are first rebalanced on (product, year, piece) (``REBALANCE`` hint), a
    row's piece being a hash of the row and of the task that read it: AQE merges
    small pieces into fewer tasks and splits large ones, without a sampling pass
    over the input.  AQE splits between the tasks that read the rows, so without
    pieces a task that reads nothing but one statement (a table that is already
    partitioned) would hand all its rows to one task to sort.  Rows that come mixed
    are split well enough with ``pieces=1``, in fewer files.

    Within each task rows are sorted by (product, year, country): the writer needs
    the partition order anyway, and the country order keeps each parquet row
    group to a narrow country range, so a country filter skips row groups.

    Blanks at the ends of cells are kept.  In CSV a country with a line break
    fails the write unless ``line_breaks`` (then read with ``multi_line=True``).
    """
    if fmt == "csv":
        _csv_options(_partitioned(_csv_rows(df, line_breaks), pieces).mode(mode), encoding).csv(path)
    else:
        _partitioned(df.select(PRODUCT, YEAR, COUNTRY, QUANTITY, VALUE), pieces).mode(mode).format(fmt).save(path)
    return path


def write_statement_files(df: DataFrame, root: str, line_breaks: bool = False, statements: DataFrame | None = None,
                          encoding: str = "UTF-8") -> str:
    """Write CSV files as ``root/<product>/dados_<year>.csv`` -- the layout the
    download step produces and ``scan_statements(layout='files')`` reads.

    A statement larger than the session's advisory partition size is written by several
    tasks as numbered files (``dados_<year>_<n>.csv``).  Tasks name and write their files, and one rename
    puts them all in place (see :mod:`adega.sources.statement_files`): ``root`` must be new or
    empty, and a job that fails leaves nothing there.  ``statements`` (``product,
    year``) get a file without rows if they have none.

    The layout has no place for a null product or year, or for a product whose name
    holds ``/``: such rows fail the write.  Blanks and line breaks are treated as in
    :func:`write_statements`.
    """
    root = root.rstrip("/")

    def named(rows: DataFrame) -> DataFrame:
        nowhere = F.col(PRODUCT).isNull() | F.col(YEAR).isNull() | F.col(PRODUCT).contains("/") | F.col(PRODUCT).isin("", ".", "..")
        message = F.concat(F.lit("no statement file for product "), F.coalesce(F.col(PRODUCT), F.lit("null")),
                           F.lit(", year "), F.coalesce(F.col(YEAR).cast("string"), F.lit("null")))
        return rows.withColumn(PRODUCT, F.when(nowhere, F.raise_error(message).cast("string")).otherwise(F.col(PRODUCT)))

    write_flat(named(_csv_rows(df, line_breaks)), root, None if statements is None else named(statements), encoding)
    return root
