"""The flat layout ``<root>/<product>/dados_<year>.csv``: sink and file listing.

The sink is a Spark data source.  Rows are dealt so that each file is one task's;
tasks name their files and write them through ``pyarrow.fs``, straight to the shared
file system, under a private folder beside the root.  The job's commit is one rename of
that folder to the root: readers see all files or none, a failed job removes the
folder, and the driver does no work per file.

The listing says which statement files are there, and how long they are, without
reading them; it tells an absent statement from an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from adega.operators.coverage import missing_periods
from adega.sources.statements import COUNTRY, PRODUCT, QUANTITY, VALUE, YEAR, product_from_path, product_paths, year_from_path

#: file systems whose folders are renamed in one step
RENAMING = ("file", "hdfs", "viewfs", "abfs", "abfss")
#: characters of a file that are handed to the file system at a time
CHUNK = 1 << 20


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a full URI."""
    scheme, _, rest = uri.partition(":")
    if scheme not in RENAMING:
        raise ValueError(f"flat statement files are committed by a rename, which {scheme} doesn't have: use write_statements")
    return pafs.FileSystem.from_uri(f"{scheme}:///{rest.lstrip('/')}" if scheme == "file" else uri)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as the session's file systems resolve it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def csv_cell(text: str | None) -> str:
    """A CSV field: null is empty, the empty string is quoted, so are separators,
    quotes (doubled) and line breaks."""
    if text is None:
        return ""
    if not text or "," in text or '"' in text or "\n" in text or "\r" in text:
        return '"' + text.replace('"', '""') + '"'
    return text


@dataclass
class Written(WriterCommitMessage):
    files: int


class StatementFilesWriter(DataSourceArrowWriter):
    def __init__(self, root: str, staging: str, encoding: str):
        self.root, self.staging, self.encoding = root, staging, encoding

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Rows sorted by file; a file is written under a private name and then takes
        its own, so that a task that runs twice leaves one whole file."""
        system, base = file_system(self.staging)
        now, out, held, size, private, files = None, None, [], 0, "", 0

        def flush() -> None:
            nonlocal size
            if held:
                out.write("".join(held).encode(self.encoding))
                held.clear()
                size = 0

        def close() -> None:
            if now is not None:
                flush()
                out.close()
                system.move(private, f"{base}/{now[0]}/{now[1]}")

        for batch in batches:
            for product, name, is_row, *cells in zip(*(batch.column(c).to_pylist() for c in ("product", "file", "is_row", "c", "q", "v"))):
                if (product, name) != now:
                    close()
                    now, files = (product, name), files + 1
                    system.create_dir(f"{base}/{product}", recursive=True)
                    private = f"{base}/{product}/_{uuid.uuid4().hex}"
                    out = system.open_output_stream(private)
                    held.append(f"{COUNTRY},{QUANTITY},{VALUE}\n")
                if is_row:
                    held.append(line := ",".join(map(csv_cell, cells)) + "\n")
                    size += len(line)
                if size > CHUNK:
                    flush()
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = file_system(self.staging)
        system.create_dir(base, recursive=True)  # no rows, no files
        for info in system.get_file_info(pafs.FileSelector(base)):
            for left in system.get_file_info(pafs.FileSelector(info.path)) if info.type == pafs.FileType.Directory else []:
                if left.base_name.startswith("_"):  # of a task that was lost
                    system.delete_file(left.path)
        system.move(base, file_system(self.root)[1])

    def abort(self, messages: list[Written | None]) -> None:
        system, base = file_system(self.staging)
        if system.get_file_info(base).type != pafs.FileType.NotFound:
            system.delete_dir(base)


class StatementFiles(DataSource):
    """Write-only source: options ``root``, ``staging`` (full URIs) and ``encoding``."""

    @classmethod
    def name(cls) -> str:
        return "adega_statement_files"

    def schema(self) -> str:
        return "product string, file string, is_row boolean, c string, q string, v string"

    def writer(self, schema, overwrite: bool) -> StatementFilesWriter:
        return StatementFilesWriter(self.options["root"], self.options["staging"], self.options["encoding"])


def write_flat(rows: DataFrame, root: str, statements: DataFrame | None = None, encoding: str = "UTF-8",
               file_bytes: int | None = None) -> None:
    """Writes checked rows (``product, year, country, quantity_kg, value_usd``) as one
    file a statement, or as numbered files ``dados_<year>_<n>.csv`` of about
    ``file_bytes`` (default: the session's advisory partition size) where it is larger.

    A first pass adds up the bytes of each statement; rows of a large one are dealt to
    its files by a hash of the row and of the task that read it, so that neither a
    statement nor a row that repeats makes one task's file grow with the data.
    ``statements`` (``product, year``) also get a file, without rows, if they have none.
    ``root`` must not exist, or be an empty folder."""
    spark = rows.sparkSession
    target = qualified(spark, root.rstrip("/"))
    system, base = file_system(target)
    info = system.get_file_info(base)
    if info.type != pafs.FileType.NotFound:
        if info.type != pafs.FileType.Directory or system.get_file_info(pafs.FileSelector(base)):
            raise FileExistsError(f"{root} exists and isn't an empty folder")
        system.delete_dir(base)
    if file_bytes is None:
        file_bytes = spark._jsparkSession.sessionState().conf().getConf(
            spark._jvm.org.apache.spark.sql.internal.SQLConf.ADVISORY_PARTITION_SIZE_IN_BYTES())
    length = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in (COUNTRY, QUANTITY, VALUE)), F.lit(3))
    sizes = rows.groupBy(PRODUCT, YEAR).agg(F.ceil(F.sum(length) / F.lit(int(file_bytes))).alias("_files"))
    dealt = F.pmod("_deal", F.col("_files")) + 1
    placed = rows.withColumn("_deal", F.xxhash64(COUNTRY, QUANTITY, VALUE, F.spark_partition_id())).join(sizes, [PRODUCT, YEAR])
    name = F.when(F.col("_files") == 1, F.format_string("dados_%d.csv", F.col(YEAR))).otherwise(
        F.format_string("dados_%d_%d.csv", F.col(YEAR), dealt))
    out = placed.select(PRODUCT, name.alias("file"), F.lit(True).alias("is_row"), F.col(COUNTRY).alias("c"), F.col(QUANTITY).alias("q"), F.col(VALUE).alias("v"))
    if statements is not None:
        bare = statements.select(PRODUCT, YEAR).distinct().join(sizes, [PRODUCT, YEAR], "left_anti")
        none = F.lit(None).cast("string")
        out = out.unionByName(bare.select(PRODUCT, F.format_string("dados_%d.csv", F.col(YEAR)).alias("file"), F.lit(False).alias("is_row"),
                                          none.alias("c"), none.alias("q"), none.alias("v")))
    spark.dataSource.register(StatementFiles)
    (out.repartition(PRODUCT, "file").sortWithinPartitions(PRODUCT, "file", "c").write.format(StatementFiles.name())
     .option("root", target).option("staging", f"{target}-staging-{uuid.uuid4().hex}").option("encoding", encoding).mode("append").save())


# --- listing ----------------------------------------------------------------------------------------

def statement_presence(spark: SparkSession, root: str, products: Sequence[str] | None = None) -> DataFrame:
    """``product, year, files, bytes`` of the statement files under a flat root, from
    the file listing alone: no file is opened.  Files whose names give no year are left out."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(product_paths(root, products, "*.csv"))
    found = listed.select(product_from_path().alias(PRODUCT), year_from_path().alias(YEAR), F.col("_metadata.file_size").alias("size"))
    return found.where(F.col(YEAR).isNotNull()).groupBy(PRODUCT, YEAR).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def missing_statements(presence: DataFrame, rows: DataFrame, first_year: int, last_year: int | None = None,
                       products: DataFrame | None = None) -> DataFrame:
    """``product, year, state``: statements of the expected years without a file
    (``absent``), and files without a row (``empty``).  ``last_year`` defaults to the
    latest year with a file; ``products`` are expected although no file names them."""
    absent = missing_periods(presence, first_year, last_year, products).select(PRODUCT, YEAR, F.lit("absent").alias("state"))
    have = rows.select(PRODUCT, YEAR).distinct()
    empty = presence.select(PRODUCT, YEAR).join(have, [PRODUCT, YEAR], "left_anti").select(PRODUCT, YEAR, F.lit("empty").alias("state"))
    return absent.unionByName(empty)


def latest_years(spark: SparkSession, root: str, n: int, products: Sequence[str] | None = None) -> tuple[list[int], list[str]]:
    """The years of the last ``n`` up to the latest with a file, and the products with a
    file in them (from the listing)."""
    presence = statement_presence(spark, root, products)
    latest = presence.agg(F.max(YEAR)).first()[0]
    if latest is None:
        return [], []
    names = presence.where(F.col(YEAR) > latest - n).select(PRODUCT).distinct().collect()  # a row per product
    return list(range(latest - n + 1, latest + 1)), sorted(r[0] for r in names)
