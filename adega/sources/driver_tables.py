"""The benchmark's TPC-H-style tables, shaped as trade statements.

There are no trade CSVs among the benchmark tables, so line items play the
statement rows: ``country`` = customer nation, ``year`` = order year,
``product`` = part type, quantity = line quantity, value = whole dollars of the
extended price; for customs rows ``via`` = return flag, ``state`` = region,
``group_code`` = part size.

:func:`raw_statements` renders the measures as Brazilian-style text
(``1.234.567``), writes the missing mark ``-`` into both measures of every line
whose ``(l_orderkey + l_linenumber)`` is a multiple of 7, a zero quantity into
the other multiples of 11, and appends one ``Total`` line per
(product, year) -- the exact shape of a statement file.  Every line item is
rendered; the masking only decides what text a cell holds.  Queries start
from this text so they run the real parsing path.

Join plan: nation and region (fixed 25 and 5 rows) are joined to customers
first, customers to orders, and that order dimension to line items on the
order key (a sort-merge join: both sides grow with the data); parts join last
on the part key.  Catalyst prunes every column the query does not use; AQE
turns a join into a broadcast only when the measured side is under the
broadcast threshold and splits skewed join partitions.

Ingest, each step written once under ``spark.checkpoint.dir`` and keyed by a
fingerprint of the input tables: :func:`cells_table` (the joins, numbers per
line item) -> :func:`statement_table` (statement text as parquet, partitioned
by product and year) -> :func:`statement_files` (the same text as CSV
statement files, only when a raw-line query asks for them).  The customs rows
are read from the cells table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adega.sources.customs import CUSTOMS_HEADER
from adega.sources.materialize import ensure_written, fingerprint, materialized
from adega.sources.statements import (
    COUNTRY, MISSING_MARK, PRODUCT, QUANTITY, TOTAL_LABEL, VALUE, YEAR, scan_lines, scan_statements)
from adega.sources.writers import write_statements

# Masking rule of the fixture (see module docstring).
MISSING_EVERY = 7
ZERO_QUANTITY_EVERY = 11


STATEMENT_SOURCES = ("lineitem", "orders", "customer", "nation", "region", "part")
ADAPTER_VERSION = "statements-v3"


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def trade_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: ``country, year, product, quantity, value, via,
    state, group_code, mask_key`` (numbers as integers)."""
    t = lambda name: table(spark, sf_dir, name)
    geo = (t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "n_name", "r_name"))
    buyers = (t("customer").select("c_custkey", "c_nationkey")
              .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
              .select("c_custkey", "n_name", "r_name"))
    order_dim = (t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
                 .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
                 .select("o_orderkey", F.year("o_orderdate").alias(YEAR), "n_name", "r_name"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                 "l_extendedprice", "l_returnflag")
    parts = t("part").select("p_partkey", "p_type", "p_size")
    # fact-to-fact join: both sides grow with the data, so it is a sort-merge join
    # on the order key (AQE still splits skewed partitions); without the hint the
    # planner's product-of-inputs size estimate for the order dimension can make it
    # broadcast the line items instead
    rows = (lines.join(order_dim.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey")))
    return rows.select(
        F.col("n_name").alias(COUNTRY),
        YEAR,
        F.col("p_type").alias(PRODUCT),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.floor("l_extendedprice").cast("bigint").alias("value"),
        F.col("l_returnflag").alias("via"),
        F.col("r_name").alias("state"),
        F.col("p_size").alias("group_code"),
        (F.col("l_orderkey") + F.col("l_linenumber")).alias("mask_key"),
    )


def _masked(base: DataFrame) -> tuple[Column, Column]:
    missing = F.col("mask_key") % MISSING_EVERY == 0
    zero = F.col("mask_key") % ZERO_QUANTITY_EVERY == 0
    quantity = F.when(missing, F.lit(None)).when(zero, F.lit(0)).otherwise(F.col("quantity"))
    value = F.when(missing, F.lit(None)).otherwise(F.col("value"))
    return quantity.cast("bigint"), value.cast("bigint")


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined line items with the masked cell values ``q`` and ``v`` (integers,
    null = missing): ``product, year, country, via, state, group_code, q, v``."""
    quantity, value = _masked(base := trade_base(spark, sf_dir))
    return base.select(PRODUCT, YEAR, COUNTRY, "via", "state", "group_code",
                       quantity.alias("q"), value.alias("v"))


def _key(spark: SparkSession, sf_dir: str) -> str:
    return fingerprint(spark, [table_path(sf_dir, t) for t in STATEMENT_SOURCES], ADAPTER_VERSION)


def by_country(cells: DataFrame) -> DataFrame:
    """Cells grouped by (country, state), then sorted by group code, within each partition.

    The order is one 64-bit number, which Spark sorts by its digits: few countries have
    all the rows, and comparing their names row by row took longer than the joins."""
    place = F.xxhash64(COUNTRY, "state").bitwiseAND(F.lit(-1 << 32))
    group = F.coalesce(F.col("group_code"), F.lit(0)).cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))
    return cells.sortWithinPartitions(place.bitwiseOR(group))


def cells_table(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """:func:`raw_cells` ingested once into parquet in the shared scratch folder:
    the joins run once, and both the statement text and the customs rows are
    derived from this table.  Rows are grouped by (country, state) and sorted by
    group within each file, so the customs filters skip pages by their statistics."""
    return materialized(
        spark, "trade-cells", _key(spark, sf_dir),
        build=lambda: raw_cells(spark, sf_dir),
        write=lambda df, path: by_country(df).write.mode("overwrite").parquet(path),
        read=lambda path: spark.read.parquet(path),
        refresh=refresh)


def pt_br(col: Column) -> Column:
    """Integer -> ``1.234.567``; null -> the missing mark.  ``col`` is a plain column.
    Below a million, where nearly all cells are, the digits are put together
    directly; ``format_number`` costs several times as much a row."""
    thousands = F.concat(F.call_function("div", col, F.lit(1000)).cast("string"), F.lit("."),
                         F.substring((col % 1000 + 1000).cast("string"), 2, 3))
    return (F.when(col.isNull(), F.lit(MISSING_MARK)).when(col.between(-999, 999), col.cast("string"))
            .when(col.between(1000, 999_999), thousands).otherwise(F.translate(F.format_number(col, 0), ",", ".")))


def statements_from_cells(cells: DataFrame) -> DataFrame:
    """Statement text ``product, year, country, quantity_kg, value_usd``: one
    line per cell row plus one ``Total`` line per (product, year)."""
    rows = cells.select(PRODUCT, YEAR, COUNTRY, pt_br(F.col("q")).alias(QUANTITY),
                        pt_br(F.col("v")).alias(VALUE))
    totals = (cells.where(F.col("q").isNotNull())
              .groupBy(PRODUCT, YEAR).agg(F.sum("q").alias("q"), F.sum("v").alias("v"))
              .select(PRODUCT, YEAR, F.lit(TOTAL_LABEL).alias(COUNTRY),
                      pt_br(F.col("q")).alias(QUANTITY), pt_br(F.col("v")).alias(VALUE)))
    return rows.unionByName(totals)


def raw_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement text computed lazily from the benchmark tables."""
    return statements_from_cells(raw_cells(spark, sf_dir))


def statement_table(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """The statement text, ingested once from :func:`cells_table` into a parquet
    table partitioned by product and year in the shared scratch folder, then
    scanned.  Scans prune partitions (product/year filters), columns, and row
    groups (country filters) and never repeat the joins."""
    return materialized(
        spark, "statements", _key(spark, sf_dir),
        build=lambda: statements_from_cells(cells_table(spark, sf_dir)),
        write=lambda df, path: write_statements(df, path, mode="overwrite", fmt="parquet", pieces=1),
        read=lambda path: scan_statements(spark, path, layout="hive", fmt="parquet"),
        refresh=refresh)


def statement_files(spark: SparkSession, sf_dir: str, refresh: bool = False) -> str:
    """Path of the statement text written once as CSV files (one folder per
    product and year, header line, quoting where needed), like the files the
    statistics site publishes."""
    return ensure_written(spark, "statement-files", _key(spark, sf_dir),
                          build=lambda: statement_table(spark, sf_dir),
                          write=lambda df, path: write_statements(df, path, mode="overwrite", fmt="csv"),
                          refresh=refresh)


def derived_path(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Path of a copy of the statement table, written once per input by
    ``write(statements, path)`` (round trips through a sink)."""
    return ensure_written(spark, name, _key(spark, sf_dir), build=lambda: statement_table(spark, sf_dir), write=write)


#: statement pages: option and product code per page, by year parity
PAGE_CODES = {("opt_06", "01"): "ECONOMY", ("opt_06", "02"): "LARGE", ("opt_06", "03"): "MEDIUM",
              ("opt_06", "04"): "PROMO", ("opt_06", "05"): "SMALL", ("opt_06", "06"): "STANDARD",
              ("opt_05", "01"): "STANDARD", ("opt_05", "02"): "SMALL", ("opt_05", "03"): "PROMO",
              ("opt_05", "04"): "MEDIUM", ("opt_05", "05"): "LARGE", ("opt_05", "06"): "ECONOMY"}


#: table rows of a rendered page, on average
PAGE_ROWS = 200
PAGE_URL = "http://statistics.example/index.php?ano=%d&opcao=%s&subopcao=subopt_%s"


def page_code(product: Column, year: Column) -> tuple[Column, Column]:
    """(option, code) under which a product's pages of a year are published."""
    option = F.when(year % 2 == 0, "opt_06").otherwise("opt_05")
    code = F.lit(None)
    for (opt, number), name in PAGE_CODES.items():
        code = F.when((option == opt) & (product == name), number).otherwise(code)
    return option, code


def statement_pages(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """Web pages ``page_id, url, html`` rendered from the line items: every line item is
    one table row, a product and year has as many pages as its rows need (even years
    under one option, odd years under the other).  A page has a menu table, two
    statement tables and a footer table, inside a layout table."""
    def build() -> DataFrame:
        cells = cells_table(spark, sf_dir)
        sizes = cells.groupBy(PRODUCT, YEAR).agg(F.ceil(F.count("*") / F.lit(PAGE_ROWS)).alias("pages"))
        dealt = F.xxhash64(COUNTRY, "via", "state", "group_code", "q", "v")
        row = F.format_string("<tr><td>%s</td><td>%s</td><td> %s </td></tr>", F.col(COUNTRY), pt_br(F.col("q")), pt_br(F.col("v")))
        rows = cells.join(sizes, [PRODUCT, YEAR]).select(
            PRODUCT, YEAR, F.pmod(dealt, F.col("pages")).alias("page"), (F.length(COUNTRY) % 2).alias("half"), row.alias("row"))
        page = rows.groupBy(PRODUCT, YEAR, "page").agg(*[
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("half") == k, F.col("row")))), "\n").alias(f"rows{k}") for k in (0, 1)])
        option, code = page_code(F.col(PRODUCT), F.col(YEAR))
        url = F.format_string(PAGE_URL + "&pagina=%d", F.col(YEAR), option, code, F.col("page") + 1)
        head = "<thead><tr><th>Países</th><th>Quantidade (Kg)</th><th>Valor (US$)</th></tr></thead>"
        html = F.concat(
            F.lit("<html><body><table><tr><td><table><tr><td>Menu</td><td>Home</td></tr><tr><td>About</td><td>1.000</td></tr></table>"
                  "</td></tr><tr><td><table>" + head),
            F.col("rows0"), F.lit("</table><table>" + head), F.col("rows1"), F.lit("</table><table><tr><td>Source</td><td>10</td><td>20</td></tr>"
                                 "<tr><td>Footer</td><td>1</td><td>2</td></tr></table></td></tr></table><![endif]></body></html>"))
        return page.select(F.xxhash64(PRODUCT, YEAR, "page").alias("page_id"), url.alias("url"), html.alias("html"))

    return materialized(spark, "statement-pages", _key(spark, sf_dir) + "-3", build=build,
                        write=lambda df, path: df.write.parquet(path), read=lambda path: spark.read.parquet(path), refresh=refresh)


def customs_sheet(spark: SparkSession, sf_dir: str, fmt: str) -> str:
    """Path of the customs rows written once under the sheet's own headers."""
    def write(df: DataFrame, path: str) -> None:
        names = {api: header for header, api in CUSTOMS_HEADER.items()}
        sheet = df.select(*[F.col(c).alias(names[c]) for c in df.columns])
        sheet.write.option("header", True).csv(path) if fmt == "csv" else sheet.write.parquet(path)

    return ensure_written(spark, f"customs-sheet-{fmt}", _key(spark, sf_dir), build=lambda: customs_rows(spark, sf_dir), write=write)


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement line as one string ``raw_data`` with product and year: the
    CSV statement files read line by line with :func:`scan_lines`."""
    return scan_lines(spark, statement_files(spark, sf_dir), layout="hive")


def customs_rows(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """Customs table ``country, state, group_code, via, net_kg, fob_usd`` read
    from :func:`cells_table`; country/state/group filters reach the parquet
    reader."""
    cells = cells_table(spark, sf_dir, refresh)
    return cells.select(COUNTRY, "state", "group_code", "via",
                        F.col("q").cast("double").alias("net_kg"), F.col("v").cast("double").alias("fob_usd"))
