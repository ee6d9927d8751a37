"""Tables found in stored web pages -> rows of cell texts -> statement rows.

Pages arrive as a DataFrame ``(page_id, url, html)``.  Extraction runs in the
executors through ``mapInArrow`` (Arrow batches of pages, one parse per page, rows
handed on as soon as there are some thousands of them);
the per-page helper is the standard-library HTML tokenizer plus a small state
machine, so nothing but the page text crosses into Python.  Every page is
parsed whole; if a page cannot be parsed to its end, the rows read so far are kept
and carry the reason in ``page_error``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from adega.functions.lookup import map_values

_SKIP_TEXT = {"script", "style", "template"}
#: rows that leave Python at a time (a page's rows stay together)
ROWS_OUT = 5_000


class _RowCollector(HTMLParser):
    """Collect, in document order, the rows (``row_tag``) of a page and the
    stripped text of their cells (``cell_tags``).  A row nested in a cell is its
    own row; an unclosed cell ends at the next cell or at the end of its row."""

    def __init__(self, row_tag: str, cell_tags: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.row_tag, self.cell_tags = row_tag, set(cell_tags)
        self.rows: list[tuple[int, int | None, list[str]]] = []
        self._open: list[list] = []   # stack of [start_index, cells, open_cell_chunks | None, table_no]
        self._started = 0
        self._skip = 0
        self._tables: list[tuple[int, int]] = []  # (open-row depth, table number) of each open <table>
        self._table_count = 0

    def parse_marked_section(self, i, report=1):
        """``<![...`` outside foreign content is a bogus comment, not an error."""
        return self.parse_bogus_comment(i)

    def _close_cell(self, row):
        self._skip = 0  # an unclosed <template> ends with its cell
        if row[2] is not None:
            row[1].append("".join(row[2]))
            row[2] = None

    def _close_row(self):
        row = self._open.pop()
        self._close_cell(row)
        self.rows.append((row[0], row[3], row[1]))

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP_TEXT:
            self._skip += 1
        elif tag == "table":
            self._tables.append((len(self._open), self._table_count))
            self._table_count += 1
        elif tag == self.row_tag:
            self._open.append([self._started, [], None, self._tables[-1][1] if self._tables else None])
            self._started += 1
        elif tag in self.cell_tags and self._open:
            row = self._open[-1]
            self._close_cell(row)
            row[2] = []

    def handle_endtag(self, tag):
        if tag in _SKIP_TEXT:
            self._skip = max(0, self._skip - 1)
        elif tag == "table" and self._tables:
            depth, _ = self._tables.pop()
            while len(self._open) > depth:  # rows left open end with their table
                self._close_row()
        elif tag == self.row_tag and self._open:
            self._close_row()
        elif tag in self.cell_tags and self._open:
            self._close_cell(self._open[-1])

    def handle_data(self, data):
        if self._skip or not self._open:
            return
        chunks = self._open[-1][2]
        text = data.strip()
        if chunks is not None and text:
            chunks.append(text)

    def finish(self) -> list[tuple[int | None, list[str]]]:
        while self._open:
            self._close_row()
        return [(table_no, cells) for _, table_no, cells in sorted(self.rows, key=lambda r: r[0])]


def table_rows_of_page(html: str | None, row_tag: str = "tr", cell_tags: Sequence[str] = ("th", "td"),
                       on_error=None) -> list[tuple[int | None, list[str]]]:
    """Rows of one page as (number of the innermost enclosing ``<table>`` in
    document order, or None; stripped cell texts).  If the page cannot be parsed to
    its end, the rows read so far are returned and ``on_error`` (if given) is called
    with the reason."""
    if not html:
        return []
    collector = _RowCollector(row_tag, cell_tags)
    try:
        collector.feed(html)
        collector.close()
    except Exception as broken:  # markup beyond the tokenizer: keep what was read
        if on_error is not None:
            on_error(f"{type(broken).__name__}: {broken}")
    return collector.finish()


def rows_of_page(html: str | None, row_tag: str = "tr",
                 cell_tags: Sequence[str] = ("th", "td")) -> list[list[str]]:
    """Rows of one page as lists of stripped cell texts (empty list on bad input)."""
    return [cells for _, cells in table_rows_of_page(html, row_tag, cell_tags)]


def extract_rows(pages: DataFrame, row_tag: str = "tr", cell_tags: Sequence[str] = ("th", "td"), *,
                 id_col: str = "page_id", html_col: str = "html",
                 carry: Sequence[str] = (), failures=None, empty_pages: bool = False) -> DataFrame:
    """``(page_id, *carry, row_no, table_no, table_row_no, cells array<string>,
    page_error)``: one output row per table row, ``row_no`` counting the rows of a page from 0 in
    document order, ``table_no`` the innermost enclosing ``<table>`` (0-based,
    null outside tables) and ``table_row_no`` the row's position in that table.

    Pages are processed independently, so the work spreads over the input
    partitions without a shuffle; only the id, ``carry`` and html columns go to
    Python.  Arrow batches are bounded by ``spark.sql.execution.arrow.maxRecordsPerBatch``
    and ``spark.sql.execution.arrow.maxBytesPerBatch`` (set to 64 MB by
    :func:`adega.session.build_session`).  ``page_error`` is null, or says why the
    page was read only in part; a page broken before its first row gives one row
    without cells that carries it, as with ``empty_pages`` does a page without rows
    (``page_error`` null).  Split sizes are the reader's
    (``spark.sql.files.maxPartitionBytes``).  Pass a Spark accumulator as
    ``failures`` to count broken pages as well (a retried task can count twice).
    """
    carried = [pages.schema[c] for c in carry]
    schema = StructType([StructField(id_col, LongType(), True), *carried,
                         StructField("row_no", IntegerType(), False),
                         StructField("table_no", IntegerType(), True),
                         StructField("table_row_no", IntegerType(), True),
                         StructField("cells", ArrayType(StringType(), True), True),
                         StructField("page_error", StringType(), True)])
    tag, cells_tags = row_tag.lower(), tuple(t.lower() for t in cell_tags)
    out_cols = [id_col, *carry]

    def explode_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # pages become Python strings one at a time
            picks, nos, tables, in_table, cells, errors = [], [], [], [], [], []

            def frame() -> pa.RecordBatch:
                kept = batch.select(out_cols).take(pa.array(picks, pa.int64()))
                return pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(nos, pa.int32()), pa.array(tables, pa.int32()), pa.array(in_table, pa.int32()),
                     pa.array(cells, pa.list_(pa.string())), pa.array(errors, pa.string())], names=schema.names)

            for i, html in enumerate(batch.column(html_col)):
                seen: dict[int, int] = {}
                broken: list[str] = []
                found = table_rows_of_page(html.as_py(), tag, cells_tags, broken.append)
                if broken:
                    if failures is not None:
                        failures.add(1)
                if broken or empty_pages:
                    found = found or [(None, None)]
                for no, (table_no, row) in enumerate(found):
                    errors.append(broken[0] if broken else None)
                    picks.append(i)
                    nos.append(no)
                    tables.append(table_no)
                    in_table.append(None if table_no is None else seen.get(table_no, 0))
                    if table_no is not None:
                        seen[table_no] = seen.get(table_no, 0) + 1
                    cells.append(row)
                if len(picks) >= ROWS_OUT:
                    yield frame()
                    for column in (picks, nos, tables, in_table, cells, errors):
                        column.clear()
            if picks:
                yield frame()

    source = pages.select(F.col(id_col).cast("long").alias(id_col), *carry, html_col)
    return source.mapInArrow(explode_pages, schema)


def cells_to_columns(rows: DataFrame, names: Sequence[str], cells_col: str = "cells") -> DataFrame:
    """Positional cells -> named columns; a short (ragged) row gives nulls."""
    keep = [c for c in rows.columns if c != cells_col]
    return rows.select(*keep, *[F.get(F.col(cells_col), i).alias(n) for i, n in enumerate(names)])


# Request parameters of the statistics site, per flow.
EXPORT_OPTION, IMPORT_OPTION = "opt_06", "opt_05"
EXPORT_PRODUCT_CODES = {"01": "table_wine", "02": "foaming_wine", "03": "fresh_grapes", "04": "grape_juice"}
IMPORT_PRODUCT_CODES = {"01": "table_wine", "02": "foaming_wine", "03": "fresh_grapes",
                        "04": "raisins_grapes", "05": "grape_juice"}
PRODUCT_CODES = {**{(EXPORT_OPTION, code): name for code, name in EXPORT_PRODUCT_CODES.items()},
                 **{(IMPORT_OPTION, code): name for code, name in IMPORT_PRODUCT_CODES.items()}}


# First cells of the statement table's header row.
TABLE_HEADER = ("Países", "Quantidade (Kg)", "Valor (US$)")


def statement_rows_of_page(html: str | None, header: Sequence[str] | None = TABLE_HEADER,
                           on_error=None) -> tuple[list[list[str]], str | None]:
    """Data rows of all statement tables of one page, in document order, and what is
    wrong with the page (None: nothing).

    A table is a statement if its first row begins with ``header`` (blanks at the ends
    and case ignored); with ``header=None`` every table is one."""
    broken: list[str] = []
    wanted = None if header is None else [h.lower() for h in header]
    statements: dict[int, bool] = {}  # table -> is it a statement?
    data = []
    for table_no, cells in table_rows_of_page(html, on_error=broken.append):
        if table_no is None:
            continue
        if table_no not in statements:  # its first row
            statements[table_no] = wanted is None or [c.strip().lower() for c in cells[: len(wanted)]] == wanted
        elif statements[table_no]:
            data.append(cells)
    if broken and on_error is not None:
        on_error(broken[0])
    return data, broken[0] if broken else None if any(statements.values()) else "no statement table"


def page_keys(url: Column) -> tuple[Column, Column, Column]:
    """(option, product code, year) that a page's URL asks for: ``opcao=opt_NN``,
    ``subopcao=subopt_NN``, ``ano=``; null where the URL doesn't say."""
    found = lambda pattern: F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    return found(r"opcao=(opt_\d+)"), found(r"subopcao=subopt_(\d+)"), found(r"ano=(\d{4})(?!\d)").try_cast("int")


def pages_to_statements(pages: DataFrame, product_codes: dict[tuple[str, str], str] | None = None, *,
                        header: Sequence[str] | None = TABLE_HEADER, failures=None, errors: str = "fail") -> DataFrame:
    """Statement tables scraped into pages -> ``product, year, country,
    quantity_kg, value_usd`` (text measures, ready for ``clean_statements``).

    The statement tables of a page are those whose first row is ``header`` (blanks
    at the ends and case ignored), however many; menus, layout tables and footers are
    other tables.  With ``header=None`` every table counts.  The header rows are dropped.
    Year, flow and product come from the page URL (:func:`page_keys`):
    ``product_codes`` maps (option, code) to the product
    and defaults to both flows.  A page with rows but an unknown option or code
    fails the job instead of giving nameless rows.

    A page that was read only in part, or has no statement table, fails the job too.
    With ``errors="keep"`` it gives its reason in a further column ``page_error``
    instead: on each row read, or on one row without country and measures (product
    null if its code is unknown) if there are none; ``clean_statements`` drops such rows,
    so look at them before.

    A page is decided on where it is parsed, one after the other: rows leave the
    Python function with the page's verdict, and nothing is shuffled."""
    if errors not in ("fail", "keep"):
        raise ValueError(f"errors: fail or keep, not {errors!r}")
    codes = product_codes or PRODUCT_CODES
    names = ("country", "quantity_kg", "value_usd")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frame(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:-1]], pa.array(columns[-1], pa.bool_())],
                                              names=["url", *names, "page_error", "is_row"])

        out: list[tuple] = []
        for batch in batches:  # pages become Python strings one at a time
            for url, html in zip(batch.column("url"), batch.column("html")):
                data, error = statement_rows_of_page(html.as_py(), header, (lambda _: failures.add(1)) if failures is not None else None)
                link = url.as_py()
                if error is not None and not data:
                    out.append((link, None, None, None, error, False))
                for cells in data:
                    out.append((link, *cells[:3], *[None] * (3 - len(cells)), error, True))
                if len(out) >= ROWS_OUT:
                    yield frame(out)
                    out = []
        if out:
            yield frame(out)

    rows = pages.select("url", "html").mapInArrow(
        read, "url string, country string, quantity_kg string, value_usd string, page_error string, is_row boolean")
    if errors == "fail":
        why = F.concat(F.col("page_error"), F.lit(" in the page "), F.coalesce("url", F.lit("without url")))
        rows = rows.filter(F.when(F.col("page_error").isNotNull(), F.raise_error(why).cast("boolean")).otherwise(F.col("is_row")))
    option, code, year = page_keys(F.col("url"))
    product = map_values(F.concat(option, F.lit("/"), code), {f"{o}/{c}": name for (o, c), name in codes.items()})
    known = F.when(product.isNotNull() | ~F.col("is_row"), product).otherwise(
        F.raise_error(F.concat(F.lit("no product for the page "), F.coalesce("url", F.lit("without url")))).cast("string"))
    return rows.select(known.alias("product"), year.alias("year"), *names, *(["page_error"] if errors == "keep" else []))
