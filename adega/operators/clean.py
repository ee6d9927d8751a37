"""Line splitting, number parsing, missing-value policies and row filters.

Every function is ``DataFrame -> DataFrame`` and lazy, except
:func:`require_rows`, which runs a one-row job on purpose.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from adega.functions.numbers import parse_digits, parse_locale_number
from adega.sources.statements import COUNTRY, MISSING_MARK, PRODUCT, QUANTITY, TOTAL_LABEL, VALUE, YEAR

MISSING_POLICIES = ("drop", "positive", "keep")


def computed_once(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``df`` with the columns ``values`` put in, each computed once per row.

    As a plain projection the optimiser would copy the expressions into every later
    filter on them (text parsed twice).  A one-element ``inline`` keeps them where
    they are, and filters on the other columns still move below it to the scan."""
    rest = [c for c in df.columns if c not in values]
    made = df.select(*rest, F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))
    return made.select(*df.columns, *[n for n in values if n not in df.columns])


def split_line(df: DataFrame, col: str = "raw_data", *, quote_aware: bool = True,
               names: Sequence[str] = (COUNTRY, QUANTITY, VALUE)) -> DataFrame:
    """Split a whole CSV line into named text fields (country trimmed).

    ``quote_aware=True`` parses the line as CSV, so a quoted country containing
    commas stays one field; lines without a quote character take the plain
    split (same fields, much cheaper), only quoted lines go through
    ``from_csv``.  ``quote_aware=False`` splits on every comma, as a plain
    ``split`` does: quoted names then spill into the next fields.  Missing
    trailing fields are null either way.
    """
    line = F.col(col)
    parts = F.split(line, ",")
    fields = [F.get(parts, i) for i in range(len(names))]
    if quote_aware:
        ddl = ", ".join(f"f{i} STRING" for i in range(len(names)))
        parsed = F.from_csv(line, ddl, {"escape": '"'})  # RFC 4180: a quote inside quotes is doubled
        quoted = line.contains('"')
        fields = [F.when(quoted, parsed[f"f{i}"]).otherwise(F.nullif(f, F.lit("")))
                  for i, f in enumerate(fields)]
    fields[0] = F.trim(fields[0])
    return df.select(*[c for c in df.columns if c != col and c not in names], *[f.alias(n) for n, f in zip(names, fields)])


def drop_totals(df: DataFrame, col: str = COUNTRY, label: str = TOTAL_LABEL) -> DataFrame:
    """Remove the statement's total line (exact, case-sensitive match).  A null
    country is removed too (three-valued comparison)."""
    return df.filter(F.col(col) != F.lit(label))


def apply_missing_policy(df: DataFrame, policy: str = "drop",
                         measures: Sequence[str] = (QUANTITY, VALUE)) -> DataFrame:
    """``drop``: both measures present; ``positive``: both strictly above zero;
    ``keep``: leave nulls in (sums over all-missing groups stay null)."""
    if policy == "drop":
        return df.dropna(subset=list(measures))
    if policy == "positive":
        cond = F.lit(True)
        for m in measures:
            cond = cond & (F.col(m) > 0)
        return df.filter(cond)
    if policy == "keep":
        return df
    raise ValueError(f"missing policy must be one of {MISSING_POLICIES}, got {policy!r}")


def clean_statements(df: DataFrame, *, missing: str = "drop", parse: str = "locale",
                     decimal: str | None = None, totals: bool = False,
                     measures: Sequence[str] = (QUANTITY, VALUE), dtype: str = "double",
                     seen: Observation | None = None) -> DataFrame:
    """Text statements -> typed facts.

    ``parse='locale'`` drops thousands dots (``1.167.696`` -> 1167696.0; with
    ``decimal=','`` a comma is the decimal point); ``parse='digits'`` keeps only
    digits and commas.  Then the missing-value policy, then the total line is
    removed unless ``totals=True``.  ``dtype`` is ``double`` (exact for whole
    numbers below 2^53) or a decimal type such as ``decimal(20,2)``.

    A cell that is neither a number nor a missing mark becomes null like a missing one;
    ``seen`` (an unused ``Observation``) counts, over the rows that are not total
    lines and as a by-product of the job that reads the facts, ``rows`` and
    ``unreadable_<measure>``; :func:`unreadable_cells` lists them.
    """
    conv = _reader(parse, decimal, dtype)
    if not totals:
        df = drop_totals(df)  # on the text: reaches the scan
    if seen is not None:
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[
            F.count_if(_unreadable(F.col(c), conv)).alias(f"unreadable_{c}") for c in measures])
    parsed = {c: conv(F.col(c)) for c in measures}
    # a filter follows unless missing values stay: then the parsing would be copied into it
    typed = df.withColumns(parsed) if missing == "keep" else computed_once(df, parsed)
    return apply_missing_policy(typed, missing, measures)


def _reader(parse: str, decimal: str | None, dtype: str) -> Callable[[Column], Column]:
    if parse == "locale":
        return lambda c: parse_locale_number(c, ".", decimal, dtype)
    if parse == "digits":
        return lambda c: parse_digits(c, dtype)
    raise ValueError(f"parse must be 'locale' or 'digits', got {parse!r}")


def _unreadable(cell: Column, conv: Callable[[Column], Column]) -> Column:
    """A cell with text that is neither the missing mark nor a number."""
    text = F.trim(cell)
    return F.coalesce((text != "") & (text != F.lit(MISSING_MARK)) & conv(cell).isNull(), F.lit(False))


def unreadable_cells(df: DataFrame, *, parse: str = "locale", decimal: str | None = None,
                     measures: Sequence[str] = (QUANTITY, VALUE), keys: Sequence[str] = (PRODUCT, YEAR), dtype: str = "double") -> DataFrame:
    """``*keys, measure, cell, rows``: what :func:`clean_statements` can't read as a
    number, with the number of rows that hold it (total lines included)."""
    conv = _reader(parse, decimal, dtype)
    cells = df.select(*keys, F.explode(F.array(*[
        F.when(_unreadable(F.col(c), conv), F.struct(F.lit(c).alias("measure"), F.col(c).alias("cell"))) for c in measures])).alias("_bad"))
    return cells.where(F.col("_bad").isNotNull()).groupBy(*keys, "_bad.measure", "_bad.cell").agg(F.count("*").alias("rows"))


def filter_country(df: DataFrame, country: str, col: str = COUNTRY) -> DataFrame:
    """Exact country name."""
    return df.filter(F.col(col) == F.lit(country))


def filter_country_like(df: DataFrame, needle: str, col: str = COUNTRY) -> DataFrame:
    """Case-insensitive substring match on the country name."""
    return df.filter(F.lower(F.col(col)).contains(needle.lower()))


def filter_positive(df: DataFrame, measures: Sequence[str] = (QUANTITY, VALUE)) -> DataFrame:
    """Both measures strictly positive (null fails the test)."""
    return apply_missing_policy(df, "positive", measures)


def filter_customs(df: DataFrame, country: str | None = None, state: str | None = None,
                   group_codes: Sequence[int] | None = None) -> DataFrame:
    """Conjunction of the customs filters that are given."""
    cond = F.lit(True)
    if country is not None:
        cond = cond & (F.col("country") == F.lit(country))
    if state is not None:
        cond = cond & (F.col("state") == F.lit(state))
    if group_codes is not None:
        cond = cond & F.col("group_code").isin(list(group_codes))
    return df.filter(cond)


def require_rows(df: DataFrame, message: str = "no rows after cleaning") -> DataFrame:
    """Raise ``ValueError`` when ``df`` is empty (a one-row limit job)."""
    if df.isEmpty():
        raise ValueError(message)
    return df
