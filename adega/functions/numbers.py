"""Number parsing for statement text (Column -> Column, JVM-side, codegen friendly).

Spark 4 runs with ANSI mode on, where ``cast`` raises on text such as ``-`` or
``''``.  Statement files write a missing figure as ``-`` and rely on it turning
into null, so every conversion here goes through ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adega.functions._col import as_col

#: the statements' missing mark.  It is looked for before the cast: a failed cast costs an
#: exception, many times a parsed number
_MARK = "-"


def parse_locale_number(col: Column | str, thousands: str = ".",
                        decimal: str | None = None, dtype: str = "double") -> Column:
    """Brazilian-style number text -> double; anything non-numeric -> null.

    ``1.167.696`` -> 1167696.0, ``6`` -> 6.0, ``-`` -> null.  With
    ``decimal=','`` the comma becomes the decimal point (``1.234,5`` -> 1234.5).
    This is the intended pt-BR meaning of the text: a separator is never read
    as a decimal point.  ``dtype`` may be a decimal type (``"decimal(20,2)"``)
    for exact sums beyond 2^53.
    """
    cell = text = as_col(col)
    if thousands:  # literal replacement: no regex engine per row
        text = F.replace(text, F.lit(thousands), F.lit(""))
    if decimal and decimal != ".":
        text = F.replace(text, F.lit(decimal), F.lit("."))
    return F.when(cell != F.lit(_MARK), text.try_cast(dtype))


def parse_digits(col: Column | str, dtype: str = "double") -> Column:
    """Keep only digits and commas, turn the comma into a decimal point, cast.

    ``"1.783"`` -> 1783.0, ``" 12,5 "`` -> 12.5, ``-`` -> null.
    """
    cell = as_col(col)
    kept = F.regexp_replace(cell, "[^0-9,]", "")
    return F.when(cell != F.lit(_MARK), F.replace(kept, F.lit(","), F.lit(".")).try_cast(dtype))
