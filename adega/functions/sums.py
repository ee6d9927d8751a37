"""Sums that don't depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adega.functions._col import as_col

#: doubles from here on have no fraction and stand for whole numbers some apart
_WIDE = float(1 << 53)
#: units of a fraction: six decimals
_UNITS = 1_000_000


def exact_sum(col: Column | str) -> Column:
    """Sum of a double measure, the same bits in whatever order tasks meet the rows.

    Whole parts and millionths are added up as 64-bit integers, map-side like any sum; the total
    is made a double once, at the end.  So whole numbers are exact as long as the total
    fits 63 bits (beyond, the job fails instead of going wrong), and figures with up to
    six decimals add up to what the decimals do; further decimals of a row are rounded.
    Infinite, NaN and very large values (2**53 and more) are added as doubles.  Nulls are passed
    over; without any value the sum is null."""
    value = as_col(col)
    wide = F.abs(value) >= F.lit(_WIDE)  # NaN is above every number
    whole = F.floor(value)
    part = F.rint((value - whole) * F.lit(float(_UNITS))).cast("bigint")
    wholes, parts = F.sum(F.when(~wide, whole)), F.sum(F.when(~wide, part))
    carried = (wholes + F.call_function("div", parts, F.lit(_UNITS))).cast("double")
    narrow = carried + (parts % F.lit(_UNITS)).cast("double") / F.lit(float(_UNITS))
    rest = F.sum(F.when(wide, value))
    return F.when(rest.isNull(), narrow).otherwise(rest + F.coalesce(narrow, F.lit(0.0)))
