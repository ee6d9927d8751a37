"""Label columns for charts and printed tables (Column -> string Column).

The reports format numbers on the driver one at a time; here every label is a
JVM expression (``when`` chain + ``format_string``) evaluated next to the data.

Rounding is that of a formatter that prints the double quotient ``value / divisor``
to a fixed number of decimals: the quotient's exact binary value is rounded to the
nearest figure, and to the even one only if it lies exactly between two.  So 1150
prints ``$1.1K`` (1.15 as a double is a little less) and 2450 prints ``$2.5K``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adega.functions._col import as_col

# ---------------------------------------------------------------------------
# Label tiers and formats the reports print.
# Each tier is (lower bound, divisor, decimals, format); the first bound that the
# value reaches wins, the last entry (bound None) applies below all of them.
# ---------------------------------------------------------------------------
CURRENCY_TIERS = [  # value labels of the country micro-report
    (1e9, 1e9, 2, "$%.2fB"),
    (1e6, 1e6, 2, "$%.2fM"),
    (1e3, 1e3, 1, "$%.1fK"),
    (None, 1, 2, "$%.2f"),
]
QUANTITY_TIERS = [  # quantity labels of the country micro-report
    (1e6, 1e6, 2, "%.2fM Kg"),
    (1e3, 1e3, 1, "%.1fK Kg"),
    (None, 1, 0, "%.0f Kg"),
]
VALUE_MILLIONS_TIERS = [  # yearly value series and annual rankings
    (1e9, 1e9, 1, "$%,.1fB"),
    (None, 1e6, 0, "$%,.0fM"),
]
QUANTITY_MILLIONS_TIERS = [  # yearly quantity series and annual rankings
    (1e9, 1e9, 1, "%,.1fB Kg"),
    (None, 1e6, 0, "%,.0fM Kg"),
]
AXIS_MILLIONS_TIERS = [  # y axis of the top-country line chart
    (1e9, 1e9, 1, "$%.1fB"),
    (None, 1e6, 0, "$%.0fM"),
]
GROUPED_FORMATS = {  # single-format labels of printed tables and bar ends
    "value_table": ("US$ %,.2f", 2),   # annual table, value
    "quantity_table": ("%,.0f Kg", 0),  # annual table and bar ends, quantity
    "value_bar": ("$%,.0f", 0),        # bar ends, value
    "unit_price": ("US$ %.2f", 2),     # mean unit price
}
# ---------------------------------------------------------------------------

#: splits a double into two halves of 26 bits, whose products are exact
_SPLIT = 134217729.0


def _scaled(value: Column, divisor: float, digits: int) -> Column:
    """``value / divisor`` as a double, rounded to ``digits`` decimals.

    With ``q`` the quotient and ``p = q * 10**digits`` as a double, rounding keeps the
    order of numbers, so ``p`` is on the same side of the middle between two whole
    numbers as the exact product, unless it is that middle.  Only then the product's
    rounding error, computed from halves, says which side is meant."""
    q = value.cast("double") / F.lit(float(divisor)) if divisor != 1 else value.cast("double")
    scale = F.lit(float(10 ** digits))
    p = q * scale
    nearest = F.rint(p)
    high = q * F.lit(_SPLIT) - (q * F.lit(_SPLIT) - q)
    low = q - high  # the factor 10**digits has few bits: both partial products are exact
    error = (high * scale - p) + low * scale
    at_middle = F.when(error > 0, p + F.lit(0.5)).when(error < 0, p - F.lit(0.5)).otherwise(nearest)
    return F.when(F.abs(p - nearest) == F.lit(0.5), at_middle).otherwise(nearest) / scale


def tiered_label(col: Column | str, tiers) -> Column:
    """Format ``col`` with the first tier whose lower bound it reaches."""
    value = as_col(col)
    *bounded, (_, divisor, digits, fmt) = tiers
    expr = F.format_string(fmt, _scaled(value, divisor, digits))
    for bound, divisor, digits, fmt in reversed(bounded):
        expr = F.when(value >= F.lit(bound), F.format_string(fmt, _scaled(value, divisor, digits))).otherwise(expr)
    return F.when(value.isNotNull(), expr)


def label_currency(col: Column | str) -> Column:
    """``$1.23B`` / ``$4.56M`` / ``$7.8K`` / ``$9.10``."""
    return tiered_label(col, CURRENCY_TIERS)


def label_quantity(col: Column | str) -> Column:
    """``1.23M Kg`` / ``4.5K Kg`` / ``678 Kg``."""
    return tiered_label(col, QUANTITY_TIERS)


def label_value_millions(col: Column | str) -> Column:
    """``$1,234.5B`` at a billion and above, else ``$12M`` (small values ``$0M``)."""
    return tiered_label(col, VALUE_MILLIONS_TIERS)


def label_quantity_millions(col: Column | str) -> Column:
    """``1.2B Kg`` at a billion and above, else ``12M Kg``."""
    return tiered_label(col, QUANTITY_MILLIONS_TIERS)


def label_axis_millions(col: Column | str) -> Column:
    """Axis ticks: ``$1.2B`` or ``$12M`` without digit grouping."""
    return tiered_label(col, AXIS_MILLIONS_TIERS)


def label_grouped(col: Column | str, style: str) -> Column:
    """One fixed format: ``value_table`` (``US$ 1,234.00``), ``quantity_table``
    (``1,234 Kg``), ``value_bar`` (``$1,234``) or ``unit_price`` (``US$ 1.23``)."""
    fmt, digits = GROUPED_FORMATS[style]
    value = as_col(col)
    return F.when(value.isNotNull(), F.format_string(fmt, _scaled(value, 1, digits)))


def label_for(measure: str, scale: str = "compact") -> Column:
    """Pick the label for a measure column by its name: value columns get the
    currency label, anything else the quantity label.  ``scale='millions'``
    selects the million/billion variants used by the yearly series."""
    is_value = "value" in measure.lower() or "valor" in measure.lower()
    if scale == "millions":
        return label_value_millions(measure) if is_value else label_quantity_millions(measure)
    return label_currency(measure) if is_value else label_quantity(measure)
