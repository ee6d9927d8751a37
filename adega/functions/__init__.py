"""Column expressions: number parsing, labels, literal lookups."""

from adega.functions.labels import (  # noqa: F401
    label_axis_millions, label_currency, label_for, label_grouped, label_quantity, label_quantity_millions,
    label_value_millions, tiered_label)
from adega.functions.lookup import map_values  # noqa: F401
from adega.functions.numbers import parse_digits, parse_locale_number  # noqa: F401
