"""Literal lookups as map expressions (no join, no UDF)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from adega.functions._col import as_col

# Colour per transport mode in the two price scatters.
MODE_COLOURS_ARGENTINA = {"RODOVIARIA": "blue", "AEREA": "red"}
MODE_COLOURS_SPAIN = {"MARITIMA": "navy", "AEREA": "crimson"}


def map_values(col: Column | str, mapping: dict) -> Column:
    """Look ``col`` up in a literal dict; a key that is missing (or null) gives null."""
    if not mapping:
        return F.lit(None)
    literal = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.try_element_at(literal, as_col(col))
