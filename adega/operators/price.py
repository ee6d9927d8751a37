"""Unit price (US$ per kg) of customs rows and its mean by transport mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adega.functions.lookup import map_values


def with_unit_price(df: DataFrame, fob: str = "fob_usd", kg: str = "net_kg",
                    out: str = "unit_price") -> DataFrame:
    """Add ``fob / kg``; zero or missing kilograms give null (not infinity)."""
    return df.withColumn(out, F.try_divide(F.col(fob), F.col(kg)))


def unit_price_by_mode(df: DataFrame, mode: str = "via", price: str = "unit_price",
                       out: str = "mean_unit_price") -> DataFrame:
    """Mean of the per-row unit prices for each transport mode (a mean of
    ratios, not a ratio of sums); rows without a mode are not a group; ordered
    by mode."""
    priced = df if price in df.columns else with_unit_price(df, out=price)
    return (priced.filter(F.col(mode).isNotNull())
            .groupBy(mode).agg(F.avg(price).alias(out))
            .orderBy(mode))


def price_scatter_rows(df: DataFrame, colours: dict[str, str], mode: str = "via") -> DataFrame:
    """Rows of the kg-vs-FOB scatter with a colour per mode (null when unmapped)."""
    return df.select("net_kg", "fob_usd", mode, map_values(mode, colours).alias("colour"))
