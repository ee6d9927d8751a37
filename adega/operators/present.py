"""Chart- and print-ready tables: bar index, label position, axis bound, labels.

Rendering is out of scope; these tables carry everything a plotting call needs.
Windows without a partition key run in one task, so :func:`chart_table` is
meant for bounded inputs (a top-k result) or gets a ``partition_by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adega.operators.rank import display_order
from adega.sources.statements import YEAR


def chart_table(df: DataFrame, measure: str, label: Column, *,
                partition_by: Sequence[str] = (), order_by: Sequence[Column] | None = None,
                label_offset: float = 0.01, bound_factor: float = 1.2) -> DataFrame:
    """Add ``bar_index`` (0-based position in the ranking order of
    :func:`adega.operators.rank.display_order` unless ``order_by`` is given), ``label_x``
    (measure x (1 + offset)), ``axis_max`` (largest measure of the panel x
    factor) and ``label``."""
    order = list(order_by) if order_by else display_order(df, measure)
    ordered = Window.partitionBy(*partition_by).orderBy(*order)
    panel = Window.partitionBy(*partition_by)
    return df.select(
        "*",
        (F.row_number().over(ordered) - 1).alias("bar_index"),
        (F.col(measure) * F.lit(1.0 + label_offset)).alias("label_x"),
        (F.max(measure).over(panel) * F.lit(bound_factor)).alias("axis_max"),
        label.alias("label"),
    )


def series_table(totals: DataFrame, measures: Sequence[str], labels: dict[str, Column],
                 ids: Sequence[str] = (YEAR,)) -> DataFrame:
    """Long ``(*ids, measure, amount, label)`` table for line/bar series: one
    row per id and measure (``unpivot``, no shuffle)."""
    labelled = totals.select(*ids, *[F.struct(F.col(m).cast("double").alias("amount"),
                                              labels[m].alias("label")).alias(m) for m in measures])
    long = labelled.unpivot(list(ids), list(measures), "measure", "cell")
    return long.select(*ids, "measure", "cell.amount", "cell.label")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows (a limit job when collected)."""
    return df.limit(n)
