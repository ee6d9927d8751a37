"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight schedule over the training time is integrated into a
cumulative token demand; a document's place in its source's token stream is put
through the inverse of that demand, which gives its training position; documents
are range-sorted by position.  Column expressions only.

The stream of a source is all its documents in a fixed pseudo-random order,
repeated.  A document's n-th pass belongs to the mix if its middle lies before the
source's target, so a source's taken tokens differ from the target by half a
document at most, and nothing is cut.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adega.llm.common import free_name, stored

#: rows of a source that one prefix-sum block holds on average
BLOCK_ROWS = 20_000

#: (time, weight) knots; weights are relative and linear between knots
Schedule = Sequence[tuple[float, float]]
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.5), (1.0, 0.5)),              # heavy sources fade out
    ((0.0, 1.0), (1.0, 1.0)),              # steady
    ((0.0, 0.5), (0.6, 1.0), (1.0, 1.5)),  # light sources come in late
)


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (null: 0): the places where a word ends."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def position_in_schedule(share: Column, schedule: Schedule) -> Column:
    """Time at which ``share`` (0 to 1) of a source's demand has been met: the
    inverse of the schedule's integral, piece by piece (a linear weight has a
    quadratic integral)."""
    if len(schedule) < 2 or any(b[0] <= a[0] for a, b in zip(schedule, schedule[1:])) or any(w < 0 for _, w in schedule):
        raise ValueError("a schedule needs rising times and weights of at least 0")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:])]
    total = sum(areas)
    if total <= 0:
        raise ValueError("a schedule needs a positive weight somewhere")
    out = F.lit(float(schedule[-1][0]))
    end = total
    for (t0, w0), (t1, w1), area in reversed(list(zip(schedule, schedule[1:], areas))):
        begin = end - area
        need = F.greatest(share * F.lit(total) - F.lit(begin), F.lit(0.0))  # area still to cover in this piece
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0)))
        # 2 * need / (w0 + root) solves slope/2 x^2 + w0 x = need without cancellation
        step = F.when(F.lit(w0) + root > 0, F.lit(2.0) * need / (F.lit(w0) + root)).otherwise(F.lit(0.0))
        here = F.least(F.lit(t0) + step, F.lit(float(t1)))
        out = here if end == total else F.when(share * F.lit(total) <= F.lit(end), here).otherwise(out)
        end = begin
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                   max_repeats: float = 2.0) -> DataFrame:
    """(source, source_size) -> plus ``rank``, ``pattern``, ``weight`` and ``target``.

    Sources by code point, null last, weigh ``weights`` in turn.  They share
    ``share`` of all tokens; a target stops at ``max_repeats`` times its source's
    size and the excess is shared by weight among the others until none is above:
    target = min(cap, level * weight), where the level is found from sums over
    the sources in the order of cap / weight.  One row per source."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(every))
    s = s.withColumn("pattern", F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("pattern") + 1))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    ordered = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("weights_from", F.sum("weight").over(after))
         .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share))))
    # level if exactly the sources before this one are capped; right at the first one whose cap it doesn't reach
    s = s.withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weights_from"))
    s = s.withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("found") * F.col("weight")))
    return s.select("source", "source_size", "rank", "pattern", "weight", target.alias("target"))


def plan_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
             weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_repeats: float = 2.0,
             schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """One row per document, all its columns kept, with

    ``size`` (words; null text: 0), ``source_size``, ``target`` (of its source),
    ``repeats`` (times the mix takes the document), ``taken`` (= repeats * size)
    and ``positions`` (array<double>, the training time of each repeat, 0 to 1).

    A document is taken at most ``max_repeats`` times, rounded up.
    A null source is a source like any other, last in order.  Documents of size 0
    are never repeated and have no positions.  Repeated rows and ids are documents
    of their own (equal rows may swap their places in the stream, which no result
    shows).  If ``docs`` already has a column of one of these names, the new one
    gets a trailing underscore.  An empty table gives an empty plan."""
    names = {n: free_name(docs, n) for n in ("size", "source_size", "target", "repeats", "taken", "positions")}
    rank, pattern, order, block, before, middle = (
        free_name(docs, f"mix_{n}") for n in ("rank", "pattern", "order", "block", "before", "middle"))
    size, total, goal = names["size"], names["source_size"], names["target"]

    # the stream's order: pseudo-random, the same at every run
    sized = docs.withColumn(size, word_count(F.col(text))).withColumn(
        order, F.xxhash64(F.col(doc_id).cast("string"), F.lit(77), F.length(F.col(text))))
    by_source = (sized.groupBy(F.col(source).alias("source"))
                 .agg(F.sum(size).alias("source_size"), F.count("*").alias("n_rows")))
    by_source = stored(by_source, "mix-sources")
    # a source's stream is cut into blocks by the top bits of the order: enough of
    # them that a block holds BLOCK_ROWS rows on average, whatever the source's share
    specs = stored(
        source_targets(by_source.select("source", "source_size"), weights, share, max_repeats).alias("t")
        .join(by_source.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")))
        .select(F.col("t.source").alias("mix_source"), F.col("t.source_size").alias(total), F.col("target").alias(goal),
                F.col("rank").alias(rank), F.col("pattern").alias(pattern),
                F.ceil(F.col("n_rows") / F.lit(BLOCK_ROWS)).alias("mix_blocks")), "mix-targets")
    # one row per source, written: the planner broadcasts it only if the file is small
    placed = sized.alias("d").join(specs.alias("s"), F.col(f"d.{_quoted(source)}").eqNullSafe(F.col("s.mix_source"))).withColumn(
        # the order is a signed 64-bit number: its share of the range picks the block
        block, F.floor((F.col(order).cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)) * F.col("s.mix_blocks")))
    running = Window.partitionBy(rank).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        placed.groupBy(rank, block).agg(F.sum(size).alias("n"))
        .select(rank, block, F.coalesce(F.sum("n").over(running), F.lit(0)).alias(before)), "mix-offsets")
    in_block = Window.partitionBy(rank, block).orderBy(order, F.col(doc_id).asc_nulls_first(), size).rowsBetween(
        Window.unboundedPreceding, -1)
    placed = placed.drop("mix_source", "mix_blocks").join(offsets, [rank, block]).withColumn(
        middle, F.col(before) + F.coalesce(F.sum(size).over(in_block), F.lit(0)) + F.col(size) / 2)

    def at(share_met: Column) -> Column:
        out = position_in_schedule(share_met, schedules[-1])
        for j, schedule in list(enumerate(schedules))[:-1]:
            out = F.when(F.pmod(F.col(pattern), F.lit(len(schedules))) == j, position_in_schedule(share_met, schedule)).otherwise(out)
        return out

    # a pass belongs to the mix if its middle lies before the target: then it has a position
    met = lambda i: (F.col(middle) + i * F.col(total)) / F.col(goal)
    passes = F.sequence(F.lit(0), F.lit(math.ceil(max_repeats) - 1))
    positions = F.filter(F.transform(passes, lambda i: F.when(met(i) < 1, at(met(i)))), lambda p: p.isNotNull())
    placed = placed.withColumn(names["positions"], F.when(F.col(size) > 0, positions).otherwise(F.array().cast("array<double>")))
    placed = placed.withColumn(names["repeats"], F.size(names["positions"]))
    return placed.select(
        *docs.columns, size, total, goal, names["repeats"],
        (F.col(names["repeats"]) * F.col(size)).alias(names["taken"]), names["positions"])


def by_position(plan: DataFrame, positions: str = "positions", ties: str = "doc_id") -> DataFrame:
    """A plan's rows range-sorted by first training position; documents that the mix
    doesn't take come last.  The plan is written first, so that the sort's sampling reads it again
    and doesn't repeat the work behind it."""
    return stored(plan, "mix-plan").orderBy(F.get(positions, F.lit(0)).asc_nulls_last(), ties)


def _quoted(name: str) -> str:
    return f"`{name}`"


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs`` plus ``position``, a row for each
    time a document is taken, range-sorted by training position; nulls, ties, repeated rows
    and empty tables as in :func:`plan_mix`, equal positions by doc_id."""
    plan = plan_mix(docs, **options)
    positions = [c for c in plan.columns if c not in docs.columns][-1]
    position = free_name(docs, "position")
    taken = plan.select(*docs.columns, F.explode(positions).alias(position))
    return taken.orderBy(position, *[c for c, kind in taken.dtypes if c == options.get("doc_id", "doc_id")])
