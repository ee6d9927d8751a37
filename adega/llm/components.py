"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from adega.llm.common import removed, stored_at


def connected_components(links: DataFrame) -> DataFrame:
    """``(a, b)`` -> ``(node, root)`` for every node of a link, root the smallest
    node reachable.

    Each round hangs the larger neighbours of a node on the smallest node around it
    (large star), then the smaller ones (small star); the number of rounds grows
    with the logarithm of the longest path.  A round aggregates minima before the
    shuffle and joins them back (a hub's links are split by the adaptive planner),
    and its links are written to the shared folder (those of the round before are removed); only their count and a checksum
    reach the driver.  Self links and null ends are ignored."""
    def ordered(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    now, path, state = _written(ordered(links))
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small_in = ordered(large)
        least = small_in.groupBy("u").agg(F.min("v").alias("m"))
        small = small_in.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, old = state, path
        now, path, state = _written(ordered(small))
        removed(links.sparkSession, old)
        if state == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _written(links: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The links in the shared folder and their place, with their count and checksum, which are
    observed while they are written (a task that runs twice can only cost a round)."""
    seen = Observation()
    kept, path = stored_at(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "stars")
    return kept, path, (seen.get["n"], seen.get["sum"])
