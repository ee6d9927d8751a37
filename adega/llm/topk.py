"""Exact top-k inner products over a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it, in annuli (rings
of one pivot between two distances).  For a query, the triangle inequality bounds
the distance to any vector of an annulus from below, and so its inner product from
above: ``<q,x> = (|q|^2 + |x|^2 - |q-x|^2) / 2``.  Each query first expands the
annuli with the best bounds until they hold enough vectors; the k-th score found
is its threshold, and only annuli whose bound reaches it are expanded after that.
Nothing else can hold a better vector, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adega.llm.common import constant_rows, stored
from adega.llm.vectors import usable

#: vectors, and queries, that one task's matrix product takes on average
BLOCK = 4096
#: rings per pivot
RINGS = 64


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, pivots: int = 32,
                       vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products
    (all, if there are fewer) over components ``floor(scale * x)``, ties to the
    smaller vec_id.

    Queries are the rows that ``is_query`` picks, candidates all rows of the same
    length but the query's own (a repeated row or id is another candidate).  Vectors
    that are null, empty or hold null or non-finite components take no part, nor do
    rows with a null vec_id.  Scores must fit a signed 64-bit integer.  Only the
    columns named and those of ``is_query`` are read; an empty table gives no rows."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
        F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")).alias("x"),
        F.monotonically_increasing_id().alias("row"))
    rows = stored(rows.withColumn("dim", F.size("x")), "topk-rows")
    # pivots: a bounded, pseudo-random choice; the origin serves lengths that none has
    centres = [np.array(r["x"], np.int64) for r in rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "row").limit(pivots).select("x").collect()]

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x = np.stack(part["x"].to_list()).astype(np.int64)
                which, distance = _nearest(x, _centres(centres, dim))
                yield part.assign(pivot=which, distance=distance, norm=np.sqrt((x.astype(float) ** 2).sum(axis=1)),
                                  x=[r.tobytes() for r in x])

    kept = "vec_id long, is_query boolean, row long, dim int"
    index = stored(rows.mapInPandas(keyed, f"{kept}, x binary, pivot int, distance double, norm double"), "topk-index")
    widest = index.agg(F.max("distance")).first()[0] or 1.0
    ring = F.floor(F.col("distance") * F.lit(RINGS / widest)).cast("int")
    index = index.withColumn("ring", ring)
    # at most pivots x rings rows a length
    rings = index.groupBy("dim", "pivot", "ring").agg(
        F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("norm").alias("norm"), F.count("*").alias("n")).toPandas()
    rings = rings.sort_values(["dim", "pivot", "ring"], ignore_index=True).assign(ring_id=np.arange(len(rings)), blocks=lambda r: -(-r["n"] // BLOCK))
    table = constant_rows(spark, rings[["dim", "pivot", "ring", "ring_id", "blocks"]].astype("int64").values.tolist(), "dim int, pivot int, ring int, ring_id int, blocks int")
    queries = index.where("is_query")
    shares = max(1, -(-queries.count() // BLOCK))
    # a ring's vectors are dealt to blocks; a block is compared with one share of the queries at a time
    members = index.join(F.broadcast(table), ["dim", "pivot", "ring"]).select(
        "ring_id", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), "row", "vec_id", "x")

    def expand(asked: DataFrame, name: str) -> DataFrame:
        """Scores of (query row, ring_id) pairs: the best k of each block."""
        asked = stored(asked, f"topk-{name}").join(F.broadcast(table.select("ring_id", "blocks")), "ring_id").withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        asked = asked.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int"))
        keys = ["ring_id", "block", "share"]
        # a block goes to the shares that ask for its ring, and nowhere if none does
        wanted = asked.select("ring_id", "block", F.col("share").alias("share")).distinct()
        have = members.join(wanted, ["ring_id", "block"])
        asked = asked.join(asking.select("row", "query_id", F.col("x").alias("query_x")), "row")

        def best(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
            if not len(ask) or not len(have):
                return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})
            x, ids, own = _ints(have["x"]), have["vec_id"].to_numpy(), have["row"].to_numpy()
            out = []
            for a in range(0, len(ask), 256):
                part = ask.iloc[a: a + 256]
                scores = _products(_ints(part["query_x"]), x)
                for row, name, line in zip(part["row"], part["query_id"], scores):
                    line = np.where(own == row, np.iinfo(np.int64).min, line)
                    if len(line) > k:
                        pick = np.flatnonzero(line >= np.partition(line, len(line) - k)[len(line) - k])
                    else:
                        pick = np.arange(len(line))
                    pick = pick[own[pick] != row]
                    pick = pick[np.lexsort((ids[pick], -line[pick]))[:k]]
                    out.append(pd.DataFrame({"query_row": row, "query_id": name, "vec_id": ids[pick], "score": line[pick]}))
            return pd.concat(out)

        return asked.groupBy(*keys).cogroup(have.groupBy(*keys)).applyInPandas(
            best, "query_row long, query_id long, vec_id long, score long")

    asking = queries.select("row", F.col("vec_id").alias("query_id"), "dim", "x")

    def choose(first: bool):
        def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for q in batch.itertuples(index=False):
                    own = rings[rings["dim"] == q.dim]
                    x = np.frombuffer(q.x, np.int64)
                    bound = _bounds(x, own, _centres(centres, q.dim))
                    order = np.argsort(-bound, kind="stable")
                    held = np.cumsum(own["n"].to_numpy()[order])
                    seed = int(np.searchsorted(held, 4 * k + 1)) + 1  # rings that hold enough to set a threshold
                    pick = order[:seed] if first else order[seed:][bound[order[seed:]] >= q.threshold]
                    yield pd.DataFrame({"row": q.row, "ring_id": own["ring_id"].to_numpy()[pick]})
        return rows_of

    pairs = "row long, ring_id int"
    by_score = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    seeds = stored(expand(asking.mapInPandas(choose(True), pairs), "first"), "topk-seeds")
    kth = (seeds.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).groupBy(F.col("query_row").alias("row"))
           .agg(F.count("*").alias("n"), F.min("score").alias("threshold")))
    lowest = F.lit(-(1 << 63)).cast("long")
    rest = asking.join(kth, "row", "left").withColumn(
        "threshold", F.when(F.col("n") >= k, F.col("threshold")).otherwise(lowest)).drop("n")
    more = expand(rest.mapInPandas(choose(False), pairs), "rest")
    ranked = seeds.unionByName(more).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _centres(centres: list[np.ndarray], dim: int) -> np.ndarray:
    return np.stack([np.zeros(dim, np.int64)] + [c for c in centres if len(c) == dim])


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each vector and the distance, centre by centre."""
    which, least = np.zeros(len(x), np.int32), np.full(len(x), np.inf)
    for i, c in enumerate(centres):
        d = ((x - c).astype(float) ** 2).sum(axis=1)
        which, least = np.where(d < least, i, which), np.minimum(d, least)
    return which.astype(np.int32), np.sqrt(least)


def _bounds(x: np.ndarray, rings: pd.DataFrame, centres: np.ndarray) -> np.ndarray:
    """No vector of a ring has a larger inner product with ``x`` than this."""
    to = np.sqrt(((centres - x).astype(float) ** 2).sum(axis=1))[rings["pivot"].to_numpy()]
    norm, far = np.sqrt((x.astype(float) ** 2).sum()), rings["norm"].to_numpy()
    gap = np.maximum(0, np.maximum(to - rings["far"].to_numpy(), rings["near"].to_numpy() - to))
    bound = np.minimum((norm ** 2 + far ** 2 - gap ** 2) / 2, norm * far)
    return bound + 1 + 1e-9 * (norm ** 2 + far ** 2)  # beyond any rounding


def _ints(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64).reshape(len(column), -1)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where every partial sum stays below 2**53."""
    if np.sqrt((q.astype(float) ** 2).sum(axis=1).max() * (x.astype(float) ** 2).sum(axis=1).max()) < 2 ** 52:
        return np.rint(q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T
