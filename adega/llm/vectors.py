"""Embedding near-dedup by sorted projection passes.

In each pass every vector gets the bits of 64 random projections, most significant
first; vectors are range-sorted by label and bits, so that similar vectors, whose
leading bits mostly agree, come to stand near each other (those with equal bits in a
random order of the pass); each vector is compared
with the neighbours in a bounded window before it, also across the borders of the
sort's partitions.  Pairs over the threshold are links; links of all passes are
united.  More passes find more: a pair is missed only if no pass brings it together.

The windows alone would miss links of a group that is much larger than a window, so
vectors with links far out in their windows (crowded ones) are counted exactly: all
vectors of their component are cut into blocks, and every block with crowded vectors is
compared with every block of the component by matrix products, which give numbers of
links and no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adega.llm.common import stored
from adega.llm.components import connected_components

#: rows of one matrix product
_CHUNK = 256
#: vectors of one block of a component with crowded vectors
BLOCK = 1024


def usable(embedding: Column) -> Column:
    """Not null, not empty, without null or non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(True))


def _links(group: np.ndarray, node: np.ndarray, unit: np.ndarray, start: int, window: int, threshold: float, split: int = 0):
    """Links of the rows from ``start`` on with the ``window`` rows before each, and
    whether they lie more than half a window apart; with ``split``, only those between
    a row before it and one from it on."""
    out = []
    for a in range(start, len(unit), _CHUNK):
        b, low = min(a + _CHUNK, len(unit)), max(0, a - window)
        near = unit[a:b] @ unit[low:b].T >= threshold
        i, j = np.nonzero(near)
        i, j = i + a, j + low
        good = (j < i) & (i - j <= window) & (group[i] == group[j]).all(axis=1)
        if split:
            good &= (j < split) & (i >= split)
        out.append(np.stack([node[i[good]], node[j[good]], (i - j)[good] > window // 2]))
    pairs = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return pd.DataFrame({"a": pairs[:2].min(axis=0), "b": pairs[:2].max(axis=0), "far": pairs[2]})


def passes_for(n: int, window: int, threshold: float, recall: float, least: int = 16) -> int:
    """Passes that bring an isolated pair at the threshold into one window with probability
    ``recall``, among ``n`` vectors of a label.

    A random plane separates the pair with probability ``acos(threshold) / pi``; a pass
    finds it if the bits agree that tell ``n`` vectors into windows: ``agree ** log2(n /
    window)``.  Closer pairs, and pairs linked through others, are found sooner."""
    agree = 1 - math.acos(threshold) / math.pi
    found = agree ** math.log2(max(1.0, n / window))
    return least if found >= 1 else max(least, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def similar_vectors(vectors: DataFrame, threshold: float = 0.93, passes: int | None = None, window: int = 128, passes_per_job: int = 4,
                    recall: float = 0.95,
                    seed: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: ``vec_id``, ``n_links`` (other rows linked directly), ``component_id``
    (smallest vec_id reachable, itself included) and ``kept`` (vec_id = component_id).

    Rows are compared if their labels are equal and not null and their vectors have
    the same length; cosine in double precision.  A vector that is null, empty, zero
    or holds null or non-finite components links with nothing.  Equal vectors of a
    label are one node, linked with each other, however many; repeated rows count as
    rows.  A null vec_id takes part but names no component that has another id.
    Only the three named columns are read; an empty table gives no rows.

    ``passes`` follow the size of the largest label (:func:`passes_for` with ``recall``:
    16 up to a million vectors, 55 at a thousand million), if not given.
    Links are found by passes, except that those of crowded vectors, which have
    ``passes / 2`` links or more in the far halves of their windows, are counted
    exactly within their component; a component's blocks make a number of block pairs
    that grows with its square."""
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[embedding] == "array<float>" else "<f8"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ok = F.coalesce(F.col("label").isNotNull() & usable(F.col("v")) & F.when(usable(F.col("v")), length > 0), F.lit(False))
    rows = rows.withColumn("node", F.when(ok, F.xxhash64("label", "v")))
    nodes = stored(rows.where("node is not null").groupBy("label", "v", "node").agg(F.count("*").alias("weight")), "vector-nodes")
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    n_nodes = sizes[0] or 0
    passes = passes or passes_for(sizes[1] or 0, window, threshold, recall)
    per_job = min(max(1, passes_per_job), passes)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a partition should hold several windows
    partitions = max(1, min(width, n_nodes * per_job // (4 * window)))
    keys = "pass int, label string, bits long, node long, v binary"
    found = None
    for first in range(0, passes, per_job):
        turns = range(first, min(first + per_job, passes))

        def project(batches: Iterator[pd.DataFrame], turns=turns) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, part in batch.groupby(batch["v"].map(len)):
                    x = np.stack(part["v"].to_list()).astype(kind)
                    for turn in turns:
                        planes = np.random.default_rng([seed, turn, dim]).standard_normal((dim, 64))
                        bits = np.packbits(x.astype(float) @ planes > 0, axis=1).view(">u8").ravel()
                        yield pd.DataFrame({"pass": turn, "label": part["label"].astype(str) + f"/{dim}", "node": part["node"],
                                            "bits": (bits ^ np.uint64(1 << 63)).astype(np.int64), "v": [r.tobytes() for r in x]})

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, held, seen = TaskContext.get().partitionId(), None, 0
            for batch in batches:
                rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
                start = len(rows) - len(batch)
                yield _link_rows(_links(*_arrays(rows, kind), start, window, threshold))
                if seen < window:  # the head meets the partition before
                    yield _border(batch.head(window - seen), part - 1, 1, seen)
                seen += len(batch)
                held = rows.tail(window)
            if held is not None:
                yield _border(held, part, 0, 0)

        ordered = nodes.select("label", "v", "node").mapInPandas(project, keys)
        # equal bits fall in an order of the pass's own, so that each pass brings other copies together
        order = ["pass", "label", "bits", F.xxhash64("pass", "node"), "node"]
        ordered = ordered.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
        got = stored(ordered.mapInPandas(compare, f"a long, b long, far long, border int, side int, at int, {keys}"), "vector-pass")

        def across(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["side", "at"], ignore_index=True)
            split = int((rows["side"] == 0).sum())
            return _links(*_arrays(rows, kind), split, window, threshold, split) if 0 < split < len(rows) else _links(
                np.zeros((0, 2)), np.zeros(0, np.int64), np.zeros((0, 1)), 0, window, threshold)

        pairs = got.where("border is null").select("a", "b", "far").unionByName(
            got.where("border is not null").groupBy("border").applyInPandas(across, "a long, b long, far long"))
        found = pairs if found is None else found.unionByName(pairs)
    links = stored(found.groupBy("a", "b").agg(F.sum("far").alias("far")), "vector-links")
    roots = connected_components(links.select("a", "b"))
    weights = nodes.select("node", "weight")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "far"))
    crowded = stored(both.groupBy(F.col("a").alias("node")).agg(F.sum("far").alias("far")).where(F.col("far") >= max(1, passes // 2))
                     .select("node"), "vector-crowded")
    counted = None
    if not crowded.isEmpty():
        counted = _count_links(nodes, roots, crowded, kind, threshold)
        # those of a crowded vector are all counted there
        both = (both.join(crowded.withColumnRenamed("node", "a"), "a", "left_anti")
                .join(crowded.withColumnRenamed("node", "b"), "b", "left_anti"))
    linked = both.join(weights.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("others"))
    if counted is not None:
        linked = linked.unionByName(counted).groupBy("node").agg(F.sum("others").alias("others"))
    info = (weights.join(linked, "node", "left").join(roots, "node", "left")
            .select("node", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    named = rows.select("vec_id", "node").join(info, "node", "left")
    least = named.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = named.join(least, "root", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                                   F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _count_links(nodes: DataFrame, roots: DataFrame, crowded: DataFrame, kind: str, threshold: float) -> DataFrame:
    """``(node, others)``: rows linked with each vector of a component that has crowded
    vectors, for the crowded ones all, for the others those of crowded vectors.  A pair
    of blocks is one row, and the pairs are dealt by their second block."""
    flagged = roots.join(crowded.withColumn("crowded", F.lit(True)), "node", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    flagged = flagged.join(flagged.where("crowded").select("root").distinct(), "root", "left_semi")
    sizes = flagged.groupBy("root", "crowded").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    members = (flagged.join(sizes, ["root", "crowded"]).join(nodes.select("node", "weight", "v"), "node")
               .withColumn("block", F.pmod(F.xxhash64("node"), "n").cast("int")))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows["v"].to_list()).astype(kind)
        return pd.DataFrame({"root": rows["root"].iloc[:1], "crowded": rows["crowded"].iloc[:1], "block": rows["block"].iloc[:1],
                             "node": [rows["node"].to_numpy("<i8").tobytes()], "weight": [rows["weight"].to_numpy("<i8").tobytes()],
                             "v": [v.tobytes()]})

    blocks = stored(members.select("root", "crowded", "block", "node", "weight", "v").groupBy("root", "crowded", "block").applyInPandas(
        pack, "root long, crowded boolean, block int, node binary, weight binary, v binary"), "vector-blocks")

    def side(s: str, *names: str) -> DataFrame:
        return blocks.select("root", *[F.col(c).alias(f"{c}_{s}") for c in ("crowded", "block", *names)])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                mine, theirs = np.frombuffer(r.node_s, "<i8"), np.frombuffer(r.node_t, "<i8")
                weight, x, y = np.frombuffer(r.weight_t, "<i8").astype(float), _unit(r.v_s, len(mine), kind), _unit(r.v_t, len(theirs), kind)
                others = np.zeros(len(mine), np.int64)
                for a in range(0, len(mine), _CHUNK):
                    near = (x[a: a + _CHUNK] @ y.T >= threshold) & (mine[a: a + _CHUNK, None] != theirs)
                    others[a: a + _CHUNK] = near @ weight
                yield pd.DataFrame({"node": mine, "others": others})

    pairs = side("s").join(side("t"), "root").where("crowded_s or crowded_t")
    pairs = pairs.join(side("s", "node", "v"), ["root", "crowded_s", "block_s"]).join(side("t", "node", "weight", "v"), ["root", "crowded_t", "block_t"])
    return pairs.select("node_s", "v_s", "node_t", "weight_t", "v_t").mapInPandas(count, "node long, others long")


def _unit(raw: bytes, n: int, kind: str) -> np.ndarray:
    """Vectors of a block, of length 1, in double precision."""
    wide = np.frombuffer(raw, kind).reshape(n, -1).astype(float)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # huge components don't overflow
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _arrays(rows: pd.DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, node, unit vector) of sorted rows; shorter vectors are filled up with
    zeros, their length is part of the group."""
    size = rows["v"].map(len).to_numpy()
    wide = np.zeros((len(rows), size.max() // np.dtype(kind).itemsize))
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        raw = b"".join(rows["v"].iloc[own])
        wide[own, : n // np.dtype(kind).itemsize] = np.frombuffer(raw, kind).reshape(len(own), -1)
    peak = np.abs(wide).max(axis=1, keepdims=True)
    wide /= peak  # huge components don't overflow
    wide /= np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    group = np.stack([rows["pass"].to_numpy(), pd.factorize(rows["label"])[0]], axis=1)
    return group, rows["node"].to_numpy(np.int64), wide


def _link_rows(links: pd.DataFrame) -> pd.DataFrame:
    nulls = {c: pd.array([pd.NA] * len(links), "Int64") for c in ("border", "side", "at", "pass", "bits", "node")}
    return links.assign(**nulls, label=None, v=None)


def _border(rows: pd.DataFrame, border: int, side: int, at: int) -> pd.DataFrame:
    rows = rows.assign(border=border, side=side, at=np.arange(at, at + len(rows)))
    return rows.assign(**{c: pd.array([pd.NA] * len(rows), "Int64") for c in ("a", "b", "far")})
