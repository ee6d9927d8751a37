"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Documents longer than a sequence are cut into full pieces; every other document
stays whole.  Pieces are matched to gaps by decreasing length.  The sorted order of
pieces and gaps is held as runs (size, how many): a sequence has at most
``capacity`` distinct lengths, so the runs stay small whatever the number of
documents.  A superstep takes all pieces of one length, sweeps the gap runs for
their successors (the smallest gap that still fits), gives gaps to pieces by rank
and updates the gaps; what no gap takes opens new sequences.  The pieces
themselves never meet the driver: each gets its rank among the pieces of its
length by a distributed two-level count, and looks up the run that its rank is in.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adega.llm.common import constant_rows, one_by_one, stored
from adega.llm.token_ids import encoder

#: bytes of a worker's cache of encoded pieces
CACHE_BYTES = 64 << 20
#: pieces of one length that a rank block holds on average
BLOCK_ROWS = 20_000


def best_fit_runs(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Supersteps over runs.  ``counts``: pieces per length (1 to ``capacity``).

    Returns the slots in order of (length, start): the pieces of ``length`` with
    ranks from ``start`` (``n`` of them) go, ``per`` in a row, to the sequences
    from ``sequence`` on, the first of a row at ``offset``."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, sequences)
    sizes: list[int] = []  # gaps that have runs, ascending
    slots: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def add(gap: int, run: tuple[int, int]) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append(run)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):  # the successor: the smallest gap that fits
                gap = sizes[at]
                first, n = gaps[gap].pop()
            else:  # no gap fits: new sequences
                gap, first, n = capacity, sequences, left
            # what is left of a gap is the next piece's successor while it fits: gaps are filled in turn
            per = min(gap // length, left)
            used = min(n, left // per)
            take = used * per
            if gap == capacity:
                sequences += used
            else:
                if used < n:
                    gaps[gap].append((first + used, n - used))
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            slots.append((length, rank, take, first, per, capacity - gap))
            add(gap - per * length, (first, used))
            left, rank = left - take, rank + take
    out = pd.DataFrame(slots, columns=["length", "start", "n", "sequence", "per", "offset"])
    return out.sort_values(["length", "start"], ignore_index=True)


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, text: str = "text", doc_id: str = "doc_id",
             cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Pieces of every whole document: ``doc_id, piece, start, length, ids`` (little-endian
    unsigned 32-bit) and ``ids_crc32``.  A null text is empty: its only id is ``end_id``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        end = np.array([end_id], "<u4").tobytes()
        encode = encoder(tokenizer, bound=cache_bytes).encode
        for batch in one_by_one(batches):
            rows, held = [], 0
            for name, body in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(body.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at: at + 4 * capacity]
                    rows.append((name, k, at // 4, len(part) // 4, part, zlib.crc32(part)))
                held += len(ids)
                if held > 1 << 24:
                    yield _frame(rows)
                    rows, held = [], 0
            if rows:
                yield _frame(rows)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long")


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "ids_crc32": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, text: str = "text",
         doc_id: str = "doc_id", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids, ids_crc32, sequence_id,
    offset``; pieces of a sequence follow each other without gaps from offset 0.

    Only the two named columns are read.  A null or empty text is a document of one
    id, the end id.  Repeated rows and ids are documents of their own; equal pieces
    may change places between runs, their number per sequence layout does not.  An
    empty table gives no pieces.  ``cache_bytes`` bounds each worker's cache."""
    pieces = stored(tokenise(docs, tokenizer, end_id, capacity, text, doc_id, cache_bytes), "pieces")
    return place(pieces, capacity)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``."""
    per_length = pieces.groupBy("length").agg(F.count("*").alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in per_length.collect()}  # capacity rows at most
    slots = best_fit_runs(counts, capacity)
    # pieces of a length are dealt to blocks by hash, so a length that many share is split
    blocks = constant_rows(pieces.sparkSession, [(k, -(-n // BLOCK_ROWS)) for k, n in counts.items()], "length long, blocks long")
    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(mixed, F.col("blocks"))).drop("blocks")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(dealt.groupBy("length", "block").agg(F.count("*").alias("n")).select(
        "length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before")), "piece-ranks")
    rank = F.col("rank_before") + F.row_number().over(
        Window.partitionBy("length", "block").orderBy(mixed, "doc_id", "piece")) - 1
    ranked = dealt.join(offsets, ["length", "block"]).withColumn("rank", rank)
    sequence, offset = _lookup(slots, F.col("length"), F.col("rank"))
    return ranked.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))


def _lookup(slots: pd.DataFrame, length: Column, rank: Column) -> tuple[Column, Column]:
    """Place of the piece with this rank among the pieces of its length."""
    key = (slots["length"].to_numpy(np.int64) << 48) + slots["start"].to_numpy(np.int64)
    start, sequence, per, offset, size = (slots[c].to_numpy(np.int64) for c in ("start", "sequence", "per", "offset", "length"))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(key, (length.to_numpy(np.int64) << 48) + rank.to_numpy(np.int64), "right") - 1
        k = rank.to_numpy(np.int64) - start[at]
        return pd.DataFrame({"sequence_id": sequence[at] + k // per[at], "offset": offset[at] + k % per[at] * size[at]})

    place = slot(length, rank)
    return place["sequence_id"], place["offset"]


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id, n_tokens, doc_ids, ids`` (pieces in place).
    A sequence has one entry of ``doc_ids`` a piece, so a document may appear twice; a null
    id stays null; repeated rows are pieces of their own; no pieces give no sequences."""
    parts = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    return parts.select("sequence_id", "n_tokens", F.col("parts")["doc_id"].alias("doc_ids"), joined.alias("ids"))
