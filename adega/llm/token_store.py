"""Token ids in a compact binary file format.

Ids are replaced by their frequency rank in the corpus, so that the commonest 256
take one byte; ranks are written byte-aligned with 1 to 4 bytes each, and the
byte counts go to separate control bytes (four 2-bit codes a byte).  A reader
looks the control bytes up in a table of 256 x 4 lengths and gathers the data
bytes with numpy; no loop runs over ids.

A token file is a folder: ``blocks`` (Parquet; a row is a block of whole documents
with binary ``control`` and ``data``), ``ranks`` (rank -> id) and ``shards`` (ids
before each task's blocks).  All are written and read by Spark, so the folder can
be in any store that Spark reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adega.llm.common import one_by_one
from adega.llm.token_ids import encoder, vocabulary_size
from adega.session import scratch_path

#: ids after which a block ends (a longer document has a block of its own)
BLOCK_IDS = 1 << 18

#: bytes of a worker's cache of encoded pieces
CACHE_BYTES = 112 << 20

#: bytes of texts encoded at once (a longer text alone)
SLICE_BYTES = 5 << 20

#: control byte -> byte counts of its four ranks
_COUNTS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Ranks (unsigned, below 2**32) -> (control bytes, data bytes)."""
    ranks = ranks.astype("<u4", copy=False)
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    width = 2 if len(ranks) and int(ranks.max()) < 1 << 16 else 4
    data = ranks.astype(f"<u{width}", copy=False).view(np.uint8).reshape(-1, width)[np.arange(width) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of :func:`pack_ranks`: ``n`` ranks as uint32."""
    size = _COUNTS[np.frombuffer(control, np.uint8)].ravel()[:n]
    first = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[first].astype(np.uint32)
    for byte in range(1, int(size.max()) if n else 1):
        longer = np.flatnonzero(size > byte)
        out[longer] |= raw[first[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text",
                     doc_id: str = "doc_id") -> None:
    """Encodes every whole ``text`` (null or empty: no ids of its own), appends
    ``end_id`` to each document and writes the token file ``path`` in ascending
    ``doc_id`` order (null ids first, ties by a hash of the text; repeated rows
    are documents of their own).  Only the two named columns are read."""
    spark = docs.sparkSession
    width = 2 if max(vocabulary_size(tokenizer) - 1, end_id) < 1 << 16 else 4
    stage = scratch_path(spark, "llm-token-ids")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], f"<u{width}").tobytes()
        encode_all = encoder(tokenizer, width, CACHE_BYTES).encode_all
        shard, before, names, sizes, out, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        seen = _Counts()
        for batch in one_by_one(batches):
            for part in _slices(batch):
                got, lengths = encode_all(part["text"], end)
                at = 0
                for name, size in zip(part["doc_id"].to_pylist(), lengths.tolist()):
                    names.append(name)
                    sizes.append(size)
                    out.append(got[at: at + size])
                    at += size
                    held += size
                    if held >= BLOCK_IDS:
                        yield _block(shard, before, names, sizes, out, seen)
                        before, names, sizes, out, held = before + held, [], [], [], 0
        if names:
            yield _block(shard, before, names, sizes, out, seen)
        if len(seen.total):  # a row of its own, read without the ids
            yield pa.RecordBatch.from_pylist([{"shard": shard, "before": before, "n_ids": 0, "counts": seen.total.astype("<i8").tobytes()}], _STAGED)

    schema = "shard int, before long, n_ids long, doc_ids array<bigint>, sizes array<int>, ids binary, counts binary"
    ranged.mapInArrow(ids, schema).write.parquet(stage)
    staged = spark.read.schema(schema).parquet(stage)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = _Counts()
        for batch in batches:
            for raw in batch["counts"]:
                seen.add(np.frombuffer(raw, "<i8"))
        here = np.flatnonzero(seen.total)
        yield pd.DataFrame({"id": here, "n": seen.total[here]})

    # one row per id of the vocabulary at most
    by_count = Window.orderBy(F.desc("n"), "id")
    (staged.where("counts is not null").select("counts").mapInPandas(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
     .select((F.row_number().over(by_count) - 1).cast("long").alias("rank"), "id").coalesce(1).write.parquet(f"{path}/ranks"))
    ranked = _ids_by_rank(spark, path)
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [pack_ranks(rank_of[_staged(raw, n)]) for raw, n in zip(batch["ids"], batch["n_ids"])]
            batch = batch.drop(columns="ids")
            batch["control"], batch["data"] = [c for c, _ in pairs], [d for _, d in pairs]
            yield batch

    schema = "shard int, before long, n_ids long, doc_ids array<bigint>, sizes array<int>, control binary, data binary"
    staged = staged.where("ids is not null").drop("counts")
    staged.mapInPandas(coded, schema).write.parquet(f"{path}/blocks")
    running = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    (staged.groupBy("shard").agg(F.sum("n_ids").alias("n"))
     .select("shard", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("shard_start"))
     .coalesce(1).write.parquet(f"{path}/shards"))


class _Counts:
    """Occurrences by id, an array as long as the vocabulary at most."""

    def __init__(self) -> None:
        self.total = np.zeros(0, np.int64)

    def add(self, more: np.ndarray) -> None:
        if len(more) > len(self.total):
            self.total = np.append(self.total, np.zeros(len(more) - len(self.total), np.int64))
        self.total[: len(more)] += more


def _staged(raw: bytes, n: int) -> np.ndarray:
    """Ids of a staged block: two or four bytes each."""
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have ``SLICE_BYTES`` at most, or one row."""
    ends = np.append(0, pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).cumsum(dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


_STAGED = pa.schema([("shard", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                     ("sizes", pa.list_(pa.int32())), ("ids", pa.binary()), ("counts", pa.binary())])


def _block(shard, before, names, sizes, out, seen: _Counts) -> pa.RecordBatch:
    ids = np.concatenate(out)
    seen.add(np.bincount(ids))
    return pa.RecordBatch.from_pylist([{"shard": shard, "before": before, "n_ids": len(ids), "doc_ids": names, "sizes": sizes, "ids": ids.tobytes()}], _STAGED)


def _ids_by_rank(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.schema("rank long, id long").parquet(f"{path}/ranks").collect()  # the vocabulary bounds it
    out = np.zeros(len(rows), np.int64)
    for rank, name in rows:
        out[rank] = name
    return out


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token file: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers)."""
    ids_of = _ids_by_rank(spark, path).astype(np.uint32)
    blocks = spark.read.parquet(f"{path}/blocks")

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = ids_of[unpack_ranks(row.control, row.data, row.n_ids)].astype("<u4").tobytes()
                sizes = np.asarray(row.sizes, np.int64)
                ends = np.cumsum(sizes)
                yield pd.DataFrame({
                    "doc_id": pd.array([None if x is None or x != x else int(x) for x in row.doc_ids], "Int64"),
                    "start": row.start + ends - sizes, "n_tokens": sizes, "ids": [ids[4 * a: 4 * b] for a, b in zip(ends - sizes, ends)]})

    shards = spark.read.parquet(f"{path}/shards")  # as many rows as tasks wrote; the planner checks the file's size
    return blocks.join(shards, "shard").select(
        (F.col("shard_start") + F.col("before")).alias("start"), "n_ids", "doc_ids", "sizes", "control", "data",
    ).mapInPandas(decoded, "doc_id long, start long, n_tokens long, ids binary")
