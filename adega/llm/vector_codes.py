"""Vector code compression: product codes by bounded k-means on whole numbers.

Vectors become integers and are cut into equal parts; every part position has a
codebook.  A round assigns each part to its codebook's nearest entry and moves the
entries to the floored means of their parts.

Between rounds each part keeps an upper bound of the distance to its entry, its ``b``
next closest entries with ordered lower bounds, and one outer bound for all others.
When entries move, bounds move by as much; a part whose upper bound stays below its
first lower bound keeps its entry without a distance.  Others are measured in exact
integers: first their own entry, then the listed entries that the bounds don't rule
out, and all entries only beyond the outer bound.  ``b`` follows the number of listed
entries that a round needed, part position by part position.

Rows travel as blocks of vectors (binary integers and bounds) that each round writes
to the shared folder; per round the driver sees sums per entry and a count per list
length, whose number doesn't grow with the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adega.llm.common import removed, stored_at
from adega.llm.vectors import usable

#: vectors of a block at most, and components that a block of long ones holds
BLOCK, BLOCK_VALUES = 4096, 1 << 20
#: rows with one label that meet their label's total in one group: about 1 / SALT of them
SALT = 32
#: integers stay below, so that squares, sums of rows and distances fit 64 bits
LARGEST = 1 << 26
#: share of the measured parts that a list should be long enough for
SETTLED = 0.98


@dataclass
class Codebooks:
    """``entries`` (part, entry, place) and, per part, how far each entry moved."""

    entries: np.ndarray
    moved: np.ndarray  # (part, entry), rounded up

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (row, entry) of integer rows."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for place in range(x.shape[1]):
        out += np.square(x[:, place, None] - entries[None, :, place])
    return out


class Bounds:
    """Assignment and bounds of the vectors of a block at one part position."""

    def __init__(self, entry: np.ndarray, upper: np.ndarray, listed: np.ndarray, lower: np.ndarray):
        self.entry, self.upper, self.listed, self.lower = entry, upper, listed, lower  # lower: b listed ones, then the outer bound

    @classmethod
    def fresh(cls, distances: np.ndarray, b: int) -> Bounds:
        """Bounds of rows whose squared distances to all entries are known."""
        order = np.argsort(distances, axis=1, kind="stable")  # ties to the lower index
        near = np.sqrt(np.take_along_axis(distances, order[:, : b + 2], axis=1).astype(float))
        if near.shape[1] < b + 2:  # no entry beyond the list
            near = np.concatenate([near, np.full((len(near), b + 2 - near.shape[1]), np.inf)], axis=1)
        return cls(order[:, 0].astype(np.uint8), _up(near[:, 0]), order[:, 1: b + 1].astype(np.uint8), _down(near[:, 1:]))

    def put(self, rows: np.ndarray, new: Bounds) -> None:
        self.entry[rows], self.upper[rows], self.listed[rows], self.lower[rows] = new.entry, new.upper, new.listed, new.lower

    def cut(self, b: int) -> Bounds:
        """A list of ``b`` entries; those left out come under the outer bound."""
        if b >= self.listed.shape[1]:
            return self
        outer = self.lower[:, b:].min(axis=1, keepdims=True)
        return Bounds(self.entry, self.upper, self.listed[:, :b], np.concatenate([self.lower[:, :b], outer], axis=1))

    def follow(self, x: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> np.ndarray:
        """New assignment after the entries moved; how many rows needed how many
        listed entries (index b + 1: all entries)."""
        b = self.listed.shape[1]
        needed = np.zeros(b + 2, np.int64)
        self.upper = _up(self.upper + _up(moved[self.entry]))
        self.lower[:, :b] = _down(self.lower[:, :b] - _up(moved[self.listed]))
        self.lower[:, b] = _down(self.lower[:, b] - _up(moved.max(keepdims=True)))
        # ordered again: nothing from a place on is closer than the place's bound
        self.lower = np.minimum.accumulate(self.lower[:, ::-1], axis=1)[:, ::-1].copy()
        open_ = np.flatnonzero(self.upper >= self.lower[:, 0])
        needed[0] += len(x) - len(open_)
        own = np.square(x[open_] - entries[self.entry[open_]]).sum(axis=1)
        self.upper[open_] = _up(np.sqrt(own.astype(float)))
        reach = (self.lower[open_] <= self.upper[open_, None]).sum(axis=1)  # bounds are ordered
        needed += np.bincount(reach, minlength=b + 2)
        far = open_[reach == b + 1]
        if len(far):
            self.put(far, Bounds.fresh(squared(x[far], entries), b))
        for n in range(1, b + 1):
            rows = open_[reach == n]
            if not len(rows):
                continue
            # the own entry and the first n listed ones, exactly; the rest is ruled out
            names = np.concatenate([self.entry[rows, None], self.listed[rows, :n]], axis=1)
            exact = np.square(x[rows, None, :] - entries[names]).sum(axis=2)
            order = np.lexsort((names, exact), axis=1)
            names, exact = np.take_along_axis(names, order, axis=1), np.take_along_axis(exact, order, axis=1)
            far_bound = self.lower[rows, n:].min(axis=1, keepdims=True)
            self.entry[rows] = names[:, 0]
            self.upper[rows] = _up(np.sqrt(exact[:, 0].astype(float)))
            self.listed[rows, :n] = names[:, 1:]
            self.lower[rows, :n] = np.minimum(_down(np.sqrt(exact[:, 1:].astype(float))), far_bound)
        return needed


def _pack(bounds: list[Bounds]) -> tuple[bytes, bytes, bytes]:
    """Entries (part by part), listed entries, bounds (upper, then lower ones)."""
    return (b"".join(p.entry.tobytes() for p in bounds), b"".join(p.listed.tobytes() for p in bounds),
            b"".join(p.upper.tobytes() + p.lower.astype(np.float32).tobytes() for p in bounds))


def _unpack(entries: bytes, listed: bytes, bounds: bytes, n: int, widths: list[int]) -> list[Bounds]:
    entry = np.frombuffer(entries, np.uint8).reshape(len(widths), n)
    flat, real, out, i, j = np.frombuffer(listed, np.uint8), np.frombuffer(bounds, np.float32), [], 0, 0
    for part, b in enumerate(widths):
        lower = real[j + n: j + n * (b + 2)].reshape(n, b + 1)
        out.append(Bounds(entry[part].copy(), real[j: j + n].copy(), flat[i: i + n * b].reshape(n, b).copy(), lower.copy()))
        i, j = i + n * b, j + n * (b + 2)
    return out


def _wide(raw: bytes, n: int, parts: int) -> np.ndarray:
    """Integers of a block: (part, row, place)."""
    return np.frombuffer(raw, f"<i{raw[0]}", offset=8).reshape(n, parts, -1).astype(np.int64).transpose(1, 0, 2)


def _blocks(rows: DataFrame, scale: float, parts: int, ids: str) -> DataFrame:
    """Rows -> blocks: arrays of names and labels, binary integers."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widest = max((len(v) for v in batch.column("v")), default=1)
            size = max(64, min(BLOCK, BLOCK_VALUES // widest))
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                v = part.column("v")
                sizes = np.diff(np.asarray(v.offsets))
                if len(set(sizes.tolist())) > 1:
                    raise ValueError("vectors of different lengths")
                x = np.floor(np.asarray(v.flatten(), float).reshape(len(part), -1) * scale)
                if x.shape[1] % parts:
                    raise ValueError(f"vectors of {x.shape[1]} components can't be cut into {parts} equal parts")
                if np.abs(x).max(initial=0) >= LARGEST:
                    raise ValueError(f"components beyond {LARGEST} / {scale:g}")
                kind = "<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<i4"
                raw = bytes([int(kind[2])]) + b"\0" * 7 + x.astype(kind).tobytes()
                one = np.array([0, len(part)], np.int32)
                names = [pa.ListArray.from_arrays(pa.array(one), part.column(c)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(part)], pa.int32()), pa.array([x.shape[1]], pa.int32()), *names, pa.array([raw], pa.binary())],
                    names=["n", "dim", "vec_ids", "labels", "x"])

    label = dict(rows.dtypes)["label"]
    return rows.mapInArrow(work, f"n int, dim int, vec_ids array<{ids}>, labels array<{label}>, x binary")


def _rounds(blocks: DataFrame, books: Codebooks, widths: list[int] | None, next_widths: list[int], kinds: tuple[str, str]) -> DataFrame:
    """Blocks with the assignment to ``books``; ``sums`` (part, entry, place and count)
    and ``needed`` (part, list length) of each block."""
    parts, k, _ = books.entries.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                n = one.column("n")[0].as_py()
                x = _wide(one.column("x")[0].as_py(), n, parts)
                needed = np.zeros((parts, k + 2), np.int64)
                if widths is None:
                    state = [Bounds.fresh(squared(x[p], books.entries[p]), next_widths[p]) for p in range(parts)]
                else:
                    old = _unpack(*(one.column(c)[0].as_py() for c in ("entries", "listed", "bounds")), n, widths)
                    state = []
                    for p in range(parts):
                        if next_widths[p] > widths[p]:  # a longer list needs all distances
                            state.append(Bounds.fresh(squared(x[p], books.entries[p]), next_widths[p]))
                            needed[p, 0] = n
                            continue
                        state.append(old[p].cut(next_widths[p]))
                        got = state[p].follow(x[p], books.entries[p], books.moved[p])
                        needed[p, : len(got) - 1] = got[:-1]
                        needed[p, k + 1] = got[-1]
                sums = np.zeros((parts, k, x.shape[2] + 1), np.int64)
                for p in range(parts):
                    for place in range(x.shape[2]):
                        # doubles are exact here: a block's sums stay below 2**53
                        sums[p, :, place] = np.bincount(state[p].entry, x[p, :, place], k).astype(np.int64)
                    sums[p, :, -1] = np.bincount(state[p].entry, minlength=k)
                error = sum(np.square(x[p] - books.entries[p][state[p].entry]).sum(axis=1) for p in range(parts))
                made = [*_pack(state), error.astype("<i8").tobytes(), sums.tobytes(), needed.tobytes()]
                yield pa.RecordBatch.from_arrays([one.column(c) for c in ("n", "dim", "vec_ids", "labels", "x")] + [pa.array([m], pa.binary()) for m in made],
                                                 names=["n", "dim", "vec_ids", "labels", "x", "entries", "listed", "bounds", "errors", "sums", "needed"])

    ids, label = kinds
    schema = (f"n int, dim int, vec_ids array<{ids}>, labels array<{label}>, x binary, entries binary, listed binary, "
              "bounds binary, errors binary, sums binary, needed binary")
    return blocks.select("n", "dim", "vec_ids", "labels", "x", *(["entries", "listed", "bounds"] if widths is not None else [])).mapInArrow(work, schema)


def _totals(assigned: DataFrame, column: str) -> np.ndarray:
    """Elementwise sum of a binary column of 64-bit integers, task by task first."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0):
                got = np.frombuffer(raw.as_py(), np.int64)
                total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(np.full(len(at), len(total)))], names=["at", "n", "size"])

    # parts x entries x (places + 1) rows at most
    rows = assigned.select(column).mapInArrow(work, "at long, n long, size long").groupBy("at", "size").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(rows[0]["size"] if rows else 0, np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return out


def next_width(needed: np.ndarray, width: int, k: int) -> int:
    """List length for the next round: the shortest that would have served nearly all
    parts that were measured, at least ``k / 8``; lists only get shorter, except that
    one which sent too many parts to all entries doubles, to ``k / 2`` at most."""
    measured = needed[1: width + 1].sum() + needed[-1]
    least = max(1, k // 8)
    if not measured:
        return max(least, min(width, k - 1))
    if needed[-1] > (1 - SETTLED) * needed.sum():
        return min(max(2 * width, least), max(1, k // 2), k - 1)
    served = np.cumsum(needed[1: width + 1]) + needed[0]
    enough = int(np.searchsorted(served, SETTLED * (needed.sum() - needed[-1]))) + 1
    return min(max(enough, least), width)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, vec_id: str = "vec_id",
             embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks]:
    """Per kept row: ``vec_id``, ``label``, ``code`` (binary, one byte a part) and
    ``error`` (squared distance to the entries, summed over parts); and the codebooks.

    Rows whose vector is null, empty or holds null or non-finite components are dropped.
    Codebooks start as the parts of the ``entries`` smallest vec_ids (null ids last,
    equal ids by their vectors), of all rows if there are fewer; an entry without parts
    stays.  Ties go to the lower entry.  Repeated rows count as rows, null ids and
    labels are kept.  Vectors must have one length, a multiple of ``parts``, and
    components below 2**26 / ``scale``: anything else fails the job.  Only the three
    columns named are read; an empty table gives no rows and empty codebooks.  All
    arithmetic that decides is on integers, so results don't depend on task order.
    The rounds run when this function is called."""
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    rows = vectors.where(usable(F.col(embedding))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    kinds = ("bigint", dict(rows.dtypes)["label"])
    first = [np.floor(np.array(r["v"]) * scale) for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    if not first:
        empty = rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        return empty, Codebooks(np.zeros((parts, 0, 0), np.int64), np.zeros((parts, 0)))
    if len({len(f) for f in first}) > 1 or len(first[0]) % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    if np.abs(np.stack(first)).max(initial=0) >= LARGEST:
        raise ValueError(f"components beyond {LARGEST} / {scale:g}")
    start = np.stack(first).astype(np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    k = len(first)
    books = Codebooks(start, np.zeros((parts, k)))
    (state, path), widths = stored_at(_blocks(rows, scale, parts, "bigint"), "code-blocks"), None
    if state.where(F.col("dim") != len(first[0])).limit(1).count():
        raise ValueError("vectors of different lengths")
    new = [min(max(1, k // 4), max(0, k - 1))] * parts
    for turn in range(rounds + 1):
        before = path
        state, path = stored_at(_rounds(state, books, widths, new, kinds), "code-rounds")
        removed(vectors.sparkSession, before)  # the round is written: nothing refers to the rows before it
        widths = new
        if turn == rounds:
            break
        sums = _totals(state, "sums").reshape(parts, k, -1)
        count = sums[:, :, -1:]
        moved = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books.entries)  # // goes down
        if turn and k > 1:
            needed = _totals(state, "needed").reshape(parts, k + 2)
            new = [next_width(np.append(n[: w + 1], n[k + 1]), w, k) for n, w in zip(needed, widths)]
        step = np.sqrt(np.square(moved - books.entries).sum(axis=2).astype(float))
        books = Codebooks(moved, np.nextafter(step, np.inf))
    return _codes(state, parts, kinds), books


def _codes(state: DataFrame, parts: int, kinds: tuple[str, str]) -> DataFrame:
    """Blocks -> rows."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n = batch.column("n")[i].as_py()
                codes = np.frombuffer(batch.column("entries")[i].as_py(), np.uint8).reshape(parts, n).T.tobytes()
                errors = np.frombuffer(batch.column("errors")[i].as_py(), "<i8")
                code = pa.array([codes[a: a + parts] for a in range(0, n * parts, parts)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_ids")[i].values, batch.column("labels")[i].values, code, pa.array(errors)],
                                                 names=["vec_id", "label", "code", "error"])

    ids, label = kinds
    return state.select("n", "vec_ids", "labels", "entries", "errors").mapInArrow(
        work, f"vec_id {ids}, label {label}, code binary, error long")


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the errors summed over rows of equal label (nulls
    together).  A label's total is given to ``SALT`` groups, so that a label that holds
    a large share of the rows isn't one group of the join."""
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = totals.select(F.col("label").alias("total_of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("total_salt"))
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALT)).cast("int"))
    met = salted.join(totals, F.col("label").eqNullSafe(F.col("total_of")) & (F.col("salt") == F.col("total_salt")))
    return met.drop("total_of", "total_salt", "salt")


def decoded(codes: DataFrame, books: Codebooks, scale: float = 4096.0) -> DataFrame:
    """``codes`` with ``vector`` (array<double>), the entries that a code names."""
    table = books.entries / scale

    @F.pandas_udf("array<double>")
    def vector(column):
        return column.map(lambda c: [x for p, e in enumerate(c) for x in table[p, e]])

    return codes.withColumn("vector", vector("code"))


def codebooks_sha256(books: Codebooks) -> str:
    return hashlib.sha256(books.text().encode()).hexdigest()
