"""Whitening of embeddings by shifted Cholesky QR.

The distinct integer vectors are centred exactly (``(n * x - S) / n`` from whole
numbers).  A pass adds up the Gram matrix of the rows, task by task and then by entry;
its Cholesky factor R orthogonalises the rows by a triangular solve, and the next pass
measures what is left.  The first factor is that of a shifted Gram matrix, so it exists
however badly conditioned the rows are; a later one is shifted only if it doesn't exist
(dependent dimensions).  Composed, the factors have the rows' own singular values and
right singular vectors, without ever squaring their condition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adega.llm.common import stored
from adega.llm.vectors import usable

#: vectors of a block at most, and components that a block of long ones holds
BLOCK, BLOCK_VALUES = 4096, 1 << 20
#: whole numbers stay below, so that n * x fits 64 bits for 2**35 rows
LARGEST = 1 << 27
#: rows are orthonormal when no entry of their Gram matrix is further from the identity's
ORTHONORMAL = 1e-12
#: Gram passes at most; only dependent dimensions need more than three or four
PASSES = 6
#: a component with a smaller share of the largest singular value has no variance
NOTHING = 1e-11


@dataclass
class Whitening:
    """``n`` distinct vectors with ``sums`` per dimension; ``components`` (dimension,
    component) of unit length with variances ``values``, and shares ``explained``;
    ``identity_error`` of the whitened fit rows' covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows @ inverse(r)`` for an upper triangular ``r``, by substitution."""
    out = np.empty_like(rows)
    for j in range(len(r)):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def cholesky(gram: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper triangular R with R'R = gram, plus a shift of the Gram matrix's rounding
    error if asked for, or if there is none without."""
    d = len(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (BLOCK * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.trace(gram)
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def _whole(batch: pa.RecordBatch, column: str, scale: float) -> np.ndarray:
    """floor(scale * c) of a column of vectors."""
    v = batch.column(column)
    if len(set(np.diff(np.asarray(v.offsets)).tolist())) > 1:
        raise ValueError("vectors of different lengths")
    x = np.floor(np.asarray(v.flatten(), float).reshape(len(batch), -1) * scale)
    if np.abs(x).max(initial=0) >= LARGEST:
        raise ValueError(f"components beyond {LARGEST} / {scale:g}")
    return x.astype("<i4")


def _fit_blocks(rows: DataFrame, scale: float) -> DataFrame:
    """Each distinct integer vector once, in blocks ``n, x`` (binary)."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _whole(batch, "v", scale)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            size = max(64, min(BLOCK, BLOCK_VALUES // max(1, len(x[0].as_py()) // 4))) if len(x) else 1
            for at in range(0, len(x), size):
                part = x[at: at + size].to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), pa.array([b"".join(part)], pa.binary())], names=["n", "x"])

    return rows.select("v").mapInArrow(keys, "x binary").distinct().mapInArrow(blocks, "n int, x binary")


def _summed(fit: DataFrame, terms, kind: str) -> np.ndarray:
    """Elementwise sum of ``terms(integer rows)`` over all blocks: within each task, then
    by place over the tasks.  The driver gets as many rows as places."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, raw in zip(batch.column("n"), batch.column("x")):
                got = terms(np.frombuffer(raw.as_py(), "<i4").reshape(n.as_py(), -1).astype(np.int64)).ravel()
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

    added = fit.mapInArrow(work, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(added), np.int64 if kind == "long" else float)
    for r in added:
        out[r["at"]] = r["value"]
    return out


def fit_whitening(vectors: DataFrame, components: int = 16, scale: float = 64.0, embedding: str = "embedding") -> Whitening | None:
    """Whitening of the distinct vectors ``floor(scale * c)``, covariances with divisor
    n; none for a table without usable vectors.

    Null and empty vectors and those with null or non-finite components are left out;
    the others must have one length and components below 2**27 / ``scale``, anything
    else fails the job.  Components are numbered by falling variance; each one's largest
    entry is positive.  Those without variance (a single vector, dependent dimensions)
    don't exist.  The passes run when this function is called."""
    rows = vectors.where(usable(F.col(embedding))).select(F.col(embedding).cast("array<double>").alias("v"))
    fit = stored(_fit_blocks(rows, scale), "whitening-fit")
    sizes = fit.select((F.octet_length("x") / F.lit(4) / F.col("n")).alias("d")).distinct().limit(2).collect()
    if not sizes:
        return None
    if len(sizes) > 1:
        raise ValueError("vectors of different lengths")
    *sums, n = _summed(fit, lambda x: np.append(x.sum(axis=0), len(x)), "long").tolist()
    sums, d = np.array(sums, np.int64), len(sums)

    def centred(x: np.ndarray) -> np.ndarray:
        return (n * x - sums) / n

    factors: list[np.ndarray] = []
    for turn in range(PASSES):
        def gram_of(x: np.ndarray, done=tuple(factors)) -> np.ndarray:
            q = centred(x)
            for r in done:
                q = solve(q, r)
            return q.T @ q

        gram = _summed(fit, gram_of, "double").reshape(d, d)
        gram = (gram + gram.T) / 2
        if not np.trace(gram) > 0 or np.abs(gram - np.eye(d)).max() <= ORTHONORMAL:
            break
        if turn + 1 < PASSES:
            factors.append(cholesky(gram, shifted=turn == 0))
    # what the last pass left: a root of its Gram matrix, near the identity if all is well
    left, turned = np.linalg.eigh(gram)
    r = np.sqrt(np.maximum(left, 0))[:, None] * turned.T
    for factor in reversed(factors):
        r = r @ factor
    _, singular, axes = np.linalg.svd(r)
    kept = min(components, int((singular > NOTHING * singular[0]).sum())) if singular[0] > 0 else 0
    axes = axes[:kept].T * np.sign(axes[np.arange(kept), np.abs(axes[:kept]).argmax(axis=1)])
    values = singular ** 2 / n
    model = Whitening(n, sums, axes, values[:kept], values[:kept] / values.sum() if kept else values[:0], 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        z = centred(x) @ (axes / np.sqrt(model.values))
        return np.append(z.T @ z, z.sum(axis=0))

    if kept:
        seen = _summed(fit, moments, "double")
        mean = seen[kept * kept:] / n
        covariance = seen[: kept * kept].reshape(kept, kept) / n - np.outer(mean, mean)
        model.identity_error = float(np.abs(covariance - np.eye(kept)).max())
    return model


def whiten(vectors: DataFrame, model: Whitening, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per usable row: ``vec_id``, ``deviation`` (decimal: the exact sum over dimensions
    of ``(n * x - S) ** 2``) and ``whitened`` (array<double>, one value a component).

    Rows that :func:`fit_whitening` leaves out have none; repeated rows and null ids are
    rows like others.  Only the two columns named are read."""
    n, sums = model.n, model.sums
    to = model.components / np.sqrt(model.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(64, min(BLOCK, BLOCK_VALUES // max(1, len(sums))))
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                apart = n * _whole(part, "v", scale).astype(np.int64) - sums
                if float(np.abs(apart).max()) ** 2 * len(sums) < 2 ** 62:
                    deviation = pa.array(np.square(apart).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    from decimal import Decimal

                    deviation = pa.array([Decimal(sum(v * v for v in row)) for row in apart.tolist()], pa.decimal128(38, 0))
                white = (apart / n) @ to
                offsets = np.arange(len(part) + 1, dtype=np.int32) * white.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), deviation, pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel()))],
                    names=["vec_id", "deviation", "whitened"])

    rows = vectors.where(usable(F.col(embedding))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.mapInArrow(work, "vec_id long, deviation decimal(38,0), whitened array<double>")
