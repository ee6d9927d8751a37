"""Document quality by a regularised quadratic discriminant.

Each document becomes a vector of transformed statistics of its text.  Every class
has a mean and a covariance that is shrunk towards the pooled one and towards a
multiple of the identity; the score is the logistic of the difference of the two
Gaussian log densities, whose Mahalanobis distances use Cholesky factors that are
computed once and sent with the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adega.llm.common import arrow_trimmed, free_name, kept_by_process, stored

FEATURES = ("words", "word_length", "upper_words", "marks", "bangs", "bars", "vocabulary", "stutter", "line_length", "digits", "stops",
            "worst")


def _share(k: float, n: float) -> float:
    """A share as a logit, drawn towards 1 in 100 by 20 counts: short texts say little."""
    return float(np.log((k + 0.2) / (max(n - k, 0) + 19.8)))


def text_statistics(text: str | None) -> tuple[float, ...]:
    """The transformed statistics of one whole text; null counts as empty, for
    which every statistic is defined."""
    text = text or ""
    words = text.split()
    n, count = len(words), text.count
    marks = sum(map(count, "*$%&#^~<>{}="))
    bangs, bars = count("!"), count("|")
    upper = sum(map(str.isupper, words))
    stutter = sum(map(eq, words, words[1:]))
    shares = [_share(upper, n), _share(marks / 3, n), _share(bangs / 2, n), _share(bars, n), _share(stutter, n)]
    return (
        np.log(n + 20), np.log((len(text) + 120) / (n + 20)), shares[0], shares[1], shares[2], shares[3],
        np.log((n + 10) / (len(set(words)) + 10)), shares[4], np.log((len(text) + 400) / (count("\n") + 3)),
        _share(sum(map(count, "0123456789")), len(text)), _share(count("."), n), max(shares))


@dataclass(frozen=True)
class QualityModel:
    """Two Gaussians and the log prior odds; ``factors`` are inverse Cholesky factors."""

    means: np.ndarray  # 2 x p
    factors: np.ndarray  # 2 x p x p: inverse of L, where covariance = L L'
    log_dets: np.ndarray  # 2
    log_odds: float  # of class 1 before seeing a text

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):  # one class or no labels: the prior is all there is
            return np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))
        log_density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d
                       for m, f, d in zip(self.means, self.factors, self.log_dets)]
        margin = np.clip(log_density[1] - log_density[0] + self.log_odds, -500, 500)
        return 1 / (1 + np.exp(-margin))


def fit_moments(n: np.ndarray, sums: np.ndarray, products: np.ndarray, pool: float, ridge: float) -> QualityModel:
    """The model from each class's count, sum and sum of outer products.

    A class covariance is ``(1 - pool) * own + pool * pooled``, then
    ``(1 - ridge) * that + ridge * mean variance * identity``."""
    empty = np.zeros((0, 0))
    if min(n) < 2:
        return QualityModel(empty, empty, empty, float(np.log((n[1] + 0.5) / (n[0] + 0.5))))
    means = sums / n[:, None]
    own = products / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * n[:, None, None]).sum(axis=0) / n.sum()
    factors, log_dets = [], []
    for c in own:
        c = (1 - pool) * c + pool * pooled
        c = (1 - ridge) * c + ridge * max(np.trace(c) / len(c), 1e-9) * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        log_dets.append(2 * np.log(np.diag(low)).sum())
    return QualityModel(means, np.array(factors), np.array(log_dets), float(np.log(n[1] / n[0])))


def with_statistics(docs: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """``docs`` plus the array of :func:`text_statistics` of each row's whole text."""

    @F.arrow_udf("array<double>")
    def statistics(texts: pa.Array) -> pa.Array:
        kept_by_process(None, None)
        arrow_trimmed()
        return pa.array([[float(x) for x in text_statistics(t.as_py())] for t in texts], pa.list_(pa.float64()))

    return docs.withColumn(name, statistics(F.col(text)))


def labelled(labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", held_out: bool = False) -> DataFrame:
    """(doc_id, label) of the ids to learn from: label 0 or 1, and not held out
    (crc32 of the id as text mod 3 is 1).  An id with contradictory labels is left out."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    agreed = rows.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("other"))
    agreed = agreed.where("label = other").select("doc_id", F.col("label").cast("int").alias("label"))
    return agreed if held_out else agreed.where(~is_held_out(F.col("doc_id")))


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(rows: DataFrame, labels: DataFrame, pool: float = 0.1, ridge: float = 0.01) -> QualityModel:
    """Learns from all rows (``doc_id, statistics``) whose id is in ``labels``
    (``doc_id, label``).  Tasks add up counts, sums and outer products; one row per
    class and moment reaches the driver."""
    p = len(FEATURES)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            x = np.array(batch["statistics"].tolist(), float).reshape(-1, p)
            y = batch["label"].to_numpy()
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pd.DataFrame([(c, k, v) for c in (0, 1) for k, v in enumerate(total[c])], columns=["label", "moment", "value"])

    joined = rows.join(labels, "doc_id").select("statistics", "label")
    sums = np.zeros((2, 1 + p + p * p))
    for r in joined.mapInPandas(moments, "label int, moment int, value double").groupBy("label", "moment").agg(F.sum("value").alias("value")).collect():
        sums[r["label"], r["moment"]] = r["value"]
    return fit_moments(sums[:, 0], sums[:, 1: 1 + p], sums[:, 1 + p:].reshape(2, p, p), pool, ridge)


def with_scores(docs: DataFrame, model: QualityModel, statistics: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` plus ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``
    (1 if score >= 0.5, else 0), from a column of statistics or from the whole text.

    Ids, sources, languages and labels have no part in a score.  A null or empty
    text has the score of a text without words; equal texts have equal scores.  If
    no class, or only one, could be learnt, every score is the smoothed share of
    label 1.  Other columns pass through; a new column whose name is taken gets a
    trailing underscore.  An empty table stays empty."""
    score, predicted = free_name(docs, "score"), free_name(docs, "predicted")

    @F.pandas_udf("double")
    def from_statistics(values: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(values.tolist(), float).reshape(-1, len(FEATURES))))

    @F.arrow_udf("double")
    def from_text(texts: pa.Array) -> pa.Array:
        kept_by_process(None, None)  # texts become Python strings one at a time
        arrow_trimmed()
        return pa.array(model.scores(np.array([text_statistics(t.as_py()) for t in texts], float).reshape(-1, len(FEATURES))))

    value = from_statistics(F.col(statistics)) if statistics else from_text(F.col(text))
    return docs.withColumn(score, value).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id") -> tuple[QualityModel, DataFrame]:
    """The model learnt from all labelled rows that aren't held out, and the stored
    statistics (``doc_id, statistics``) of every row of ``docs``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(with_statistics(rows).drop("text"), "quality-statistics")
    return fit(rows, labelled(labels, label)), rows
