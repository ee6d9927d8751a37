"""Main-text extraction with a linear-chain conditional random field.

A page's leaf blocks are a sequence with two labels, article and furniture.  Block
features (ancestor tags, names of classes and ids, text) and label transitions have
weights that maximise the conditional likelihood of labelled pages; a page's labels
are decoded by Viterbi, and the article's blocks are its main text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adega.llm.blocks import page_blocks
from adega.llm.common import free_name
from adega.llm.labelled_pages import labelled_pages


@dataclass(frozen=True)
class ChainModel:
    """``weights``: feature -> advantage of label 1 (article); ``step[i][j]``:
    transition from label i to j."""

    weights: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, features: Sequence[Sequence[str]]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi); ties go to label 0."""
        (s00, s01), (s10, s11) = self.step
        get, back = self.weights.get, []
        a = b = 0.0  # best scores of paths that end in label 0 and 1
        for k, block in enumerate(features):
            own = sum(get(f, 0.0) for f in block)
            if k:
                to0, to1 = a + s00 >= b + s10, a + s01 >= b + s11  # from label 0?
                back.append((0 if to0 else 1, 0 if to1 else 1))
                a, b = (a + s00 if to0 else b + s10), (a + s01 if to1 else b + s11) + own
            else:
                b = own
        if not features:
            return []
        out = [1 if b > a else 0]
        for come in reversed(back):
            out.append(come[out[-1]])
        return out[::-1]


def train_chain(pages: Sequence[tuple[Sequence[Sequence[str]], Sequence[int]]], rounds: int = 150, rate: float = 0.3,
                penalty: float = 0.02) -> ChainModel:
    """Maximises the penalised conditional log-likelihood of labelled sequences
    (features per block, labels per block) by adaptive gradient ascent; all pages
    go through the forward and backward recursions at once."""
    pages = [p for p in pages if len(p[1])]
    names = sorted({f for blocks, _ in pages for block in blocks for f in block})
    number = {f: k for k, f in enumerate(names)}
    longest = max(len(y) for _, y in pages)
    ids, where, labels = [], [], np.full((len(pages), longest), -1)
    for p, (blocks, y) in enumerate(pages):
        labels[p, : len(y)] = y
        for t, block in enumerate(blocks):
            ids += [number[f] for f in block]
            where += [p * longest + t] * len(block)
    ids, where, real = np.array(ids), np.array(where), labels >= 0
    flat = real.ravel()
    w, step = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros(len(names) + 4), np.zeros(len(names) + 4)]
    seen = np.zeros((2, 2))
    pair = real[:, 1:]
    np.add.at(seen, (labels[:, :-1][pair], labels[:, 1:][pair]), 1)
    for turn in range(1, rounds + 1):
        score = np.zeros((len(pages), longest, 2))
        score[..., 1] = np.bincount(where, w[ids], len(pages) * longest).reshape(len(pages), longest)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            go = np.logaddexp(forward[:, t - 1, :1] + step[0], forward[:, t - 1, 1:] + step[1]) + score[:, t]
            forward[:, t] = np.where(real[:, t, None], go, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            on = score[:, t + 1] + backward[:, t + 1]
            go = np.logaddexp(step[:, 0] + on[:, :1], step[:, 1] + on[:, 1:])
            backward[:, t] = np.where(real[:, t + 1, None], go, 0.0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        chance = np.exp(forward[..., 1] + backward[..., 1] - total[:, None])
        grad = np.bincount(ids, ((labels == 1).ravel() - chance.ravel() * flat)[where], len(names))
        expected = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                p = np.exp(forward[:, :-1, i] + step[i, j] + score[:, 1:, j] + backward[:, 1:, j] - total[:, None])
                expected[i, j] = p[pair].sum()
        g = np.concatenate([grad - penalty * w, (seen - expected - penalty * step).ravel()]) / len(pages)
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = rate * (moments[0] / (1 - 0.9 ** turn)) / (np.sqrt(moments[1] / (1 - 0.99 ** turn)) + 1e-8)
        w, step = w + move[:-4], step + move[-4:].reshape(2, 2)
    return ChainModel(dict(zip(names, w.tolist())), tuple(map(tuple, step.tolist())))


@lru_cache(maxsize=4)
def default_model(n_pages: int = 900, seed: int = 1) -> ChainModel:
    """The model learnt from ``n_pages`` of the labelled pages."""
    pages = []
    for html, main in labelled_pages(n_pages, seed):
        blocks = page_blocks(html)
        pages.append(([b.features for b in blocks], [int(b.text in main) for b in blocks]))
    return train_chain(pages)


def main_text(html: str | None, model: ChainModel) -> str:
    """The article's blocks, in page order, joined by line feeds."""
    blocks = page_blocks(html)
    return "\n".join(b.text for b, keep in zip(blocks, model.decode([b.features for b in blocks])) if keep)


def extract(pages: DataFrame, html: str = "html", model: ChainModel | None = None) -> DataFrame:
    """``pages`` plus ``text``, the main text of each whole page, and ``n_chars``, its
    length in code points.

    A null, empty or text-less page, and one without an article, has the empty text.
    Equal pages have equal texts.  Other columns pass through; a new column whose
    name is taken gets a trailing underscore.  An empty table stays empty."""
    chain = model or default_model()

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, chain) for h in column], dtype=object)

    text = free_name(pages, "text")
    return pages.withColumn(text, texts(F.col(html))).withColumn(free_name(pages, "n_chars"), F.char_length(text).cast("long"))
