"""SentencePiece ids of whole texts, and texts of ids.

Ids come from the score-ordered agenda of :mod:`adega.llm.piece_model`, a chunk at a
time through a bounded cache.  The chunks that are new to a process are encoded by the
``sentencepiece`` library too, together for a part of an Arrow batch, and compared;
where the two differ, the library's ids hold and ``agrees`` is false.  Decoding is the
library's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adega.llm.common import kept_by_process
from adega.llm.piece_model import MARK, ChunkEncoder, read_vocabulary

#: characters that are encoded, and compared with the library, at a time (a longer text by itself)
BATCH_CHARS = 1 << 20

class Codec:
    """The library's processor and this module's encoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        if not self.library.normalize("a").startswith(MARK):
            raise ValueError(f"{path}: puts no mark before a text")
        self.encoder = ChunkEncoder(read_vocabulary(path))
        self.size = self.library.get_piece_size()

    def roundtrip(self, texts: list[str | None]) -> list[tuple[np.ndarray, str, bool]]:
        """(ids, decoded text, whether agenda and library agree) of each text."""
        sections = [self.encoder.sections(self.library.normalize(t)) if t else [] for t in texts]
        ids = [[self.encoder.encode(s) for s in parts] for parts in sections]
        if not self.encoder.compare(lambda chunks: self.library.encode(chunks, num_threads=1)):
            ids = [[self.encoder.encode(s) for s in parts] for parts in sections]
        out = []
        for parts, got in zip(sections, ids):
            # a section begins with a mark, which the library takes off a decoded text
            text = " ".join([self.library.decode(x.tolist()) for x in got])
            whole = np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32)
            out.append((whole, text, not any(map(self.encoder.mended, parts))))
        return out

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        if any(i is None or not 0 <= i < self.size for i in ids):
            raise ValueError("ids hold a null or no id of the vocabulary")
        return self.library.decode(ids)


def codec(path: str) -> Codec:
    """This process's codec of a model file (Python workers are reused)."""
    return kept_by_process(("codec", path), lambda: Codec(path))


def encode_decode(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id``, ``ids`` (array<int>, no begin or end id), ``n_tokens``,
    ``decoded`` (the text of these ids) and ``agrees`` (agenda and library).

    A null or empty text has no ids and decodes to the empty string.  Texts are encoded
    whole; a very long one is worked on in sections cut between words, where no piece
    can reach across, so memory follows one section and the ids.  Rows are handled
    one by one: repeated rows and ids give rows of their own, a null id stays null, an
    empty table gives no rows.  Only the two named columns are read, so further columns
    may have any names."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(model)
        for batch in batches:
            names, texts, start, held = batch.column("doc_id"), [], 0, 0
            for i, text in enumerate(batch.column("text")):
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held >= BATCH_CHARS or i + 1 == len(batch):
                    yield _record(names[start: i + 1], both.roundtrip(texts))
                    texts, start, held = [], i + 1, 0

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids array<int>, n_tokens long, decoded string, agrees boolean")


def _record(doc_ids: pa.Array, rows: list[tuple[np.ndarray, str, bool]]) -> pa.RecordBatch:
    sizes = np.array([len(r[0]) for r in rows], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[0] for r in rows])))
    return pa.RecordBatch.from_arrays([doc_ids, ids, pa.array(sizes), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows])],
                                      names=["doc_id", "ids", "n_tokens", "decoded", "agrees"])


def decode_ids(rows: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of an array column of ids (null: null, empty: empty text;
    a null or an id outside the vocabulary fails the job).  ``out`` must be a new name."""
    if out.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"there is a column {out} already")

    @F.pandas_udf("string")
    def text(column):
        both = codec(model)
        return column.map(lambda x: both.decode(None if x is None else [None if i is None or i != i else int(i) for i in x]))

    return rows.withColumn(out, text(F.col(ids).cast("array<int>")))
