import random
import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from adega.llm.catalog import QUERIES
from adega.llm.packing import best_fit_runs, pack, place, sequences
from adega.llm.token_ids import PieceEncoder, tokenizer_path
from adega.llm.token_store import pack_ranks, read_token_file, unpack_ranks, write_token_file
from adega.session import scratch_path
from tests_llm_helpers import AWKWARD, documents

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ENCODERS = {p: PieceEncoder(p, bound=10_000) for p in (BYTE, WORD)}
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
PIECES = ["a", "B", "word", "Élan", "ß", "ﬁ", "'s", "'", "don't", ".", "...", "|", "$$$", "12", "½", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b",
          "\x1c", "\x85", " ", " ", "​", "é", "İ", "Σ", "漢字", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "_", "-", "\x00"]


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text(max_size=20).filter(lambda t: t.isprintable()))
def test_ids_are_the_librarys(path, text):
    want = np.array(LIBRARY[path].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert ENCODERS[path].encode(text) == want


@given(st.lists(st.integers(0, 2 ** 32 - 1) | st.integers(0, 300) | st.integers(0, 70000), max_size=60))
def test_rank_coding_round_trip(ranks):
    ranks = np.array(ranks, np.uint32)
    control, data = pack_ranks(ranks)
    assert (unpack_ranks(control, data, len(ranks)) == ranks).all() and len(control) == -(-len(ranks) // 4)


def ids_of(path, text, end):
    return np.array(LIBRARY[path].encode(text or "", add_special_tokens=False).ids + [end], "<u4").tobytes()


def test_token_file_of_awkward_rows(spark, awkward):
    path = scratch_path(spark, "test-token-file")
    write_token_file(awkward, path, BYTE, end_id=2)
    got = sorted(read_token_file(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] + sorted(i for i, *_ in AWKWARD if i is not None)
    start, want = 0, sorted((i or 0, ids_of(BYTE, t, 2)) for i, t, *_ in AWKWARD)
    assert sorted((r["doc_id"] or 0, bytes(r["ids"])) for r in got) == want
    for r in got:
        assert r["start"] == start and r["n_tokens"] * 4 == len(r["ids"])
        start += r["n_tokens"]


def test_token_file_of_no_documents(spark, no_documents):
    path = scratch_path(spark, "test-token-file")
    write_token_file(no_documents, path, BYTE, end_id=2)
    assert read_token_file(spark, path).count() == 0


def test_token_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    for r in QUERIES["op4_token_ids"](spark, sf).orderBy("doc_id").collect():
        ids = ids_of(BYTE, docs.pop(r["doc_id"]), 2)
        assert tuple(r)[1:] == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert not docs


def expand(slots):
    """(length, rank, sequence, offset) of every piece."""
    return [(s.length, s.start + k, s.sequence + k // s.per, s.offset + k % s.per * s.length) for s in slots.itertuples() for k in range(s.n)]


@settings(max_examples=400, deadline=None)
@example({1: 1, 2: 1, 21: 24, 3: 1, 4: 1, 5: 3, 6: 15, 16: 18})
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_runs_are_best_fit_decreasing(counts):
    placed = expand(best_fit_runs(counts, 40))
    assert sorted((n, r) for n, r, *_ in placed) == sorted((n, r) for n, c in counts.items() for r in range(c))
    fill = {}
    for length, _, sequence, offset in sorted(placed, key=lambda p: (p[2], p[3])):
        assert fill.get(sequence, 0) == offset
        fill[sequence] = offset + length
    assert all(v <= 40 for v in fill.values())
    gaps = []  # brute-force best fit, piece by piece
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 40) - length)
    assert sorted(40 - v for v in fill.values()) == sorted(gaps)


def check_packed(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pack_awkward_rows(spark, awkward):
    packed = pack(awkward, WORD, end_id=0, capacity=64)
    rows = packed.collect()
    check_packed(rows, 64)
    want = []
    for i, t, *_ in AWKWARD:
        ids = ids_of(WORD, t, 0)
        want += [(i or -1, k // 256, k // 4, len(ids[k: k + 256]) // 4, zlib.crc32(ids[k: k + 256])) for k in range(0, len(ids), 256)]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    whole = sequences(packed).collect()
    assert sum(r["n_tokens"] for r in whole) * 4 == sum(len(r["ids"]) for r in whole)
    assert pack(documents(spark, []), WORD).count() == 0


def test_many_pieces_of_one_length_are_ranked_across_blocks(spark, monkeypatch):
    monkeypatch.setattr("adega.llm.packing.BLOCK_ROWS", 7)
    rng = random.Random(1)
    pieces = [(k, 0, 0, rng.choice([3, 3, 3, 5, 8]), b"", k % 3) for k in range(300)]
    df = spark.createDataFrame(pieces, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long")
    rows = place(df, 10).collect()
    assert len(rows) == 300 and check_packed(rows, 10) == best_fit_runs({n: sum(p[3] == n for p in pieces) for n in (3, 5, 8)}, 10).eval("sequence + (n - 1) // per").max() + 1


def test_packing_query(spark):
    rows = QUERIES["op10_packing"](spark, "/root/testdata/sf0.001").collect()
    used = check_packed(rows, 2048)
    assert used <= sum(r["length"] for r in rows) / 2048 * 1.03 + 1


def test_a_worker_keeps_one_cache_of_bounded_bytes():
    import sys

    from adega.llm import common
    from adega.llm.ngram_join import shingle_set
    from adega.llm.token_ids import encoder

    small = encoder(BYTE, bound=200_000)
    assert encoder(BYTE, bound=200_000) is small
    rng = random.Random(1)
    for _ in range(20):
        small.encode(" ".join(f"{rng.choice('abcdef')}{rng.randint(0, 10 ** 6)}" for _ in range(400)))
        entries = [*dict(small).items(), *small.old.items()]
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in entries) + sys.getsizeof(small) + sys.getsizeof(small.old) < 3 * 200_000
    shingle_set("another stage asks for another cache", 3)
    assert list(common._KEPT) == ["word hashes"] and encoder(BYTE, bound=200_000) is not small
    common.kept_by_process(None, None)
    assert not common._KEPT


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text(max_size=20).filter(lambda t: t.isprintable()), max_size=8))
def test_ids_of_many_texts_are_the_librarys(path, texts):
    import pyarrow as pa

    end = np.array([2], "<u4").tobytes()
    got, sizes = ENCODERS[path].encode_all(pa.array(texts, pa.string()), end)
    want = [ids_of(path, t, 2) for t in texts]
    assert got.tobytes() == b"".join(want) and sizes.tolist() == [len(w) // 4 for w in want]


def test_a_piece_of_many_texts_is_looked_up_once():
    import pyarrow as pa

    class Counting(PieceEncoder):
        asked = 0

        def __getitem__(self, piece):
            self.asked += 1
            return super().__getitem__(piece)

    own = Counting(BYTE)
    got, sizes = own.encode_all(pa.array(["one two two", "one three two"] * 500))
    assert own.asked == 2 and sizes.tolist() == [3] * 1000 and len(got) == 3000


def test_slices_hold_every_row_within_their_bytes(monkeypatch):
    import pyarrow as pa

    from adega.llm.token_store import _slices

    monkeypatch.setattr("adega.llm.token_store.SLICE_BYTES", 10)
    texts = ["a" * n for n in (3, 7, 0, 11, 10, 1, 25)] + [None, "b"]
    parts = [p["text"].to_pylist() for p in _slices(pa.RecordBatch.from_pydict({"text": texts}))]
    assert sum(parts, []) == texts and all(len(p) == 1 or sum(len(t or "") for t in p) <= 10 for p in parts)
    assert len(parts) == 6
