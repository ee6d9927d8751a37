"""SentencePiece ids against the library."""

import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from adega.llm import piece_model
from adega.llm.catalog import QUERIES
from adega.llm.piece_model import ChunkEncoder, read_vocabulary
from adega.llm.pieces import Codec, decode_ids, encode_decode

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = list("abc  \n\t▁　é語😀\x00<s>.,()'") + ["the", " the", "</s>", "<0x0A>", "​", "▁▁", "x" * 30, "ab" * 40, "ā", "naïve", " 1.000"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def strange_texts(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(1, longest))) for _ in range(n)]


def test_vocabulary_file_is_read_as_the_library_reads_it(library):
    vocabulary = read_vocabulary(MODEL)
    assert [p for p, _, _ in vocabulary] == [library.id_to_piece(i) for i in range(library.get_piece_size())]
    assert [s for _, s, _ in vocabulary] == [library.get_score(i) for i in range(library.get_piece_size())]


def test_ids_and_texts_are_the_librarys_on_strange_texts(library):
    codec = Codec(MODEL)
    texts = strange_texts(4000, 50, 1)
    for text, (ids, back, agrees) in zip(texts, codec.roundtrip(texts)):
        assert agrees and ids.tolist() == library.encode(text) and back == library.decode(library.encode(text)), repr(text)
    for n in ("", "▁", " ", "\n", "  \n ", "▁▁ x"):
        assert codec.roundtrip([n])[0][0].tolist() == library.encode(n)


def test_sections_of_a_long_text_join_without_a_seam(library, monkeypatch):
    monkeypatch.setattr(piece_model, "SECTION", 15)
    codec = Codec(MODEL)
    for text in strange_texts(800, 200, 2):
        ids, back, agrees = codec.roundtrip([text])[0]
        assert agrees and ids.tolist() == library.encode(text) and back == library.decode(library.encode(text)), repr(text)


def test_list_and_heap_agendas_agree():
    encoder = ChunkEncoder(read_vocabulary(MODEL))
    rng = random.Random(4)
    for _ in range(3000):
        chunk = "▁" + "".join(rng.choices("aabeinorst", k=rng.randint(1, 60)))
        assert encoder.by_list(chunk) == encoder.by_heap(chunk)


def test_a_chunk_that_differs_takes_the_librarys_ids(library):
    codec = Codec(MODEL)
    codec.encoder.rank.pop("▁the")  # break the agenda
    (ids, _, agrees), (_, _, other) = codec.roundtrip(["see the end", "no article"])
    assert ids.tolist() == library.encode("see the end") and not agrees and other
    assert not codec.roundtrip(["the"])[0][2]


def test_small_caches_give_the_same_ids(library):
    codec = Codec(MODEL)
    codec.encoder.limit = 3
    for text in strange_texts(300, 50, 5):
        assert codec.roundtrip([text])[0][0].tolist() == library.encode(text)


def test_a_vocabulary_with_pieces_across_words_isnt_cut():
    encoder = ChunkEncoder([("<unk>", 0.0, piece_model.UNKNOWN), *((p, -float(i), piece_model.NORMAL) for i, p in enumerate(["a▁b", "a▁", "▁b", "a", "b", "▁"]))])
    assert encoder.cuts is None
    assert encoder.encode("a▁b").tolist() == [1] and encoder.encode("xya").tolist() == [0, 4]  # unknown symbols side by side are one


def test_rows_of_all_kinds(spark, awkward, no_documents, library):
    got = encode_decode(awkward, MODEL)
    assert got.columns == ["doc_id", "ids", "n_tokens", "decoded", "agrees"]
    want = [(r["doc_id"], library.encode(r["text"] or "")) for r in awkward.collect()]
    rows = got.collect()
    assert sorted([(r["doc_id"], list(r["ids"])) for r in rows], key=str) == sorted(want, key=str)
    assert all(r["agrees"] and r["n_tokens"] == len(r["ids"]) and r["decoded"] == library.decode(r["ids"]) for r in rows)
    assert encode_decode(no_documents, MODEL).count() == 0


def test_decoding_a_column_of_ids(spark, library):
    rows = spark.createDataFrame([(1, library.encode("naïve 語 😀\n x")), (2, []), (3, None), (4, [3 + 0xF0, 3 + 0x9F])], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in decode_ids(rows, MODEL).collect()}
    assert got == {1: "naïve 語 😀\n x", 2: "", 3: None, 4: library.decode([3 + 0xF0, 3 + 0x9F])}
    with pytest.raises(Exception):  # noqa: B017
        decode_ids(spark.createDataFrame([([40_000],)], "ids array<int>"), MODEL).collect()
    with pytest.raises(ValueError):
        decode_ids(rows, MODEL, out="K")


def test_whole_table(spark, library):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r["text"] or "")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        want[r["doc_id"]] = (len(ids), *digest, True)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_sentencepiece"](spark, SF).collect()}
    assert got == want
