import re

import pytest

from adega.llm.catalog import QUERIES
from adega.llm.licenses import PASSAGES, PHRASES, WORDS, scan
from tests_llm_helpers import AWKWARD, documents

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute(rows):
    out = []
    for i, t, *_ in rows:
        w = re.findall(WORDS, (t or "").translate(LOWER))
        places = [(k, label) for p, label in PHRASES for k in range(len(w)) if w[k: k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        out.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    return sorted(out, key=str)


BASE = ("doc_id", "n_words_", "n_base", "first_word", "last_word", "base_labels")
TEXTS = [
    "MIT License", "the mit\tlicense, MIT-License mit license", "MIT licensed", "cc by cc by", "cc-by 4.0 and Apache License", "gnu general public",
    "GNU General Public License GNU general public license", "apache éapache license", "license mit", "Licensed under CC BY-NC 4.0.", "mit mit license license",
]


def test_base_phrases_match_brute_force(spark, awkward):
    rows = AWKWARD + [(100 + k, t, "en", "a") for k, t in enumerate(TEXTS)] + [(100, "MIT License", "en", "a")] * 3
    got = scan(documents(spark, rows))
    assert sorted((tuple(r[c] for c in BASE) for r in got.collect()), key=str) == brute(rows)
    for r in got.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels_"].split(","))) and 0 <= r["score_"] <= 1
        assert r["n_base"] == 0 or r["score_"] == 1
    assert got.columns[: len(awkward.columns)] == awkward.columns


@pytest.mark.parametrize("k", [0, 5, 7])
def test_passages_with_changes_are_found_where_they_stand(spark, k):
    words, label = PASSAGES[k][0].split(" "), PASSAGES[k][1]
    changed = words[:6] + ["very"] + words[6:9] + words[10:]  # one word put in, one left out
    other = words[:3] + [f"x{n}" for n in range(len(words))]  # too little of it
    rows = [(1, "a b c " + " ".join(words), "en", "a"), (2, "d " + " ".join(changed) + " e", "en", "a"), (3, " ".join(other), "en", "a")]
    got = {r["doc_id"]: r for r in scan(documents(spark, rows, extra=False), phrases=()).collect()}
    assert label in got[1]["labels"].split(",") and got[1]["score"] == 1
    assert (3, 3 + len(words)) in [(s["start"], s["end"]) for s in got[1]["spans"]]
    assert label in got[2]["labels"].split(",") and 0.8 <= got[2]["score"] < 1
    assert label not in got[3]["labels"].split(",")


GPL = PASSAGES[0][0].split(" ")


def labels_of(spark, texts, **how):
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)]
    return {r["doc_id"]: (set(filter(None, r["labels"].split(","))), r["score"], r["spans"]) for r in scan(documents(spark, rows, extra=False), phrases=(), **how).collect()}


def test_scattered_and_reversed_words_are_no_passage(spark):
    pairs = [" ".join(GPL[k: k + 2]) for k in range(len(GPL) - 1)]
    scattered = " ".join(f"{p} filler{k} more{k}" for k, p in enumerate(pairs))
    backwards = " ".join(reversed(pairs))
    shuffled = " ".join(pairs[k * 7 % len(pairs)] for k in range(len(pairs)))
    swapped = " ".join(GPL[15:] + GPL[:15])  # both halves, in the wrong order
    got = labels_of(spark, [scattered, backwards, shuffled, swapped, " ".join(GPL)])
    assert [got[k][0] for k in range(4)] == [set()] * 4 and got[4][0] == {"gpl"} and got[4][1] == 1


def test_insertions_within_the_bound_are_found_with_their_span(spark):
    every_fifth = [w for k, w in enumerate(GPL) for w in ([w, "extra"] if k % 5 == 4 else [w])]
    many = [w for k, w in enumerate(GPL) for w in ([w, "x", "y", "z"] if k % 2 else [w])]
    twice = GPL + ["between"] * 5 + GPL[:14] + GPL[16:]
    noisy = ["free", "software"] * 4 + every_fifth + ["this", "program"] * 4
    got = labels_of(spark, [" ".join(x) for x in (every_fifth, many, twice, noisy)])
    assert got[0][0] == {"gpl"} and (got[0][2][0]["start"], got[0][2][0]["end"]) == (0, len(every_fifth) - (len(GPL) % 5 == 0))
    assert got[1][0] == set()
    assert [(s["start"], s["end"]) for s in got[2][2]] == [(0, len(GPL)), (len(GPL) + 5, 2 * len(GPL) + 3)]
    assert got[3][0] == {"gpl"} and got[3][2][0]["start"] == 8


def longest_chain(words, template):
    """Words of the template in its order that stand beside a template neighbour (brute force)."""
    hits = {(k + j, i + j) for i in range(len(words) - 1) for k in range(len(template) - 1) if words[i: i + 2] == template[k: k + 2] for j in (0, 1)}
    best = {}
    for at, pos in sorted(hits):
        best[at, pos] = 1 + max((n for (a, p), n in best.items() if a < at and p < pos), default=0)
    return max(best.values(), default=0)


def test_share_is_that_of_the_longest_chain(spark):
    import random

    rng = random.Random(4)
    template = PASSAGES[4][0].split(" ")
    texts = []
    for _ in range(60):  # few edits: every diagonal lies within the bound
        words = list(template)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(words))
            words[k: k + rng.randint(0, 1)] = [rng.choice(["new", rng.choice(template)])] * rng.randint(0, 1)
        texts.append(words)
    got = labels_of(spark, [" ".join(t) for t in texts])
    for k, t in enumerate(texts):
        share = longest_chain(t, template) / len(template)
        assert got[k][1] == pytest.approx(share if share >= 0.8 else 0.0), " ".join(t)


def test_no_documents(spark, no_documents):
    assert scan(no_documents).count() == 0


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op9_licenses"](spark, sf).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_any_case_words_are_the_words_of_every_character(spark):
    from pyspark.sql import functions as F

    from adega.llm.licenses import WORDS_ANY_CASE

    rows = spark.range(1, 0x110000).where("id < 55296 or id > 57343").select(F.decode(F.encode(F.format_string("%c", F.col("id").cast("int")), "UTF-8"), "UTF-8").alias("c"))
    low = F.translate("c", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = lambda c: F.concat(F.lit("x"), c, F.lit("y"))
    got = rows.select(F.regexp_count(text(F.col("c")), F.lit(WORDS_ANY_CASE)).alias("a"), F.regexp_count(text(low), F.lit(WORDS)).alias("b"))
    assert got.where("a = b").count() == 0x10FFFF - 2048 and got.where("a = 2").count() == 128 - 62 - 1


def test_only_ascii_letters_match_in_any_case(spark):
    texts = ["Licen\u00e7a P\u00daBLICA", "LICEN\u00c7A p\u00fablica", "licen\u00e7a p\u00fablica", "public \u212aey", "Public KEY", "public \u017fey", "public"]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)]
    for phrases in ([("public key", "k")], [("licen\u00e7a p\u00fablica", "p"), ("public key", "k"), ("Public KEY", "never")]):
        got = {r["doc_id"]: r for r in scan(documents(spark, rows, extra=False), phrases=phrases, passages=()).collect()}
        assert [got[k]["base_labels"] for k in range(7)] == ["", "", "p" * (len(phrases) > 1), "", "k", "", ""]
        assert [got[k]["n_words"] for k in range(7)] == [2, 2, 2, 2, 2, 2, 1]


def test_a_text_is_matched_by_ranges_only(spark):
    """Java takes many times longer over a complement of ranges; a text is split once."""
    found = scan(documents(spark, [(1, "MIT License", "en", "a")], extra=False))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "[^" not in plan and "regexp_extract_all" in plan
