import hashlib
from collections import Counter

import duckdb

from adega.llm.catalog import QUERIES, ORACLE_SQL
from adega.llm.lines import drop_frequent_lines
from tests_llm_helpers import AWKWARD, documents

SMOKE = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\f\r"
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute(rows, least):
    keys = [[line.strip(BLANKS).translate(LOWER) for line in (t or "").split("\n")] for _, t, *_ in rows]
    seen = Counter(k for own in keys for k in set(own) if k)
    out = []
    for (i, t, *_), own in zip(rows, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, own) if not (k and seen[k] >= least)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_awkward_rows_match_brute_force(spark, awkward):
    rows = AWKWARD + [(20 + k, f" Shared LINE \t\nown {k}\nÉ\n\nshared line", "en", "a") for k in range(4)] + [(30, "é\nE\n", "en", "a")] * 3
    for least in (2, 3, 5):
        got = drop_frequent_lines(documents(spark, rows), min_docs=least)
        assert sorted(((r["doc_id"], r["text"], r["n_lines_"], r["n_dropped"]) for r in got.collect()), key=str) == brute(rows, least)
        assert got.columns[: len(awkward.columns)] == awkward.columns and {r["n_lines"] for r in got.collect()} == {"x"}


def test_short_keys_can_be_kept(spark):
    rows = [(k, "ab\nabc", "en", "a") for k in range(3)]
    assert {r["text"] for r in drop_frequent_lines(documents(spark, rows), min_docs=2, min_chars=3).collect()} == {"ab"}


def test_no_documents(spark, no_documents):
    assert drop_frequent_lines(no_documents).count() == 0


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SMOKE}/documents.parquet')")
    want = sorted(con.sql(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({ORACLE_SQL['op7_line_dedup']})").fetchall())
    got = sorted(map(tuple, QUERIES["op7_line_dedup"](spark, SMOKE).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()))
    assert got == want and len(got[0][3]) == len(hashlib.sha256().hexdigest())
