import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from adega.llm.catalog import ORACLE_SQL, QUERIES
from adega.llm.topk import top_inner_products
from adega.llm.vectors import passes_for, similar_vectors

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, node string, x string, n_links string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c, "x", "x", "x", "x") for i, v, c in rows], SCHEMA)


AWKWARD = [
    (1, None, 0), (2, [], 0), (3, [0, 0], 0), (4, [1, None], 0), (5, [1, math.nan], 0), (6, [1, math.inf], 0), (7, [1, 0], 0), (8, [1, 0], 0),
    (8, [1, 0], 0), (9, [2, 0], 0), (10, [1, 0], None), (11, [1, 0], 1), (12, [1, 0, 0], 0), (None, [1, 0.01], 0), (13, [0, 1], 0),
    (14, [3e38, 3e36], 0), (15, [-0.0, 1], 0), (16, [0.0, 1], 0),
]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows, threshold):
    unit = [np.array(v, np.float32).astype(float) if usable(v) and c is not None else None for _, v, c in rows]
    unit = [u / np.linalg.norm(u / np.abs(u).max()) / np.abs(u).max() if u is not None and np.abs(u).max() > 0 else None for u in unit]
    n, root = len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    ids = {}
    for k in range(n):
        if rows[k][0] is not None:
            ids[find(k)] = min(ids.get(find(k), 1 << 60), rows[k][0])
    return [(r[0], links[k], ids.get(find(k)), r[0] == ids.get(find(k))) for k, r in enumerate(rows)]


def test_awkward_vectors(spark):
    got = similar_vectors(table(spark, AWKWARD), passes=4)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_links(AWKWARD, 0.93), key=str)
    assert similar_vectors(table(spark, []), passes=2).count() == 0


def test_planted_groups_and_a_hot_label(spark):
    rng = np.random.default_rng(4)
    rows = []
    for group in range(60):
        base = rng.normal(size=16)
        rows += [(len(rows) + k, base + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.2]), 0 if group % 3 else group) for k in range(rng.integers(1, 6))]
    hot = rng.normal(size=16)
    rows += [(1000 + k, hot + rng.normal(size=16) * 0.1, 0) for k in range(150)]
    rows = [(int(i), [float(np.float32(x)) for x in v], int(c)) for i, v, c in rows]
    want = {r[0]: r for r in brute_links(rows, 0.93)}
    got = {r["vec_id"]: tuple(r) for r in similar_vectors(table(spark, rows), window=64).collect()}
    assert got.keys() == want.keys() and all(got[k][1] <= want[k][1] for k in got)  # none below the threshold
    found, true = sum(r[1] for r in got.values()), sum(r[1] for r in want.values())
    assert found >= 0.9 * true
    assert sum(got[k][2] == want[k][2] for k in got) >= 0.98 * len(got)


def hot_group(size, noise, others, dim=64, seed=7):
    """Rows of one group of near copies and of unrelated vectors, and each row's true number of links."""
    rng = np.random.default_rng(seed)
    near = rng.normal(size=dim) + rng.normal(size=(size, dim)) * noise
    v = np.concatenate([near, rng.normal(size=(others, dim))]).astype(np.float32)
    unit = v / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    return [(k, x, 0) for k, x in enumerate(v)], (unit @ unit.T >= 0.93).sum(axis=1) - 1


def test_copies_with_equal_bits_meet_others_in_every_pass(spark):
    rows, want = hot_group(970, 1e-4, 100)
    got = {r["vec_id"]: r["n_links"] for r in similar_vectors(table(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.9 * want.sum()


def test_links_of_a_group_far_larger_than_the_windows_are_counted_exactly(spark):
    rows, want = hot_group(3000, 0.2, 200)
    rows += [(len(rows) + k, rows[k][1], 0) for k in range(40)]  # equal rows count as rows
    unit = np.stack([v for _, v, _ in rows]).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    got = {r["vec_id"]: tuple(r) for r in similar_vectors(table(spark, rows)).collect()}
    assert [got[k][1] for k in range(len(rows))] == want.tolist()
    assert {got[k][2] for k in range(3000)} == {0}


def test_recall_against_brute_force_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {r[0]: r for r in brute_links(rows, 0.93)}
    got = {r["vec_id"]: tuple(r) for r in QUERIES["op5_embedding_dedup"](spark, SF).select("vec_id", "n_links", "component_id", "kept").collect()}
    assert sum(r[1] for r in got.values()) >= 0.9 * sum(r[1] for r in want.values()) and got.keys() == want.keys()


def brute_top(rows, query, k):
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if usable(v) and i is not None]
    out = []
    for a, (i, q) in enumerate(ints):
        if query(i):
            scored = sorted((-sum(x * y for x, y in zip(q, c)), j) for b, (j, c) in enumerate(ints) if b != a and len(c) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_top_products_of_awkward_vectors(spark):
    rows = [r for r in AWKWARD if r[0] != 14]  # its products don't fit 64 bits
    got = top_inner_products(table(spark, rows), F.col("vec_id") % 2 == 0, k=4)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda i: i % 2 == 0, 4)
    assert top_inner_products(table(spark, []), F.lit(True)).count() == 0


def test_top_products_with_ties_blocks_and_uneven_norms(spark, monkeypatch):
    monkeypatch.setattr("adega.llm.topk.BLOCK", 50)
    rng = np.random.default_rng(9)
    rows = [(k, rng.integers(-2, 3, 3) * rng.choice([0.25, 1, 8]), 0) for k in range(400)]
    rows += [(500 + k, [1.0, 1.0, 1.0], 0) for k in range(200)]
    rows = [(i, [float(x) for x in v], c) for i, v, c in rows]
    for pivots in (1, 7):
        got = top_inner_products(table(spark, rows), F.col("vec_id") % 20 == 0, pivots=pivots)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda i: i % 20 == 0, 10)


def test_top_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = sorted(con.sql(f"select query_id, rank, vec_id, score from ({ORACLE_SQL['op8_topk']})").fetchall())
    assert sorted(map(tuple, QUERIES["op8_topk"](spark, SF).select("query_id", "rank", "vec_id", "score").collect())) == want


def test_passes_grow_with_the_label():
    got = [passes_for(n, 128, 0.93, 0.95) for n in (0, 1, 100, 10_000, 10 ** 6, 10 ** 7, 10 ** 9)]
    assert got[:4] == [16] * 4 and got == sorted(got) and got[-1] > 40
    assert passes_for(10 ** 6, 128, 0.93, 0.999) > passes_for(10 ** 6, 128, 0.93, 0.95)
    # by simulation: isolated pairs at the threshold among random vectors
    rng = np.random.default_rng(1)
    n, dim, window = 3000, 32, 16
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((200, dim))
    side -= (side * x[:200]).sum(axis=1, keepdims=True) * x[:200]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([x, 0.93 * x[:200] + math.sqrt(1 - 0.93 ** 2) * side])
    found = np.zeros(200, bool)
    for turn in range(passes_for(len(x), window, 0.93, 0.95, least=1)):
        bits = np.packbits(x @ rng.standard_normal((dim, 64)) > 0, axis=1).view(">u8").ravel()
        place = np.argsort(np.argsort(bits, kind="stable"), kind="stable")
        found |= np.abs(place[:200] - place[n:]) <= window
    assert found.mean() >= 0.9
