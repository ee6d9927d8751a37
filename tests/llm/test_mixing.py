import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from adega.llm.catalog import QUERIES
from adega.llm.mixing import mixed, plan_mix, position_in_schedule
from tests_llm_helpers import AWKWARD, documents, prose

SMOKE = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """The contract's words: share by weight, cap, reshare the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    return target


def check(spark, rows):
    plan = plan_mix(documents(spark, rows, extra=False)).collect()
    sizes, most, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in plan:
        assert r["size"] == words(r["text"]) and r["taken"] == r["size"] * r["repeats"] and r["repeats"] <= 2
        assert len(r["positions"]) == r["repeats"] and all(0 <= p <= 1 for p in r["positions"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    target = brute_targets(dict(sizes))
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
    return plan


def test_awkward_rows(spark, awkward):
    check(spark, AWKWARD)
    plan = plan_mix(awkward)
    assert plan.count() == len(AWKWARD) and {"size_", "target_", "taken"} <= set(plan.columns)


def test_targets_and_taken_words(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randint(0, 60)), "en", rng.choice(["a", "a", "a", "b", "É", "z", None])) for k in range(400)]
    first = check(spark, rows)
    assert sorted(map(str, first)) == sorted(map(str, check(spark, rows)))  # reruns agree


def test_caps_pass_their_excess_on(spark):
    rows = [(k, "w " * n, "en", s) for k, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 1000), ("d", 3)])]
    check(spark, rows)


def test_positions_invert_the_schedule(spark):
    for schedule in (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.0), (0.25, 2.0), (1.0, 0.0)), ((0.0, 0.0), (0.5, 0.0), (1.0, 1.0))):
        t = np.linspace(0, 1, 20001)
        w = np.interp(t, *zip(*schedule))
        demand = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        demand /= demand[-1]
        shares = [k / 50 for k in range(1, 50)]
        got = spark.createDataFrame([(s,) for s in shares], "s double").select(position_in_schedule(F.col("s"), schedule)).collect()
        assert [r[0] for r in got] == pytest.approx([t[np.searchsorted(demand, s)] for s in shares], abs=1e-3)


def test_mix_is_sorted_by_position_and_heavy_sources_come_first(spark):
    rows = [(k, "w " * 10, "en", "abc"[k % 3]) for k in range(300)]
    out = mixed(documents(spark, rows, extra=False)).collect()
    place = [r["position"] for r in out]
    assert place == sorted(place)
    early, late = out[: len(out) // 4], out[-len(out) // 4:]
    share = lambda part: sum(r["source"] == "a" for r in part) / len(part)
    assert share(early) > share(late)


def test_no_documents(spark, no_documents):
    assert plan_mix(no_documents).count() == 0 and mixed(no_documents).count() == 0


def test_fractional_repeats_meet_their_target(spark):
    rows = [(k, "w " * 10, "en", "ab"[k % 2]) for k in range(200)]
    plan = plan_mix(documents(spark, rows, extra=False), share=2.5, max_repeats=2.5).collect()
    assert abs(sum(r["taken"] for r in plan) - 2.5 * 2000) <= 20 and {r["repeats"] for r in plan} == {2, 3}


SQL = """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
SELECT doc_id, size, source_size FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source"""


def test_query_against_sql_and_brute_force(spark):
    import duckdb

    got = QUERIES["op6_mixing"](spark, SMOKE).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMOKE}/documents.parquet')")
    assert sorted((r["doc_id"], r["size"], r["source_size"]) for r in got) == sorted(con.execute(SQL).fetchall())
    source = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    sizes, taken, most = {}, defaultdict(int), defaultdict(int)
    for r in got:
        sizes[source[r["doc_id"]]] = r["source_size"]
        taken[source[r["doc_id"]]] += r["taken"]
        most[source[r["doc_id"]]] = max(most[source[r["doc_id"]]], r["size"])
    target = brute_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and r["taken"] == r["size"] * len(r["positions"]) <= 2 * r["size"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
    first = [r["positions"][0] if r["positions"] else 2.0 for r in got]
    assert first == sorted(first)
    # the stream rebuilt by hand: a source's documents follow each other, each pass at the middle of its words
    order = {i: h for i, h in spark.read.parquet(f"{SMOKE}/documents.parquet").selectExpr(
        "doc_id", "xxhash64(cast(doc_id as string), 77, length(text)) as h").collect()}
    from adega.llm.mixing import SCHEDULES
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    for k, s in enumerate(names):
        schedule, before = SCHEDULES[k % 3], 0
        t = np.linspace(0, 1, 100_001)
        demand = np.concatenate([[0], np.cumsum((lambda w: (w[1:] + w[:-1]) / 2)(np.interp(t, *zip(*schedule))))])
        demand /= demand[-1]
        for r in sorted((r for r in got if source[r["doc_id"]] == s), key=lambda r: (order[r["doc_id"]], r["doc_id"])):
            shares = [(before + r["size"] / 2 + p * sizes[s]) / target[s] for p in range(2)] if r["size"] else []
            assert r["positions"] == pytest.approx([t[np.searchsorted(demand, x)] for x in shares if x < 1], abs=1e-3)
            before += r["size"]


def test_query_integrates_and_range_sorts(spark):
    plan = QUERIES["op6_mixing"](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [positions" in plan or "Sort [" in plan
    whole = plan_mix(spark.read.parquet(f"{SMOKE}/documents.parquet")).select("taken")._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" in whole.upper()  # ``taken`` is read off the positions, so they can't be pruned
