from collections import Counter

import corpus_pipeline as P
from adega.llm.common import table
from adega.llm.ngram_join import similar_components
from tests_llm_helpers import AWKWARD, documents

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_the_other(spark):
    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        docs = P.stored(docs, f"test-{name}")
        seen[name] = (before, docs)
        if name != "best_fit_packing":
            assert tuple(docs.columns) == P.COLUMNS
    before, after = seen["quality_classifier"]
    bad = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 0").collect()}
    ids = {r["doc_id"] for r in after.collect()}
    assert ids < {r["doc_id"] for r in before.collect()} and len(ids & bad) <= 0.05 * len(bad) + 1
    before, after = seen["line_dedup"]
    assert after.count() == before.count()
    lines = Counter(x for r in after.collect() for x in {k.strip().lower() for k in r["text"].split("\n")} if x)
    assert max(lines.values()) < 10
    before, after = seen["ngram_jaccard_join"]
    groups = {r["doc_id"]: r["component_id"] for r in similar_components(before).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(groups.values()))
    before, after = seen["mixing"]
    copies = Counter(r["doc_id"] for r in after.collect())
    assert set(copies) <= {r["doc_id"] for r in before.collect()} and max(copies.values()) <= 2
    packed = seen["best_fit_packing"][1].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


def test_awkward_documents_pass_every_stage(spark, no_documents):
    for docs in (documents(spark, AWKWARD), no_documents):
        for name, stage in P.STAGES:
            docs = P.stored(stage(spark, docs, SF), f"test-{name}")
        docs.count()


def test_run(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
