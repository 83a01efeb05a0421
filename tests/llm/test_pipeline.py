from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm.common import table, written
from tests.llm.helpers import no_documents, odd_documents, words
from tests.llm.test_mixing import goals
from tests.llm.test_neardup import brute as classes
from tests.llm.test_packing import check as check_packing
from tests.llm.test_quality import brute as quality
from tests.llm.test_substrings import sequential


def staged(spark, docs):
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], ""), name))
    return out


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_every_stage_against_brute_force(spark, folder):
    docs, good, apart, cut, mixed, packed = staged(spark, table(spark, f"/root/testdata/{folder}", "documents"))
    for x in (good, apart, cut, mixed):
        assert x.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert all(texts[k] == t and not quality(t)["base_failed"] for k, t in kept.items())
    assert len(kept) > 0.8 * len(texts)

    left = {r["doc_id"]: r["text"] for r in apart.collect()}
    assert left == {k: kept[k] for k, (_, c) in classes(list(kept.items())).items() if k == c}

    new = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert new == {k: t for k, (t, _) in sequential(sorted(left.items())).items() if words(t) or t == left[k]}
    assert all(len(r["text"]) == r["n_chars"] for r in cut.collect())

    sizes, got = defaultdict(int), defaultdict(int)
    for r in cut.collect():
        sizes[r["source"]] += len(words(r["text"]))
    for r in mixed.collect():
        got[r["source"]] += len(words(r["text"]))
    want = goals(dict(sizes))
    assert all(abs(got[s] - want[s]) <= 1 for s in sizes)

    check_packing(packed.collect(), mixed.collect())


def test_run_is_the_stages(spark, small):
    a = staged(spark, table(spark, small, "documents"))[-1]
    b = pipeline.run(spark, small)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_odd_and_no_documents(spark):
    odd = odd_documents(spark)
    more = table(spark, "/root/testdata/sf0.001", "documents").limit(20).withColumn("doc_id", F.col("doc_id") + 100)
    out = staged(spark, odd.unionByName(more, allowMissingColumns=True))
    assert out[1].count() and out[-1].count()
    assert [x.count() for x in staged(spark, no_documents(spark))] == [0] * 6
