import numpy as np
import pytest

from tessera.llm import neardup
from tessera.llm.common import table
from tessera.llm.components import components
from tessera.llm.queries import op5_minhash_near_dedup
from tests.llm.helpers import no_documents, odd_documents, shingles


def brute(docs):
    """Least id reachable by links between all pairs."""
    sets = [(k, shingles(t)) for k, t in docs]
    root = {k: k for k, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return {k: (len(s), find(k)) for k, s in sets}


def check(rows, docs):
    want = brute([d for d in docs if d[0] is not None])
    assert len(rows) == len(docs)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_table_against_brute_force(spark, folder):
    d = f"/root/testdata/{folder}"
    check(op5_minhash_near_dedup(spark, d).collect(), [(r["doc_id"], r["text"]) for r in table(spark, d, "documents").collect()])


def test_odd_documents(spark):
    df = odd_documents(spark)
    check(neardup.near_duplicates(df).collect(), [(r["doc_id"], r["text"]) for r in df.collect()])
    assert neardup.near_duplicates(no_documents(spark)).count() == 0
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert kept.where("doc_id is not null").groupBy("doc_id", "text").count().where("count > 1").count() == 0


def test_one_id_with_two_texts_keeps_both(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "quite other words stand here now", "y"), (1, "a b c d e f g", "w"), (2, "a b c d e f g", None), (None, "a b c d e f g", "z"), (3, None, "n"), (3, "", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _kept_id string")
    for parts in (1, 5):
        got = sorted(map(tuple, neardup.keep_one(df.repartition(parts)).collect()), key=str)
        assert got == sorted([(1, "a b c d e f g", "w"), (1, "quite other words stand here now", "y"), (None, "a b c d e f g", "z"), (3, None, "n"), (3, "", "m")], key=str)


def test_chains_and_crowds_of_strangers(spark):
    """Neighbours in a chain are near and its ends are not; others share much of their text but are not near."""
    rng = np.random.default_rng(5)
    texts, words = [], [f"a{i}" for i in range(60)]
    for i in range(40):
        texts.append(" ".join(words))
        words[(3 * i) % 60] = f"b{i}"
    common = " ".join(f"c{i}" for i in range(60))
    texts += [common + " " + " ".join(f"d{i}x{j}" for j in range(rng.integers(10, 40))) for i in range(60)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(neardup.near_duplicates(df).collect(), docs)


def test_sketches_estimate_resemblance():
    rng = np.random.default_rng(6)
    for shared, size in ((0, 400), (300, 400), (30, 40), (3, 4), (1, 1)):
        both = rng.integers(0, 2**63, shared, "uint64")
        found = []
        for _ in range(20):
            own = rng.integers(0, 2**63, (2, size - shared), "uint64")
            s = neardup.sketch([np.unique(np.concatenate([both, o])) for o in own], 160)
            assert (s != np.iinfo("uint64").max).all()
            found.append((s[0] == s[1]).mean())
        assert abs(np.mean(found) - shared / (2 * size - shared)) < 0.08


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (300, 300), (100 + 50, 120)] + [(1000, i) for i in range(1001, 1200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 51)} | {200: 100, 150: 100, 120: 100} | {i: 1000 for i in range(1001, 1200)}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    odd = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (None, 1), (3, None), (4, 4)], "u long, v long")
    assert [tuple(r) for r in components(odd).collect()] == [(2, 1)]
