from collections import defaultdict
from fractions import Fraction

import numpy as np

from tessera.llm import mixing
from tessera.llm.common import table
from tessera.llm.queries import op8_source_mixing
from tests.llm.helpers import no_documents, odd_documents, words


def goals(sizes):
    """Water filling, a source at a time."""
    out, left, rest = {}, Fraction(3, 2) * sum(sizes.values()), dict(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while rest:
        part = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        above = [s for s in rest if part[s] > 2 * rest[s]]
        if not above:
            return out | part
        for s in above:
            out[s] = Fraction(2 * rest.pop(s))
            left -= out[s]
    return out


def check(rows, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += len(words(d["text"]))
    want = goals({s: n for s, n in sizes.items() if n})
    got = defaultdict(int)
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=str) == sorted(((d["doc_id"], len(words(d["text"]))) for d in docs), key=str)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want.get(r["source"], 0)) < 1e-6
        got[r["source"]] += r["taken"]
    for s, n in got.items():
        assert abs(n - want.get(s, 0)) <= 1


def test_table_meets_its_targets(spark, small):
    docs = table(spark, small, "documents").collect()
    check(mixing.taken(table(spark, small, "documents")).collect(), docs)
    a, b = (sorted(map(tuple, op8_source_mixing(spark, small).collect())) for _ in range(2))
    assert a == b


def test_odd_documents(spark):
    df = odd_documents(spark)
    check(mixing.taken(df).collect(), df.collect())
    check(mixing.taken(df, block=7).collect(), df.collect())
    assert mixing.taken(no_documents(spark)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark, small):
    df = table(spark, small, "documents")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    sums = defaultdict(int)
    for r in out.collect():
        sums[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
        assert all(part in texts[r["doc_id"]] for part in r["text"].split("\n"))
    for r in mixing.taken(df).collect():
        assert sums[r["doc_id"]] == r["taken"]
    odd = odd_documents(spark)
    total = sum(r["taken"] for r in mixing.taken(odd).collect())
    assert sum(len(words(r["text"])) for r in mixing.mixed_documents(odd).collect()) == total


def walked(spark, docs, **options):
    """Words taken of each document, slot by slot: every slot's words are looked up in its source's line of words."""
    m = mixing.mix(docs, **options)
    lines = defaultdict(list)
    for u in sorted(m.units.collect(), key=lambda u: (u["source_id"], u["start"])):
        line = lines[u["source_id"]]
        assert len(line) == u["start"] or not u["words"]
        line += [(u["doc_id"], u["h"])] * u["words"]
    got = defaultdict(int)
    for s in m.slots.collect():
        for unit in lines[s["source_id"]][s["block"] * m.block :][: s["take"]]:
            got[unit] += 1
    return got


def test_every_document_s_words_against_a_walk_of_the_slots(spark, small):
    df = table(spark, small, "documents")
    got = defaultdict(int)
    for (k, _), n in walked(spark, df).items():
        got[k] += n
    assert got and {r["doc_id"]: r["taken"] for r in mixing.taken(df).collect() if r["taken"]} == dict(got)


def test_many_sources_in_few_groups(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), None if i % 50 == 0 else f"s{rng.integers(0, 300)}é") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for groups in (1, 7, 1000):
        check(mixing.taken(df, block=5, groups=groups).collect(), df.collect())


def test_rows_alike_are_pooled_by_partition_only(spark):
    df = spark.createDataFrame([(1, "a b c", "x")] * 500 + [(2, "d e", "y")], "doc_id long, text string, source string").repartition(9)
    units = mixing.mix(df, block=4).units.collect()
    assert max(u["copies"] for u in units) < 200 and sum(u["copies"] for u in units) == 501
    check(mixing.taken(df, block=4).collect(), df.collect())


def test_columns_with_names_of_its_own_stay(spark):
    df = odd_documents(spark)
    own = [f"`{c}`" for c in df.columns if c not in ("text", "n_chars")]
    got = set(map(str, mixing.mixed_documents(df).select(*own).collect()))
    assert got and got <= set(map(str, df.select(*own).collect()))


def test_permutations_of_any_size():
    for n in (1, 2, 3, 10, 257, 5000):
        seen = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 3))
        assert sorted(seen) == list(range(n))
    a, b = (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k)) for k in (0, 1))
    assert (a != b).mean() > 0.9 and (a != np.arange(1000)).mean() > 0.9


def test_draws_deal_all_slots():
    counts = mixing.draw([1000, 10, 0, 500], 100)
    assert sum(counts).tolist() == [1000, 10, 0, 500]
    assert all(c.sum() == 100 for c in counts[:-1]) and len({tuple(c) for c in counts}) > 1
