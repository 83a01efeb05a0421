from collections import Counter

from tessera.llm import quality
from tessera.llm.common import table
from tessera.llm.queries import op9_quality_rules
from tests.llm.helpers import no_documents, odd_documents, words


def brute(text):
    ws = words(text)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(ws)
    return {
        "n_words": n,
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 10 or 100 * len(covered) > 20 * n,
    }


def test_table_against_brute_force(spark, small):
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    rows = op9_quality_rules(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert not (r["base_failed"] and r["kept"])


def test_odd_documents(spark):
    df = odd_documents(spark)
    rows = quality.judge(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        want = brute(r["text"])
        assert {k: r[k] for k in want} == want
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert quality.judge(no_documents(spark)).count() == 0


def test_labels_are_followed(spark):
    """Good documents stay and bad ones go, but for a few."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    found = quality.judge(docs).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert n[1, True] > 0.95 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, True), 0) < 0.05 * (n[0, False] + n.get((0, True), 0))
