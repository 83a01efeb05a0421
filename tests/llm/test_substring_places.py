import numpy as np

from tessera.llm import substrings


def test_windows_are_the_shortest_stretches():
    rng = np.random.default_rng(3)
    for _ in range(200):
        edges = np.cumsum(rng.integers(1, 200, rng.integers(1, 12))).tolist()
        long = {(a, b) for a in edges for b in edges if b - a >= 120}
        want = {(a, b) for a, b in long if not any(c == a and d < b for c, d in long) or not any(d == b and c > a for c, d in long)}
        first, last = substrings.windows(np.array(edges), 120)
        got = [(edges[a], edges[b]) for a, b in zip(first, last, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_repeats_from_many_places_do_not_add_up(spark):
    """A text whose chunks stand in other documents, each in another one, holds no repeat; a whole passage is one."""
    rng = np.random.default_rng(12)
    some = lambda n: " ".join(f"{rng.integers(10**5):x}" for _ in range(n))
    mosaic = some(60)
    ends = substrings.boundaries(np.frombuffer(mosaic.encode(), "uint8")).tolist()
    pieces = [mosaic[max(0, a - 20) : b] for a, b in zip([0, *ends], ends) if b - a < 100]
    docs = [(i, f"{some(30)} {p} {some(30)}") for i, p in enumerate(pieces)]
    passage = some(80)
    docs += [(50, f"{some(30)} {passage} {some(30)}"), (100, mosaic), (101, f"{some(20)} {passage} {some(20)}")]
    texts = dict(docs)
    rows = {r["doc_id"]: r for r in substrings.cut_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[100]["_text"] == texts[100] and not rows[100]["_shared"] and rows[100]["_copied_from"] == []
    assert len(rows[101]["_text"]) < len(texts[101]) - 300 and rows[101]["_copied_from"] == [50]
    raw = texts[101].encode()
    for s in rows[101]["_spans"]:
        assert raw[s["start"] : s["end"]] in texts[50].encode()
