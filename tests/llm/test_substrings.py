from collections import defaultdict

import numpy as np

from tessera.llm import substrings
from tessera.llm.common import table
from tessera.llm.queries import op2_substring_dedup
from tests.llm.helpers import no_documents, odd_documents, words


SPACE = b" \t\n\r\x0b\x0c"


def chunk_ends(raw):
    """Ends of chunks, byte by byte."""
    h, last, ends, n = 0, 0, [], len(raw)
    low = [-substrings.LEAST]
    for i, x in enumerate(raw):
        h = (2 * h + int(substrings.GEAR[x])) % 65536
        if h < 65536 // substrings.MEAN and i + 1 < n and raw[i + 1] & 0xC0 != 0x80:
            if i + 1 - low[-1] >= substrings.LEAST or len(low) == 1:
                ends.append(i + 1)
            low.append(i + 1)
    out = []
    for end in [*ends, n]:
        while end - last > substrings.MOST:
            at = last + substrings.MOST
            while raw[at] & 0xC0 == 0x80:
                at -= 1
            out.append(at)
            last = at
        out.append(end)
        last = end
    return out if n else []


def inner_words(raw, a, b):
    """The stretch without what is left of words at its ends, as long as a space is near."""
    start, end = a, b
    while a and a < b and a - start < 64 and raw[a - 1] not in SPACE:
        a += 1
    while b < len(raw) and b > start and end - b < 64 and raw[b - 1] not in SPACE:
        b -= 1
    clean = (not a or raw[a - 1] in SPACE) and (b == len(raw) or raw[b - 1] in SPACE)
    return (a, b) if clean and a < b else (start, end)


def sequential(docs, cut=substrings.CUT):
    """Texts without their repeats, one document after another: every chunk met before is a repeat."""
    seen, out, counts = {}, {}, defaultdict(int)
    parts = {}
    for k, t in docs:
        raw = (t or "").encode()
        ends = chunk_ends(raw)
        parts[k] = [(a, b, raw[a:b]) for a, b in zip([0, *ends], ends)]
        for *_, d in parts[k]:
            counts[d] += 1
    for k, t in docs:
        raw, runs, froms = (t or "").encode(), [], []
        for a, b, d in parts[k]:
            if d in seen:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                    froms[-1].add(seen[d])
                else:
                    runs.append([a, b])
                    froms.append({seen[d]})
            seen.setdefault(d, k)
        keep = [(r, f) for r, f in zip(runs, froms, strict=True) if r[1] - r[0] >= cut]
        text, at = b"", 0
        for (a, b), _ in keep:
            a, b = inner_words(raw, a, b)
            text += raw[at:a]
            at = b
        out[k] = ((text + raw[at:]).decode(), sorted({x for _, f in keep for x in f}))
    return out


def test_table_against_sequential_search(spark, small):
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect())
    want = sequential(docs)
    for r in op2_substring_dedup(spark, small).collect():
        assert (r["text"], r["copied_from"]) == want[r["doc_id"]]
        assert r["n_chars"] + r["n_removed"] == len(dict(docs)[r["doc_id"]] or "") and r["shared"] >= (r["n_removed"] > 0)


def test_repeated_passages_are_caught_and_others_stay(spark):
    rng = np.random.default_rng(8)
    some = lambda n: " ".join(f"{rng.integers(10**5):x}" for _ in range(n))
    passages = [some(60) for _ in range(30)]
    planted = [(i, f"{some(40)} {passages[i % 30]} {some(int(rng.integers(5, 50)))}") for i in range(90)]
    clean = [(1000 + i, some(200)) for i in range(60)]
    rows = {r["doc_id"]: r for r in substrings.cut_repeats(spark.createDataFrame(planted + clean, "doc_id long, text string")).collect()}
    for k, t in clean:
        assert rows[k]["_text"] == t and not rows[k]["_shared"]
    shared = [rows[k]["_shared"] for k, _ in planted]
    assert np.mean(shared) > 0.97
    for k, t in planted:
        text = rows[k]["_text"]
        if k < 30:
            assert text == t  # the first place is kept
        elif rows[k]["_shared"]:
            assert passages[k % 30] not in text
            assert k % 30 in rows[k]["_copied_from"] and {x % 30 for x in rows[k]["_copied_from"]} == {k % 30}
            assert set(words(text)) <= set(words(t))


def test_boundaries_resist_insertions():
    rng = np.random.default_rng(9)
    raw = rng.integers(97, 123, 20_000).astype("uint8").tobytes()

    def cut(x):
        ends = substrings.boundaries(np.frombuffer(x, "uint8")).tolist()
        return [x[a:b] for a, b in zip([0, *ends], ends)]

    a, b = cut(raw), cut(raw[:9000] + b"inserted" + raw[9000:])
    assert b"".join(b) == raw[:9000] + b"inserted" + raw[9000:]
    assert len(set(a) - set(b)) <= 4
    assert max(map(len, a)) <= substrings.MOST
    wide = ("é\U0001f600中" * 3000).encode()
    assert all(x.decode() for x in cut(wide)) and b"".join(cut(wide)) == wide
    assert all(len(x) <= substrings.MOST for x in cut(b"a" * 5000))


def test_rolling_hash_is_gear():
    data = np.random.default_rng(10).integers(0, 256, 300).astype("uint8")
    h, want = 0, []
    for x in data.tolist():
        h = (2 * h + int(substrings.GEAR[x])) % 65536
        want.append(h)
    assert substrings.rolling(data).tolist() == want


def test_odd_documents(spark):
    df = odd_documents(spark)
    rows = substrings.cut_repeats(df).collect()
    assert len(rows) == df.count()
    long = sorted((r["doc_id"], len(r["_text"])) for r in rows if r["text"] and len(r["text"]) > 10_000)
    assert long[0][1] > 100_000 and long[1][1] < 1000
    assert all(r["_text"] == r["text"] for r in rows if r["text"] is None or len(r["text"]) < 20)
    out = substrings.deduplicated(df)
    assert out.columns == df.columns
    assert substrings.deduplicated(no_documents(spark)).count() == 0


def test_many_rows_without_an_id_or_of_one_id_lose_nothing_of_their_own(spark):
    rng = np.random.default_rng(11)
    passage = " ".join(f"{rng.integers(10**6):x}" for _ in range(60))
    for key in (None, 7):
        rows = [(key, f"u{i}x " + passage + f" v{i}x" if i % 3 else f"alone{i} " * 3) for i in range(10_000)]
        got = [r["_text"] for r in substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert len(got) == len(rows) and sum(passage in t for t in got) == 1
        left = {w for t in got for w in words(t)}
        assert {w for i in range(10_000) for w in ((f"u{i}x", f"v{i}x") if i % 3 else (f"alone{i}",))} <= left
        assert all(len(words(t)) <= 30 or passage in t for t in got)


def test_columns_with_names_of_its_own_stay(spark):
    df = odd_documents(spark)
    own = [c for c in df.columns if c not in ("text", "n_chars", "_text", "_spans")]
    quoted = [f"`{c}`" for c in own]
    got = substrings.cut_repeats(df)
    assert sorted(map(str, got.select(*quoted).collect())) == sorted(map(str, df.select(*quoted).collect()))
    kept = substrings.deduplicated(df).select(*quoted, "`_text`", "`_spans`").collect()
    assert kept and set(map(str, kept)) <= set(map(str, df.select(*quoted, "`_text`", "`_spans`").collect()))
