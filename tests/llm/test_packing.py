import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.common import table, tokenizer_path
from tessera.llm.queries import op1_best_fit_packing
from tessera.llm.wordcache import WordCache
from tests.llm.helpers import no_documents, odd_documents


def ids_of(texts):
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(pieces, docs, length=2048):
    """Pieces are the documents' cut ids, and fill sequences without gaps or overlaps."""
    want = []
    for key, ids in zip([d["doc_id"] for d in docs], ids_of([d["text"] for d in docs]), strict=True):
        for k, start in enumerate(range(0, len(ids), length)):
            part = ids[start : start + length]
            want.append((key, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = [(p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces]
    assert sorted(got, key=str) == sorted(want, key=str)
    held = defaultdict(list)
    for p in pieces:
        held[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(held), sum(p["length"] for p in pieces)


def test_packs_a_table_closely(spark, small):
    pieces = op1_best_fit_packing(spark, small).collect()
    docs = table(spark, small, "documents").collect()
    sequences, tokens = check(pieces, docs)
    assert sequences <= -(-tokens // 2048) + 2


def test_odd_documents(spark):
    df = odd_documents(spark)
    check(packing.pack(df, part_rows=4).collect(), df.collect())
    assert packing.pack(no_documents(spark)).count() == 0


def test_keeps_ids(spark):
    df = odd_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    by_doc = defaultdict(dict)
    for r in packing.pack(df, keep_ids=True, length=64).collect():
        assert r["length"] == len(r["ids"]) <= 64
        by_doc[r["doc_id"]][r["piece"]] = r["ids"]
    docs = df.collect()
    for d, ids in zip(docs, ids_of([d["text"] for d in docs]), strict=True):
        assert [i for k in sorted(by_doc[d["doc_id"]]) for i in by_doc[d["doc_id"]][k]] == ids


def test_best_fit_takes_the_fullest_bin_with_room():
    b = packing.BestFit(10, 8)
    assert b.add(6) == (0, 0)
    assert b.add(7) == (1, 0)
    assert b.add(3) == (1, 7)
    assert b.add(4) == (0, 6)
    assert b.add(10) == (2, 0)


def test_the_fullest_bin_closes_first():
    b = packing.BestFit(10, 2)
    b.add(6), b.add(7), b.add(8)  # the third opens and closes the bin of 7
    assert b.add(3) == (0, 6)
    assert b.add(2) == (2, 8)
    rng = np.random.default_rng(1)
    for most in (1, 3, 100):
        b, fill = packing.BestFit(50, most), defaultdict(int)
        for size in rng.integers(1, 51, 2000).tolist():
            where, offset = b.add(size)
            assert fill[where] == offset
            fill[where] += size
            assert fill[where] <= 50 and b.open <= most


def test_word_encoder_is_the_tokenizer():
    rng = np.random.default_rng(2)
    alphabet = [chr(c) for c in range(1, 0x250)] + list("̀́中\U0001f600 　Å") + ["'s", " the", "<|endoftext|>", "<|", "J̌"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 25))) for _ in range(4000)]
    found = packing.WordEncoder(tokenizer_path("word_bpe_49k.json")).encode(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [x[:-1] for x in ids_of(texts)]


def test_cache_that_overflows_changes_nothing():
    e = packing.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    texts = [f"word{i} other{i}. third" for i in range(300)]
    want = e.encode(texts)
    e.parts.most = 50
    assert [e.encode([t])[0] for t in texts] == want


def test_cache_keeps_what_is_asked_for_again():
    asked = []
    cache = WordCache(lambda ws: asked.extend(ws) or [w * 2 for w in ws], 20, longest=5)
    for i in range(200):
        assert cache.known([["hot", f"w{i}"], [f"v{i}", "hot"]]) == {w: w * 2 for w in ("hot", f"w{i}", f"v{i}")}
        assert len(cache.young) + len(cache.old) <= 30
    assert asked.count("hot") == 1
    assert cache.known([["toolong"]]) == {"toolong": "toolongtoolong"} and "toolong" not in cache.young


def test_bins_close_with_the_registered_parameters():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, packing.LENGTH + 1, packing.PART_ROWS).tolist()
    bins = packing.BestFit()
    found = [x for part in packing.placed(bins, iter([(s,) for s in sizes])) for x in part]
    assert len(found) == len(sizes) and bins.closed > 0 and bins.open <= packing.OPEN_BINS
    assert bins.made <= 1.01 * -(-sum(sizes) // packing.LENGTH)


def test_a_tokenizer_that_is_not_proved_encodes_whole_texts():
    path = tokenizer_path("byte_bpe_50k.json")
    e, t = packing.WordEncoder(path), Tokenizer.from_file(path)
    texts = ["Hello World, this is it", "", "  two  spaces\n\nÉté <|endoftext|>"]
    assert not e.by_words and packing.WordEncoder(tokenizer_path("word_bpe_49k.json")).by_words
    assert [np.frombuffer(f, "<u4").tolist() for f in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_every_character_that_is_cut_here_is_cut_as_the_tokenizer_does():
    texts = [s for c in map(chr, range(1, 0x300)) for s in (f"a{c}b", f"1{c}!", f"!{c}{c}", f" {c}")]
    found = packing.WordEncoder(tokenizer_path("word_bpe_49k.json")).encode(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [x[:-1] for x in ids_of(texts)]
