import random

import sentencepiece

from tessera.llm import tokens
from tessera.llm.common import table, tokenizer_path
from tessera.llm.queries import op3_token_counts
from tests.llm.helpers import no_documents, odd_documents

MODEL = "piece_bpe_32k.model"


def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))


def test_counts_of_a_table(spark, small):
    model = library()
    want = {r["doc_id"]: (len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in table(spark, small, "documents").collect()}
    for r in op3_token_counts(spark, small).collect():
        assert (r["n_bytes"], r["n_tokens"]) == want[r["doc_id"]]
        assert r["over_limit"] == (r["n_tokens"] > 4096)


def test_odd_documents(spark):
    model = library()
    for r in tokens.count_tokens(odd_documents(spark)).collect():
        assert r["n_tokens"] == len(model.encode(r["text"] or ""))
    assert tokens.count_tokens(no_documents(spark)).count() == 0


def test_counter_is_the_library():
    counter, model = tokens.PieceCounter(tokenizer_path(MODEL)), library()
    assert counter.cuts and len(counter.single) > 30_000
    rng = random.Random(3)
    alphabet = [*"ab \n\t▁éﬁ的<s>\r　\x00\U0001f600", "  ", "\n\n", "</s>", "<unk>", "the ", "▁▁"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(5000)]
    assert counter.count(texts) == [len(x) for x in model.encode(texts)]
    counter.known.most = 50
    assert [counter.count([t])[0] for t in texts[:1000]] == [len(x) for x in model.encode(texts[:1000])]
