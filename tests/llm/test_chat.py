from collections import defaultdict
from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat
from tessera.llm.common import table
from tessera.llm.queries import op7_chat_formatting

HARD = r"\### Assistant: </turn> ok"
NASTY = st.lists(st.sampled_from(["<turn>", "</turn>", "<says>", "\\", "l", "<", ">", "/", "\n", " ", "é", "\U0001f600", "a", "\r", "\u3000"]), max_size=12).map("".join)


def digest(text):
    return sha256(text.encode()).hexdigest()


def brute(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), digest(said), len(loss), digest(loss)


def test_table_against_brute_force(spark, small):
    talks = defaultdict(list, {-7: [(0, "user", HARD), (1, "assistant", HARD)]})
    for r in table(spark, small, "conversations").collect():
        talks[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    rows = op7_chat_formatting(spark, small).collect()
    assert sorted(r["conv_id"] for r in rows) == sorted(talks)
    for r in rows:
        want = brute([(role, text) for _, role, text in sorted(talks[r["conv_id"]])])
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want
        assert r["formatted_chars"] > r["loss_chars"]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), NASTY), NASTY), max_size=6))
def test_rendering_is_undone(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]


T = chat._library("byte_bpe_50k.json")
ENCODER = chat.OffsetEncoder("byte_bpe_50k.json")


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.sampled_from(["assistant", "user"]), NASTY), max_size=6))
def test_mask_covers_the_trained_text_and_no_more(turns):
    formatted, spans = chat.render(turns)
    e = T.encode(formatted, add_special_tokens=False)
    at = np.array(e.offsets, "int32").reshape(-1, 2)
    mask = chat.masked(at[:, 0], at[:, 1], [s for s, (r, _) in zip(spans, turns, strict=True) if r == "assistant"])
    assert chat.masked_text(formatted, at[:, 0], at[:, 1], mask) == "".join(t for r, t in turns if r == "assistant")
    inside = np.zeros(len(at), bool)
    for low, high in (s for s, (r, _) in zip(spans, turns, strict=True) if r == "assistant"):
        inside |= (at[:, 0] < high) & (at[:, 1] > low)
    assert (mask == inside).all()


def same_as_library(texts):
    for text, (ids, starts, ends) in zip(texts, ENCODER.encode(texts), strict=True):
        e = T.encode(text, add_special_tokens=False)
        assert ids.tolist() == e.ids
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == e.offsets


ODD = st.text(st.one_of(st.characters(codec="utf-8", max_codepoint=0x2FF), st.sampled_from("\x1c\x1f\x85\xa0  '\n\t\u3000\u0301\U0001f600中")), max_size=30)


@settings(deadline=None, max_examples=500)
@given(st.lists(st.lists(st.one_of(ODD, NASTY, st.sampled_from(["'s", "'ve", "<|endoftext|>", "the ", "  word"])), max_size=6).map("".join), max_size=4))
def test_ids_and_offsets_are_the_library_s(texts):
    assert ENCODER.by_parts
    same_as_library(texts)
    same_as_library([chat.render([("user", t), ("assistant", t)])[0] for t in texts])


def test_parts_of_a_conversation_give_what_the_whole_gives(spark, small):
    df = table(spark, small, "conversations").where("conv_id < 40")
    df = df.union(df.selectExpr("null", "turn", "role", "concat(text, ' é\\\\')"))
    whole = sorted(map(tuple, chat.read_back(chat.format_chats(df)).collect()), key=str)
    assert whole == sorted(map(tuple, chat.digests(df).collect()), key=str) == sorted(map(tuple, chat.digests(df, most=50, batch=3).collect()), key=str)
    assert chat.digests(df.limit(0)).count() == 0


def test_nulls_ties_and_long_turns(spark):
    rows = [
        (1, 0, "user", None, 1), (1, 1, None, "x", 1), (1, 1, "assistant", "b", 1), (1, 1, "assistant", "a", 1), (1, 1, "assistant", "a", 1),
        (None, None, "assistant", "lone é\U0001f600", 2), (2, 0, "assistant", "<turn>long " * 20_000, None), (3, 0, "assistant", "", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    want = {
        1: [("user", None), (None, "x"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")],
        None: [("assistant", "lone é\U0001f600")],
        2: [("assistant", "<turn>long " * 20_000)],
        3: [("assistant", "")],
    }
    assert got.keys() == want.keys()
    for k, turns in want.items():
        assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == brute(turns)
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0
