"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered whole, tokenized once with offsets, and its sorted
turn spans are met with the sorted token spans by binary search.

Template: each turn is <turn>role<says>text</turn> and a line feed.  The three
marks are tokens of their own, added to the tokenizer when it is loaded, so no
other token reaches over a turn's ends.  Inside roles and texts a backslash is
written twice and the < of a mark is written \\l, which takes every mark
out of the content and can be undone.

The tokens of a byte-level vocabulary spell a text's bytes out, so offsets are
sums of the tokens' own lengths.  Each distinct pre-token is encoded once per
cache where the tokenizer's description proves that it works by pre-tokens.

Defined cases: a null role or text is empty; turns go by turn, then role, then
text, null first; a null conv_id is one conversation; repeated rows are repeated
turns; an empty turn trains nothing; no rows give no conversations; extra
columns are not read.  The rows of a conversation come sorted to one task, which
reads them one after another: format_chats() holds one conversation at a time,
as its result is a row of it, digests() a bounded part of one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_marks, tokenizer_path
from tessera.llm.wordcache import WordCache

TURN, SAYS, END = "<turn>", "<says>", "</turn>"
_CONTROL = re.compile(r"\\|<(?=turn>|says>|/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_SHAPE = re.compile(f"{TURN}(.*?){SAYS}(.*?){END}\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else "\\l", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" if m[1] == "l" else m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + SAYS, escape(text)
        parts.append(f"{head}{body}{END}\n")
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """render() undone."""
    return [(unescape(m[1]), unescape(m[2])) for m in _SHAPE.finditer(formatted)]


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in a span.  Tokens and spans are sorted; a token counts if it overlaps."""
    mask = np.zeros(len(starts), bool)
    for low, high in spans:
        if low < high:
            mask[np.searchsorted(ends, low, "right") : np.searchsorted(starts, high, "left")] = True
    return mask


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The text under the mask, unescaped; tokens that share a character count it once."""
    at = np.flatnonzero(mask)
    if not len(at):
        return ""
    new = np.flatnonzero((np.diff(at) > 1) | (starts[at[1:]] > ends[at[:-1]])) + 1
    firsts, lasts = at[np.append(0, new)], at[np.append(new - 1, len(at) - 1)]
    out, done = [], 0
    for low, high in zip(starts[firsts].tolist(), ends[lasts].tolist(), strict=True):
        out.append(formatted[max(low, done) : high])
        done = max(done, high)
    return unescape("".join(out))


def _library(name: str):
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_tokens([AddedToken(x, normalized=False) for x in (TURN, SAYS, END)])
    return t


#: White space below U+0300, and how a byte-level tokenizer cuts text into pre-tokens.
_SPACE = r"\t-\r\x20\x85\xa0"
_CUT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_CUT_ASCII = r" ?[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\t-\r\x20A-Za-z0-9]+|[\t-\r\x20]+(?![^\t-\r\x20])|[\t-\r\x20]+"


class OffsetEncoder:
    """Token ids with offsets of rendered conversations."""

    def __init__(self, name: str):
        import regex

        self.library = _library(name)
        told = json.loads(self.library.to_str())
        before, model = told["pre_tokenizer"] or {}, told["model"]
        self.by_parts = (
            told["normalizer"] is None
            and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("ByteLevel", False, True)
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        )
        self.marks = {m: np.array([self.library.token_to_id(m)], "<i4").tobytes() for m in (TURN, SAYS, END)}
        self.split = re.compile(f"({TURN}|{SAYS}|{END})").split
        self.cut, self.cut_ascii = regex.compile(_CUT).findall, re.compile(_CUT_ASCII).findall
        self.odd = re.compile(r"[\u0300-\U0010ffff]").search
        self.shown = byte_marks()
        n = self.library.get_vocab_size(with_added_tokens=True)
        added = {int(k): v.content for k, v in self.library.get_added_tokens_decoder().items()}
        # a token of the vocabulary is written with a character for each byte
        self.sizes = np.array([len(added[i].encode()) if i in added else len(self.library.id_to_token(i) or "") for i in range(n)], "int64")
        self.known = WordCache(self._merge, 600_000)

    def _merge(self, parts: list[str]) -> list[bytes]:
        shown, merge = self.shown, self.library.model.tokenize
        return [np.array([t.id for t in merge("".join([shown[b] for b in p.encode()]))], "<i4").tobytes() for p in parts]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of each text, offsets in code points."""
        plain = [self.by_parts and not self.odd(t) for t in texts]
        rest = iter(self.library.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        cuts = [self._cuts(t) if p else [] for t, p in zip(texts, plain, strict=True)]
        known = self.known.known([part for part in parts if part not in self.marks] for parts in cuts) | self.marks
        out = []
        for text, parts, p in zip(texts, cuts, plain, strict=True):
            if not p:
                e = next(rest)
                at = np.array(e.offsets, "int32").reshape(-1, 2)
                out.append((np.array(e.ids, "int32"), at[:, 0].copy(), at[:, 1].copy()))
                continue
            ids = np.frombuffer(b"".join(map(known.__getitem__, parts)), "<i4")
            sizes = self.sizes[ids]
            ends = np.cumsum(sizes)
            out.append((ids, *_code_points(text, ends - sizes, ends)))
        return out

    def _cuts(self, text: str) -> list[str]:
        cut = self.cut_ascii if text.isascii() else self.cut
        return [part for piece in self.split(text) for part in ((piece,) if piece in self.marks else cut(piece))]


def _code_points(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in bytes as offsets in code points; a token of part of a character covers it."""
    data = np.frombuffer(text.encode(), "uint8")
    if len(ends) and ends[-1] != len(data) or not len(ends) and len(data):
        raise ValueError("tokens do not spell the text out")
    if len(data) != len(text):
        begun = np.cumsum((data & 0xC0) != 0x80)
        starts, ends = begun[starts] - 1, begun[ends - 1]
    return starts.astype("int32"), ends.astype("int32")


@cache
def offset_encoder(name: str) -> OffsetEncoder:
    """One for all tasks of a worker process, so that what it knows is kept."""
    return OffsetEncoder(name)


def _turns(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, role, text) of all rows, those of a conversation in one partition and in order."""
    empty = F.lit("")
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")


def _pieces(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple]:
    """(conv_id, whether it begins, turns): whole conversations, or parts of them from a size of most characters."""
    key, turns, size, begins = None, [], 0, True
    for batch in batches:
        for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if turns and (k != key or most and size > most):
                yield key, begins, turns
                begins, turns, size = k != key, [], 0
            key = k
            turns.append((role, text))
            size += len(role) + len(text)
    if turns:
        yield key, begins, turns


def _formatted(batches: Iterator[pa.RecordBatch], tokenizer: str, train_on: tuple[str, ...], most: int | None, batch: int) -> Iterator[tuple]:
    """(conv_id, whether it begins, formatted, ids, starts, ends, mask) of each piece."""
    encoder = offset_encoder(tokenizer)
    for pieces in batched(_pieces(batches, most), batch):
        rendered = [render(turns) for _, _, turns in pieces]
        for (key, begins, turns), (formatted, spans), (ids, starts, ends) in zip(pieces, rendered, encoder.encode([f for f, _ in rendered]), strict=True):
            trained = [s for s, (role, _) in zip(spans, turns, strict=True) if role in train_on]
            yield key, begins, formatted, ids, starts, ends, masked(starts, ends, trained)


def format_chats(
    df: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    train_on: tuple[str, ...] = ("assistant",),
    tokenizer: str = "byte_bpe_50k.json",
    batch: int = 32,
) -> DataFrame:
    """One row per conversation: conv_id, formatted, ids, starts, ends (token offsets in code points), mask."""
    rows = _turns(df, conv_id, turn, role, text)
    id_type = rows.schema["conv_id"].dataType.simpleString()
    kinds = {"ids": pa.int32(), "starts": pa.int32(), "ends": pa.int32(), "mask": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        key_type = first.schema.field("conv_id").type
        for rows in batched(_formatted(_chained(first, batches), tokenizer, train_on, None, batch), batch):
            lists = {}
            for i, (name, kind) in enumerate(kinds.items(), 3):
                at = np.cumsum([0, *(len(r[i]) for r in rows)]).astype("int32")
                lists[name] = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([r[i] for r in rows]), kind))
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([r[0] for r in rows], key_type), "formatted": pa.array([r[2] for r in rows], pa.string()), **lists})

    return rows.mapInArrow(run, f"conv_id {id_type}, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>")


def _chained(first, rest):
    yield first
    yield from rest


_DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    """What is read back from the formatted text and the mask alone, piece by piece."""

    def __init__(self) -> None:
        self.turns = self.loss = self.chars = 0
        self.said, self.trained = sha256(), sha256()

    def add(self, formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> None:
        turns = parse(formatted)
        loss = masked_text(formatted, starts, ends, mask)
        self.said.update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
        self.trained.update(loss.encode())
        self.turns, self.loss, self.chars = self.turns + len(turns), self.loss + len(loss), self.chars + len(formatted)

    def row(self) -> tuple:
        return self.turns, self.said.hexdigest(), self.loss, self.trained.hexdigest(), self.chars


def _rows(found: Iterator[tuple], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *(f.split()[0] for f in _DIGESTS.split(", "))]
    kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for rows in batched(found, 1000):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from the formatted text and the mask alone."""
    id_type = chats.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, formatted, starts, ends, mask in zip(*(batch.column(c) for c in ("conv_id", "formatted", "starts", "ends", "mask")), strict=True):
                d = _Digest()
                d.add(formatted.as_py(), *(x.values.to_numpy(zero_copy_only=False) for x in (starts, ends, mask)))
                found.append((key.as_py(), *d.row()))
            yield from _rows(iter(found), batch.schema.field("conv_id").type)

    return chats.mapInArrow(run, f"conv_id {id_type}, {_DIGESTS}")


def digests(
    df: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    train_on: tuple[str, ...] = ("assistant",),
    tokenizer: str = "byte_bpe_50k.json",
    most: int = 4_000_000,
    batch: int = 32,
) -> DataFrame:
    """read_back(format_chats(df)) in one pass: what is formatted is read back where it is.

    A conversation of more than most characters is formatted in parts, cut
    between turns, which give the same tokens, so memory does not grow with it.
    """
    rows = _turns(df, conv_id, turn, role, text)
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return

        def found() -> Iterator[tuple]:
            held: tuple | None = None
            for key, begins, formatted, _, starts, ends, mask in _formatted(_chained(first, batches), tokenizer, train_on, most, batch):
                if begins or held is None:
                    if held is not None:
                        yield held[0], *held[1].row()
                    held = (key, _Digest())
                held[1].add(formatted, starts, ends, mask)
            if held is not None:
                yield held[0], *held[1].row()

        yield from _rows(found(), first.schema.field("conv_id").type)

    return rows.mapInArrow(run, f"conv_id {id_type}, {_DIGESTS}")
