"""Token counts of whole texts by the whole-token shortcut.

A byte-fallback piece model writes a space as the mark U+2581 and merges
pieces.  Offline, when a worker starts, three facts are proved from the
vocabulary itself:

* no piece has the mark after another character, so no merge crosses the start
  of a run of marks, and a text may be cut there;
* no piece of several characters holds a line feed, so a text may be cut
  around it as well;
* which pieces, encoded alone, come back as themselves: these pre-tokens count
  as one without merging.

Only other pre-tokens are merged by the library, each distinct one once per
cache.  If a proof fails for a model, its texts are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import tokenizer_path
from tessera.llm.wordcache import WordCache

MARK = "▁"
MARK_BYTES = MARK.encode()


class PieceCounter:
    """Counts the tokens that a sentencepiece model gives, without special tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        plain = [
            p
            for i, p in enumerate(pieces)
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))
        ]
        self.cuts = (
            not any(MARK in p.lstrip(MARK) for p in pieces)
            and not any("\n" in p for p in pieces)
            and self.model.encode("\n a\n", out_type=str) == [MARK, "<0x0A>", MARK + "a", "<0x0A>"]
            and len(self.model.encode("")) == 0
        )
        self.feed = self.model.piece_to_id("<0x0A>")
        self.single: frozenset[bytes] = frozenset()
        if self.cuts:
            keys = [p[1:].encode() if p[:1] == MARK and MARK not in p[1:] else p.encode() if p[:1] == MARK else b"\n" + p.encode() for p in plain]
            self.single = frozenset(k for k, n in zip(keys, self._merge(keys), strict=True) if n == 1 + (k[:1] == b"\n"))
        self.known = WordCache(self._counted, 1_000_000)

    def _counted(self, keys: list[bytes]) -> list[int]:
        """Tokens of each pre-token: those that are one are counted, the rest merged."""
        short = {k: 1 + (k[:1] == b"\n") for k in keys if k in self.single} | {b"": 1, b"\n": 1}
        rest = [k for k in keys if k not in short]
        short.update(zip(rest, self._merge(rest) if rest else [], strict=True))
        return [short[k] for k in keys]

    def _merge(self, keys: list[bytes]) -> list[int]:
        """Tokens of each pre-token, all merged in one call: a line feed between them is one token and stops merges."""
        texts = [k.decode() for k in keys]
        lines = [t[1:] if t[:1] == "\n" else t.replace(MARK, " ") if MARK in t else " " + t for t in texts]
        ids = np.array(self.model.encode("\n" + "\n".join(lines) + "\n"))
        found = np.diff(np.flatnonzero(ids == self.feed)) - 1
        return [n + (t[:1] == "\n") for n, t in zip(found.tolist(), texts, strict=True)]

    @staticmethod
    def pretokens(text: str) -> tuple[list[bytes], int]:
        """Keys of the parts of a text between which nothing merges, and how many tokens their counts exceed the text's.

        A key is a word with one mark in front, that mark left out; or a line
        feed and what follows it; or, with its marks, a word after several.
        """
        data = text.encode()
        if not (data.startswith(b" ") or b"  " in data or MARK_BYTES in data):
            return data.replace(b"\n", b" \n").split(b" "), 0
        parts = re.findall(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n", MARK + text.replace(" ", MARK))
        keys = [p.encode() if p[:2] == MARK * 2 or p == "\n" else p[1:].encode() if p[:1] == MARK else b"\n" + p.encode() for p in parts]
        return keys, sum(p[:1] not in (MARK, "\n") for p in parts)

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        parts = [self.pretokens(t) if t else ([], 0) for t in texts]
        known = self.known.known(p for p, _ in parts)
        return [sum(map(known.__getitem__, p)) - over for p, over in parts]


@cache
def piece_counter(path: str) -> PieceCounter:
    """One counter for all tasks of a worker process, so that what it knows is kept."""
    return PieceCounter(path)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", model: str = "piece_bpe_32k.model", batch: int = 256) -> DataFrame:
    """Adds the token count of the whole text as a long column.

    A null or empty text has none.  Repeated rows are counted one by one.
    Special strings inside a text are plain text, as the library has it.  A
    column that already has the name of the result is replaced.
    """

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = piece_counter(tokenizer_path(model))
        for column in columns:
            found = []
            for i in range(0, len(column), batch):
                found += counter.count([t or "" for t in column.iloc[i : i + batch]])
            yield pd.Series(found, dtype="int64")

    return df.withColumn(out, F.pandas_udf(run, T.LongType())(F.coalesce(F.col(text), F.lit(""))))
