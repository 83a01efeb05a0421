"""Best-fit packing of token pieces into sequences of a fixed length.

Texts are tokenized once, where they lie.  What moves is one small row per
document: its id, its length and a checksum per piece (or the ids, if asked
for).  The rows are dealt round-robin into even parts of a stated size, so no
key, however frequent, makes a part larger.  Each part is packed by itself, by
bounded-space online best fit: pieces arrive in the order of their checksums,
which has nothing to do with their sizes, wait in a buffer of a fixed number of
pieces that is emptied longest first, and go to one of a fixed number of open
bins; where a bin more would be open, the fullest closes.  Neither number
depends on the input, and a task that runs again after a lost executor packs
alike.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import byte_marks, tokenizer_path
from tessera.llm.wordcache import WordCache

LENGTH = 2048
#: Bins that are open at once, pieces that wait to be packed, and documents in a part.
OPEN_BINS = 512
BUFFER = 1024
PART_ROWS = 32_768


#: How the tokenizers that WordEncoder understands change texts and cut words.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": CUTS}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def works_by_words(description: dict) -> bool:
    """Whether a tokenizer's own description proves that words may be encoded one by one.

    It must compose, lower-case and cut texts as above, merge by plain BPE
    without chance, and have no special strings but those that begin with <|.
    """
    model = description["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in description["added_tokens"])
    return plain and special and description["normalizer"] == NORMALIZER and description["pre_tokenizer"] == PRE_TOKENIZER


def cutter(ascii_only: bool):
    """Finds the parts of a lower-cased text of characters below U+0300 as CUTS does, by the kinds that Unicode gives these."""
    if ascii_only:
        return re.compile(r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r\x20a-z0-9]+").findall
    letters, numbers = ("".join(f"\\u{c:04x}" for c in range(0x300) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t-\r\x20\x85\xa0{letters}{numbers}]+").findall


class WordEncoder:
    """Ids of whole texts, part by part where the tokenizer is proved to work so, else by the tokenizer itself.

    If a text has only characters below U+0300 (each its own composed form) and
    no special strings, it is lower-cased and cut as the tokenizer cuts it, and
    each distinct part goes to the tokenizer's model once per cache.  Other
    texts are cut at ASCII white space, and each of their distinct words goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_words = works_by_words(json.loads(self.tokenizer.to_str()))
        self.marks = byte_marks()
        self.cut, self.cut_ascii = cutter(False), cutter(True)
        # letters below U+0300 whose small letters are beyond it are odd, too
        beyond = "".join(chr(c) for c in range(0x300) if any(x >= "\u0300" and x.isalpha() for x in chr(c).lower()))
        self.odd = re.compile(rf"[{beyond}\u0300-\U0010ffff]|<\|").search
        self.parts = WordCache(self._merge, 800_000)
        self.raw = WordCache(self._whole, 50_000)

    def _merge(self, parts: list[str]) -> list[bytes]:
        marks, merge = self.marks, self.tokenizer.model.tokenize
        written = [p if p.isascii() and p.isprintable() else "".join([marks[b] for b in p.encode()]) for p in parts]
        return [array("I", [t.id for t in merge(p)]).tobytes() for p in written]

    def _whole(self, words: list[bytes]) -> list[bytes]:
        return self._library([w.decode() for w in words])

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_words:
            return self._library(texts)
        # nothing here makes cycles, and a collection would walk the caches again and again
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        plain = [self._plain(t) for t in texts]
        cuts = [(self.cut_ascii if t.isascii() else self.cut)(t.lower()) if p else t.encode().split() for t, p in zip(texts, plain, strict=True)]
        parts = self.parts.known(c for c, p in zip(cuts, plain, strict=True) if p)
        raw = self.raw.known(c for c, p in zip(cuts, plain, strict=True) if not p)
        return [b"".join(map((parts if p else raw).__getitem__, c)) for c, p in zip(cuts, plain, strict=True)]

    def _plain(self, text: str) -> bool:
        return "<|" not in text if text.isascii() else not self.odd(text)


@cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process, so that what it knows is kept."""
    return WordEncoder(path)


class BestFit:
    """Bounded-space online best fit.

    Open bins are kept by their free space; bit f of a bitset says that a bin
    with f tokens free is open.  A piece goes to the open bin that it leaves
    fullest, found by the lowest set bit from its length up.  If none has room
    a bin is opened, and if too many were open the fullest closes first.
    """

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.most = length, open_bins
        self.bits, self.open, self.made, self.closed = 0, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def add(self, size: int) -> tuple[int, int]:
        """Bin and place of a piece of 1 to length tokens."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            where = self._take(free)
        else:
            free, where = self.length, self.made
            self.made += 1
            if self.open >= self.most and size < self.length:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
        left = free - size
        if left:
            if not self.bins[left]:
                self.bits |= 1 << left
            self.bins[left].append(where)
            self.open += 1
        return where, self.length - free


def placed(bins: BestFit, pieces: Iterator[tuple], buffer: int = BUFFER) -> Iterator[list[tuple]]:
    """Lists of (bin, offset, piece) of the pieces, tuples that begin with their size, as a full buffer of them is emptied."""
    while waiting := list(islice(pieces, buffer)):
        waiting.sort(key=lambda p: -p[0])
        yield [(*bins.add(p[0]), p) for p in waiting]


def _tokenized(df: DataFrame, text: str, tokenizer: str, length: int, keep_ids: bool, batch: int = 128):
    fields = [T.StructField("n", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))]
    kind = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * keep_ids)

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(tokenizer_path(tokenizer))
        step = 4 * length
        for column in columns:
            out = []
            for i in range(0, len(column), batch):
                for ids in encoder.encode([t or "" for t in column.iloc[i : i + batch]]):
                    ids += b"\0\0\0\0"
                    crcs = [zlib.crc32(ids[k : k + step]) for k in range(0, len(ids), step)]
                    out.append((len(ids) // 4, crcs, ids)[: 2 + keep_ids])
            yield pd.DataFrame(out, columns=kind.names)

    return F.pandas_udf(run, kind)(F.coalesce(F.col(text), F.lit("")))


def pack(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    length: int = LENGTH,
    open_bins: int = OPEN_BINS,
    buffer: int = BUFFER,
    part_rows: int = PART_ROWS,
    keep_ids: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Packs all documents; one row per piece.

    A document is its ids and then id 0; only one longer than a sequence is
    cut, and its full pieces are sequences of their own.  Columns: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset, and ids if keep_ids.
    rows: how many rows df has, if known; else it is counted.

    Defined cases: a null or empty text is the one token 0; a null id is kept;
    repeated rows are packed as often as they occur; very long texts become
    many pieces; no rows give no pieces; other columns are not read.
    """
    rows = df.count() if rows is None else rows
    parts = max(1, -(-rows // part_rows))
    one = _tokenized(df, text, tokenizer, length, keep_ids)
    small = df.select(F.col(doc_id).alias("doc_id"), one.alias("t")).select("doc_id", "t.*")
    id_type = small.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * keep_ids

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs = [x for f in frames for x in zip(f["doc_id"], f["n"], f["crcs"], f["ids"] if keep_ids else repeat(None), strict=False)]
        docs.sort(key=lambda d: (*d[2][:1], d[1], tuple(d[2]), str(d[0])))
        arriving = ((min(length, d[1] - start), i, start) for i, d in enumerate(docs) for start in range(0, d[1], length))
        bins, base = BestFit(length, open_bins), TaskContext.get().partitionId() << 40
        for found in placed(bins, arriving, buffer):
            out = []
            for where, offset, (size, i, start) in found:
                key, _, crcs, ids = docs[i]
                row = (None if pd.isna(key) else key, start // length, start, size, crcs[start // length], base + where, offset)
                out.append(row + ((np.frombuffer(ids, "<u4", size, 4 * start).astype("int32"),) if keep_ids else ()))
            yield _frame(out, keep_ids)

    return small.repartition(parts).mapInPandas(run, schema)


def _frame(rows: list[tuple], keep_ids: bool) -> pd.DataFrame:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    return pd.DataFrame(rows, columns=names).astype({"doc_id": object})
