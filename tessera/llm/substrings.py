"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's bytes; a low value ends a chunk, so boundaries
depend on the last 16 bytes alone and an insertion moves only the chunks
around it.  Chunks are compared by digest.  The first place of a chunk, by
document id and position, is kept; at any other place it is a repeat.  Where
chunks that are seen twice follow each other, the shortest stretches of them
that are long enough to be cut are compared by a digest of their chunks in turn.
A stretch is cut out if it stood in one piece at an earlier place; so a phrase
which two documents share by chance stays, and phrases shared with several
documents do not add up.

Chunks move as a digest, a place and what names their document: its id, and
where ids are null or repeat, 128 bits of its text beside it.  Digests are counted by partial
aggregates before the shuffle; only places of digests seen twice go on, and
the engine's skew join splits a digest that a third of all documents hold.  The
repeats of one document, and its stretches of them, are bounded by its own length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filtered, forget, free_prefix, text_key, written

#: One byte in MEAN ends a chunk, unless LEAST bytes have not passed since the last that could; none is longer than MOST.
MEAN, LEAST, MOST = 16, 8, 256
#: Bytes of whole repeated chunks in a row from which they are cut: a repeated passage of 50 words
#: has that many between the parts of chunks at its ends, a repeated line mostly not.
CUT = 120


_LONGS = struct.Struct("<qq")


def gear(seed: int = 7) -> np.ndarray:
    """The table of 256 random 16-bit values."""
    x = np.arange(1, 257, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(48)).astype("uint16")


GEAR = gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 * h[i - 1] + GEAR[data[i]] modulo 2^16 at every byte, by doubling the window four times."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint16(width)
    return h


def boundaries(data: np.ndarray, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Ends of the chunks of a text's bytes, never inside a character."""
    n = len(data)
    ends = np.flatnonzero(rolling(data) < 65536 // mean) + 1
    ends = ends[ends < n]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    ends = ends[np.diff(ends, prepend=-least) >= least]
    ends = np.append(ends, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() <= most:
        return ends
    more = []
    for end, gap in zip(ends[gaps > most].tolist(), gaps[gaps > most].tolist(), strict=True):
        at = end - gap + most
        while at < end:
            while at > end - gap and data[at] & 0xC0 == 0x80:
                at -= 1
            more.append(at)
            at += most
    return np.union1d(ends, more).astype("int64")


def chunks(df: DataFrame, batch: int = 500) -> DataFrame:
    """(digest, at, and what names the document) of every chunk of a table of text and names; at holds start and length."""
    names = [c for c in df.columns if c != "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest as digest

        for part in (f.iloc[i : i + batch] for f in frames for i in range(0, len(f), batch)):
            digests, at, counts = [], [], np.zeros(len(part), "int64")
            for row, text in enumerate(part["text"]):
                raw = text.encode()
                if not raw:
                    continue
                ends = boundaries(np.frombuffer(raw, "uint8"))
                sizes = np.diff(ends, prepend=0)
                starts = ends - sizes
                digests += [digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                at.append((starts << 9) | sizes)
                counts[row] = len(ends)
            if at:
                whose = {c: np.repeat(part[c].to_numpy("int64"), counts) for c in names}
                yield pd.DataFrame({"digest": np.array(digests, "uint64").view("int64"), "at": np.concatenate(at), **whose})

    return df.mapInPandas(run, ", ".join(["digest long, at long", *(f"{c} long" for c in names)]))


def windows(edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indexes of edges: the shortest stretches of at least so many bytes that start, or end, at each edge."""
    n, least = len(edges), max(least, 1)
    last = np.searchsorted(edges, edges + least)
    first = np.searchsorted(edges, edges - least, "right") - 1
    pairs = np.concatenate([np.flatnonzero(last < n) * n + last[last < n], first[first >= 0] * n + np.flatnonzero(first >= 0)])
    return np.divmod(np.unique(pairs), n)


def _stretches(at: np.ndarray, digest: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, two longs of a digest) of the windows of a document's chunks that follow each other."""
    from xxhash import xxh3_128_digest

    order = np.argsort(at)
    start, digest = at[order] >> 9, np.ascontiguousarray(digest[order])
    end = start + (at[order] & 511)
    heads = np.flatnonzero(np.append(True, start[1:] != end[:-1])).tolist()
    for low, high in zip(heads, [*heads[1:], len(start)], strict=True):
        edges = np.append(start[low:high], end[high - 1])
        if edges[-1] - edges[0] >= least:
            for a, b in zip(*(x.tolist() for x in windows(edges, least)), strict=True):
                yield int(edges[a]), int(edges[b]), *_LONGS.unpack(xxh3_128_digest(digest[low + a : low + b].tobytes()))


def _joined(starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """The union of stretches, as those [start, end] that do not meet."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _whole_words(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The stretch without the words at its ends that it holds parts of; as it is, if there are no spaces near."""
    a, b = start, end
    while a and a < end and a - start < 64 and raw[a - 1] not in b" \t\n\r\x0b\x0c":
        a += 1
    while b < len(raw) and b > start and end - b < 64 and raw[b - 1] not in b" \t\n\r\x0b\x0c":
        b -= 1
    near = (a == 0 or raw[a - 1 : a] in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")) and (b == len(raw) or raw[b - 1 : b] in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    return (a, b) if near and a < b else (start, end)


def cut_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", cut: int = CUT, prefix: str = "_") -> DataFrame:
    """Adds prefix + text, the text without its repeats, and what was found.

    prefix + spans: the cut stretches as (start, end) in bytes; copied_from: ids
    of the documents that keep them; shared: whether some stretch of the
    document, kept or cut, is repeated.

    Defined cases: null and empty texts have no chunks and stay; a null id
    comes before all others; rows alike in id and text are one document to the
    search and each is kept or cut alike; rows of one id, or of none, with other
    texts are documents in the order of 128 bits of their texts; texts are read
    whole; other columns stay as they are, but for those named like a result,
    which are replaced.
    """
    results = [prefix + c for c in ("text", "spans", "shared", "copied_from")]
    df = df.drop(*results)
    p = free_prefix(df, "cut")
    given, id_of = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    body = F.coalesce(given, F.lit(""))
    named = F.coalesce(id_of.cast("long"), F.lit(-(2**63)))
    repeated = bool(df.groupBy(named.alias("id")).count().where("count > 1").limit(1).count())
    own = {"doc_id": named} | (dict(zip(("k1", "k2"), text_key(id_of, body), strict=True)) if repeated else {})
    names = list(own)
    found = written(chunks(df.select(*[c.alias(n) for n, c in own.items()], body.alias("text"))), "chunks")
    place = F.struct(*names, "at")
    # aggregates are written before they are joined, so that a join's skewed side can be split
    twice = written(found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "twice")
    some = written(found.join(twice, "digest", "left_semi"), "repeated")
    forget(found)
    forget(twice)
    first = written(some.groupBy("digest").agg(F.min(place).alias("first")), "first")
    seen = some.join(first, "digest").withColumn("repeat", place != F.col("first"))
    mine = seen.groupBy(*names).agg(
        F.collect_list("at").alias("at"),
        F.collect_list("digest").alias("digest"),
        F.collect_list("repeat").alias("repeat"),
        F.collect_list("first.doc_id").alias("of"),
    )
    mine = written(mine, "mine")
    forget(some)
    forget(first)
    kinds = ", ".join(f"{n} long" for n in names)

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for *whose, at, digest in zip(*(frame[c] for c in (*names, "at", "digest")), strict=True):
                out += [(*whose, *s) for s in _stretches(np.asarray(at, "int64"), np.asarray(digest, "int64"), cut)]
            yield pd.DataFrame(out, columns=[*names, "start", "end", "s1", "s2"])

    whole = written(mine.select(*names, "at", "digest").mapInPandas(combine, f"{kinds}, start int, end int, s1 long, s2 long"), "stretches")
    place = F.struct(*names, "start")
    origin = whole.groupBy("s1", "s2").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    origin = written(origin, "origins")
    again = F.when(place != F.col("origin"), True)
    shared = whole.join(origin, ["s1", "s2"]).groupBy(*names).agg(
        F.collect_list(F.when(again, F.col("start"))).alias("starts"), F.collect_list(F.when(again, F.col("end"))).alias("ends")
    )

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for *whose, starts, ends, at, repeat, of in zip(*(frame[c] for c in (*names, "starts", "ends", "at", "repeat", "of")), strict=True):
                runs = _joined(np.asarray(starts, "int64"), np.asarray(ends, "int64"))
                start = np.asarray(at, "int64") >> 9
                inside = np.zeros(len(start), bool)
                for a, b in runs:
                    inside |= (start >= a) & (start < b)
                keepers = np.asarray(of, "int64")[inside & np.asarray(repeat, bool)]
                out.append((*whose, [{"start": a, "end": b} for a, b in runs], np.unique(keepers).tolist()))
            yield pd.DataFrame(out, columns=[*names, "spans", "copied_from"])

    both = shared.join(mine.select(*names, "at", "repeat", "of").hint("shuffle_merge"), names)
    cuts = written(both.mapInPandas(decide, f"{kinds}, spans array<struct<start:int,end:int>>, copied_from array<long>"), "cuts")
    for table in (mine, whole, origin):
        forget(table)
    cuts = cuts.select(*[F.col(n).alias(f"{p}of_{n}") for n in names], F.col("spans").alias(f"{p}spans"), F.col("copied_from").alias(f"{p}from"))
    docs = df.withColumns({p + n: c for n, c in own.items()})
    same = [F.col(p + n) == F.col(f"{p}of_{n}") for n in names]
    both = docs.hint("shuffle_merge").join(cuts, same, "left")
    spans, nothing = F.col(f"{p}spans"), F.array()
    touched = F.size(spans) > 0
    new = _without(F.when(touched, given), F.when(touched, spans))
    values = (
        F.when(touched, new).otherwise(given),
        F.coalesce(spans, nothing.cast("array<struct<start:int,end:int>>")),
        spans.isNotNull(),
        F.transform(F.coalesce(f"{p}from", nothing.cast("array<long>")), lambda x: F.when(x != -(2**63), x)),
    )
    return both.select(*[F.col(f"`{c}`") for c in df.columns], *[v.alias(n) for v, n in zip(values, results, strict=True)])


def _without(text: Column, spans: Column) -> Column:
    def run(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(text, spans, strict=True):
            if t is None or ss is None:
                out.append(None)
                continue
            raw, parts, at = t.encode(), [], 0
            for s in ss:
                a, b = _whole_words(raw, s["start"], s["end"])
                parts.append(raw[at:a])
                at = b
            out.append(b"".join([*parts, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(text, spans)


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", cut: int = CUT) -> DataFrame:
    """The documents with their repeats cut out and n_chars counted anew; those of which nothing but white space is left go.

    Defined cases: as for cut_repeats(); a text that was null or blank before stays.
    """
    p = free_prefix(df, "new")
    out = cut_repeats(df, doc_id, text, cut, p)
    whole = F.size(f"{p}spans") == 0
    out = filtered(out, whole | F.col(f"{p}text").rlike(r"[^\x20\x09-\x0D]"))
    new = {text: F.col(f"{p}text"), n_chars: F.when(whole, F.col(f"`{n_chars}`")).otherwise(F.char_length(f"{p}text").cast("long"))}
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
