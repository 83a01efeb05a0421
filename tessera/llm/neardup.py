"""MinHash near-duplicates: fast similarity sketches, banding and exact verification.

A sketch has t coordinates.  Round i < t hashes every shingle to a random
coordinate, round t + j all of them to coordinate j; a coordinate keeps the
least hash of the first round that reaches it.  So every coordinate is filled
after 2t rounds whatever the set, mostly after a few, and the share of equal
coordinates is as concentrated about the resemblance as independent ones.
With 40 bands of 4 a pair of resemblance 0.75 goes unseen with a chance of
(1 - 0.75^4)^40 = 2.5e-7.

What moves are band keys and ids; texts only to be verified, a document's once for
some hundreds of its partners:

1. Documents of equal shingle sets are one class, named by its least id.
2. In each band bucket every class is paired with the least one, a pair per
   class first, the rest if it does not follow from earlier links.  A bucket of
   n classes gives n - 1 pairs, not n^2.
3. In buckets that still hold several components, members of different ones
   may be near, too.  They are not paired bucket by bucket, as a passage that
   very many share fills buckets with strangers: those that share a rare enough
   shingle are, which every two near ones do.
4. All pairs are verified on full shingle sets, and links become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, free_prefix, one_of_each, text_key, written
from tessera.llm.components import components

BANDS, ROWS = 40, 4
SHINGLE = 5
#: Partners of a document that one task verifies, about.
PARTNERS = 512
NEAR, OF = 75, 100
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scrambler."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts: A to Z lower-cased, words at ASCII white space."""

    def __init__(self, window: int = SHINGLE):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        self.window = window
        self.digest = digest
        self.odd = _mix(np.arange(1, window + 1, dtype="uint64") * _U(0x9E3779B97F4A7C15)) | _U(1)

    def shingles(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, "uint64")
        ids = np.fromiter(map(self.digest, words), "uint64", n)
        with np.errstate(over="ignore"):
            if n < self.window:
                # a short sequence is one shingle, never equal to a full window
                return _mix(np.array([(ids * self.odd[:n]).sum() + _U(n)], "uint64"))
            sums = ids[: n - self.window + 1] * self.odd[0]
            for k in range(1, self.window):
                sums = sums + ids[k : n - self.window + 1 + k] * self.odd[k]
            return np.unique(_mix(sums))


@cache
def shingler() -> Shingler:
    """One for all tasks of a worker process."""
    return Shingler()


def sketch(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, one row each; a value holds its round in its high bits."""
    out = np.full(len(sets) * size, np.iinfo("uint64").max, "uint64")
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, "uint64")
    with np.errstate(over="ignore"):
        for i in range(2 * size):
            if not len(items):
                break
            h = _mix(items + _U(0x9E3779B97F4A7C15) * _U(i + 1))
            spot = (h >> _U(40)) % _U(size) if i < size else _U(i - size)
            value = _U(i << 40) | _mix(h) >> _U(24)
            np.minimum.at(out, rows * size + spot.astype("int64"), value)
            full = (out.reshape(-1, size) != np.iinfo("uint64").max).all(1)
            left = ~full[rows]
            rows, items = rows[left], items[left]
    return out.reshape(-1, size)


def band_keys(sketches: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band; bands never share a key but by chance."""
    with np.errstate(over="ignore"):
        odd = _mix(np.arange(1, bands * rows + 1, dtype="uint64")) | _U(1)
        return _mix((_mix(sketches) * odd).reshape(-1, bands, rows).sum(2) + np.arange(bands, dtype="uint64")).astype("int64")


def _sketched(df: DataFrame, bands: int, rows: int, batch: int = 256) -> DataFrame:
    """id, size, two longs that name the shingle set, and the band keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        make = shingler().shingles
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                sets = [make(t) for t in part["text"]]
                some = [j for j, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), bands), "int64")
                if some:
                    keys[some] = band_keys(sketch([sets[j] for j in some], bands * rows), bands, rows)
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "int64").reshape(-1, 2)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "size": [len(s) for s in sets], "s1": names[:, 0], "s2": names[:, 1], "keys": list(keys)})

    return df.mapInPandas(run, "id long, size long, s1 long, s2 long, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, near: int, of: int) -> DataFrame:
    """Of the pairs (u, v) those whose full shingle sets are near.

    The partners of a document are dealt to as many tasks as they fill; its own
    text goes to each of these once, not once a pair, and is read before theirs.
    """
    pairs = written(pairs, "pairs")  # read twice
    parts = pairs.groupBy("u").agg(F.floor((F.count("*") + (PARTNERS - 1)) / PARTNERS).cast("int").alias("parts"))
    parts = written(parts, "partners")
    bodies = texts.select("id", "text")
    own = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.join(bodies.withColumnRenamed("id", "u"), "u").select("u", "part", F.lit(None).cast("long").alias("v"), "text")
    others = pairs.join(parts, "u").withColumn("part", F.pmod(F.hash("v"), F.col("parts")))
    others = others.join(bodies.withColumnRenamed("id", "v"), "v").select("u", "part", "v", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, whose, sets = shingler().shingles, None, []
        for frame in frames:
            out = []
            for u, part, v, text in zip(frame["u"], frame["part"], frame["v"], frame["text"], strict=True):
                if whose != (u, part):
                    whose, sets = (u, part), []
                y = make(text)
                if pd.isna(v):
                    sets.append(y)
                    continue
                for x in sets:
                    if of * min(len(x), len(y)) >= near * max(len(x), len(y)):
                        shared = len(x) + len(y) - len(np.union1d(x, y))
                        if of * shared >= near * (len(x) + len(y) - shared):
                            out.append((u, int(v)))
                            break
            yield pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    # a nullable whole number is read as a float: v is kept as text
    both = own.union(others).withColumn("v", F.col("v").cast("string"))
    both = both.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    return both.mapInPandas(run, "u long, v long")


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds root: the component of each id."""
    named = roots.select(F.col("node").alias("id"), "root")
    return members.join(named, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _rare_first(members: DataFrame, texts: DataFrame, near: int, of: int) -> DataFrame:
    """(key, pos, id, size, root): under which rare shingles each member (id, size, root) must meet every near one.

    With its shingles in one order for all, rarest among the members first, a
    set of n shares one of its first n - ceil(n * near / of) + 1 with any set
    near to it.  Passages that many members share come last in that order, so
    they bring no strangers together.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = shingler().shingles
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "s": [make(t).view("int64") for t in frame["text"]]})

    sets = texts.join(members.select("id"), "id", "left_semi").select("id", "text").mapInPandas(run, "id long, s array<long>")
    items = written(sets.select("id", F.explode("s").alias("key")).distinct(), "shingles")
    common = items.groupBy("key").agg(F.count("*").alias("n"))
    ranked = items.join(common, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("all"))
    head = F.size("all") - F.ceil(F.size("all") * F.lit(near) / of).cast("int") + 1
    first = ranked.select("id", F.posexplode(F.slice("all", F.lit(1), head)).alias("pos", "x"))
    return first.where("x.n > 1").select("id", "pos", "x.key").join(members, "id").select("key", "pos", "id", "size", "root")


def _across(members: DataFrame, near: int, of: int) -> DataFrame:
    """Pairs of members of different components that may be near by a common key, its places and their sizes.

    At the first shingle that two sets share, no more than what follows it in
    either can be shared.  So from its own place a member knows how large a
    smaller partner may be, and looks for it under the key and steps of size:
    members that share no more than a common passage do not meet.  Of a key's
    components the one with the most members is not matched with itself.
    """
    parts = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    facts = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"))
    mixed = members.join(facts.where("roots > 1").select("key", F.col("top.root").alias("top")), "key")
    mixed = mixed.withColumns({"strange": F.col("root") != F.col("top"), "rest": F.col("size") - F.col("pos")})
    step = lambda size: F.floor(F.log(size.cast("double")) * 50).cast("int")
    least = F.ceil(F.col("size") * F.lit(near) / of)
    # of * rest >= near * (size + partner - rest)
    most = F.least(F.col("size"), F.floor(F.col("rest") * F.lit(of + near) / near - F.col("size")))
    large = mixed.where(most >= least).select(
        "key", F.col("id").alias("u"), F.col("size").alias("u_size"), F.col("rest").alias("u_rest"), F.col("root").alias("u_root"),
        F.explode(F.sequence(step(least), step(most))).alias("step"), "strange",
    )
    large = large.withColumn("strange", F.explode(F.when(F.col("strange"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    small = mixed.select("key", F.col("id").alias("v"), F.col("size").alias("v_size"), F.col("rest").alias("v_rest"), F.col("root").alias("v_root"), step(F.col("size")).alias("step"), "strange")
    most_shared = F.least("u_rest", "v_rest")
    fits = (
        ((F.col("v_size") < F.col("u_size")) | (F.col("v_size") == F.col("u_size")) & (F.col("v") < F.col("u")))
        & (F.col("u_root") != F.col("v_root"))
        & (of * most_shared >= near * (F.col("u_size") + F.col("v_size") - most_shared))
    )
    both = large.join(small, ["key", "step", "strange"]).where(fits)
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    near: int = NEAR,
    of: int = OF,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the classes that links of near texts make of documents.

    Two documents are linked if of * |shared shingles| >= near * |all shingles|.
    component_id is the least id that links reach, kept says it is the row's own.

    Defined cases: null, empty and blank texts have no shingles and stay alone;
    shorter texts than a shingle are one shingle; rows that repeat an id are
    one document if their texts have equal sets, and else are linked as well,
    having the same id; rows with a null id are not linked, each its own
    component with a null id, and kept; texts are read whole; extra columns
    are not read.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = docs.where(F.col("id").isNotNull())
    sketches = written(_sketched(known, bands, rows), "sketches")

    # 1. classes of equal sets
    some = sketches.where("size > 0")
    # written before it is joined, so that the engine can split the rows of a set that very many documents have
    classes = written(some.groupBy("s1", "s2").agg(F.min("id").alias("rep")), "sets")
    named = written(some.select("id", "size", "s1", "s2").join(classes, ["s1", "s2"]).select("id", "size", "rep"), "classes")
    copies = named.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))

    # 2. a pair per class and bucket with the bucket's least class
    leads = named.where("id = rep").select("id").distinct()
    lead_rows = some.join(leads, "id", "left_semi").dropDuplicates(["id", "s1", "s2"])
    buckets = lead_rows.select(F.explode("keys").alias("key"), "id", "size")
    least = buckets.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    shared = written(buckets.join(least, "key"), "buckets")
    texts = known.join(shared.select("id").distinct(), "id", "left_semi")
    texts = written(texts.dropDuplicates(["id", "text"]), "texts")
    star = shared.where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v")).distinct()
    star = written(star, "star")
    one = star.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    links = written(_verified(one, texts, near, of), "links")
    roots = components(links, rounds=1)
    rest = star.join(one, ["u", "v"], "left_anti")
    rest = _apart(rest, roots)
    links = _more(links, _verified(rest, texts, near, of))
    roots = components(links, rounds=1)

    # 3. pairs of components that still share a bucket
    members = _labelled(shared.select("key", "id", "size"), roots)
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    members = written(members.join(mixed, "key", "left_semi").select("id", "size", "root").distinct(), "members")
    left = _across(_rare_first(members, texts, near, of), near, of).join(star, ["u", "v"], "left_anti")
    links = _more(links, _verified(left, texts, near, of))

    # 4. components over classes and copies
    roots = components(links.union(copies))
    out = _labelled(sketches.select("id", "size"), roots)
    out = out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("root").alias("component_id"))
    nameless = _sketched(docs.where(F.col("id").isNull()), bands, rows).select(
        F.lit(None).cast("long").alias("doc_id"), F.col("size").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")
    )
    return out.union(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    u, v = (roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "uv")
    both = pairs.join(u, "u", "left").join(v, "v", "left")
    return both.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def _more(links: DataFrame, new: DataFrame) -> DataFrame:
    out = written(links.union(new), "links")
    forget(links)
    return out


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class: that whose id is the class's.

    Defined cases: rows of that id with other texts are other documents, and each
    of those texts stays; of rows alike in id and text the least stays, by its
    columns as JSON; rows with a null id stay.
    """
    p = free_prefix(df, "kept")
    id_of, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    found = near_duplicates(df, doc_id, text, **options)
    kept = written(found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(f"{p}id")).agg(F.count("*").alias(f"{p}n")), "kept")
    known = df.where(id_of.isNotNull()).join(kept.select(f"{p}id"), id_of.cast("long") == F.col(f"{p}id"), "left_semi")
    if kept.where(F.col(f"{p}n") > 1).limit(1).count():
        known = one_of_each(known, [id_of, *text_key(body)])
    return known.union(df.where(id_of.isNull()))
