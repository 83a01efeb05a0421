"""Mixing sources to target weights, by blocks of words.

Each source's documents, in a pseudorandom but fixed order, form one line of
words that is cut into blocks of a fixed length.  Every output shard draws
multinomial counts of slots per source; slot k of a source maps through a
pseudorandom permutation of the source's block indexes, pass after pass, and
joins the blocks by index.  Draws are made from what is left of each source's
slots, so that all shards together hold exactly the slots that the target
asks for, and the last slot of a source takes only the words still missing.

What grows with the input stays distributed, the sources and their totals too:
they are a table.  The driver knows how many there are, and draws counts for a
bounded number of groups of neighbouring sources (one source each, if they are
few); inside a group the counts are drawn again among its sources, which
together is a multinomial draw among all.  The place of a document in its source
comes from two sums, over buckets and inside a bucket, so that a source with a
third of all rows is not one task; rows alike are pooled no further than the
partition that they are read in.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; an empty document is taken 0 words; rows alike in id, source and
text share what is taken of them evenly within a partition; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WORD, forget, free_prefix, one_of_each, text_key, written
from tessera.operators.scan import numbered

BLOCK = 128
SEED = 2024
#: Groups of sources, and counts of groups and shards, that the driver draws at most; slots that one row stands for at most.
GROUPS, DRAWN, RUN = 1000, 200_000, 65_536
BUCKET_ROWS = 4096
ROUNDS = 24


def draw(slots: list[int], per_shard: int, seed: int = SEED) -> list[np.ndarray]:
    """Counts per source of each shard: multinomial by what is left, until all slots are dealt."""
    left, rng, out = np.array(slots, "int64"), np.random.default_rng(seed), []
    while total := int(left.sum()):
        out.append(_taken(left, min(per_shard, total), rng))
        left = left - out[-1]
    return out


def _taken(left: np.ndarray, want: int, rng: np.random.Generator) -> np.ndarray:
    """want in all of what is left, by multinomial draws; what they ask for beyond what is left of a source is drawn again."""
    got = np.zeros_like(left)
    while (lacking := want - int(got.sum())) > 0:
        rest = left - got
        if rest.sum() <= lacking:
            return left.copy()
        got += np.minimum(rng.multinomial(lacking, rest / rest.sum()), rest)
    return got


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scrambler."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """Where a pseudorandom permutation of range(size) sends each index; key tells permutations apart.

    In each round an index and its mirror image under a secret shift either
    swap or stay, by one pseudorandom bit of the larger: a bijection of any size.
    """
    x, n = index.astype("uint64"), np.maximum(size, 1).astype("uint64")
    with np.errstate(over="ignore"):
        base = _mixed(key.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        for r in range(rounds):
            mark = _mixed(base + np.uint64(r + 1))
            mirror = (mark % n + n - x) % n
            swap = _mixed(np.maximum(x, mirror) ^ mark) >> np.uint64(63) == 1
            x = np.where(swap, mirror, x)
    return x.astype("int64")


@dataclass
class Mix:
    """sources: source_id (its place in order), source, source_size, target.  units: one row per distinct document row
    of a partition, with its place in its source.  slots: shard, source_id, slot, pass, block, take (words from the block's start)."""

    sources: DataFrame
    units: DataFrame
    slots: DataFrame
    block: int

    def parts(self) -> DataFrame:
        """The mix itself: for each slot the documents' words in it, from_word to to_word of the unit."""
        b = self.block
        pieces = self.units.where("words > 0").select(
            "source_id", *UNIT, "start", "words",
            F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("words") - 1) / b))).alias("block"),
        )
        low = F.greatest(F.col("start"), F.col("block") * b)
        high = F.least(F.col("start") + F.col("words"), F.col("block") * b + F.col("take"))
        return pieces.join(self.slots, ["source_id", "block"]).where(high > low).select(
            "shard", "source_id", "slot", "pass", "block", *UNIT, (low - F.col("start")).alias("from_word"), (high - F.col("start")).alias("to_word"),
        )


#: What names a unit: rows alike in id, source and text (by 128 bits) that are read in one partition.
UNIT = ("source", "doc_id", "h", "g", "size", "part")


def _goals(sources: DataFrame, weights: tuple[int, ...], share: Fraction, most: int) -> DataFrame:
    """Adds target and wanted, a whole number: a share of all words by weight, none above most times its size; the excess is shared anew.

    A round finds what is above by the words and weights that are left, by one
    aggregate over the sources, until nothing more is; what was above stays so.
    """
    big = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    w, size = F.col("weight"), F.col("source_size")
    sums = lambda which: (F.coalesce(F.sum(F.when(which, size.cast("decimal(38,0)"))), big(0)), F.coalesce(F.sum(F.when(~which, w)), F.lit(0)))
    some = sources.where("source_size > 0")
    total, weight = map(int, some.agg(*sums(F.lit(False))[1:], F.coalesce(F.sum("source_size"), F.lit(0))).first()[::-1])
    left, above = share * total, F.lit(False)
    while weight:
        # weight of the source * left / weight of all > most * size
        above = w.cast("decimal(38,0)") * big(left.numerator) > big(most * left.denominator * weight) * size
        capped, now = map(int, some.agg(*sums(above)).first())
        new = share * total - most * capped
        if now == weight:
            break
        left, weight = new, now
    goals = {x: left * x / weight if weight else Fraction(0) for x in set(weights)}
    full = above if weight else F.lit(True)
    known = [F.lit(float(g)) for g in goals.values()], [F.lit(round(g)).cast("long") for g in goals.values()]
    out = []
    for values, whole in zip(known, ((size * most).cast("double"), (size * most).cast("long")), strict=True):
        shared = F.coalesce(*[F.when(w == x, v) for x, v in zip(goals, values, strict=True)])
        out.append(F.when(size == 0, F.lit(0)).when(full, whole).otherwise(shared))
    return sources.withColumns({"target": out[0].cast("double"), "wanted": out[1].cast("long")})


def _drawn(facts: DataFrame, groups: int, seed: int) -> DataFrame:
    """shard, source_id, first, n: the slots of each source in each shard."""
    spark = facts.sparkSession
    slots = {r["group"]: r["slots"] for r in facts.groupBy("group").agg(F.sum("slots").alias("slots")).collect()}
    order = sorted(slots)
    total = sum(slots.values())
    per_shard = max(1024, math.ceil(total / max(1, DRAWN // max(1, groups))))
    counts = np.array(draw([slots[g] for g in order], per_shard, seed)).reshape(-1, max(1, len(order)))
    shard, at = np.nonzero(counts)
    table = pa.table({"shard": shard.astype("int32"), "group": np.array(order, "int32")[at] if len(at) else np.zeros(0, "int32"), "n": counts[shard, at].astype("int64")})

    def run(key: tuple, sources: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        sources, shards = sources.sort_values("source_id"), shards.sort_values("shard")
        ids, left, first = sources["source_id"].to_numpy(), sources["slots"].to_numpy("int64"), np.zeros(len(sources), "int64")
        rng, out = np.random.default_rng([seed, int(key[0])]), []
        for s, n in zip(shards["shard"], shards["n"], strict=True):
            got = _taken(left, int(n), rng)
            some = np.flatnonzero(got)
            out.append((np.full(len(some), s, "int64"), ids[some], first[some], got[some]))
            left, first = left - got, first + got
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [[]] * 4
        return pd.DataFrame(dict(zip(("shard", "source_id", "first", "n"), columns, strict=True)))

    both = facts.select("group", "source_id", "slots").where("slots > 0").groupBy("group").cogroup(spark.createDataFrame(table).groupBy("group"))
    return both.applyInPandas(run, "shard int, source_id long, first long, n long")


def mix(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    block: int = BLOCK,
    seed: int = SEED,
    groups: int = GROUPS,
) -> Mix:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h, g = text_key(body)
    rows = df.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), h.alias("h"), g.alias("g"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), F.spark_partition_id().alias("part"),
    )
    alike = written(rows.groupBy(*UNIT).agg(F.count("*").alias("copies")), "mix-rows")
    sources = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n"))
    sources = numbered(sources.withColumn("none", F.col("source").isNull()), ["none", "source"], name="source_id").drop("none")
    sources = written(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_id") % len(weights) + 1).cast("int"))), "mix-sources")
    number = max(1, sources.count())
    groups = min(groups, number)
    size, wanted = F.col("source_size"), F.col("wanted")
    facts = _goals(sources, weights, Fraction(share), most).withColumns(
        {"whole": F.expr(f"source_size div {block}"), "blocks": F.expr(f"(source_size + {block - 1}) div {block}"), "rest": F.when(size > 0, wanted % size).otherwise(F.lit(0)), "group": F.expr(f"cast(source_id * {groups} div {number} as int)")}
    )
    facts = facts.withColumns(
        {
            "slots": F.when(size > 0, F.expr("wanted div source_size") * F.col("blocks") + F.expr(f"(rest + {block - 1}) div {block}")).otherwise(F.lit(0)).cast("long"),
            "last": F.when(F.col("rest") > 0, (F.col("rest") - 1) % block + 1).otherwise(F.lit(block)).cast("long"),
            "buckets": F.greatest(F.lit(1), F.expr(f"n div {BUCKET_ROWS}")),
        }
    )
    facts = written(facts, "mix-facts")
    forget(sources)

    named = facts.select(F.col("source").alias("of"), "source_id", "buckets")
    units = alike.join(named, alike["source"].eqNullSafe(named["of"])).drop("of")
    units = units.withColumns({"words": F.col("size") * F.col("copies"), "bucket": F.pmod(F.xxhash64("doc_id", "h", "part", F.lit(seed)), F.col("buckets"))}).drop("buckets")
    before = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = units.groupBy("source_id", "bucket").agg(F.sum("words").alias("sum"))
    sums = sums.select("source_id", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_id", "bucket").orderBy("doc_id", "h", "g", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    units = units.join(sums, ["source_id", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
    units = units.select("source_id", *UNIT, "copies", "words", "start")

    drawn = written(_drawn(facts, groups, seed), "mix-drawn")
    total = facts.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    # a row stands for a bounded number of slots before they are written out
    runs = drawn.withColumn("low", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1, F.lit(RUN).cast("long"))))
    runs = runs.select("shard", "source_id", "low", F.least(F.col("low") + (RUN - 1), F.col("first") + F.col("n") - 1).alias("high"))
    runs = runs.repartition(max(1, min(10_000, total // 500_000)))
    table = runs.join(facts.select("source_id", "slots", "whole", "blocks", "last"), "source_id")
    table = table.withColumn("slot", F.explode(F.sequence("low", "high")))
    table = table.withColumns({"pass": F.floor(F.col("slot") / F.col("blocks")), "j": F.col("slot") % F.col("blocks")})

    @F.pandas_udf("long")
    def place(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(np.where(index < size, permuted(index.to_numpy(), size.to_numpy(), key.to_numpy(), seed), index))

    take = F.when(F.col("slot") == F.col("slots") - 1, F.col("last")).otherwise(F.lit(block))
    dealt = table.select("shard", "source_id", "slot", "pass", place("j", "whole", "source_id").alias("block"), take.cast("long").alias("take"))
    return Mix(facts.select("source_id", "source", "source_size", "target"), units, dealt, block)


def taken(df: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row; options as for mix()."""
    m = mix(df, **options)
    # a document that the mix takes nothing of comes back with none
    none = m.units.select("source_id", *UNIT, "copies", F.lit(0).cast("long").alias("got"))
    got = m.parts().select("source_id", *UNIT, F.lit(0).cast("long").alias("copies"), (F.col("to_word") - F.col("from_word")).alias("got"))
    rows = none.union(got).groupBy("source_id", *UNIT).agg(F.sum("copies").alias("copies"), F.sum("got").alias("got"))
    rows = rows.join(m.sources.select("source_id", "source_size", "target"), "source_id")
    each = F.floor(F.col("got") / F.col("copies")) + F.when(F.col("copy") <= F.col("got") % F.col("copies"), 1).otherwise(0)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "source", "size", "source_size", "target", each.cast("long").alias("taken")
    )


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: each pass over a document that the mix takes words of is a row.

    Its text is the document's own where all words are taken, else the taken
    stretches, each as it stands in the text, joined by line feeds; n_chars is
    counted anew.  Documents without words are not in the mix.

    Defined cases: as for mix(); other columns are those of the row, of rows
    alike in id, source and text those of the least by its columns as JSON.
    """
    m = mix(df, doc_id=doc_id, text=text, **options)
    p = free_prefix(df, "mixed")
    of = {"doc_id": F.col(f"`{doc_id}`"), "source": F.col(f"`{options.get('source', 'source')}`")}
    of["h"], of["g"] = text_key(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    spans = m.parts().groupBy(*UNIT, "pass").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("spans"))
    spans = spans.select(*[F.col(c).alias(f"{p}of_{c}") for c in of], F.col("size").alias(f"{p}size"), F.col("spans").alias(f"{p}spans"))
    repeated = m.units.groupBy("doc_id", "source", "h", "g").agg(F.sum("copies").alias("n")).where("n > 1").limit(1).count()
    docs = one_of_each(df, list(of.values())) if repeated else df
    docs = docs.withColumns({p + c: v for c, v in of.items()})
    same = [docs[p + c].eqNullSafe(spans[f"{p}of_{c}"]) for c in of]
    both = docs.join(spans, same).withColumn(f"{p}new", F.explode(_cut(F.col(f"`{text}`"), F.col(f"{p}size"), F.col(f"{p}spans"))))
    new = F.col(f"{p}new")
    out = {text: new, n_chars: F.char_length(new).cast("long")}
    return both.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut(text: pd.Series, size: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts of the spans of words; spans of a row alike in all may run over several copies, size words each."""
    import re

    out = []
    for t, n, ss in zip(text, size, spans, strict=True):
        copies: dict[int, list[list[int]]] = {}
        for s in ss:
            low, high = s["from_word"], s["to_word"]
            while low < high:
                c = low // n
                stop = min(high, (c + 1) * n)
                runs = copies.setdefault(c, [])
                if runs and runs[-1][1] == low - c * n:
                    runs[-1][1] = stop - c * n
                else:
                    runs.append([low - c * n, stop - c * n])
                low = stop
        at = None
        texts = []
        for runs in copies.values():
            if runs == [[0, n]]:
                texts.append(t)
                continue
            at = at or [w.span() for w in re.finditer(WORD, t)]
            texts.append("\n".join(t[at[a][0] : at[b - 1][1]] for a, b in runs))
        out.append(texts)
    return pd.Series(out)
