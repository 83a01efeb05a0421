"""Bottom-k sketches of documents' word shingles, by column functions alone.

A sketch holds the k smallest distinct hashes of a text's five-word shingles.
Sketches of parts merge into the sketch of the whole, and two of them estimate
resemblance, containment and the number of distinct shingles.

Defined cases: null and empty texts have an empty sketch; fewer than five words
are one shingle; two empty sketches are alike (1.0), an empty and another are
not (0.0); rows alike in id and text count once in the order of documents and
each gets the same result; a null id comes first; a lone document follows
itself; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import window_hashes, words, written

K = 64
WINDOW = 5
_SPAN = 2.0**64


def with_sketch(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """Adds the sketch of a text column as a sorted array of longs."""
    hs, n = f"{out}_hs", F.size(f"{out}_hs")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    hashes = window_hashes(F.col(hs), starts, WINDOW)
    df = df.withColumn(hs, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop(hs)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated shared part of the union of two shingle sets."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    largest = F.get(a, F.lit(k - 1)).cast("double") + _SPAN / 2
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * _SPAN / largest)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of the first set that lies in the second."""
    r, m, n = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r / (1 + r) * (m + n) / F.greatest(m, F.lit(1.0))))


def as_string(a: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, joined by full stops."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ".")


def from_string(s: Column) -> Column:
    parts = F.filter(F.split(s, r"\."), lambda x: x != "")
    # a hash over 2^63 is a negative long: halves are joined by bits, so nothing overflows
    return F.transform(
        parts,
        lambda x: F.shiftleft(F.conv(F.substring(x, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(x, 9, 8), 16, 10).cast("long")),
    )


def following(ids: DataFrame, order: list[str]) -> DataFrame:
    """Adds the column next, a struct of the row that comes next by the order, the first after the last.

    The rows are sorted by range over all partitions and written; then only the
    first row of each partition has to be known beyond it.
    """
    names = ids.columns
    placed = ids.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "order").withColumn("_part", F.shiftright("_at", 33))
    row = F.struct(*names)
    firsts = placed.groupBy("_part").agg(F.min_by(row, "_at").alias("first"))
    parts = Window.orderBy("_part")
    everything = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_part", F.coalesce(F.lead("first").over(parts), F.first("first").over(everything)).alias("_over"))
    inside = Window.partitionBy("_part").orderBy("_at")
    step = placed.withColumn("_next", F.lead(row).over(inside))
    return step.join(firsts, "_part").select(*names, F.coalesce("_next", "_over").alias("next"))


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they are to each other and to the next document's.

    The edited text has its last half replaced by the first code points of the
    next document.  Texts move once by their own key and their needed heads
    once by the key of the document before.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # two longs name a row by id and text; a null id differs from any other
    docs = df.select(F.col(doc_id).alias("doc_id"), body.alias("body"))
    docs = docs.withColumns({"kd": F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id")), "kh": F.xxhash64("body")})
    rows = docs.groupBy("doc_id", "kd", "kh").agg(F.max(F.char_length("body")).alias("n"), F.count("*").alias("copies"))
    chain = written(following(rows, ["doc_id", "kh"]), "chain")
    repeated = bool(chain.where("copies > 1").limit(1).count())

    sketched = with_sketch(docs, "body", "sk", k).select("kd", "kh", "body", "sk")
    before = chain.select(F.col("next.kd").alias("kd"), F.col("next.kh").alias("kh"), "doc_id", "n", F.col("kd").alias("to_kd"), F.col("kh").alias("to_kh"))
    givers = sketched.dropDuplicates(["kd", "kh"]) if repeated else sketched
    heads = givers.hint("shuffle_merge").join(before, ["kd", "kh"]).select(
        F.col("to_kd").alias("kd"), F.col("to_kh").alias("kh"), "doc_id", F.col("n").cast("long").alias("n"),
        F.expr("left(body, cast(n div 2 as int))").alias("head"), F.col("sk").alias("next_sk"),
    )
    both = sketched.hint("shuffle_merge").join(heads, ["kd", "kh"])
    both = both.withColumn("edited", F.concat(F.expr("left(body, cast(n - n div 2 as int))"), F.col("head")))
    both = with_sketch(both, "edited", "edited_sk", k)
    return both.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("sk")).alias("fingerprint"),
        as_string(F.col("edited_sk")).alias("edited_fingerprint"),
        resemblance(F.col("sk"), F.col("edited_sk"), k).alias("near_edited"),
        resemblance(F.col("sk"), F.col("next_sk"), k).alias("near_next"),
    )
