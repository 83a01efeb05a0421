"""Sorting by range, places in the sorted order, and splits at a pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.scan import numbered, prefix_sum


#: Rows of a bracket of order statistics that one task may sum up.
HELD = 1_000_000


def ranked(df: DataFrame, keys: Sequence[str], name: str = "rank") -> DataFrame:
    """Adds each row's place from 0 in the ascending order of the whole table."""
    return numbered(df, keys, name=name)


def checksum_places(n: int) -> list[int]:
    """The places whose values make the published checksum of n sorted values."""
    return [0, 478, n // 2, n - 324, n - 1]


def order_statistics(df: DataFrame, key: str, places: Sequence[int], accuracy: int = 20_000) -> DataFrame:
    """(place, value) of the ascending values, nulls first; a place given twice counts twice, one outside the table not at all.

    Nothing is sorted as a whole.  A first pass finds approximate percentiles
    around each place, whose error in places is bounded; a second counts what
    lies below each of these brackets and how often each value inside them
    occurs, which is the only thing that moves.  A bracket that does not hold
    its place, which the bound rules out, would be an error.
    """
    total, nulls = df.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
    wanted = [p for p in places if 0 <= p < total]
    kind = df.schema[key].dataType
    schema = f"place long, value {kind.simpleString()}"
    spark = df.sparkSession
    empty = spark.createDataFrame([(p, None) for p in wanted if p < nulls], schema)
    known = sorted({p for p in wanted if p >= nulls})
    if not known:
        return empty
    # a percentile may be off by n / accuracy places
    shares = [min(1.0, max(0.0, (p - nulls) / (total - nulls) + side / accuracy)) for p in known for side in (-2, 2)]
    edges = df.agg(F.percentile_approx(key, shares, accuracy)).first()[0]
    brackets = [(float("-inf") if low == 0.0 else a, float("inf") if high == 1.0 else b) for low, high, a, b in zip(shares[::2], shares[1::2], edges[::2], edges[1::2], strict=True)]
    value = F.col(key)
    above = [F.lit(True) if a == float("-inf") else value >= F.lit(a).cast(kind) for a, _ in brackets]
    upto = [F.lit(True) if b == float("inf") else value <= F.lit(b).cast(kind) for _, b in brackets]
    known_in = df.agg(*[F.count_if(~c) for c in above], *[F.count_if(a & b) for a, b in zip(above, upto, strict=True)]).first()
    below, held = known_in[: len(known)], known_in[len(known) :]
    inside = F.array_compact(F.array(*[F.when(a & b, F.lit(i)) for i, (a, b) in enumerate(zip(above, upto, strict=True))]))
    counts = df.where(value.isNotNull()).select(F.explode(inside).alias("at"), value.alias("value")).groupBy("at", "value").agg(F.count("*").alias("n"))
    # a bracket is one window, or spread over all partitions if it holds too much for one
    summed = prefix_sum(counts, "n", ["value"], ["at"], spread=max(held) > HELD, name="upto")
    goals = spark.createDataFrame([(p, i, p - nulls - below[i]) for p in wanted if p >= nulls for i in (known.index(p),)], "place long, at int, inside long")
    found = summed.join(F.broadcast(goals), "at").where((F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n")))
    return found.select("place", "value").union(empty)


def checksum(df: DataFrame, key: str, n: int, name: str = "checksum") -> DataFrame:
    return order_statistics(df, key, checksum_places(n)).agg(F.sum("value").alias(name))


def pivot_of(df: DataFrame, order: str, key: str) -> DataFrame:
    """(pivot_at, pivot_value): the value of the first row."""
    return df.agg(F.min(order).alias("pivot_at"), F.min_by(key, order).alias("pivot_value"))


def split(df: DataFrame, order: str, key: str) -> DataFrame:
    """Adds side to every row but the pivot's: left below the pivot, right from it."""
    marked = df.join(F.broadcast(pivot_of(df, order, key)))  # one row
    side = F.when(F.col(key) < F.col("pivot_value"), "left").otherwise("right")
    return marked.where(F.col(order) != F.col("pivot_at")).withColumn("side", side).drop("pivot_at", "pivot_value")


def split_counts(df: DataFrame, order: str, key: str) -> DataFrame:
    """(pivot_value, left, right) of such a split; left is also the pivot's own place."""
    marked = df.join(F.broadcast(pivot_of(df, order, key)))  # one row
    low, high = F.col(key) < F.col("pivot_value"), (F.col(key) >= F.col("pivot_value")) & (F.col(order) != F.col("pivot_at"))
    return marked.groupBy("pivot_value").agg(F.count_if(low).alias("left"), F.count_if(high).alias("right"))
