"""Sums, mapped sums and counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers that a task strikes out at once, or more where their root is larger.
SEGMENT = 1 << 17


def total(df: DataFrame, value: str | Column, by: Sequence[str] = (), name: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias(name))


def mapped_total(spark: SparkSession, start: int, count: int, function: Callable[[Column], Column], name: str = "total") -> DataFrame:
    """Sum of a function over a range of integers that is never stored."""
    return spark.range(start, start + count).select(function(F.col("id")).alias("v")).agg(F.sum("v").alias(name))


def count_where(df: DataFrame, predicate: Column, by: Sequence[str] = (), name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(predicate).alias(name))


def primes_below(n: int) -> np.ndarray:
    """The primes below n, by a sieve."""
    sieve = np.ones(max(n, 2), bool)
    sieve[:2] = False
    for p in range(2, math.isqrt(max(n, 2)) + 1):
        if sieve[p]:
            sieve[p * p :: p] = False
    return np.flatnonzero(sieve)


def count_primes(spark: SparkSession, start: int, count: int, name: str = "primes", segment: int | None = None) -> DataFrame:
    """Number of primes in a range; as is_prime() has it, 1 is one.

    A segmented sieve: each row names a segment of the range, which the task
    that has it strikes out by the primes up to the root of the segment's end.
    Those primes are made once per task; nothing is broadcast or shuffled but
    one count per task.
    """
    end = start + count
    segment = segment or max(SEGMENT, min(math.isqrt(max(end, 0)), 1 << 24))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        primes, below = primes_below(2), 2
        for batch in batches:
            found = []
            for low in batch.column(0).to_pylist():
                high = min(low + segment, end)
                root = math.isqrt(max(high - 1, 0))
                if root >= below:
                    below = 2 * root + 2
                    primes = primes_below(below)
                alive = np.ones(high - low, bool)
                alive[: max(0, min(1, high) - low)] = False
                for p in primes[: np.searchsorted(primes, root, "right")].tolist():
                    alive[max(p * p, -(-low // p) * p) - low :: p] = False
                found.append(int(alive.sum()))
            yield pa.RecordBatch.from_pydict({"n": pa.array(found, "int64")})

    segments = spark.range(start, max(end, start), segment)
    return segments.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
