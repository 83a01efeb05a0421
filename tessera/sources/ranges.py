"""Generated inputs: nothing is stored, a range of indexes and a column function make the values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.generators import random_cos, random_mul, xorshift32

#: Where the published kernels begin their ranges.
START = 1 << 30


def generated(spark: SparkSession, n: int, value: Callable[[Column], Column], groups: int = 1, start: int = 0, name: str = "v") -> DataFrame:
    """(m, i, value) for i in range(n), the same n values in each of the groups m."""
    rows = spark.range(n * groups).select((F.col("id") / n).cast("int").alias("m"), (F.col("id") % n).alias("i"))
    return rows.select("m", "i", value(F.col("i") + start).alias(name))


def sum_input(spark: SparkSession, n: int) -> DataFrame:
    return generated(spark, n, random_cos, start=START).select("i", "v")


def scan_input(spark: SparkSession, n: int, groups: int = 1) -> DataFrame:
    return generated(spark, n, xorshift32, groups)


def sort_input(spark: SparkSession, n: int) -> DataFrame:
    return generated(spark, n, random_mul, name="x").select("i", "x")
