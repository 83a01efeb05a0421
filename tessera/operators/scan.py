"""Prefix sums and row numbers, per group or over a whole table.

A window without groups would bring all rows to one task.  Here the rows are
sorted by range over all partitions and written; a small table has the sum of
each partition, its prefix gives each partition's base, and the running sum
inside a partition is added to it.  Groups may use the same way, so that a
group with a third of all rows is spread as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.storage import written

_AT, _PART, _V, _BASE = "_scan_at", "_scan_part", "_scan_v", "_scan_base"


def prefix_sum(
    df: DataFrame,
    value: str | Column,
    order: Sequence[str],
    by: Sequence[str] = (),
    initial: int = 0,
    exclusive: bool = False,
    name: str = "prefix",
    spread: bool | None = None,
) -> DataFrame:
    """Adds the sum of the values up to each row in its order, within its group.

    spread: sort over all partitions, as is always done without groups; else
    each group is one window, which needs one shuffle and no table in between.
    Rows that tie in the order are taken in an unspecified order among
    themselves.  A null value counts as nothing; null groups are groups.
    """
    end = -1 if exclusive else 0
    value = F.col(value) if isinstance(value, str) else value
    if by and not spread:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)) + F.lit(initial))

    placed = df.withColumn(_V, value).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = written(placed.withColumn(_AT, F.monotonically_increasing_id()), "scan").withColumn(_PART, F.shiftright(_AT, 33))
    before = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*by, _PART).agg(F.sum(_V).alias("s"))
    bases = sums.select(*[F.col(c).alias(f"_scan_by{i}") for i, c in enumerate(by)], F.col(_PART).alias("_scan_p"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias(_BASE))
    same = F.col(_PART) == F.col("_scan_p")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_scan_by{i}"))
    inside = Window.partitionBy(*by, _PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, end)
    out = placed.join(bases, same).withColumn(name, F.col(_BASE) + F.coalesce(F.sum(_V).over(inside), F.lit(0)) + F.lit(initial))
    return out.select(*df.columns, name)


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "index", spread: bool | None = None) -> DataFrame:
    """Adds each row's index from 0 in its order, within its group."""
    return prefix_sum(df, F.lit(1).cast("long"), order, by, exclusive=True, name=name, spread=spread)
