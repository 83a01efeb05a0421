"""Order-preserving filters with dense output indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from tessera.operators.scan import numbered


def compact(df: DataFrame, predicate: Column, order: Sequence[str], by: Sequence[str] = (), name: str = "index", spread: bool | None = None) -> DataFrame:
    """The rows that fit, each with its place among them, in order and within its group."""
    return numbered(df.where(predicate), order, by, name, spread)
