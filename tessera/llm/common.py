"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.storage import forget, written

__all__ = ["SPACE", "WORD", "ascii_lower", "byte_marks", "filtered", "forget", "free_prefix", "one_of_each", "table", "text_key", "tokenizer_path", "window_hashes", "words", "written"]

#: ASCII white space, the only word separators of these operators.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    spaced = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def window_hashes(hashes: Column, starts: Column, width: int) -> Column:
    """A hash of each run of so many words, from the words' own hashes and the places where runs start; a run past the end is shorter."""
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))


def free_prefix(df: DataFrame, stem: str) -> str:
    """A prefix of names, made of underscores and the stem, that no column of df begins with."""
    prefix = f"_{stem}_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def text_key(*columns: Column) -> tuple[Column, Column]:
    """Two longs that tell values apart, nulls among them."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def one_of_each(df: DataFrame, keys: list[Column]) -> DataFrame:
    """One row for each value of the keys: the least by its columns as JSON, so that it is the same one whenever a task runs again."""
    p = free_prefix(df, "key")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    named = [k.alias(f"{p}{i}") for i, k in enumerate(keys)]
    least = df.groupBy(*named).agg(F.min_by(row, F.to_json(row)).alias(f"{p}row"))
    return least.select(*[F.col(f"{p}row").getField(c).alias(c) for c in df.columns])


def filtered(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that fit, filtered where they are.

    The optimizer would push a filter below the projections that made its
    columns, and write their expressions out in it, inside of lambda functions
    too, to be evaluated for each element.  It does not push a filter past a
    condition that it takes to vary.
    """
    name = free_prefix(df, "fits")
    marked = df.withColumn(name, condition & (F.monotonically_increasing_id() >= 0))
    return marked.where(name).drop(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on the machine that asks."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_marks() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself if it shows, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    marks = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [marks[b] for b in range(256)]
