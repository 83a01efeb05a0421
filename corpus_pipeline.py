"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, neardup, packing, quality, substrings
from tessera.llm.common import forget, table, written
from tessera.plans.storage import scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go.  A null, empty or blank text is rejected; rows are judged one by one, whatever their id."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least id.

    Rows of one id with other texts stay together, of rows alike in both one
    stays, and rows without an id all stay.
    """
    return neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of all documents but the first that holds them, by id, then by text; no id comes first.

    Rows alike in id and text are one document here.  A document of which nothing
    is left goes; null and empty texts stay.
    """
    return substrings.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or stretches of them, as often as their sources' targets ask for.

    Null sources are one source; documents without a word are in no mix; rows
    alike in id, source and text share what is taken of them.
    """
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' token pieces in sequences.  A null text is the one token 0; every row is packed, repeated or not."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Sketches, rolling hashes and a tokenizer are beyond SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote on its way goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope() as keep:
            new = written(stage(spark, docs, sf_dir), name)
            keep.append(new._tessera_path)
        forget(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
