"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, fingerprints, html, mixing, neardup, packing, quality, substrings, tokens, urls
from tessera.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document's tokens lies in sequences of 2048.  Nulls and repeats as in packing.pack()."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeats; n_removed counts the code points cut, copied_from names who keeps them."""
    docs = substrings.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda c: F.char_length(F.coalesce(c, F.lit(""))).cast("long")
    return docs.select(
        "doc_id",
        n("_text").alias("n_chars"),
        (n("text") - n("_text")).alias("n_removed"),
        F.col("_shared").alias("shared"),
        F.col("_copied_from").alias("copied_from"),
        F.col("_text").alias("text"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text.  A null text has none; repeated rows are counted one by one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"),
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL.  A null URL has neither host nor path and is judged by its features."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select(
        "page_id",
        F.col("_url_host").alias("host"),
        F.col("_url_path").alias("path"),
        F.col("_url_rule").alias("rule"),
        F.col("_url_verdict").alias("verdict"),
    )


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document by links of near texts.  Nulls and repeated ids as in neardup.near_duplicates()."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every text and its edited text, and their likenesses.  Nulls and repeats as in fingerprints.py."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one hard one, formatted and read back.  Nulls and repeats as in chat.py."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    return chat.digests(given.union(more))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document.  Nulls and repeats as in mixing.py."""
    docs = table(spark, sf_dir, "documents")
    return mixing.taken(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document.  A null text has no words and fails."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page.  A null page has none."""
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_substring_dedup,
        op3_token_counts,
        op4_url_filters,
        op5_minhash_near_dedup,
        op6_document_fingerprints,
        op7_chat_formatting,
        op8_source_mixing,
        op9_quality_rules,
        op10_html_extraction,
    )
}
