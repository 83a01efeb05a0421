"""Connected components of a graph of links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v): each node's neighbours join the least node around it.

    A large star moves the greater neighbours of a node, a small star the
    lesser ones and the node itself.  Both take the least by a partial
    aggregate, and join it back on the node, so a node with very many links is
    split by the engine's skew join.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    moved = moved.where("u <> v")
    return moved if large else moved.distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root): the least node that links (u, v) reach from each linked node that is not its own root.

    Alternates large and small stars, writing each round's edges, until they
    no longer change; then every edge points at its root.  After a given
    number of rounds instead, a root is some node that the links reach.

    Defined cases: a link of a node to itself, a repeated link and one given both
    ways say nothing new; a link with a null end is none; no links give no rows.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    if rounds:
        for _ in range(rounds):
            edges = _stars(_stars(edges, True), False)
        edges = edges.groupBy("u").agg(F.min("v").alias("v"))
        return written(edges, "stars").select(F.col("u").alias("node"), F.col("v").alias("root"))
    edges = written(edges, "links")
    seen = _state(edges)
    while True:
        new = written(_stars(_stars(edges, True), False), "stars")
        forget(edges)
        edges, now = new, _state(new)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
