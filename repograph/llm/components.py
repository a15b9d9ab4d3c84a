"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, sweep

EDGES_A_PARTITION = 250_000


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b of one orderable type); root is the component's least node.

    Each round costs two aggregations by node and is cut to the checkpoint folder; nothing is collected but the fingerprint that tells
    that the edges did not change. A hub's neighbours are never gathered: only the least one is taken, by a partial aggregate. Few edges are held in few
    partitions. Edges with a null end are left out; an empty table has no components.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _fingerprint(now)
    for _ in range(most_rounds):
        now = now.coalesce(_partitions(now, mark[0]))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        own = least.select("a", F.col("m").alias("b"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(own.unionByName(small).where("a <> b").distinct().coalesce(_partitions(now, mark[0])))
        new = _fingerprint(now)
        sweep(now.sparkSession)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after ``links`` (a, b) are added to components (node, root): only the links between components are walked."""
    named = links
    for end in ("a", "b"):
        at = roots.select(F.col("node").alias(end), F.col("root").alias("_r"))
        named = named.join(at, end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    over = connected_components(named)
    higher = over.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    moved = roots.join(higher, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    alone = over.join(roots.select("node"), "node", "left_anti")
    return moved.unionByName(alone)


def _partitions(df: DataFrame, n: int) -> int:
    return max(1, min(shuffle_partitions(df.sparkSession), -(-2 * n // EDGES_A_PARTITION)))


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
