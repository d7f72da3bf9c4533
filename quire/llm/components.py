"""Connected components of links between nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_written, latest, made, scratch, written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (u, v): the smallest node that links reach. Nodes without edges have no row.

    Each round hangs a node's neighbours on the smallest of them; links shorten by about half a round. Minima are
    partly made before the shuffle, and the joins' large keys can be split, so a hub of most links is no burden to one task.
    """
    with scratch(edges.sparkSession, keep=1):
        edges = _stars(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v): every node but the smallest of its component with that one, as the table written last."""
    spark = edges.sparkSession
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    state, old = None, latest()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        edges = written(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(spark, old + made()[-2:-1])
        if now == state:
            return edges
        state, old = now, latest()
