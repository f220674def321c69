"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoledger.session import materialised


def _least(edges: DataFrame) -> DataFrame:
    """The edges with `m`, the smallest neighbour of `a`: one shuffle, where an aggregate joined back takes two."""
    return edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))


def _large(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the smallest node of its neighbourhood."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = _least(edges.select(F.inline(ends)))
    return both.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    # the smallest is its own end already: its edge ties the node itself
    return _least(edges).select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """Columns (node, component) for all nodes of `edges` (a, b); a component is named by its smallest node.

    Each round writes its edges to the shared folder, so a lost executor repeats one round at most. Rounds end when
    the edges no longer change: they are stars around the smallest nodes then. Loops and repeated edges are allowed.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    edges = materialised(edges.filter("a <> b").select(big.alias("a"), small.alias("b")).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        edges = materialised(_small(_large(edges)).distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
