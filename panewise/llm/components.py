"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panewise.llm.common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """`node, label`: for each node of the edges `a, b`, the smallest node it is connected with.

    Each round first links every node's larger neighbours to its smallest one, then all that are not larger;
    after a number of rounds that grows with the logarithm of the nodes only stars are left, which ends it.
    Rounds are written, so lineage stays short, and the round before goes. A node's neighbours are only ever
    met through joins and minima that combine before the shuffle; nothing is gathered in one place.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.write(_edges(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))))
    while not _only_stars(now):
        for large in (True, False):
            now = _star(now, large, scratch)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none if it has larger ones."""
    ups = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down"))
    downs = edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = ups.unionByName(downs).groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter(F.col("up") + F.col("down") > 1).limit(1).count() == 0


def _edges(edges: DataFrame) -> DataFrame:
    """From the larger to the smaller node, each once."""
    return edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Of each node u with least neighbour-or-self m: link to m the neighbours above u, or those below and u.

    The edges are replaced: their table goes.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.write(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        above = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
        met = above.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = scratch.write(edges.groupBy("a").agg(F.min("b").alias("m")))
        met = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        met = met.unionByName(least.select("a", F.col("m").alias("b")))
    after = scratch.write(_edges(met))
    scratch.drop(edges, least)
    return after
