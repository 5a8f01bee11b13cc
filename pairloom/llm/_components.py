"""Connected components of a graph held as a table of edges, by alternating large and small stars
(Kiveris et al., "Connected components in MapReduce and beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm._common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links its larger neighbours (large) or its smaller ones and itself (small) to the smallest of all."""
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # a: the node, b: its neighbour; in the small star edges run from the larger to the smaller end
    least = seen.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = seen.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), any order, no nulls, to (a, b): each node but the smallest of its component, with that smallest.

    Each round writes the edges to the shared folder and deletes those of the round before. It ends when a round changes nothing, after about log(n) rounds.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = materialise(_star(_star(now, large=True), large=False), now)
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(row) == mark:
            return now
        mark = tuple(row)
