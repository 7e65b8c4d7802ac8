"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm.textops import stored


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either the larger end of one edge or the smaller end of any number."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("larger"), F.lit(0).alias("smaller"))
    ends = ends.union(edges.select(F.col("v").alias("x"), F.lit(0).alias("larger"), F.lit(1).alias("smaller")))
    ends = ends.groupBy("x").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller"))
    return ends.where(F.col("larger") + F.col("smaller") > 1).agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges (a, b; longs, no nulls).

    Each round links every node's larger neighbours, then its smaller ones, to
    the least of them, until all edges are stars: every larger end has one edge and is no other's smaller end. The edges never grow in number. Least
    neighbours are aggregated before the shuffle and joined back, so a node with a third of
    all edges is one row per task in the aggregation and a join side that Spark can split.
    The edge list is written after every round, so no lineage builds up.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(down, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(down.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
