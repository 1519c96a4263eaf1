"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.lineage import written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> one row per node on an edge: node, component (smallest node reachable).

    Each step keeps the components and pulls nodes nearer to their smallest neighbour; steps grow with the
    logarithm of the number of nodes. Minima are aggregated partially before the shuffle, so a node with very
    many neighbours fills no task. Nulls must not occur; loops and repeated edges are dropped.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "edges")
    while not _all_stars(now):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every edge now leads from a node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        now = written(large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has exactly one edge, to a centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
        .unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")) \
        .where("up > 1 or (up = 1 and down = 1)").isEmpty()
