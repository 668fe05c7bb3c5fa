"""Connected components by alternating large and small stars, on DataFrames only.

Edge cases: no edges give no rows; an edge of a node with itself says nothing; repeated
edges, in either direction, are one; an edge with a null end is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.store import drop_path, paths_of, written


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id) of every node of ``edges`` (u, v) that isn't itself the smallest.

    Stops once all edges lead from a node straight to a smallest one.  Each
    round is a written table, so no lineage grows and a lost executor repeats one round at most.
    """
    current = written(edges.select("u", "v").where("u <> v"), "edges")  # a null end is neither equal nor different
    while True:
        following = written(_small(_large(current)), "edges")
        for path in paths_of(current):
            drop_path(edges.sparkSession, path)
        current = following
        if current.join(current.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return current.select(F.col("u").alias("id"), F.col("v").alias("component"))
