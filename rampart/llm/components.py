"""Connected components of an edge table by alternating star steps.

Every step replaces edges by edges to the smallest neighbour (large star:
larger neighbours move to it; small star: the node and its smaller
neighbours do) until each component is a star around its smallest node.
Both steps are a grouped minimum and a join, so a node with very many edges
is pre-aggregated and its join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.session import write_table

MAX_ROUNDS = 64


def _mark(edges: DataFrame):
    """Number and hash sum of the edges."""
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; the component is its
    smallest node.  Self edges are ignored, repeated edges are harmless."""
    now = write_table(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                      .where("a <> b").distinct(), "edges")
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = write_table(large.where("a <> b"), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(tied.select("a", F.col("m").alias("b")))
        now = write_table(small.where("a <> b").distinct(), "edges")
        # a star forest maps to itself, so an unchanged edge set is the end
        seen = _mark(now)
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
