"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written


def oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges (big, small)."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct()


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node is the big end of at most one edge, or the small end of some, but not both."""
    ends = edges.select(F.col("big").alias("node"), F.lit(1).alias("below")).unionAll(edges.select("small", F.lit(0)))
    mixed = ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return mixed.where("below > 1 or (below = 1 and least = 0)").isEmpty()


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's bigger neighbours move to the node's least neighbour."""
    both = edges.unionAll(edges.select(F.col("small"), F.col("big"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("to")).withColumn("to", F.least("node", "to"))
    return both.where("other > node").join(least, "node").select(F.col("other").alias("a"), F.col("to").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("big").agg(F.min("small").alias("to"))
    moved = edges.join(least, "big").select(F.col("small").alias("a"), F.col("to").alias("b"))
    return moved.unionAll(least.select("big", "to"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs to (node, component): the least node that each node of an edge reaches.

    Every round is a few joins over at most as many edges as came in, written to the shared folder; the number of
    rounds grows with the logarithm of the longest path. Nulls and loops are ignored.
    """
    now = written(oriented(edges.select("a", "b")), "components")
    while not is_forest_of_stars(now):
        now = written(oriented(small_star(oriented(large_star(now)))), "components")
    return now.select(F.col("big").alias("node"), F.col("small").alias("component")).unionAll(now.select("small", "small").distinct())
