"""Connected components of a graph given as pairs of ids.

Alternating large-star and small-star steps (Kiveris et al. 2014): every round
is two grouped minima and joins on the ids, so nothing is gathered at a node and
nothing but three numbers a round comes to the driver.  Each round's edges are a
written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import shared


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component): for every id in a pair, the smallest id that it is connected with, itself included.

    Pairs may repeat and have either order; pairs of an id with itself or with
    null are left out.  Without pairs the result is empty.
    """
    edges = pairs.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).filter("a < b").distinct()
    edges = shared.table(_small_star(edges), "edges")
    seen = None
    while True:
        edges = shared.table(_small_star(_large_star(edges).distinct()), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
