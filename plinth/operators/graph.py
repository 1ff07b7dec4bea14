"""Room graphs: links, display edges, exclusions, hops and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; where the session has none, a local one on one machine alone, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back, which ends their lineage."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "graph")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def display_edges(doors: DataFrame) -> DataFrame:
    """(edge, door, source, target): a door with both sides joins its two rooms, in order of their names."""
    both = doors.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    source, target = F.least("a", "b"), F.greatest("a", "b")
    return both.select(F.concat_ws(":", F.lit("viz-door"), "door", source, target).alias("edge"), "door", source.alias("source"), target.alias("target"))


def portals(links: DataFrame) -> DataFrame:
    """(door, n_spaces, kind): doors with one room are exits, others doors."""
    n = links.groupBy("door").agg(F.count_distinct("space").alias("n_spaces"))
    return n.select("door", "n_spaces", F.when(F.col("n_spaces") == 1, "exit").otherwise("door").alias("kind"))


def portal_steps(links: DataFrame, doors: DataFrame) -> DataFrame:
    """(source, target, space, cost): two portals of one room are a straight walk apart; of several shared rooms the smallest name counts."""
    at = links.join(doors.select("door", "x", "y"), "door")
    a, b = (at.select(F.col("door").alias(f"{e}"), "space", F.col("x").alias(f"{e}_x"), F.col("y").alias(f"{e}_y")) for e in ("source", "target"))
    met = a.join(b, "space").filter("source <> target")
    cost = F.hypot(F.col("target_x") - F.col("source_x"), F.col("target_y") - F.col("source_y"))
    return met.groupBy("source", "target").agg(F.min("space").alias("space"), F.min(cost).alias("cost"))


def excluded_edges(excluded: DataFrame, doors: DataFrame) -> DataFrame:
    """(door): every door whose pair of rooms is an excluded pair (source, target), not only the one named."""
    edges = display_edges(doors)
    return edges.join(excluded.select("source", "target").distinct(), ["source", "target"], "left_semi").select("door").distinct()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).union(b.exceptAll(a)).distinct()


def merged(previous: DataFrame, fresh: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Rows of untouched keys from before, rows of touched keys anew."""
    return previous.join(touched, key, "left_anti").unionByName(fresh.join(touched, key, "left_semi"))


def hops(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, hops) of every node that undirected edges (a, b) lead to from the start nodes, one job a step.

    Each step joins the last frontier alone; done when it is empty.  Neighbours of
    a step's nodes are of that step, the one before or the next, so only the last
    two frontiers are held against what is found, and plans don't grow.
    """
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b and a is not null and b is not null").distinct())
    spark, folder = both.sparkSession, scratch(both.sparkSession, "hops")
    frontier = kept(start.select("node").distinct().withColumn("hops", F.lit(0).cast("bigint")))
    before, step = frontier.limit(0), 0
    while not frontier.isEmpty() or not step:
        frontier.write.mode("append").parquet(folder)
        step += 1
        found = both.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        known = frontier.select("node").union(before.select("node"))
        before, frontier = frontier, kept(found.join(known, "node", "left_anti").withColumn("hops", F.lit(step).cast("bigint")))
    return spark.read.schema(before.schema).parquet(folder)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that undirected edges (a, b) connect; rounds of smallest neighbour and pointer jumping."""
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    label = kept(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("near"))
        lower = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        lower = kept(lower)
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = kept(lower.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "was"))
        label = after.select("node", "component")
        if after.filter("component <> was").isEmpty():
            return label


def edge_kind(method: Column, kind: Column, inferred: Column) -> Column:
    """Which healing an edge comes from: ifc, door, space or stair; null for others."""
    return F.when(~inferred & (method == "ifc_rel_space_boundary"), "ifc").when(kind == "space_door", "door").when(kind == "space_space", "space").when(kind == "vertical", "stair")
