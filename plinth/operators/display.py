"""What a plan shows: where portals stand, adjacency from elsewhere, markers of loads, heights in metres, lines cut short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators import graph


def portal_points(edges: DataFrame, doors: DataFrame, real: DataFrame, spaces: DataFrame) -> DataFrame:
    """(edge, x, y): where display edges (edge, door, source, target) stand.

    At the door's place, its segment's middle (doors: door, x, y, segment), the place
    of the edge itself or of another edge of the same two rooms (real: id, source,
    target, x, y; the smallest id), or between the rooms' middles (spaces: space,
    ring); no row where there is none of them.
    """
    end = lambda i, c: F.get("segment", F.lit(i))[c]
    at_door = doors.select("door", F.coalesce("x", (end(0, "x") + end(1, "x")) / 2).alias("dx"), F.coalesce("y", (end(0, "y") + end(1, "y")) / 2).alias("dy"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    placed = real.filter(finite("x") & finite("y")).withColumns({"source": F.least("source", "target"), "target": F.greatest("source", "target")})
    own = placed.select(F.col("id").alias("edge"), F.struct("x", "y").alias("__own"))
    pair = placed.groupBy("source", "target").agg(F.min(F.struct("id", "x", "y")).alias("__pair"))
    middle = spaces.filter(F.size("ring") >= 3).withColumn("__c", g.centroid(F.col("ring")))
    ends = [middle.select(F.concat(F.lit("space:"), "space").alias(e), F.col("__c").alias(f"__{e}")) for e in ("source", "target")]
    named = edges.withColumns({"source": F.least("source", "target"), "target": F.greatest("source", "target")})
    found = named.join(at_door, "door", "left").join(own, "edge", "left").join(pair, ["source", "target"], "left").join(ends[0], "source", "left").join(ends[1], "target", "left")
    between = F.when(F.col("__source").isNotNull() & F.col("__target").isNotNull(), g.point((F.col("__source.x") + F.col("__target.x")) / 2, (F.col("__source.y") + F.col("__target.y")) / 2))
    p = F.coalesce(F.when(F.col("dx").isNotNull() & F.col("dy").isNotNull(), g.point(F.col("dx"), F.col("dy"))), F.when(F.col("__own").isNotNull(), g.point(F.col("__own.x"), F.col("__own.y"))), F.when(F.col("__pair").isNotNull(), g.point(F.col("__pair.x"), F.col("__pair.y"))), between)
    return found.withColumn("__p", p).filter("__p is not null").select("edge", F.col("__p.x").alias("x"), F.col("__p.y").alias("y"))


def with_adjacency(edges: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges (id, kind, source, target, method, inferred) and those of pairs (a, b) of two rooms found elsewhere, where both nodes (id) are there and no edge has the id."""
    known = nodes.select(F.col("id"))
    both = pairs.filter("a <> b").select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).distinct()
    for e in ("source", "target"):
        both = both.join(known.select(F.col("id").alias(e)), e, "left_semi")
    new = both.select(F.concat_ws(":", F.lit("space_space"), "source", "target", F.lit("adjacent")).alias("id"), F.lit("space_space").alias("kind"), "source", "target", F.lit("adjacency").alias("method"), F.lit(True).alias("inferred"))
    return edges.select(new.columns).unionByName(new.join(edges.select("id"), "id", "left_anti"))


def markers(loads: DataFrame, places: DataFrame, storey: str | None = None) -> DataFrame:
    """(node, storey, x, y, load): loads other than 0 at their nodes' places (node, storey, x, y), of one storey or all."""
    shown = places.select("node", "storey", "x", "y").distinct()
    if storey is not None:
        shown = shown.filter(F.col("storey") == storey)
    return loads.filter("load <> 0").join(shown, "node").select("node", "storey", "x", "y", "load")


def reachable(start: DataFrame, links: DataFrame, blocked_spaces: DataFrame, blocked_portals: DataFrame) -> DataFrame:
    """(space): open rooms that open portals lead to from the start rooms (space), these included."""
    free = links.join(blocked_spaces.select("space"), "space", "left_anti").join(blocked_portals.select("door"), "door", "left_anti").select("door", "space").distinct()
    both = free.select("door", F.col("space").alias("a")).join(free.select("door", F.col("space").alias("b")), "door").filter("a < b").select("a", "b")
    first = start.join(blocked_spaces.select("space"), "space", "left_anti").select(F.col("space").alias("node"))
    return graph.hops(both, first).select(F.col("node").alias("space"))


def elevation_scales(storeys: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """(model, scale): 0.001 for models whose elevations (model, elevation) look like millimetres, else 1.

    They do where the upper median of the steps between them (the largest value where
    there is none) is over 100, a value is over 1000, or their span is over eight
    times the model's height (model, height), for heights over half a metre.
    """
    w = Window.partitionBy("model").orderBy("elevation")  # a model's storeys
    some = storeys.filter("elevation is not null")
    step = some.withColumn("gap", F.col("elevation") - F.lag("elevation").over(w)).filter("gap > 1e-9")
    order = Window.partitionBy("model").orderBy("gap")
    ranked = step.select("model", "gap", F.row_number().over(order).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("model")).alias("n"))
    typical = ranked.filter(F.col("k") == F.floor(F.col("n") / 2) + 1).select("model", F.col("gap").alias("typical"))
    whole = some.groupBy("model").agg(F.max(F.abs("elevation")).alias("most"), (F.max("elevation") - F.min("elevation")).alias("span")).join(typical, "model", "left")
    known = whole.join(heights.select("model", "height"), "model", "left") if heights is not None else whole.withColumn("height", F.lit(None).cast("double"))
    tall = F.coalesce((F.col("height") > 0.5) & (F.col("span") > F.col("height") * 8), F.lit(False))
    return known.select("model", F.when((F.coalesce("typical", "most") > 100) | (F.col("most") > 1000) | tall, 0.001).otherwise(1.0).alias("scale"))


def polyline_distance(x: Column, y: Column, points: Column) -> Column:
    """Distance to a line of points: infinite without any, to the one where there is one."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(points) - 2), lambda i: F.struct(F.get(points, i)["x"].alias("ax"), F.get(points, i)["y"].alias("ay"), F.get(points, i + 1)["x"].alias("bx"), F.get(points, i + 1)["y"].alias("by")))
    far = F.transform(pairs, lambda e: g.once(g.closest_on_segment(x, y, e), lambda q: g.distance(x, y, q["x"], q["y"])))
    one = F.get(points, F.lit(0))
    return F.when(F.size(points) >= 2, F.array_min(far)).when(F.size(points) == 1, g.distance(x, y, one["x"], one["y"])).otherwise(F.lit(float("inf")))


def thinned(points: Column, most: int) -> Column:
    """At most so many points of a line, evenly by number, the ends included."""
    step = (F.size(points) - 1) / (most - 1)
    chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(points, F.floor(i * step + 0.5).cast("int")))
    return F.when(F.size(points) <= most, points).otherwise(chosen)


def interface_midpoint(a: Column, b: Column) -> Column:
    """The middle between the closest vertex of one ring and boundary point of the other; null below three points."""
    ways = lambda ring, other: F.transform(ring, lambda p: g.once(g.closest_on_ring(p["x"], p["y"], other), lambda c: F.struct(c["d"].alias("d"), g.point((p["x"] + c["p"]["x"]) / 2, (p["y"] + c["p"]["y"]) / 2).alias("m"))))
    return F.when((F.size(a) >= 3) & (F.size(b) >= 3), F.array_min(F.concat(ways(a, b), ways(b, a)))["m"])
