"""What stands in a room, and whether one sees from a place of it to another with room to walk.

Lines are cut into samples, and a line stands under the cells that its samples fall in;
obstacles stand under all cells they touch, so lines and obstacles meet in a hash join by
room and cell, and only the samples of the pairs that meet are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators import healing, spatial
from plinth.operators.graph import kept

# Fixed values, in metres: between samples, around an obstacle, of clearance, across a doorway.
STEP, AROUND, CLEAR, ACROSS = 0.05, 0.045, 0.4, 1.0
CELL = 1.0


def in_rooms(shapes: DataFrame, spaces: DataFrame) -> DataFrame:
    """(item, space): shapes (item, storey, ring) that overlap a room (space, storey, ring, holes) of their storey; a room without storey takes all.

    By a vertex, the middle or an edge's middle in the room, or a vertex of the room or of
    a hole in the shape.
    """
    own, room = healing.boxed(shapes), healing.boxed(spaces)
    same = spatial.boxes_to_boxes(own.filter("storey is not null"), room.filter("storey is not null"), on=["storey"]).drop("storey")
    every = spatial.boxes_to_boxes(own.drop("storey"), room.filter("storey is null").drop("storey"), on=[])
    inside = lambda p: g.point_in_space(p["x"], p["y"], F.col("ring_r"), F.col("holes_r"))
    held = lambda p: g.point_in_ring(p["x"], p["y"], F.col("ring_l"))
    middles = F.transform(g.ring_edges(F.col("ring_l")), lambda e: g.point((e["ax"] + e["bx"]) / 2, (e["ay"] + e["by"]) / 2))
    probes = F.concat(F.transform("ring_l", lambda p: g.point(p["x"], p["y"])), F.array(g.centroid(F.col("ring_l"))), middles)
    corners = F.concat(F.col("ring_r"), F.flatten(F.coalesce("holes_r", F.array().cast("array<array<struct<x:double,y:double>>>"))))
    return same.unionByName(every).filter(F.exists(probes, inside) | F.exists(corners, held)).select(F.col("item_l").alias("item"), F.col("space_r").alias("space"))


def doorways(openings: DataFrame, spaces: DataFrame) -> DataFrame:
    """(opening, space): openings (opening, x, y, ring, host_is_wall, window) in walls, thin on one axis and without window, that are in a room by a vertex or their place, on whatever storey."""
    thin = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) <= ACROSS
    own = healing.boxed(openings.filter("host_is_wall and window is null")).filter(thin).select("opening", "x", "y", "ring", *(f"{c}{i}" for i in (0, 1) for c in "xy"))
    reach = {f"{c}{i}": f(F.col(f"{c}{i}"), F.coalesce(F.col(c), F.col(f"{c}{i}"))) for c in "xy" for i, f in ((0, F.least), (1, F.greatest))}
    met = spatial.boxes_to_boxes(own.withColumns(reach), healing.boxed(spaces.select("space", "ring", "holes")), on=[])
    inside = lambda x, y: g.point_in_space(x, y, F.col("ring_r"), F.col("holes_r"))
    touches = F.exists("ring_l", lambda p: inside(p["x"], p["y"])) | F.coalesce(inside(F.col("x_l"), F.col("y_l")), F.lit(False))
    return met.filter(touches).select(F.col("opening_l").alias("opening"), F.col("space_r").alias("space"))


def samples(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """array<struct<k, x, y>>: places along a line, at most a step apart, without its ends."""
    size = g.distance(ax, ay, bx, by)
    n = F.greatest(F.lit(1), F.ceil(size / STEP)).cast("int")
    at = lambda k: F.struct(k.alias("k"), (ax + k / n * (bx - ax)).alias("x"), (ay + k / n * (by - ay)).alias("y"))
    return F.when((size < 1e-9) | (n < 2), F.array().cast("array<struct<k:int,x:double,y:double>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), at))


def _met(lines: DataFrame, shapes: DataFrame, pad: float) -> DataFrame:
    """Lines (line, space, s: samples) with shapes (space, ring) of their room, by cell; each pair once."""
    own = lines.withColumn("__cell", F.explode(F.array_distinct(F.transform("s", lambda p: F.struct(F.floor(p["x"] / CELL).alias("cx"), F.floor(p["y"] / CELL).alias("cy"))))))
    box = healing.boxed(shapes.select("space", "ring")).withColumn("shape", F.xxhash64("ring"))
    box = box.withColumn("__cell", F.explode(spatial.cells(F.col("x0") - pad, F.col("y0") - pad, F.col("x1") + pad, F.col("y1") + pad, CELL)))
    pairs = own.select("line", "space", "__cell").join(box.select("space", "shape", "__cell"), ["space", "__cell"]).select("line", "space", "shape").distinct()
    return pairs.join(box.drop("__cell").dropDuplicates(["space", "shape"]), ["space", "shape"]).join(lines.select("line", "s"), "line")


def sight(lines: DataFrame, spaces: DataFrame, obstacles: DataFrame, voids: DataFrame) -> DataFrame:
    """(line, clear): whether each line (line, space, ax, ay, bx, by) is in its room at CLEAR metres or more from walls and obstacles (space, ring).

    A sample in an obstacle, or at less than AROUND from it, is free where a doorway
    (voids: space, ring) holds it or is as near; an obstacle whose box isn't that near
    doesn't narrow the way.  Lines of rooms that aren't there aren't clear.
    """
    drawn = kept(lines.select("line", "space", samples(*(F.col(c) for c in ("ax", "ay", "bx", "by"))).alias("s")))
    walls = lambda p: F.array_min(F.transform(F.concat(F.array("ring"), F.filter(F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>")), lambda h: F.size(h) >= 3)), lambda r: g.ring_distance(p["x"], p["y"], r)))
    tight = lambda p: ~g.point_in_space(p["x"], p["y"], F.col("ring"), F.col("holes")) | (walls(p) < CLEAR)
    room = drawn.join(spaces.select("space", "ring", "holes"), "space", "left")
    by_room = room.select("line", F.when(F.col("ring").isNull(), True).otherwise(F.exists("s", tight)).alias("bad"))

    ring, x0, y0, x1, y1 = (F.col(c) for c in ("ring", "x0", "y0", "x1", "y1"))
    near_box = lambda p: p["x"].between(x0 - AROUND, x1 + AROUND) & p["y"].between(y0 - AROUND, y1 + AROUND)
    by_shape = _met(drawn, obstacles, AROUND).select("line", "space", F.transform(F.filter("s", near_box), lambda p: F.struct(p.alias("p"), g.polygon_distance(p["x"], p["y"], ring).alias("d"))).alias("at"))
    hits = by_shape.select("line", "space", F.explode("at").alias("h")).groupBy("line", "space", F.col("h.p").alias("p")).agg(F.min("h.d").alias("d"))
    hits = kept(hits.filter(F.col("d") < CLEAR).select("line", "space", "p", (F.col("d") < AROUND).alias("shut")))
    shut = hits.filter("shut").select("line", "space", "p", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    opened = spatial.points_to_boxes(shut, healing.boxed(voids.select("space", "ring")), on=["space"], pad=AROUND, size=CELL)
    opened = opened.filter(g.polygon_distance(F.col("x"), F.col("y"), F.col("ring")) <= AROUND).select("line", "p").distinct().withColumn("__open", F.lit(True))
    bad = hits.join(opened, ["line", "p"], "left").filter("not shut or __open is null").select("line").distinct().withColumn("__hit", F.lit(True))
    return by_room.join(bad, "line", "left").select("line", (~F.col("bad") & F.col("__hit").isNull()).alias("clear"))
