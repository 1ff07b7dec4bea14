"""Rings within rings: exteriors and holes, solids of an occupied plan, nesting by depth, outlines of shared shapes.

Rings are rows (element, ring_no, ring).  Which ring holds which is a join of boxes by
element and cell; what is a solid is settled in rounds over these pairs alone, as many
as rings are nested, so no element is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators import footprints, spatial
from plinth.operators.graph import kept

# Share of an area at which a ring within another is a copy of it, square metres of the least ring.
COPY, LEAST = 0.9, 1e-8


def measured(rings: DataFrame, least: float = LEAST) -> DataFrame:
    """Rings of at least three points and the least area, with area, middle (vertex mean) and order, the largest first."""
    sized = rings.filter(F.size("ring") >= 3).withColumn("area", g.area(F.col("ring"))).filter(F.col("area") >= least)
    sized = sized.withColumn("__c", g.centroid(F.col("ring"))).withColumns({"cx": F.col("__c.x"), "cy": F.col("__c.y")}).drop("__c")
    return sized.withColumn("rank", F.struct((-F.round("area", 9)).alias("area"), F.col("ring_no").alias("ring_no")))


def exteriors(rings: DataFrame) -> DataFrame:
    """(element, ring, holes): the largest ring of each element, and the others whose middle is within it."""
    sized = measured(rings)
    first = sized.groupBy("element").agg(F.min(F.struct("rank", "ring")).alias("m")).select("element", F.col("m.rank").alias("first"), F.col("m.ring").alias("outer"))
    rest = sized.join(first, "element").filter((F.col("rank") > F.col("first")) & g.point_in_ring(F.col("cx"), F.col("cy"), F.col("outer")))
    holes = rest.groupBy("element").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ring"))), lambda r: r["ring"]).alias("holes"))  # an element's own rings
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return first.join(holes, "element", "left").select("element", F.col("outer").alias("ring"), F.coalesce("holes", none).alias("holes"))


def containments(sized: DataFrame) -> DataFrame:
    """(element, inner, outer, share): ranks of measured rings and of the larger ones of their element that hold their middle; share of the areas."""
    box = sized.withColumn("__b", g.bbox(F.col("ring"))).select("element", "rank", "ring", "area", *(F.col(f"__b.{m}_{c}").alias(f"{c}{i}") for i, m in enumerate(("min", "max")) for c in "xy"))
    middle = sized.select("element", F.col("rank").alias("inner"), F.col("area").alias("own"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    met = spatial.points_to_boxes(middle, box, on=["element"])
    held = met.filter((F.col("rank") < F.col("inner")) & g.point_in_ring(F.col("x"), F.col("y"), F.col("ring")))
    return held.select("element", "inner", F.col("rank").alias("outer"), (F.col("own") / F.col("area")).alias("share"))


def forest(rings: DataFrame) -> DataFrame:
    """(element, ring_no, depth, parent, is_hole): how many rings hold each one, the smallest of them, and whether that number is odd."""
    sized = kept(measured(rings))
    inside = containments(sized).groupBy("element", F.col("inner").alias("rank")).agg(F.count(F.lit(1)).alias("depth"), F.max("outer").alias("__p"))
    found = sized.join(inside, ["element", "rank"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return found.select("element", "ring_no", "depth", F.col("__p.ring_no").alias("parent"), (F.col("depth") % 2 == 1).alias("is_hole"))


def _chosen(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of items (element, rank) those that no chosen one before stands against; pairs (element, inner, outer)."""
    pairs, open_ = kept(pairs.select("element", "inner", "outer")), kept(items.select("element", "rank"))
    chosen = open_.limit(0)
    while not open_.isEmpty():
        against = pairs.join(open_.select("element", F.col("rank").alias("outer")), ["element", "outer"], "left_semi")
        new = open_.join(against.select("element", F.col("inner").alias("rank")), ["element", "rank"], "left_anti")
        chosen = kept(chosen.unionByName(new))
        fallen = pairs.join(chosen.select("element", F.col("rank").alias("outer")), ["element", "outer"], "left_semi").select("element", F.col("inner").alias("rank"))
        open_ = kept(open_.join(chosen, ["element", "rank"], "left_anti").join(fallen, ["element", "rank"], "left_anti"))
    return chosen


def occupied(rings: DataFrame, least: float = LEAST) -> DataFrame:
    """(element, ring_no, solid, role): each ring of the least area is a solid, a hole of one, or a copy.

    From the largest down: a ring whose middle is in a solid is its hole, or a copy
    from nine tenths of its area on; the largest solid that holds it counts.  Others
    are solids.
    """
    sized = kept(measured(rings, least))
    pairs = kept(containments(sized))
    solids = _chosen(sized, pairs)
    held = pairs.join(solids.select("element", F.col("rank").alias("outer")), ["element", "outer"], "left_semi")
    of = held.groupBy("element", F.col("inner").alias("rank")).agg(F.min(F.struct("outer", "share")).alias("m"))
    role = F.when(F.col("m").isNull(), "solid").when(F.round("m.share", 9) >= COPY, "copy").otherwise("hole")
    return sized.join(of, ["element", "rank"], "left").select("element", "ring_no", F.coalesce("m.outer.ring_no", "ring_no").alias("solid"), role.alias("role"))


def without_copies(solids: DataFrame) -> DataFrame:
    """Solids (element, ring_no, ring) of all heights, without those whose middle is in a kept one of about their size."""
    sized = kept(measured(solids, 0.0))
    copies = containments(sized).filter(F.round("share", 9) >= COPY)
    return sized.join(_chosen(sized, copies), ["element", "rank"], "left_semi").select(solids.columns)


# --- shared shapes -------------------------------------------------------------------------------


def instanced(faces: DataFrame, placements: DataFrame, scale: float = 1.0) -> DataFrame:
    """(element, ring_no, ring): outlines of elements (element, shape, matrix) whose shapes' faces (shape, ax .. cz) are shared.

    Shapes with the same faces are one, whatever their names.  Its outline is made once
    and moved into place where the placement keeps what is level level (its third axis
    upright); the faces of others are moved, and outlined each for itself.
    """
    corner = [f"{p}{k}" for p in "abc" for k in "xyz"]
    face = F.xxhash64(*(F.round(c, footprints.PLACES) for c in corner)).alias("h")
    content = faces.select("shape", face).groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("h")).alias("k"))
    same = kept(content.select("shape", F.struct("n", "h", "k").alias("content")))
    one = same.groupBy("content").agg(F.min("shape").alias("first"))
    named = kept(placements.join(same.join(one, "content").select("shape", "first"), "shape"))
    at = lambda i: F.element_at("matrix", i)
    upright = (F.abs(at(9)) < 1e-9) & (F.abs(at(10)) < 1e-9) & (F.abs(at(3)) < 1e-9) & (F.abs(at(7)) < 1e-9)
    level, tilted = named.filter(upright), named.filter(~upright)
    points = lambda df, key: df.groupBy(key, "ring_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: g.point(p["x"], p["y"])).alias("ring"))

    needed = level.select(F.col("first").alias("shape")).distinct()
    shapes = faces.join(needed, "shape", "left_semi").select(F.col("shape").alias("element"), *corner)
    outline = points(footprints.outlines(shapes), "element").withColumnRenamed("element", "first")
    moved = F.transform("ring", lambda p: g.point(at(1) * p["x"] + at(5) * p["y"] + at(13) * scale, at(2) * p["x"] + at(6) * p["y"] + at(14) * scale))
    upright_rings = level.join(outline, "first").select("element", "ring_no", moved.alias("ring"))

    turned = faces.join(tilted.select(F.col("first").alias("shape"), "element", "matrix"), "shape")
    axis = lambda p, k: (at(k) * F.col(f"{p}x") + at(4 + k) * F.col(f"{p}y") + at(8 + k) * F.col(f"{p}z") + at(12 + k) * scale).alias(f"{p}{'xyz'[k - 1]}")
    own = points(footprints.outlines(turned.select("element", *(axis(p, k) for p in "abc" for k in (1, 2, 3)))), "element")
    return upright_rings.unionByName(own)
