"""Footprints of a model's elements, each from the best it has: a mesh, its parts' meshes, a placement, or nothing.

Elements are rows (element, kind, storey, width, depth, ox, oy, oz) with kinds space,
stair, wall and furniture; meshes are faces (element, ax .. cz) in metres, of elements
and of their parts.  A mesh is never gathered to take its hull: batches are reduced to
their own hulls before these are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.functions import rectangles
from plinth.operators import footprints, rings, spatial
from plinth.operators.graph import kept

# Fixed values, in metres: grid of equal points, least area of furniture, heights above a floor that people walk in,
# height of furniture without mesh, tolerance of furniture's outlines.
SAME_POINT, LEAST_FURNITURE, WALK, ASSUMED_HEIGHT, FINE = 1e-6, 0.05, (0.15, 2.10), 1.0, 0.01
_RING = "array<struct<x:double,y:double>>"


def distinct_points(points: DataFrame) -> DataFrame:
    """(element, i, x, y): of an element's points (element, i, x, y) in one cell of the grid the first; points without place are left out."""
    cell = lambda c: F.rint(F.col(c) / SAME_POINT)
    placed = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    first = placed.groupBy("element", cell("x").alias("cx"), cell("y").alias("cy")).agg(F.min(F.struct("i", "x", "y")).alias("p"))
    return first.select("element", "p.*")


def mesh_points(faces: DataFrame) -> DataFrame:
    """(element, x, y, z): the distinct corners of each element's faces."""
    corners = F.array(*(F.struct(*(F.col(f"{p}{k}").alias(k) for k in "xyz")) for p in "abc"))
    return faces.select("element", F.explode(corners).alias("p")).select("element", "p.*").distinct()


def hulls(points: DataFrame) -> DataFrame:
    """(element, hull): the convex hull of each element's points (element, x, y), counter-clockwise, fewer than three points as they are."""
    kind = dict(points.dtypes)["element"]

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own: dict = {}
            for e, x, y in zip(b.element, b.x, b.y, strict=True):
                own.setdefault(e, []).append((x, y))
            yield pd.DataFrame([(e, x, y) for e, points in own.items() for x, y in footprints.hull(points)], columns=["element", "x", "y"])

    @F.pandas_udf(_RING)
    def whole(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([[{"x": x, "y": y} for x, y in footprints.hull(list(zip(a.tolist(), b.tolist(), strict=True)))] for a, b in zip(xs, ys, strict=True)])

    partial = points.select("element", "x", "y").filter("element is not null").mapInPandas(reduced, f"element {kind}, x double, y double")
    met = partial.groupBy("element").agg(F.collect_list(F.struct("x", "y")).alias("p"))  # corners of its batches' hulls
    return met.select("element", whole("p.x", "p.y").alias("hull"))


def mesh_outlines(faces: DataFrame) -> DataFrame:
    """(element, ring, holes): the outline of each mesh's level faces, of the side (up, down) with the larger area; of all faces where none is level."""
    faces = faces.select("element", *(f"{p}{k}" for p in "abc" for k in "xyz"))
    best = kept(footprints.widest_band(faces).select("element", "up"))
    level = footprints.face_normals(faces).filter("horizontal").join(best, "element").filter((F.col("nz") > 0) == F.col("up")).select(faces.columns)
    return rings.exteriors(kept(footprints.outline_rings(level.unionByName(faces.join(best, "element", "left_anti")))))


def occupied_plans(faces: DataFrame) -> DataFrame:
    """(element, ring, holes, parts): what furniture stands on, from every level face, slab by slab of a decimetre.

    The largest solid with its holes, the other solids as parts; solids that repeat at
    another height count once.  A mesh with no solid of the least area has its outline
    if that is large enough, else no row.
    """
    faces = faces.select("element", *(f"{p}{k}" for p in "abc" for k in "xyz"))
    slab = F.bround((F.col("az") + F.col("bz") + F.col("cz")) / 3, 1)
    level = footprints.face_normals(faces).filter("horizontal").withColumn("key", F.to_json(F.struct(F.col("element").alias("e"), slab.alias("z"))))
    keys = level.groupBy("key").agg(F.first("element").alias("element"), F.first(slab).alias("slab"))
    cut = level.select(F.col("key").alias("element"), *faces.columns[1:])
    found = kept(footprints.outline_rings(cut, FINE))
    roles = kept(rings.occupied(found, LEAST_FURNITURE).join(found, ["element", "ring_no"]).withColumnRenamed("element", "key"))
    order = F.struct(F.round(g.area(F.col("ring")) * -1, 9).alias("a"), "ring_no")
    holes = roles.filter("role = 'hole'").groupBy("key", F.col("solid").alias("ring_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "ring"))), lambda h: h["ring"]).alias("holes"))
    none = F.array().cast(f"array<{_RING}>")
    solids = roles.filter("role = 'solid'").join(holes, ["key", "ring_no"], "left").join(keys, "key")
    solids = kept(rings.without_copies(solids.select("element", F.struct("slab", "ring_no").alias("ring_no"), "ring", F.coalesce("holes", none).alias("holes"))))
    ranked = F.array_sort(F.collect_list(F.struct(order.alias("o"), "ring", "holes")))
    whole = solids.groupBy("element").agg(ranked.alias("s")).select("element", F.col("s")[0]["ring"].alias("ring"), F.col("s")[0]["holes"].alias("holes"), F.transform(F.slice("s", 2, F.size("s")), lambda p: p["ring"]).alias("parts"))
    whole = kept(whole)
    rest = mesh_outlines(faces.join(whole.select("element"), "element", "left_anti")).filter(g.area(F.col("ring")) >= LEAST_FURNITURE)
    return whole.unionByName(rest.withColumn("parts", none))


def owners_points(points: DataFrame, elements: DataFrame, parts: DataFrame) -> DataFrame:
    """(element, x, y): the points of each element, and for stairs those of their parts (element, part); a part may have several owners."""
    own = points.join(elements.select("element").distinct(), "element", "left_semi").select("element", "x", "y")
    stairs = elements.filter("kind = 'stair'").select("element").distinct()
    of = parts.select("element", F.col("part")).distinct().join(stairs, "element", "left_semi")
    below = points.select(F.col("element").alias("part"), "x", "y").join(of, "part").select("element", "x", "y")
    return own.unionByName(below)


def in_walk_band(low: Column, high: Column, floor: Column) -> Column:
    """Whether heights meet those that people walk in; unknown heights and floors do."""
    return F.coalesce((low <= floor + WALK[1]) & (high >= floor + WALK[0]), F.lit(True))


def _furniture(items: DataFrame, points: DataFrame, plans: DataFrame, found: DataFrame, storeys: DataFrame) -> DataFrame:
    heights = points.groupBy("element").agg(F.min("z").alias("low"), F.max("z").alias("high"), F.avg("z").alias("mean"))
    placed = F.col("ox").isNotNull() & F.col("oy").isNotNull()
    base = F.when(placed, F.col("oz"))
    known = items.join(heights, "element", "left").withColumns({"z": F.coalesce("mean", base), "low": F.coalesce("low", base), "high": F.coalesce("high", base + ASSUMED_HEIGHT)})
    near = spatial.nearest_storey(known.select("element", "z").filter("z is not null"), storeys.filter("elevation is not null").select("storey", "elevation"))
    known = known.join(near.select("element", F.col("storey").alias("__near")), "element", "left").withColumn("storey", F.coalesce("storey", "__near"))
    known = known.join(storeys.groupBy("storey").agg(F.min("elevation").alias("floor")), "storey", "left").join(plans, "element", "left").join(found, "element", "left")
    tiny = F.coalesce((F.size("hull") >= 3) & (g.area(F.col("hull")) < LEAST_FURNITURE), F.lit(False))
    sized = F.coalesce((F.col("width") > 0) & (F.col("depth") > 0) & placed, F.lit(False))
    drop = F.when(~in_walk_band(F.col("low"), F.col("high"), F.col("floor")), "overhead").when(F.col("ring").isNotNull(), None).when(tiny, "tiny").when(~sized, "unmeasured")
    box = rectangles.placement_box(F.when(placed, g.point(F.col("ox"), F.col("oy"))), F.col("width"), F.col("depth"))
    method = F.when(drop.isNotNull(), None).when(F.col("ring").isNotNull(), "ifc_mesh_xy_outline").otherwise("ifc_placement_bbox")
    none = F.array().cast(f"array<{_RING}>")
    shown = lambda c, other: F.when(F.col("dropped").isNull(), F.coalesce(c, other))
    told = known.withColumns({"dropped": drop, "method": method, "box": box})
    return told.select("element", "kind", "storey", shown("ring", "box").alias("ring"), shown("holes", none).alias("holes"), shown("parts", none).alias("parts"), F.lit(False).alias("incomplete"), "method", "dropped")


def element_footprints(elements: DataFrame, faces: DataFrame, parts: DataFrame, storeys: DataFrame) -> DataFrame:
    """(element, kind, storey, ring, holes, parts, incomplete, method, dropped) of every element.

    Spaces: outline with holes, hull, box of the placement (one metre where no size is
    given), or incomplete.  Stairs (with their parts (element, part)) and walls: the
    same from the hull on.  Furniture: what it occupies, a box only where its size is
    given; dropped are pieces out of people's reach (overhead), measured but under the
    least area (tiny) and those with neither mesh nor size (unmeasured: routes won't
    avoid them).  Furniture without storey belongs to the nearest one of storeys
    (storey, elevation).  Elements without id are left out, of several rows with one
    id the first by all columns counts.
    """
    columns = ["element", "kind", "storey", "width", "depth", "ox", "oy", "oz"]
    one = elements.select(columns).filter("element is not null").groupBy("element").agg(F.min(F.struct(*columns[1:])).alias("e"))
    elements = kept(one.select("element", "e.*"))
    used = elements.select("element").union(parts.select("part")).distinct()
    faces = kept(faces.filter("element is not null").join(used, "element", "left_semi").select("element", *(f"{p}{k}" for p in "abc" for k in "xyz")))
    points = kept(mesh_points(faces))
    flat = distinct_points(owners_points(points, elements, parts).withColumn("i", F.lit(0)))
    found = kept(hulls(flat))
    of = lambda kind: elements.filter(F.col("kind") == kind)
    own = lambda kind: faces.join(of(kind).select("element"), "element", "left_semi")
    none = F.array().cast(f"array<{_RING}>")

    outlined = mesh_outlines(own("space"))
    rooms = elements.filter("kind in ('space', 'stair', 'wall')").join(outlined, "element", "left").join(found, "element", "left")
    origin = F.when(F.col("ox").isNotNull() & F.col("oy").isNotNull(), g.point(F.col("ox"), F.col("oy")))
    rooms = rooms.withColumn("f", rectangles.space_outline(F.col("ring"), F.col("holes"), F.col("hull"), origin, F.col("width"), F.col("depth")))
    rooms = rooms.select("element", "kind", "storey", "f.ring", "f.holes", none.alias("parts"), "f.incomplete", "f.method", F.lit(None).cast("string").alias("dropped"))
    items = _furniture(of("furniture"), points.join(of("furniture").select("element"), "element", "left_semi"), occupied_plans(own("furniture")), found, storeys)
    return rooms.unionByName(items)
