"""Oriented rectangles of doors as column expressions: from a convex hull, from a placement, and what to fall back on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions import geometry as g

# Fixed values, in metres: halves at least, of a hull of two points, and sizes where none are given.
LEAST_ALONG, LEAST_THROUGH, LINE_THROUGH = 0.15, 0.04, 0.05
WIDTH, DEPTH, SIDE = 0.9, 0.12, 1.0


def rectangle(c: Column, along: Column, through: Column, half_along: Column, half_through: Column) -> Column:
    """struct<point, ring, normal, segment> around a centre, axes as points of length one."""

    def corner(a: int, t: int) -> Column:
        return g.point(c["x"] + a * along["x"] * half_along + t * through["x"] * half_through, c["y"] + a * along["y"] * half_along + t * through["y"] * half_through)

    return F.struct(
        g.point(c["x"], c["y"]).alias("point"), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring"), g.point(through["x"], through["y"]).alias("normal"), F.array(corner(-1, 0), corner(1, 0)).alias("segment"),
    )


def from_hull(hull: Column) -> Column:
    """The rectangle of least width along an edge of a hull, around the mean of its vertices; null below two points apart.

    Of equal widths (nine digits) the longer rectangle, then the earlier edge; the
    normal goes through the thin side.
    """

    def along_edge(e: Column, i: Column) -> Column:
        size = g.distance(e["ax"], e["ay"], e["bx"], e["by"])
        return F.struct(i.alias("i"), size.alias("size"), ((e["bx"] - e["ax"]) / size).alias("x"), ((e["by"] - e["ay"]) / size).alias("y"))

    def extents(a: Column) -> Column:
        span = lambda f: F.array_max(F.transform(hull, f)) - F.array_min(F.transform(hull, f))
        thick, long = span(lambda p: p["y"] * a["x"] - p["x"] * a["y"]), span(lambda p: p["x"] * a["x"] + p["y"] * a["y"])
        return F.struct(F.round(thick, 9).alias("width"), (-F.round(long, 9)).alias("back"), a["i"].alias("i"), thick.alias("thick"), long.alias("long"), a["x"].alias("x"), a["y"].alias("y"))

    def told(best: Column) -> Column:
        swap = -best["back"] < best["width"]
        x, y = F.when(swap, -best["y"]).otherwise(best["x"]), F.when(swap, best["x"]).otherwise(best["y"])
        nx, ny = F.when(swap, best["x"]).otherwise(-best["y"]), F.when(swap, best["y"]).otherwise(best["x"])
        half_along = F.greatest(F.greatest(best["long"], best["thick"]) / 2, F.lit(LEAST_ALONG))
        half_through = F.greatest(F.least(best["long"], best["thick"]) / 2, F.lit(LEAST_THROUGH))
        return g.once(g.centroid(hull), lambda c: rectangle(c, g.point(x, y), g.point(nx, ny), half_along, half_through))

    def line(e: Column) -> Column:
        size = g.distance(e["ax"], e["ay"], e["bx"], e["by"])
        x, y = (e["bx"] - e["ax"]) / F.when(size >= 1e-9, size), (e["by"] - e["ay"]) / F.when(size >= 1e-9, size)
        middle = g.point((e["ax"] + e["bx"]) / 2, (e["ay"] + e["by"]) / 2)
        return F.when(size >= 1e-9, rectangle(middle, g.point(x, y), g.point(-y, x), size / 2, F.lit(LINE_THROUGH)))

    edges = F.filter(g.ring_edges(hull), lambda e: g.distance(e["ax"], e["ay"], e["bx"], e["by"]) >= 1e-9)
    best = F.array_min(F.transform(F.transform(edges, along_edge), extents))
    of_two = g.once(F.get(g.ring_edges(hull), F.lit(0)), line)
    return F.when(F.size(hull) == 2, of_two).when((F.size(hull) > 2) & (F.size(edges) > 0), g.once(best, told))


def from_placement(origin: Column, x_axis: Column, y_axis: Column, width: Column, depth: Column) -> Column:
    """The rectangle of an opening's own axes and sizes (0.9 by 0.12 where none are given); null where an axis has no length in plan."""
    lx, ly = g.distance(F.lit(0), F.lit(0), x_axis["x"], x_axis["y"]), g.distance(F.lit(0), F.lit(0), y_axis["x"], y_axis["y"])
    fits = (lx >= 1e-9) & (ly >= 1e-9)
    w, d = (F.when(v != 0, v).otherwise(F.lit(least)) for v, least in ((width, WIDTH), (depth, DEPTH)))
    one = lambda a, size: g.point(a["x"] / F.when(fits, size), a["y"] / F.when(fits, size))
    along, through = one(x_axis, lx), one(y_axis, ly)
    wide = rectangle(origin, along, through, w / 2, F.greatest(d / 2, F.lit(LEAST_THROUGH)))
    deep = rectangle(origin, through, along, d / 2, F.greatest(w / 2, F.lit(LEAST_THROUGH)))
    return F.when(fits & origin.isNotNull(), F.when(d <= w, wide).otherwise(deep))


def placement_box(origin: Column, width: Column, depth: Column) -> Column:
    """Axis-aligned ring around a placement, one metre where no size is given; null without placement."""
    w, d = (F.when(v != 0, v).otherwise(F.lit(SIDE)) / 2 for v in (width, depth))
    return F.when(origin.isNotNull(), g.box_ring(origin["x"] - w, origin["y"] - d, origin["x"] + w, origin["y"] + d))


def door_portal(points: Column, hull: Column, origin: Column, x_axis: Column, y_axis: Column, width: Column, depth: Column) -> Column:
    """struct<point, ring, normal, segment, incomplete, method>: by the mesh's hull, its placement, its points' mean or the origin alone, or nothing."""
    mesh = F.coalesce(F.size(points) > 0, F.lit(False))
    own, placed, mean = from_hull(hull), from_placement(origin, x_axis, y_axis, width, depth), g.centroid(points)

    def told(best: Column) -> Column:
        point = F.coalesce(best["point"], F.when(mesh, mean), origin)
        method = F.when(mesh, "ifc_mesh_xy_centroid").when(origin.isNotNull(), "ifc_object_placement").otherwise("unavailable")
        return F.struct(point.alias("point"), best["ring"].alias("ring"), best["normal"].alias("normal"), best["segment"].alias("segment"), point.isNull().alias("incomplete"), method.alias("method"))

    return g.once(F.coalesce(F.when(mesh, own), placed), told)


def space_outline(ring: Column, holes: Column, hull: Column, origin: Column, width: Column, depth: Column) -> Column:
    """struct<ring, holes, incomplete, method>: the outline, the hull, the box of the placement, or nothing."""
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    outlined, hulled, placed = (F.coalesce(F.size(r) >= 3, F.lit(False)) for r in (ring, hull, placement_box(origin, width, depth)))
    method = F.when(outlined, "ifc_mesh_xy_outline").when(hulled, "ifc_mesh_xy_hull").when(placed, "ifc_placement_bbox").otherwise("unavailable")
    best = F.when(outlined, ring).when(hulled, hull).when(placed, placement_box(origin, width, depth)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    return F.struct(best.alias("ring"), F.when(outlined, F.coalesce(holes, none)).otherwise(none).alias("holes"), (~(outlined | hulled | placed)).alias("incomplete"), method.alias("method"))
