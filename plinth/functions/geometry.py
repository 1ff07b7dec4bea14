"""Plane geometry as column expressions over array<struct<x, y>> rings (not closed).

Null rings, and rings too short for the question, give null or the stated value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Counter-clockwise ring of an axis-aligned box."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def ring_edges(ring: Column) -> Column:
    """array<struct<ax, ay, bx, by>>: vertex i to i + 1, the last to the first."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive counter-clockwise; 0 below three vertices."""
    twice = _sum(F.transform(ring_edges(ring), lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]))
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(twice / 2)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """Mean of the vertices."""
    n = F.size(ring)
    return F.when(n > 0, point(_sum(F.transform(ring, lambda p: p["x"])) / n, _sum(F.transform(ring, lambda p: p["y"])) / n))


def perimeter(ring: Column) -> Column:
    return _sum(F.transform(ring_edges(ring), lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"])))


def bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def boxes_meet(a: Column, b: Column, pad: float = 0.0) -> Column:
    """Whether two boxes overlap or touch within `pad`."""
    return (a["min_x"] - pad <= b["max_x"]) & (b["min_x"] - pad <= a["max_x"]) & (a["min_y"] - pad <= b["max_y"]) & (b["min_y"] - pad <= a["max_y"])


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; false below three vertices.  Points on the boundary are in or out by the edge's direction."""

    def crosses(e: Column) -> Column:
        at = (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"] + 1e-15) + e["ax"]
        return F.when(((e["ay"] > y) != (e["by"] > y)) & (x < at), 1).otherwise(0)

    crossings = F.aggregate(F.transform(ring_edges(ring), crosses), F.lit(0), lambda acc, v: acc + v)
    return (F.size(ring) >= 3) & (crossings % 2 == 1)


def point_in_space(x: Column, y: Column, ring: Column, holes: Column) -> Column:
    """In the ring and in none of its holes."""
    return point_in_ring(x, y, ring) & ~F.coalesce(F.exists(holes, lambda h: point_in_ring(x, y, h)), F.lit(False))


def closest_on_segment(x: Column, y: Column, e: Column) -> Column:
    """Closest point of a segment; its first end if it has no length."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    size = dx * dx + dy * dy
    t = F.when(size < 1e-18, F.lit(0.0)).otherwise(F.least(F.greatest(((x - e["ax"]) * dx + (y - e["ay"]) * dy) / size, F.lit(0.0)), F.lit(1.0)))
    return point(e["ax"] + t * dx, e["ay"] + t * dy)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(bx - ax, by - ay)


def closest_on_ring(x: Column, y: Column, ring: Column) -> Column:
    """struct<d, p>: the boundary's closest point and its distance."""
    near = F.transform(ring_edges(ring), lambda e: closest_on_segment(x, y, e))
    return F.array_min(F.transform(near, lambda p: F.struct(distance(x, y, p["x"], p["y"]).alias("d"), p.alias("p"))))


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    return closest_on_ring(x, y, ring)["d"]


def polygon_distance(x: Column, y: Column, ring: Column) -> Column:
    """0 inside, else the distance to the boundary."""
    return F.when(point_in_ring(x, y, ring), F.lit(0.0)).otherwise(ring_distance(x, y, ring))


def segments_meet(a: Column, b: Column, eps: float = 1e-4) -> Column:
    """Whether two segments cross or touch."""

    def turn(px, py, qx, qy, rx, ry):
        return (qx - px) * (ry - py) - (qy - py) * (rx - px)

    def on(px, py, qx, qy, rx, ry):
        return (F.abs(turn(px, py, qx, qy, rx, ry)) <= eps) & (rx >= F.least(px, qx) - eps) & (rx <= F.greatest(px, qx) + eps) & (ry >= F.least(py, qy) - eps) & (ry <= F.greatest(py, qy) + eps)

    pa, pb = (a["ax"], a["ay"]), (a["bx"], a["by"])
    qa, qb = (b["ax"], b["ay"]), (b["bx"], b["by"])
    apart = lambda p, q, r, s: turn(*p, *q, *r) * turn(*p, *q, *s) < 0
    return (apart(pa, pb, qa, qb) & apart(qa, qb, pa, pb)) | on(*pa, *pb, *qa) | on(*pa, *pb, *qb) | on(*qa, *qb, *pa) | on(*qa, *qb, *pb)


def polygons_meet(a: Column, b: Column) -> Column:
    """Whether a vertex of one is in the other or two edges meet; never for fewer than three vertices."""
    return (F.size(a) >= 3) & (F.size(b) >= 3) & (
        F.exists(a, lambda p: point_in_ring(p["x"], p["y"], b))
        | F.exists(b, lambda p: point_in_ring(p["x"], p["y"], a))
        | F.exists(ring_edges(a), lambda e: F.exists(ring_edges(b), lambda f: segments_meet(e, f)))
    )


def calipers(ring: Column) -> Column:
    """struct<least, most>: widths of the ring across the normals of its edges of some length."""
    edges = F.filter(ring_edges(ring), lambda e: distance(e["ax"], e["ay"], e["bx"], e["by"]) > 1e-9)

    def width(e: Column) -> Column:
        size = distance(e["ax"], e["ay"], e["bx"], e["by"])
        along = F.transform(ring, lambda p: (p["x"] * (e["ay"] - e["by"]) + p["y"] * (e["bx"] - e["ax"])) / size)
        return F.array_max(along) - F.array_min(along)

    widths = F.transform(edges, width)
    return F.struct(F.array_min(widths).alias("least"), F.array_max(widths).alias("most"))


def ray_enters(x: Column, y: Column, nx: Column, ny: Column, ring: Column) -> Column:
    """Smallest t >= 0 at which the ray from the point along the normal meets the ring; 0 inside; null if it doesn't."""

    def hit(e: Column) -> Column:
        ex, ey = e["bx"] - e["ax"], e["by"] - e["ay"]
        det = nx * ey - ny * ex
        t = ((e["ax"] - x) * ey - (e["ay"] - y) * ex) / F.when(F.abs(det) >= 1e-12, det)
        u = ((e["ax"] - x) * ny - (e["ay"] - y) * nx) / F.when(F.abs(det) >= 1e-12, det)
        return F.when((t >= -1e-9) & (u >= -1e-9) & (u <= 1 + 1e-9), F.greatest(t, F.lit(0.0)))

    hits = F.filter(F.transform(ring_edges(ring), hit), lambda t: t.isNotNull())
    return F.when(point_in_ring(x, y, ring), F.lit(0.0)).otherwise(F.when(F.size(hits) > 0, F.array_min(hits)))


def inset(ring: Column, by: float = 0.05) -> Column:
    """Vertices moved toward the centroid, at most half the way."""
    c = centroid(ring)

    def move(p: Column) -> Column:
        d = distance(p["x"], p["y"], c["x"], c["y"])
        step = F.when(d > 0, F.least(F.lit(by), d / 2) / d).otherwise(F.lit(0.0))
        return point(p["x"] + (c["x"] - p["x"]) * step, p["y"] + (c["y"] - p["y"]) * step)

    return F.transform(ring, move)


def interior_point(ring: Column, holes: Column) -> Column:
    """The centroid if it is inside, else the first vertex moved 5 % of the way to it, else null."""
    c, v = centroid(ring), F.get(ring, F.lit(0))
    nudged = point(v["x"] + 0.05 * (c["x"] - v["x"]), v["y"] + 0.05 * (c["y"] - v["y"]))
    return F.when(point_in_space(c["x"], c["y"], ring, holes), c).when(point_in_space(nudged["x"], nudged["y"], ring, holes), nudged)
