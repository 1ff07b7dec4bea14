"""Footprints of elements from meshes: what Catalyst can do as joins and groups, the walks as small grouped functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Flatness of a horizontal face, decimals that place a vertex, tolerance of simplification.
FLAT, PLACES, TOLERANCE = 0.85, 4, 0.05


def face_normals(faces: DataFrame) -> DataFrame:
    """faces (element, ax .. cz) with nx, ny, nz, horizontal and plan_area; degenerate faces are left out."""
    u, v = ([F.col(f"{p}{k}") - F.col(f"a{k}") for k in "xyz"] for p in ("b", "c"))
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    out = faces.withColumn("size", size).filter("size >= 1e-12")
    return out.withColumns({"nx": n[0] / F.col("size"), "ny": n[1] / F.col("size"), "nz": n[2] / F.col("size")}).withColumns({"horizontal": F.abs("nz") >= FLAT, "plan_area": F.abs(n[2]) / 2}).drop("size")


def widest_band(faces: DataFrame) -> DataFrame:
    """(element, up, area): of the horizontal faces that look up and those that look down the larger plan area; up wins ties."""
    flat = face_normals(faces).filter("horizontal").groupBy("element", (F.col("nz") > 0).alias("up")).agg(F.sum("plan_area").alias("area"))
    best = flat.groupBy("element").agg(F.max(F.struct(F.round("area", 9).alias("area"), "up")).alias("b"))
    return best.select("element", "b.up", "b.area")


def boundary_edges(faces: DataFrame) -> DataFrame:
    """(element, ax, ay, bx, by): plan edges that one face alone has, ends rounded and in order."""
    place = lambda c: F.round(F.col(c), PLACES)
    ends = {p: F.struct(place(f"{p}x").alias("x"), place(f"{p}y").alias("y")) for p in "abc"}
    each = F.array(*(F.struct(F.least(ends[p], ends[q]).alias("a"), F.greatest(ends[p], ends[q]).alias("b")) for p, q in ("ab", "bc", "ca")))
    once = faces.select("element", F.explode(each).alias("e")).groupBy("element", "e").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") == 1) & (F.col("e.a") != F.col("e.b")))
    return once.select("element", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull counter-clockwise from the smallest point, without collinear ones; one or two points as they are."""
    points = sorted(set(points))
    if len(points) <= 2:
        return points

    def half(ps):
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def simplified(ring: list[tuple[float, float]], tolerance: float = TOLERANCE) -> list[tuple[float, float]]:
    """Douglas-Peucker on a closed ring; the ring itself where fewer than three points would be left."""
    line, keep, todo = [*ring, ring[0]] if ring else [], {0, len(ring)}, [(0, len(ring))]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = line[a], line[b]
        size = math.hypot(bx - ax, by - ay)
        off = [(abs((bx - ax) * (line[i][1] - ay) - (by - ay) * (line[i][0] - ax)) / size if size > 1e-12 else math.hypot(line[i][0] - ax, line[i][1] - ay), -i) for i in range(a + 1, b)]
        if off and max(off)[0] > tolerance:
            i = -max(off)[1]
            keep.add(i)
            todo += [(a, i), (i, b)]
    out = [line[i] for i in sorted(keep)][:-1]
    return out if len(out) >= 3 else ring


def stitched(edges: list[tuple[tuple, tuple]]) -> list[list[tuple[float, float]]]:
    """Closed rings of at least three points that undirected edges make, each edge once."""
    near: dict[tuple, set] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rings = []
    for a, b in sorted(edges):
        if b not in near[a]:
            continue
        ring, at, before = [a], b, a
        near[a].discard(b), near[b].discard(a)
        while at != a and near[at]:
            ring.append(at)
            following = min(near[at])
            near[at].discard(following), near[following].discard(at)
            before, at = at, following
        if at == a and len(ring) >= 3:
            rings.append(ring)
    return rings


def outline_rings(faces: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(element, ring_no, ring): stitched and simplified boundary rings of each element, the largest first; a batch of elements at a time."""

    def area(r: list) -> float:
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)))

    @F.pandas_udf("array<array<struct<x:double,y:double>>>")
    def walk(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        out = []
        for x0, y0, x1, y1 in zip(ax, ay, bx, by, strict=True):
            ends = zip(zip(x0.tolist(), y0.tolist(), strict=True), zip(x1.tolist(), y1.tolist(), strict=True), strict=True)
            rings = [simplified(r, tolerance) for r in stitched(list(ends))]
            out.append([[{"x": x, "y": y} for x, y in r] for r in sorted(rings, key=lambda r: (-area(r), r))])
        return pd.Series(out)

    edges = boundary_edges(faces).groupBy("element").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("e"))  # one element's outline
    return edges.select("element", F.posexplode(walk("e.ax", "e.ay", "e.bx", "e.by")).alias("ring_no", "ring"))


def outlines(faces: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(element, ring_no, x, y, i): the points of the outlines' rings."""
    points = outline_rings(faces, tolerance).select("element", "ring_no", F.posexplode("ring").alias("i", "p"))
    return points.select("element", "ring_no", "p.x", "p.y", "i")


def transformed(points: Column, matrix: Column, scale: Column) -> Column:
    """array<struct<x, y, z>> moved by a 4 x 4 matrix (column-major array) whose translation is in project units."""
    m = lambda i: F.element_at(matrix, i + 1)
    axis = lambda p, k: m(k) * p["x"] + m(4 + k) * p["y"] + m(8 + k) * p["z"] + m(12 + k) * scale
    return F.transform(points, lambda p: F.struct(axis(p, 0).alias("x"), axis(p, 1).alias("y"), axis(p, 2).alias("z")))
