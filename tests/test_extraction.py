"""Footprints from meshes, parts, placements or nothing: each stage, and what furniture is dropped for."""

import math
import random

import pytest

from plinth.functions import geometry as g
from plinth.operators import extraction, footprints

ELEMENTS = "element string, kind string, storey string, width double, depth double, ox double, oy double, oz double"
FACES = "element string, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"
STOREYS = [("L0", 0.0), ("L1", 3.0), ("L2", None)]


def plate(element, x0, y0, x1, y1, z, turn=0.0):
    """Two level triangles."""
    c, s = math.cos(turn), math.sin(turn)
    p, q, r, t = ((x * c - y * s, x * s + y * c, float(z)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1)))
    return [(element, *p, *q, *r), (element, *p, *r, *t)]


def ringed(element, outer, inner, z):
    """A square plate with a square hole around the same middle: eight triangles."""
    corner = lambda h: [(-h, -h), (h, -h), (h, h), (-h, h)]
    o, i = corner(outer / 2), corner(inner / 2)
    out = []
    for k in range(4):
        a, b, c, d = o[k], o[(k + 1) % 4], i[(k + 1) % 4], i[k]
        out += [(element, *a, z, *b, z, *c, z), (element, *a, z, *c, z, *d, z)]
    return out


@pytest.fixture(scope="module")
def told(spark):
    wall = [("upright", 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 4.0, 0.0, 3.0), ("upright", 0.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 3.0, 3.0)]
    faces = [
        *(f[:4] + f[7:] + f[4:7] for f in plate("room", 0, 0, 4, 3, 0)), *plate("room", 0, 0, 4, 3, 2.5), *ringed("court", 8.0, 2.0, 0.0), *plate("twice", 0, 0, 2, 2, 0), *plate("twice", 0, 0, 2, 2, 0),
        *plate("flight1", 0, 0, 1, 2, 0), *plate("flight2", 1, 2, 2, 5, 1.5), *plate("own", 0, 0, 1, 1, 0, 0.5), *wall, *plate("stranger", 0, 0, 99, 99, 0),
        *plate("desk", 0, 0, 2, 1, 0.7), *plate("desk", 0, 0, 2, 1, 0.0), *plate("desk", 3, 0, 4, 1, 0.7), *ringed("well", 2.0, 1.0, 0.7), *plate("clock", 0, 0, 0.2, 0.2, 1.5),
        *plate("lamp", 0, 0, 1, 1, 2.8), *plate("upstairs", 0, 0, 1, 1, 3.5), *plate("upstairs", 0, 0, 1, 1, 2.9),
        *plate("screens", 0, 0, 1, 1, 0.7), *plate("screens", 0.2, 0.2, 0.6, 0.6, 1.4),
    ]
    none = (None,) * 5
    placed = lambda w=None, d=None, z=0.0: (w, d, 10.0, 20.0, z)
    elements = [
        ("room", "space", "L0", *none), ("court", "space", "L0", *none), ("twice", "space", "L0", *none), ("boxed", "space", None, *placed(2.0, 0.0)), ("lost", "space", "L0", *none), ("lost", "space", "L0", *none),
        ("stair", "stair", "L0", *placed()), ("own", "stair", "L0", *none), ("bare", "stair", "L0", *placed()), ("gone", "stair", "L0", 1.0, 1.0, 1.0, None, None), ("upright", "wall", "L0", *none), (None, "wall", "L0", *none),
        *((n, "furniture", "L0", *none) for n in ("desk", "well", "clock", "lamp", "screens")), ("upstairs", "furniture", None, *none),
        ("sized", "furniture", "L1", *placed(1.5, 0.5, 3.0)), ("half", "furniture", "L0", *placed(1.5)), ("above", "furniture", "L0", *placed(1.5, 0.5, 2.2)), ("floorless", "furniture", "L2", *placed(1.0, 1.0, 77.0)), ("nowhere", "furniture", None, *none),
    ]
    parts = [("stair", "flight1"), ("stair", "flight2"), ("stair", "flight2"), ("room", "stranger"), ("stair", "missing"), (None, "own"), ("bare", None)]
    make = spark.createDataFrame
    found = extraction.element_footprints(make(elements, ELEMENTS), make(faces, FACES), make(parts, "element string, part string"), make(STOREYS, "storey string, elevation double"))
    rows = found.withColumn("area", g.area(found.ring)).collect()
    assert len(rows) == len({r.element for r in rows}) == 21
    return {r.element: r for r in rows}


def test_rooms_stairs_walls(told):
    method = {k: (r.method, r.incomplete, round(r.area or 0, 6), len(r.holes)) for k, r in told.items() if r.kind != "furniture"}
    assert method == {
        "room": ("ifc_mesh_xy_outline", False, 12.0, 0), "court": ("ifc_mesh_xy_outline", False, 64.0, 1), "twice": ("ifc_mesh_xy_hull", False, 4.0, 0), "boxed": ("ifc_placement_bbox", False, 2.0, 0), "lost": ("unavailable", True, 0.0, 0),
        "stair": ("ifc_mesh_xy_hull", False, 7.5, 0), "own": ("ifc_mesh_xy_hull", False, 1.0, 0), "bare": ("ifc_placement_bbox", False, 1.0, 0), "gone": ("unavailable", True, 0.0, 0), "upright": ("ifc_mesh_xy_hull", False, 6.0, 0),
    }


def test_furniture(told):
    kept = {k: (r.method, r.storey, round(r.area, 6), len(r.holes), len(r.parts)) for k, r in told.items() if r.kind == "furniture" and r.dropped is None}
    assert kept == {
        "desk": ("ifc_mesh_xy_outline", "L0", 2.0, 0, 1), "well": ("ifc_mesh_xy_outline", "L0", 4.0, 1, 0), "screens": ("ifc_mesh_xy_outline", "L0", 1.0, 0, 1), "upstairs": ("ifc_mesh_xy_outline", "L1", 1.0, 0, 0),
        "sized": ("ifc_placement_bbox", "L1", 0.75, 0, 0), "floorless": ("ifc_placement_bbox", "L2", 1.0, 0, 0),
    }
    assert {k: r.dropped for k, r in told.items() if r.dropped} == {"clock": "tiny", "lamp": "overhead", "half": "unmeasured", "above": "overhead", "nowhere": "unmeasured"}
    assert all(r.ring is None and r.method is None for r in told.values() if r.dropped)


def test_hulls_don_t_depend_on_partitions(spark):
    rng = random.Random(3)
    points = [(e, round(rng.gauss(0, 3), 3), round(rng.gauss(0, 3), 3)) for e in "abc" for _ in range(400)] + [("one", 1.0, 1.0), ("line", 0.0, 0.0), ("line", 1.0, 1.0), ("line", 2.0, 2.0)]
    df = spark.createDataFrame(points, "element string, x double, y double").repartition(7)
    got = {r.element: [(p.x, p.y) for p in r.hull] for r in extraction.hulls(df).collect()}
    assert got == {e: footprints.hull([(x, y) for n, x, y in points if n == e]) for e in ("a", "b", "c", "one", "line")}
    assert extraction.hulls(df.limit(0)).count() == 0


def test_distinct_points_keep_the_first_of_a_cell(spark):
    rows = [("a", 0, 1.0, 1.0), ("a", 1, 1.0 + 2e-7, 1.0), ("a", 2, 1.000002, 1.0), ("b", 3, 1.0, 1.0), ("a", 4, float("nan"), 1.0), ("a", 5, None, 1.0)]
    got = extraction.distinct_points(spark.createDataFrame(rows, "element string, i int, x double, y double")).collect()
    assert sorted((r.element, r.i) for r in got) == [("a", 0), ("a", 2), ("b", 3)]
