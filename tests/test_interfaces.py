"""Fronts of rooms, walls and voids: the cases of two rooms side by side, a ring's start, a room around another."""

import math

import pytest
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators import interfaces
from plinth.operators import interfaces as i


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


RING = "array<struct<x:double,y:double>>"
PAIRS = f"a string, b string, storey string, ring_a {RING}, ring_b {RING}"
VOIDS = f"storey string, x double, y double, ring {RING}, host_is_wall boolean, sill_z double, head_z double"


@pytest.fixture()
def strip(spark):
    def portal(walls=(), voids=(), a=box(0, 0, 4, 4), b=box(4.2, 0, 8.2, 4), storey="L1", runs=False):
        pairs = spark.createDataFrame([("A", "B", "L1", a, b)], PAIRS)
        w = spark.createDataFrame([(storey, r) for r in walls], f"storey string, ring {RING}")
        v = i.walkable_voids(spark.createDataFrame([("L1", *r) for r in voids], VOIDS))
        s = i.blocked_samples(i.strip_samples(pairs), w, v)
        return (i.clear_runs(s) if runs else i.strip_portals(s)).collect()

    return portal


SEALED = box(4, 0, 4.2, 4)


def test_open_and_sealed(strip):
    (p,) = strip()
    assert p.x == pytest.approx(4.1, abs=0.05) and 0.5 < p.y < 3.5
    assert strip([SEALED]) == [] and strip([box(3.95, -0.1, 4.25, 4.1)]) == []
    assert len(strip([SEALED], storey="L2")) == 1  # another storey's wall
    assert len(strip([[(4.0, 0.0), (4.2, 4.0)]])) == 1  # no outline, no wall


def test_partial_wall(strip):
    (p,) = strip([box(4, 0, 4.2, 1.2)], [(4.1, 2.0, None, True, None, None)])
    assert 1.5 < p.y < 3.5


@pytest.mark.parametrize("void, found", [
    ((4.1, 2.0, None, False, None, None), 0),  # of furniture
    ((4.1, 2.0, None, None, None, None), 0),
    ((None, 2.0, None, True, None, None), 0),
    ((4.1, 2.0, None, True, None, None), 1),  # unmeasured
    ((4.1, 2.0, [], True, None, None), 1),
    ((4.1, 2.0, box(3, 0, 5.2, 4), True, None, None), 0),  # a wall's profile
    ((4.1, 2.0, box(3.98, 1.55, 4.22, 2.45), True, 0.0, 2.1), 1),  # a doorway
    ((4.1, 2.0, box(3.98, 1.55, 4.22, 2.45), True, 2.4, 3.0), 0),  # low
    ((4.1, 2.0, box(3.98, 1.875, 4.22, 2.125), True, 0.0, 2.1), 0),  # narrow
])
def test_voids(strip, void, found):
    assert len(strip([SEALED], [void])) == found


def test_start_of_the_ring(strip):
    """A room to the left meets the outline's first and last samples: one run, not two."""
    (r,) = strip(a=box(4.2, 0, 8.2, 4), b=box(0, 0, 4, 4), runs=True)
    assert r.start < 0 and r.span > 4


def test_room_around(strip):
    """A front all around: a run goes on over the outline's start, the longest one behind the only wall."""
    (r,) = strip([box(-0.05, 1.9, 0.05, 2.1)], a=box(0, 0, 4, 4), b=box(-0.2, -0.2, 4.2, 4.2), runs=True)
    assert 15 < r.span < 16
    (whole,) = strip(a=box(0, 0, 4, 4), b=box(-0.2, -0.2, 4.2, 4.2), runs=True)
    assert whole.start == 0 and whole.span == pytest.approx(16, abs=0.13)


def test_corner(strip):
    """A room in the corner of an L, a wall along its lower side."""
    ell = [(0.0, 0.0), (6.0, 0.0), (6.0, 1.8), (1.8, 1.8), (1.8, 6.0), (0.0, 6.0)]
    (p,) = strip([box(1.8, 1.8, 5.2, 2.05)], a=box(2, 2, 5, 5), b=ell)
    assert p.span >= 0.7


def test_lengths_and_nothing(spark, strip):
    pairs = spark.createDataFrame([("A", "B", "L1", box(0, 0, 4, 4), box(4.2, 0, 8.2, 4)), ("A", "C", "L1", box(0, 0, 4, 4), box(9, 0, 10, 4)), ("A", "D", None, box(0, 0, 4, 4), None), ("A", "E", "L1", [], box(0, 0, 4, 4))], PAIRS)
    (r,) = i.interface_lengths(pairs).collect()
    assert r.b == "B" and r.length == pytest.approx((35 + 3 + 3) * 0.12) and 0.2 <= r.gap < 0.3  # of each room: the facing edge, three samples at either corner
    assert strip(b=box(9, 0, 10, 4)) == [] and strip(a=[(0.0, 0.0), (1.0, 1.0)]) == []
    assert i.interface_lengths(pairs.limit(0)).collect() == [] and i.strip_samples(pairs.limit(0)).collect() == []


def test_fronts_of_other_outlines(spark):
    """Batches give what the column functions give point by point: turned, hollow and overlapping outlines, ones without room, and none."""
    corner = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    rings = {"corner": corner, "in": [(1.3, 1.2), (3.0, 1.3), (2.9, 3.0), (1.2, 2.9)], "over": [(3.5, 0.5), (6.0, 0.5), (5.0, 3.0)], "twice": [(4.2, 0.0), (4.2, 0.0), (6.0, 0.0), (6.0, 2.0), (4.2, 2.0)], "line": [(-0.2, 0.0), (-0.2, 3.0)], "far": [(90.0, 90.0), (91.0, 90.0), (91.0, 91.0)], "none": None}
    pairs = spark.createDataFrame([(a, b, "L1", rings[a], rings[b]) for a in rings for b in rings if a != b], "a string, b string, storey string, ring_a array<struct<x:double,y:double>>, ring_b array<struct<x:double,y:double>>")

    def points(ring, last):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]) if ring and len(ring) > 2 else ():
            if (size := math.dist(p, q)) >= 1e-9:
                n = max(1, math.ceil(size / interfaces.STEP))
                out += [(p[0] + k / n * (q[0] - p[0]), p[1] + k / n * (q[1] - p[1])) for k in range(n + last)]
        return out

    rows = [(a, b, last, x, y, rings[b]) for a in rings for b in rings if a != b for last in (0, 1) for x, y in points(rings[a], last)]
    far = spark.createDataFrame(rows, "a string, b string, last int, x double, y double, ring array<struct<x:double,y:double>>")
    far = far.select("a", "b", "last", g.polygon_distance(F.col("x"), F.col("y"), F.col("ring")).alias("d")).filter(F.col("d") <= interfaces.GAP).collect()
    near = lambda last, *ways: [r.d for r in far if r.last == last and (r.a, r.b) in ways]
    want = {(a, b): (len(d) * interfaces.STEP / 2, sum(d) / len(d)) for a in rings for b in rings if a != b and (d := near(1, (a, b), (b, a))) and len(d) * interfaces.STEP / 2 >= interfaces.LENGTH}
    got = {(r.a, r.b): (r.length, r.gap) for r in interfaces.interface_lengths(pairs).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} and len(want) > 6
    samples = {(a, b): n for a in rings for b in rings if a != b and rings[b] and len(rings[b]) > 2 and (n := len(near(0, (a, b))))}
    assert {(r.a, r.b): r["count"] for r in interfaces.strip_samples(pairs).groupBy("a", "b").count().collect()} == samples


def test_fronts_on_every_partition(spark, sf_dir):
    """Few pairs make many samples, so they aren't left in one task (one of 1,000 rooms took two minutes)."""
    from plinth.plans import interfaces as plans
    from plinth.plans.building import Building

    found = interfaces.strip_samples(plans.fronts(Building(spark, sf_dir)))
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
