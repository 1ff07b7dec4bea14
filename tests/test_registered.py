"""SQL functions of a session."""

import pytest

from plinth.functions import registered


@pytest.fixture(scope="module")
def sql(spark):
    registered.register(spark)
    registered.register(spark)  # again does no harm
    return lambda q: spark.sql(q).collect()


RING = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 2D), named_struct('x', 0D, 'y', 2D))"
NONE = "cast(array() AS array<struct<x: double, y: double>>)"


def test_rings(sql):
    (r,) = sql(f"SELECT ring_area({RING}), ring_signed_area(reverse({RING})), ring_perimeter({RING}), ring_centroid({RING}).y, ring_box({RING}).x1, point_in_ring(1D, 1D, {RING}), point_in_ring(5D, 1D, {RING}), ring_distance(7D, 6D, {RING})")
    assert tuple(r) == (8.0, -8.0, 12.0, 1.0, 4.0, True, False, 5.0)
    (r,) = sql(f"SELECT ring_area({NONE}), ring_perimeter({NONE}), ring_centroid({NONE}), point_in_ring(0D, 0D, {NONE}), ring_distance(0D, 0D, {NONE}), segment_distance(3D, 4D, 0D, 0D, 0D, 0D)")
    assert tuple(r) == (0.0, 0.0, None, False, None, 5.0)


def test_ids(sql):
    (r,) = sql("SELECT node_kind('door:a:b'), node_gid('door:a:b'), viz_door('viz-door:door:D:space:A:space:B'), viz_door('viz-door:door:D'), viz_exit('viz-exit:door:E:space:A:b'), viz_exit('door:E'), landing_parts('vlink-evac:stair:a@b@S2'), landing_parts('x')")
    assert (r[0], r[1], tuple(r[2]), r[3], tuple(r[4]), r[5], tuple(r[6]), r[7]) == ("door", "a:b", ("door:D", "space:A", "space:B"), None, ("E", "A:b"), None, ("stair:a@b", "S2"), None)


def test_numbers(sql):
    (r,) = sql("SELECT fnv1a(''), fnv1a('abc'), metres(5000D, 0.001D), metres(5D, null)")
    assert r[0] == 2166136261 / 2**32 and r[1] == 440920331 / 2**32 and (r[2], r[3]) == (5.0, 5.0)


def test_tables(sql):
    rows = sql(f"SELECT t.k, e.i, e.bx FROM VALUES (1, {RING}), (2, {NONE}) AS t(k, ring), LATERAL ring_edges(t.ring) e ORDER BY e.i")
    assert [tuple(r) for r in rows] == [(1, 0, 4.0), (1, 1, 4.0), (1, 2, 0.0), (1, 3, 0.0)]
    assert sql(f"SELECT count(*) FROM boundary_samples({RING}, 0.5D)")[0][0] == 28
