"""Places of portals, adjacency from elsewhere, markers, reach, heights, lines: small cases."""

import types

import pytest
from pyspark.sql import functions as F

from plinth.operators import display as d
from plinth.operators import graph

POINTS = "array<struct<x:double,y:double>>"


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def test_portal_points(spark):
    make = spark.createDataFrame
    edges = make([("e1", "D1", "space:A", "space:B"), ("e2", "D2", "space:A", "space:B"), ("e3", None, "space:B", "space:A"), ("e4", "D9", "space:B", "space:C"), ("e5", None, "space:A", "space:C"), ("e6", None, "space:A", "space:X")], "edge string, door string, source string, target string")
    doors = make([("D1", 1.0, 2.0, []), ("D2", None, None, [(0.0, 0.0), (2.0, 4.0)]), ("D9", None, None, None)], f"door string, x double, y double, segment {POINTS}")
    real = make([("e3", "space:A", "space:B", float("nan"), 1.0), ("r2", "space:B", "space:C", 7.0, 8.0), ("r1", "space:C", "space:B", 5.0, 6.0)], "id string, source string, target string, x double, y double")
    spaces = make([("A", box(0, 0, 2, 2)), ("B", box(2, 0, 4, 2)), ("C", box(10, 0, 12, 2)), ("X", [])], f"space string, ring {POINTS}")
    assert {r.edge: (r.x, r.y) for r in d.portal_points(edges, doors, real, spaces).collect()} == {"e1": (1.0, 2.0), "e2": (1.0, 2.0), "e3": (2.0, 1.0), "e4": (5.0, 6.0), "e5": (6.0, 1.0)}


def test_adjacency_and_markers(spark):
    make = spark.createDataFrame
    edges = make([("space_space:space:A:space:B:adjacent", "space_space", "space:A", "space:B", "given", False)], "id string, kind string, source string, target string, method string, inferred boolean")
    nodes = make([("space:A",), ("space:B",), ("space:C",)], "id string")
    pairs = make([("space:B", "space:A"), ("space:C", "space:B"), ("space:B", "space:C"), ("space:A", "space:A"), ("space:A", "space:Z")], "a string, b string")
    assert sorted((r.source, r.target, r.method) for r in d.with_adjacency(edges, nodes, pairs).collect()) == [("space:A", "space:B", "given"), ("space:B", "space:C", "adjacency")]
    loads, places = make([("p", 2.0), ("q", 0.0), ("r", 1.0)], "node string, load double"), make([("p", "L1", 0.0, 0.0), ("p", "L1", 0.0, 0.0), ("q", "L1", 0.0, 0.0), ("r", "L2", 1.0, 1.0)], "node string, storey string, x double, y double")
    assert [r.node for r in d.markers(loads, places, "L1").collect()] == ["p"] and d.markers(loads, places).count() == 2


def test_reachable(spark):
    make = spark.createDataFrame
    links = make([("d1", "A"), ("d1", "B"), ("d2", "B"), ("d2", "C"), ("d3", "C"), ("d3", "D"), ("d4", "B"), ("d4", "E"), ("x", "A")], "door string, space string")
    got = d.reachable(make([("A",)], "space string"), links, make([("C",)], "space string"), make([("d4",)], "door string"))
    assert sorted(r.space for r in got.collect()) == ["A", "B"]
    assert d.reachable(make([("C",)], "space string"), links, make([("C",)], "space string"), make([], "door string")).collect() == []


def test_scales_and_lines(spark):
    make = spark.createDataFrame
    rows = [("mm", 0.0), ("mm", 3000.0), ("mm", 6000.0), ("m", 0.0), ("m", 3.0), ("m", 80.0), ("one", 150.0), ("low", 2.0), ("tall", 0.0), ("tall", 90.0), ("tall", None)]
    scale = {r.model: r.scale for r in d.elevation_scales(make(rows, "model string, elevation double"), make([("tall", 9.0), ("m", 80.0), ("low", 0.1)], "model string, height double")).collect()}
    assert scale == {"mm": 0.001, "m": 1.0, "one": 0.001, "low": 1.0, "tall": 0.001}
    line = make([(0, []), (1, [(3.0, 4.0)]), (2, [(0.0, 1.0), (5.0, 1.0), (5.0, 9.0)])], f"k int, p {POINTS}")
    far = {r.k: r.d for r in line.select("k", d.polyline_distance(F.lit(0.0), F.lit(0.0), F.col("p")).alias("d")).collect()}
    assert far == {0: float("inf"), 1: 5.0, 2: 1.0}
    many = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.cast("double").alias("x"), F.lit(0.0).alias("y"))).alias("p"))
    (r,) = many.select(d.thinned(F.col("p"), 4).alias("few"), d.thinned(F.col("p"), 10).alias("all")).collect()
    assert [p.x for p in r["few"]] == [0.0, 3.0, 6.0, 9.0] and len(r["all"]) == 10
    (m,) = make([(box(0, 0, 4, 4), box(4.2, 1, 8, 3))], f"a {POINTS}, b {POINTS}").select(d.interface_midpoint(F.col("a"), F.col("b")).alias("m")).collect()
    assert (round(m.m.x, 6), m.m.y) == (4.1, 1.0)


@pytest.mark.parametrize("master, fine", [("local", True), ("local[4]", True), ("local-cluster[3,2,1000]", False), ("spark://host:7077", False), ("yarn", False)])
def test_no_local_folder_on_a_cluster(master, fine):
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    session = types.SimpleNamespace(conf=Conf(), sparkContext=types.SimpleNamespace(master=master))
    if fine:
        assert graph.scratch(session, "x").startswith(session.conf["spark.checkpoint.dir"])
    else:
        with pytest.raises(RuntimeError):
            graph.scratch(session, "x")
    session.conf["spark.checkpoint.dir"] = "hdfs://shared/"
    assert graph.scratch(session, "x").startswith("hdfs://shared/x-")
