"""Every registered query of the derived building against its SQL; evacuation against a plain search."""

import heapq
import inspect
import math

import duckdb
import pytest

from plinth.operators import evacuation, graph
from plinth.plans import blocks, catalogue, display, footprints, healing, interfaces, routes, sight  # noqa: F401  they register theirs
from plinth.plans import queries as q
from plinth.plans.building import Building

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    def value(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_against_sql(spark, sf_dir, duck, name):
    df = q.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cur = duck.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert columns == sorted(names)
    assert plain([tuple(r[c] for c in columns) for r in df.collect()]) == plain([tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()])


def test_evacuation(spark, sf_dir, monkeypatch):
    """Distances by one search over all nodes, loads by walking each room's way; tiles of few rooms, so that there are several levels."""
    monkeypatch.setattr(evacuation, "TILE", 6.0)
    monkeypatch.setattr(evacuation, "FACTOR", 2)
    b = Building(spark, sf_dir)
    rooms, distances = q._evacuation(b)
    st = b.stairs().selectExpr("stair", "storey", "(x0 + x1) / 2 as x", "(y0 + y1) / 2 as y")
    landing = evacuation.landings(st, b.spaces(), b.storeys())
    portal = b.links().join(b.doors(), "door").selectExpr("concat('p:', door) as node", "space", "x", "y", "b is null as exit")
    nodes = portal.union(landing.selectExpr("concat('v:', stair, '@', storey)", "space", "x", "y", "false")).toPandas()
    place = {r.node: (r.x, r.y) for r in nodes.itertuples()}
    near = {}
    for _, g in nodes.groupby("space"):
        for a in g.node:
            for o in g.node:
                if a != o:
                    near.setdefault(a, {})[o] = math.dist(place[a], place[o])
    stops = {}
    for r in landing.collect():
        stops.setdefault(r.stair, []).append((r.elevation, f"v:{r.stair}@{r.storey}"))
    for s in stops.values():
        for (e, a), (f, o) in zip(sorted(s), sorted(s)[1:]):
            near.setdefault(a, {})[o] = near.setdefault(o, {})[a] = max(f - e, 1.0)
    best, heap = {}, [(0.0, n) for n in set(nodes[nodes.exit].node)]
    heapq.heapify(heap)
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for o, w in near.get(n, {}).items():
                heapq.heappush(heap, (d + w, o))
    got = {r.node: r for r in distances.collect()}
    assert {k: round(v, 6) for k, v in best.items()} == {k: round(r.distance, 6) for k, r in got.items()}
    load = {}
    for r in rooms.collect():
        n = r.node
        while n is not None:
            load[n] = load.get(n, 0) + r.weight
            n = got[n].parent if got[n].parent != n else None
    assert {k: round(v, 6) for k, v in load.items()} == {r.node: r.load for r in evacuation.loads(rooms, distances).collect()}


def test_hops_and_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "c"), ("d", None)], "a string, b string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.hops(edges, start).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "node string")
    assert {r.node: r.component for r in graph.components(nodes, edges.filter("b is not null")).collect()} == dict(a="a", b="a", c="a", x="x", y="x", z="z")


def test_hops_have_no_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(3, 20), (20, 5)], "a int, b int")
    found = graph.hops(edges, spark.createDataFrame([(0,)], "node int"))
    assert {tuple(r) for r in found.collect()} == {(i, i) for i in range(13)} | {(20, 4)}
    assert "most" not in inspect.signature(graph.hops).parameters and "Union" not in found._jdf.queryExecution().toString()
    assert graph.hops(edges, spark.createDataFrame([], "node int")).count() == 0
