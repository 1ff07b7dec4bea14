"""Walks between points: one table of cases, with storeys, ties, blocked landings and places that repeat."""

import pytest

from plinth.functions import geometry as g
from plinth.operators import paths
from pyspark.sql import functions as F

LEVELS = {"S1": 0.0, "S2": 3.0}
ROOMS = {"A": ("S1", (0, 0, 4, 4)), "B": ("S1", (4, 0, 8, 4)), "C": ("S2", (0, 0, 8, 4)), "ISO": ("S1", (50, 50, 54, 54)), "R1": ("S1", (0, 20, 4, 24)), "R2": ("S1", (4, 20, 8, 24))}
DOORS = {"D": ("S1", 4, 2, "AB"), "E": ("S1", 0, 2, "A"), "T1": ("S1", 4, 21, ("R1", "R2")), "T2": ("S1", 4, 23, ("R1", "R2"))}
ASKED = {
    "near": ("S1", 1, 1, "S1", 3, 3), "next": ("S1", 1, 2, "S1", 7, 2), "up": ("S1", 7, 2, "S2", 3, 3), "down": ("S2", 3, 3, "S1", 7, 2), "nowhere": ("S1", 1, 1, "S1", 52, 52), "outside": ("S1", 1, 1, "S1", 99, 99),
    "tie": ("S1", 2, 22, "S1", 6, 22), "at the door": ("S1", 1, 2, "S1", 4, 2), "same place": ("S1", 1, 1, "S1", 1, 1),
}


@pytest.fixture(scope="module")
def walk(spark):
    make = spark.createDataFrame
    spaces = make([(k, s, *map(float, b)) for k, (s, b) in ROOMS.items()], "space string, storey string, x0 double, y0 double, x1 double, y1 double").withColumn("ring", g.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    doors = make([(k, s, float(x), float(y)) for k, (s, x, y, _) in DOORS.items()], "door string, storey string, x double, y double")
    links = make([(k, r) for k, v in DOORS.items() for r in v[3]], "door string, space string")
    landing = make([("ST", "S1", 0.0, "A", 2.0, 2.0), ("ST", "S2", 3.0, "C", 4.0, 2.0)], "stair string, storey string, elevation double, space string, x double, y double")
    asked = make([(k, *(float(v) if isinstance(v, int) else v for v in a)) for k, a in ASKED.items()], "query string, from_storey string, from_x double, from_y double, to_storey string, to_x double, to_y double")
    return lambda **blocked: paths.between(asked, spaces, links, doors, landing, **blocked)


def told(walk):
    out = {}
    for r in sorted(walk.collect(), key=lambda r: (r.query, r.step)):
        out.setdefault(r.query, (round(r.cost, 6), []))[1].append(r.node or (r.x, r.y))
    return out


def test_walks(walk):
    found = walk().cache()
    got = told(found)
    assert set(got) == set(ASKED) - {"nowhere", "outside"}
    assert got["near"] == (round(8**0.5, 6), [(1.0, 1.0), (3.0, 3.0)]) and got["same place"][0] == 0
    assert got["next"] == (6.0, [(1.0, 2.0), "p:D", (7.0, 2.0)])
    up = 3 + 2 + 3 + 2**0.5
    assert got["up"] == (round(up, 6), [(7.0, 2.0), "p:D", "v:ST@S1", "v:ST@S2", (3.0, 3.0)]) and got["down"] == (round(up, 6), got["up"][1][::-1])
    assert got["tie"][1][1] == "p:T1" and got["at the door"] == (3.0, [(1.0, 2.0), "p:D", (4.0, 2.0)])
    parts = {(r.query, r.segment): (r.storey, r.n, round(r.length, 6)) for r in paths.stretches(found).collect()}
    assert parts["up", 0] == ("S1", 3, 5.0) and parts["up", 1] == ("S2", 2, round(2**0.5, 6))
    assert parts["at the door", 0] == ("S1", 2, 3.0) and parts["same place", 0] == ("S1", 1, 0.0)


def test_blocked(spark, walk):
    shut = told(walk(blocked_landings=spark.createDataFrame([("ST", "S2")], "stair string, storey string"), blocked_portals=spark.createDataFrame([("T1",)], "door string")))
    assert "up" not in shut and "down" not in shut and shut["tie"][1][1] == "p:T2" and shut["next"][0] == 6.0


def test_long_corridor(spark, monkeypatch):
    """A walk through 90 rooms over several tiles, of equal ways at its end: written tables grow with tiles, not with doors (over 90 before)."""
    n, tables = 90, []
    monkeypatch.setattr(paths, "kept", lambda df, kept=paths.kept: tables.append(1) or kept(df))
    make = spark.createDataFrame
    spaces = make([(f"R{i:02}", "S1", i * 5.0, 0.0, i * 5.0 + 5, 4.0) for i in range(n)], "space string, storey string, x0 double, y0 double, x1 double, y1 double").withColumn("ring", g.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    doors = [(f"D{i:02}", "S1", i * 5.0, 2.0, i) for i in range(1, n)] + [("T1", "S1", (n - 1) * 5.0, 1.0, n - 1), ("T2", "S1", (n - 1) * 5.0, 3.0, n - 1)]
    links = make([(d, f"R{r:02}") for d, _, _, _, i in doors for r in (i - 1, i)], "door string, space string")
    landing = make([], "stair string, storey string, elevation double, space string, x double, y double")
    asked = make([("there", "S1", 1.0, 2.0, "S1", n * 5 - 1.0, 2.0), ("back", "S1", n * 5 - 1.0, 2.0, "S1", 1.0, 2.0), ("tile", "S1", 241.0, 2.0, "S1", 257.0, 2.0)], "query string, from_storey string, from_x double, from_y double, to_storey string, to_x double, to_y double")
    got = told(paths.between(asked, spaces, links, make([d[:4] for d in doors], "door string, storey string, x double, y double"), landing))
    way = [f"p:D{i:02}" for i in range(1, n)]
    assert got["there"] == (n * 5 - 2.0, [(1.0, 2.0), *way, (n * 5 - 1.0, 2.0)]) and got["back"] == (n * 5 - 2.0, [(n * 5 - 1.0, 2.0), *way[::-1], (1.0, 2.0)])
    assert got["tile"] == (16.0, [(241.0, 2.0), "p:D49", "p:D50", "p:D51", (257.0, 2.0)]) and len(tables) < 60
