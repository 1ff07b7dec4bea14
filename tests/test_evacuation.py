"""Evacuation on small buildings, all in one table far apart: exits near and far, blocked sets, towers, and sizes of tiles that don't matter."""

import pytest

from plinth.operators import evacuation


def box(x0, y0, x1, y1):
    return tuple(map(float, (x0, y0, x1, y1)))


LEVELS = [(f"S{k:02}", 3.0 * k) for k in range(30)]
TWO = {"A": ("S00", box(0, 0, 4, 4)), "U": ("S01", box(0, 0, 4, 4))}
STAIRS = [("ST", "S00", "A"), ("ST", "S01", "U")]
ROW = {"L": ("S00", box(0, 0, 2, 2)), "M": ("S00", box(2, 0, 6, 2)), "R": ("S00", box(6, 0, 16, 2)), "I": ("S00", box(50, 50, 52, 52))}
DOORS = {"EL": (0, 1, "L"), "ER": (16, 1, "R"), "DL": (2, 1, "LM"), "DR": (6, 1, "MR")}
LONG = {f"{k:02}": ("S00", box(4 * k, -40, 4 * k + 4, -36)) for k in range(40)}

#: Case: rooms {name: (storey, box)}, doors {name: (x, y, rooms)}, stairs (stair, storey, room), blocked portals, rooms and landings.
CASES = {
    "two": (TWO, {"E": (0, 2, "A")}, STAIRS, [], [], []),
    "landing": (TWO, {"E": (0, 2, "A")}, STAIRS, [], [], [("ST", "S01")]),
    "no exit": (TWO, {}, STAIRS, [], [], []),
    "row": (ROW, DOORS, [], [], [], []),
    "row, exit": (ROW, DOORS, [], ["EL"], [], []),
    "row, M": (ROW, DOORS, [], [], ["M"], []),
    "row, L": (ROW, DOORS, [], [], ["L"], []),
    "long": (LONG, {"E": (0, -38, ["00"])} | {f"D{k:02}": (4 * k, -38, [f"{k - 1:02}", f"{k:02}"]) for k in range(1, 40)}, [], [], [], []),
    "size": ({"S": ("S00", box(0, 0, 2, 2)), "B": ("S00", box(10, 0, 12, 50))}, {"ES": (0, 1, "S"), "EB": (10, 25, "B")}, [], [], [], []),
    "tower": ({s: (s, box(0, 0, 9, 9)) for s, _ in LEVELS}, {"E": (0, 4.5, ["S00"])}, [(f"T{t}", s, s) for t in range(3) for s, _ in LEVELS], [], [], [("T0", "S07")]),
}


@pytest.mark.parametrize("tile, factor", [(40.0, 4), (5.0, 3)])
def test_buildings(spark, monkeypatch, tile, factor):
    monkeypatch.setattr(evacuation, "TILE", tile)
    monkeypatch.setattr(evacuation, "FACTOR", factor)
    spaces, doors, links, landing, portals, shut, landings = ([] for _ in range(7))
    for k, (case, (rooms, ways, stairs, *blocked)) in enumerate(CASES.items()):
        name, dx = (lambda n, c=case: f"{c}:{n}"), 300.0 * k - 700
        spaces += [(name(n), s, x0 + dx, y0, x1 + dx, y1) for n, (s, (x0, y0, x1, y1)) in rooms.items()]
        doors += [(name(n), x + dx, float(y)) for n, (x, y, _) in ways.items()]
        links += [(name(n), name(r)) for n, (_, _, sides) in ways.items() for r in sides]
        landing += [(name(n), s, dict(LEVELS)[s], name(r), (rooms[r][1][0] + rooms[r][1][2]) / 2 + dx, (rooms[r][1][1] + rooms[r][1][3]) / 2) for n, s, r in stairs]
        portals += [(name(p),) for p in blocked[0]]
        shut += [(name(p),) for p in blocked[1]]
        landings += [(name(n), s) for n, s in blocked[2]]
    make = spark.createDataFrame
    s, d, l = make(spaces, "space string, storey string, x0 double, y0 double, x1 double, y1 double"), make(doors, "door string, x double, y double"), make(links, "door string, space string")
    at = make(landing, "stair string, storey string, elevation double, space string, x double, y double")
    blocked = {"blocked_portals": make(portals, "door string"), "blocked_spaces": make(shut, "space string"), "blocked_landings": make(landings, "stair string, storey string")}
    distances = evacuation.exit_distances(l, d, at, s, make(LEVELS, "storey string, elevation double"), **blocked)
    ways = evacuation.room_exits(s, l, d, at, distances, **blocked)
    far, load = {}, {}
    for r in ways.collect():
        far.setdefault(r.space.split(":")[0], {})[r.space.split(":")[1]] = r.distance
    for r in evacuation.loads(ways, distances).collect():
        kind, case, n = r.node.split(":")
        load.setdefault(case, {})[f"{kind}:{n}"] = r.load
    parent = {r.node: r.parent for r in distances.collect()}

    assert far["two"] == {"A": 2.0, "U": 5.0}  # the exit wins over the landing at the same place
    assert load["two"] == {"v:ST@S01": 1.6, "v:ST@S00": 1.6, "p:E": 3.2}
    assert [parent[n] for n in ("p:two:E", "v:two:ST@S00", "v:two:ST@S01")] == ["p:two:E", "p:two:E", "v:two:ST@S00"]
    assert far["landing"] == {"A": 2.0, "U": None} and load["landing"] == {"p:E": 1.6}
    assert far["no exit"] == {"A": None, "U": None} and "no exit" not in load
    assert far["row"] == {"L": 1.0, "M": 4.0, "R": 5.0, "I": None} and load["row"] == {"p:EL": 2.0, "p:DL": 1.0, "p:ER": 2.0}
    assert far["row, exit"]["L"] == 1 + 4 + 10 and load["row, exit"]["p:ER"] == 4.0 and "p:EL" not in load["row, exit"]
    assert far["row, M"] == {"L": 1.0, "R": 5.0, "I": None} and set(load["row, M"]) == {"p:EL", "p:ER"}  # a door with one open room is no exit
    assert far["row, L"] == {"M": 12.0, "R": 5.0, "I": None}
    assert load["long"]["p:E"] == 64.0 and far["long"] == {f"{k:02}": 4.0 * k + 2 for k in range(40)}
    assert far["size"] == {"S": 1.0, "B": 1.0} and load["size"]["p:EB"] > 5 * load["size"]["p:ES"]
    assert far["tower"] == pytest.approx({s: 4.5 + h for s, h in LEVELS}) and load["tower"]["p:E"] == pytest.approx(30 * 8.1)


def test_no_rows(spark):
    make = lambda s: spark.createDataFrame([], s)
    s, d, l = make("space string, storey string, x0 double, y0 double, x1 double, y1 double"), make("door string, x double, y double"), make("door string, space string")
    at = make("stair string, storey string, elevation double, space string, x double, y double")
    distances = evacuation.exit_distances(l, d, at, s, make("storey string, elevation double"))
    assert distances.collect() == evacuation.loads(evacuation.room_exits(s, l, d, at, distances), distances).collect() == []
