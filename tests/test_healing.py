"""Healing of doors, fronts and stairs: every case is a storey of its own in one table, so a case costs no job."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators import healing as h


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


RING = "array<struct<x:double,y:double>>"
SPACES = f"space string, storey string, ring {RING}"
DOORS = "door string, storey string, x double, y double, nx double, ny double, x0 double, y0 double, x1 double, y1 double"

#: Case: rooms, door place, normal, existing links, rooms that the door gets.
DOOR_CASES = {
    "gap": ({"A": box(0, 0, 4, 4), "B": box(5, 0, 9, 4)}, (4.5, 2), None, "", "AB"),
    "inside near corridor": ({"A": box(0, 0, 4, 4), "B": box(4.3, 0, 8, 4)}, (3.9, 2), None, "", "AB"),
    "nearest pair": ({"A": box(-4, -1, 0, 1), "B": box(0, -1, 2, 1), "C": box(0.4, -1, 3, 1)}, (0, 0), None, "", "AB"),
    "same side": ({"A": box(0.2, -1, 2, 1), "B": box(0.5, -1, 3, 1)}, (0, 0), None, "", "A"),
    "inside both": ({"A": box(-2, -2, 2, 2), "B": box(-1, -1, 3, 3)}, (0, 0), None, "", "AB"),
    "two links": ({"A": box(-4, -1, 0, 1), "B": box(0, -1, 2, 1), "C": box(-1, 1.2, 1, 3)}, (0, 0), None, "AB", ""),
    "one link": ({"R": box(-4, -1, 0, 1), "G": box(0, -1, 2, 1), "U": box(0.5, -1, 3, 1)}, (0, 0), None, "R", "G"),
    "one link without outline": ({"G": box(0, -1, 2, 1)}, (0, 0), None, "R", ""),
    "corner": ({"A": box(0.3, -1, 2, 1), "B": box(-1, 0.25, 0.2, 2)}, (0, 0), None, "", "B"),
    "far": ({"A": box(1.1, -1, 2, 1)}, (0, 0), None, "", ""),
    "rays": ({"A": box(-4, -1, -0.05, 1), "B": box(0.05, -1, 4, 1), "C": box(-1, 1.2, 1, 3)}, (0, 0), (1, 0), "", "AB"),
    "long normal": ({"A": box(-4, -1, -0.05, 1), "B": box(0.05, -1, 4, 1)}, (0, 0), (-7, 0), "", "AB"),
    "no length": ({"A": box(-4, -1, -0.05, 1)}, (0, 0), (0, 0), "", ""),
    "rays from inside": ({"A": box(0, 0, 4, 4), "B": box(4.3, 0, 8, 4)}, (3.9, 2), (1, 0), "", "AB"),
    "rays to one side": ({"A": box(0.2, -1, 2, 1), "B": box(0.5, -1, 3, 1)}, (0, 0), (1, 0), "", "A"),
    "inflated box": ({"A": box(-4, -1, -0.05, 1), "F": box(2, -1, 4, 1)}, (0, 0), (1, 0), "", "A"),
    "rays, one link": ({"R": box(-4, -1, 0, 1), "G": box(0.05, -1, 2, 1), "U": box(0.5, -1, 3, 1)}, (0, 0), (1, 0), "R", "G"),
    "outer wall": ({"R": box(0, 0, 4, 4), "G": box(0, -4, 4, -0.2)}, (0.05, 2), (1, 0), "R", ""),
    "two around": ({"A": box(-2, -2, 2, 2), "B": box(-1, -1, 3, 3), "C": box(-9, -9, 9, 9)}, (0, 0), (1, 0), "", "AB"),
    "touching": ({"A": [(0.0, -1.0), (0.0, 1.0), (-2.0, 1.0), (-2.0, -1.0)]}, (0, 0), (1, 0), "", "A"),
    "slanted": ({"A": [(-3.0, 0.0), (0.0, -3.0), (-0.1, -0.1)], "B": [(0.1, 0.1), (3.0, 0.0), (0.0, 3.0)], "C": box(0.4, -2, 2, -0.4)}, (0, 0), (1, 1), "", "AB"),
    "both ways": ({"A": [(-2.0, -0.5), (-0.3, -0.5), (-0.3, 0.4), (0.3, 0.4), (0.3, -0.5), (2.0, -0.5), (2.0, 2.0), (-2.0, 2.0)], "B": box(-1.0, -0.4, -0.5, 0.4)}, (0, 0), (1, 0), "", "AB"),
}


def rows_of_doors(cases, storey=lambda k: k, door_storey=lambda k: k):
    spaces, doors, links = [], [], []
    for k, (rooms, (x, y), normal, had, _) in cases.items():
        spaces += [(f"{k}/{n}", storey(k), r) for n, r in rooms.items()]
        nx, ny = normal or (None, None)
        dx, dy = (0.06 * abs(nx) + 0.45 * abs(ny), 0.06 * abs(ny) + 0.45 * abs(nx)) if normal and math.hypot(*normal) == 1 else (0.05, 0.05)
        doors.append((k, door_storey(k), float(x), float(y), None if nx is None else float(nx), None if ny is None else float(ny), x - dx, y - dy, x + dx, y + dy))
        links += [(k, f"{k}/{n}") for n in had]
    return spaces, doors, links


def test_doors(spark):
    spaces, doors, links = rows_of_doors(DOOR_CASES)
    doors += [("nowhere", "gap", None, None, None, None, None, None, None, None), (None, "gap", 4.5, 2.0, None, None, 4.4, 1.9, 4.6, 2.1)]
    spaces += [("gap/broken", "gap", []), ("gap/none", "gap", None), ("gap/line", "gap", [(4.0, 0.0), (5.0, 4.0)])]
    links += [("gap", None), (None, "gap/A")]
    got = h.match_doors(spark.createDataFrame(doors, DOORS), spark.createDataFrame(spaces, SPACES), spark.createDataFrame(links, "door string, space string")).collect()
    found = {k: "" for k in DOOR_CASES}
    for r in sorted(got, key=lambda r: (str(r.door), r.space)):
        if r.door:
            found[r.door] += r.space.rpartition("/")[2]
    assert found == {k: "".join(sorted(c[4])) for k, c in DOOR_CASES.items()}
    phase = {(r.door, r.space.rpartition("/")[2]): r.phase for r in got}
    assert (phase["rays from inside", "A"], phase["rays from inside", "B"]) == ("host", "ray_plus")
    assert phase["rays", "B"] == "ray_plus" and phase["rays", "A"] == "ray_minus" and phase["rays, one link", "G"] == "partner_ray"
    assert phase["gap", "A"] == phase["gap", "B"] == "between" and phase["same side", "A"] == "nearest" and phase["one link", "G"] == "partner_between"


@pytest.mark.parametrize("bare", ["doors", "spaces"])
def test_rows_without_storey_meet_all(spark, bare):
    case = {"rays": DOOR_CASES["rays"]}
    spaces, doors, links = rows_of_doors(case, *((lambda k: "L1", lambda k: None) if bare == "doors" else (lambda k: None, lambda k: "L1")))
    got = h.match_doors(spark.createDataFrame(doors, DOORS), spark.createDataFrame(spaces, SPACES), spark.createDataFrame([], "door string, space string")).collect()
    assert sorted(r.space for r in got) == ["rays/A", "rays/B"]


def test_no_rows(spark):
    empty = lambda s: spark.createDataFrame([], s)
    assert h.match_doors(empty(DOORS), empty(SPACES), empty("door string, space string")).collect() == []


# --- stairs ---------------------------------------------------------------------------------

HULL = box(0, 0, 2, 2)
STAIRS = f"stair string, storey string, ring {RING}"


def stairs_of(spark, rooms, stairs, levels, links=()):
    storeys = spark.createDataFrame(levels, "storey string, elevation double")
    spaces = spark.createDataFrame(rooms, SPACES)
    had = spark.createDataFrame(list(links), "stair string, space string")
    return {(r.stair, r.storey): r.space for r in h.match_stairs(spark.createDataFrame(stairs, STAIRS), spaces, storeys, had, spaces).collect()}


def test_stairs(spark):
    levels = [("1", 0.0), ("2", 3.0), ("3", 6.0), ("4", 9.0), ("5", 12.0), ("?", None)]
    rooms = [("L1a", "1", HULL), ("L2a", "2", HULL), ("L3a", "3", HULL), ("L2far", "2", box(10, 10, 12, 12)), ("L4a", "4", HULL), ("L5a", "5", HULL), ("Q", "?", HULL), ("N", None, HULL)]
    stairs = [("s1", "1", HULL), ("s3", "3", HULL), ("top", "5", HULL), ("odd", "?", HULL), ("none", None, HULL), ("thin", "1", [(0.0, 0.0), (2.0, 0.0)]), ("had", "1", HULL)]
    want = {("s1", "1"): "L1a", ("s1", "2"): "L2a", ("s3", "3"): "L3a", ("s3", "4"): "L4a", ("top", "5"): "L5a", ("odd", "?"): "Q", ("had", "1"): "L1a"}
    assert stairs_of(spark, rooms, stairs, levels, [("had", "L2far")]) == want


def test_stair_ranks(spark):
    """The largest overlap, then the size nearest the stair's; each case is a storey of its own."""
    levels = [("a", 0.0), ("b", 10.0), ("c", 20.0)]
    rooms = [("A", "a", HULL), ("B", "a", box(0, 0, 2.5, 2)), ("C", "a", box(1.5, 0, 3, 2)), ("C2", "b", box(0, 0, 2, 1)), ("D", "b", box(-0.5, 0, 2.5, 1))]
    assert stairs_of(spark, rooms, [("s", "a", HULL), ("t", "b", HULL)], levels) == {("s", "a"): "A", ("s", "b"): "D", ("t", "b"): "D"}


def plain_overlap(a, b):
    """Cuts a by b's edges, one after another."""

    def area(r):
        return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1], strict=True))) / 2

    def cut(subject, clip):
        if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(clip, clip[1:] + clip[:1], strict=True)) < 0:
            clip = clip[::-1]
        for p, q in zip(clip, clip[1:] + clip[:1], strict=True):
            side = [(q[0] - p[0]) * (v[1] - p[1]) - (q[1] - p[1]) * (v[0] - p[0]) for v in subject]
            out = []
            for i, v in enumerate(subject):
                u, su, sv = subject[i - 1], side[i - 1], side[i]
                if (su >= -1e-4) != (sv >= -1e-4):
                    t = su / (su - sv)
                    out.append((u[0] + t * (v[0] - u[0]), u[1] + t * (v[1] - u[1])))
                if sv >= -1e-4:
                    out.append(v)
            subject = out
            if len(subject) < 3:
                return []
        return subject

    for x, y in ((a, b), (b, a)):
        if len(c := cut(x, y)) >= 3:
            return area(c)
    return 0.0


def test_overlaps_of_rotated_shapes(spark):
    rng = random.Random(3)

    def turned(n, ccw=True):
        cx, cy, r, start = rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(0.5, 3), rng.uniform(0, 6)
        ring = [(cx + r * math.cos(start + 2 * math.pi * k / n), cy + r * math.sin(start + 2 * math.pi * k / n)) for k in range(n)]
        return ring if ccw else ring[::-1]

    notch = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    pairs = [(turned(rng.randint(3, 7)), turned(rng.randint(3, 6), k % 2 == 0)) for k in range(60)] + [(notch, box(1, 1, 3, 3)), (HULL, notch), (HULL, box(9, 9, 10, 10)), (HULL, HULL)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], f"k int, a {RING}, b {RING}")
    got = {r.k: r.v for r in df.select("k", h.overlap(F.col("a"), F.col("b")).alias("v")).collect()}
    assert got == pytest.approx({k: plain_overlap(a, b) for k, (a, b) in enumerate(pairs)}, abs=1e-9)
    assert got[63] == pytest.approx(4.0) and got[62] == 0 and sum(v > 0 for v in got.values()) > 30
    assert spark.range(1).select(h.overlap(F.array().cast(RING), F.array().cast(RING))).first()[0] == 0


# --- whole graphs ------------------------------------------------------------------------------

A, B, C = box(0, 0, 4, 4), box(4.2, 0, 8.2, 4), box(20, 0, 24, 4)
SEALED, DOORWAY, SLOT = box(4, 0, 4.2, 4), box(3.98, 1.55, 4.22, 2.45), box(3.98, 1.875, 4.22, 2.125)
L_SHAPE = [(0.0, 0.0), (7.0, 0.0), (7.0, 7.0), (5.2, 7.0), (5.2, 1.8), (0.0, 1.8)]

#: Case: rooms, walls, openings (ring, host is wall, sill, head, its door), doors (x, y, storey or the case's), whether A and B are linked, and by which opening.
FRONT_CASES = {
    "open": ({"A": A, "B": B, "C": C}, [], [], [], True),
    "sealed": ({"A": A, "B": B}, [SEALED], [], [], False),
    "door of another storey": ({"A": A, "B": B}, [SEALED], [], [(4.1, 2.0, "elsewhere")], False),
    "partial": ({"A": A, "B": B}, [box(4, 0, 4.2, 1.2)], [(None, True, None, None, None)], [], True),
    "furniture void": ({"A": A, "B": B}, [SEALED], [(None, False, None, None, None)], [], False),
    "wall void": ({"A": A, "B": B}, [SEALED], [(None, True, None, None, None)], [], True),
    "filled void": ({"A": A, "B": B}, [SEALED], [(None, True, None, None, "D9")], [], True),
    "profile": ({"A": A, "B": B}, [SEALED], [(box(3, 0, 5.2, 4), True, None, None, None)], [], False),
    "doorway": ({"A": A, "B": B}, [SEALED], [(DOORWAY, True, 0.0, 2.1, None)], [], True),
    "low": ({"A": A, "B": B}, [SEALED], [(DOORWAY, True, 2.4, 3.0, None)], [], False),
    "slot": ({"A": A, "B": B}, [SEALED], [(SLOT, True, 0.0, 2.1, None)], [], False),
    "covered": ({"A": A, "B": B}, [box(3.95, -0.1, 4.25, 4.1)], [], [], False),
    "corner": ({"A": box(2, 2, 5, 5), "B": L_SHAPE}, [box(1.8, 1.8, 5.2, 2.05)], [], [], True),
    "door": ({"A": A, "B": B}, [], [], [(4.1, 2.0, None)], False),
}

NODES = "id string, kind string, global_id string, storey string"
EDGES = "id string, kind string, source string, target string, global_id string, method string, inferred boolean, x double, y double"
OPENINGS = f"opening string, ord int, storey string, x double, y double, ring {RING}, host_is_wall boolean, sill_z double, head_z double, door string, window string"


def model_of(spark, cases, *, stairs=(), more_rooms=(), levels=None, edges=(), no_node=()):
    spaces, walls, openings, doors = list(more_rooms), [], [], []
    for k, (rooms, rings, voids, ways, _) in cases.items():
        spaces += [(f"{k}/{n}", k, r, []) for n, r in rooms.items()]
        walls += [(k, r) for r in rings]
        openings += [(f"{k}/O{i}", i, k, 4.1, 2.0, ring, wall, sill, head, door, None) for i, (ring, wall, sill, head, door) in enumerate(voids)]
        doors += [(f"{k}/D{i}", storey or k, x, y, None, None, x - 0.05, y - 0.05, x + 0.05, y + 0.05) for i, (x, y, storey) in enumerate(ways)]
    nodes = [(f"space:{s[0]}", "space", s[0], s[1]) for s in spaces] + [(f"door:{d[0]}", "door", d[0], d[1]) for d in doors] + [(f"stair:{s[0]}", "stair", s[0], s[1]) for s in stairs]
    make = spark.createDataFrame
    return h.Model(
        make(levels or [(k, float(3 * i)) for i, k in enumerate(cases)], "storey string, elevation double"), make(spaces, f"{SPACES}, holes array<{RING}>"), make(doors, DOORS), make(list(stairs), STAIRS),
        make(walls, f"storey string, ring {RING}"), make(openings, OPENINGS), make([n for n in nodes if n[0] not in no_node], NODES), make(list(edges), EDGES),
    )


def test_whole_graph(spark):
    """All fronts in one graph, one edge a pair; doors come first; what the model links isn't healed again, whatever the direction; nodes that aren't there get nothing."""
    more = {"had": FRONT_CASES["open"], "half": FRONT_CASES["door"], "gone": FRONT_CASES["door"]}
    edges = [
        ("e1", "space_space", "space:had/B", "space:had/A", None, "given", False, None, None),
        ("e2", "space_door", "door:half/D0", "space:half/A", None, "ifc_rel_space_boundary", False, None, None),
        ("e3", "space_door", "space:gone/A", "door:gone/D0", None, "ifc_rel_space_boundary", False, None, None),
    ]
    got = h.healed(model_of(spark, FRONT_CASES | more, edges=edges, no_node=("door:gone/D0",))).collect()
    ids = {r.id: r for r in got}
    assert len(ids) == len(got)
    new = [r for r in got if r.kind == "space_space" and r.inferred]
    case = lambda r: r.source.split("/")[0].split(":")[1]
    assert sorted(map(case, new)) == sorted([k for k, c in FRONT_CASES.items() if c[4]] + ["gone"])
    by = {case(r): r for r in new}
    assert all(r.source < r.target and r.method == "geom_opening_space" for r in new)
    assert by["open"].id == "space_space:space:open/A:space:open/B:strip:geom" and by["open"].x == pytest.approx(4.1, abs=0.05) and 0.5 < by["open"].y < 3.5
    assert by["partial"].global_id == "partial/O0" and 1.5 < by["partial"].y < 3.5 and by["partial"].id == "space_space:space:partial/A:space:partial/B:opening:partial/O0:geom"
    assert by["doorway"].global_id == "doorway/O0" and by["filled void"].global_id is None
    doors = sorted(r.id for r in got if r.kind == "space_door")
    assert [d for d in doors if "door/D0" in d] == ["space_door:door/A:door/D0:geom", "space_door:door/B:door/D0:geom"]
    assert [d for d in doors if "half" in d] == ["space_door:half/B:half/D0:geom"] and {"e1", "e2", "e3"} <= set(ids)
    r = ids["space_door:half/B:half/D0:geom"]
    assert (r.kind, r.source, r.target, r.method, r.inferred) == ("space_door", "space:half/B", "door:half/D0", "geom_door_space", True)


def test_reheal(spark):
    """Rooms excluded: their storeys are healed anew without them and their links, others keep what they had; nothing excluded: the previous graph."""
    levels = [("L1", 0.0), ("L2", 3.0), ("L3", 6.0), ("L4", 60.0)]
    rooms = [("PARENT", "L1", box(0, 0, 40, 40), []), ("LOBBY", "L1", box(0, 0, 2.4, 2.4), []), ("UP", "L2", box(0, 0, 3, 3), [])]
    linked = [("e4", "space_door", "door:L4/D0", "space:L4/A", None, "ifc_rel_space_boundary", False, None, None)]
    twins = ({"A": A, "A2": A, "B": B}, [SEALED], [], [(4.1, 2.0, None)], False)
    model = model_of(spark, {"L3": FRONT_CASES["open"], "L4": twins}, stairs=[("S", "L1", box(0.5, 0.5, 2.5, 2.5))], more_rooms=rooms, levels=levels, edges=linked)
    before = h.kept(h.healed(model))
    of = lambda df, kind: sorted(r.source for r in df.collect() if r.kind == kind)
    assert of(before, "vertical") == ["space:PARENT", "space:UP"] and of(before, "space_door") == ["door:L4/D0", "space:L4/B"]
    marked = before.withColumn("x", F.when(F.col("kind") == "space_space", 77.0).otherwise(F.col("x")))  # shows whether an edge was kept
    after = h.kept(h.rehealed(model, marked, spark.createDataFrame([("space:PARENT",), ("space:L4/A",), (None,)], "id string")))
    assert of(after, "vertical") == ["space:LOBBY", "space:UP"] and of(after, "space_door") == ["door:L4/D0", "space:L4/A2", "space:L4/B"]
    assert [r.x for r in after.filter("kind = 'space_space' and source like 'space:L3%'").collect()] == [77.0]
    same = h.rehealed(model, marked, spark.createDataFrame([(None,)], "id string"))
    assert sorted(map(tuple, same.collect()), key=str) == sorted(map(tuple, marked.collect()), key=str)


def test_nested(spark):
    cases = {
        "plain": {"P": (box(0, 0, 20, 10), []), "A": (box(1, 1, 5, 5), []), "B": (box(12, 1, 18, 8), []), "O": (box(30, 0, 34, 4), [])},
        "flush": {"P": (box(0, 0, 20, 10), []), "F": (box(0, 0, 5, 5), [])},
        "walls": {"L": (box(0, 0, 5, 5), []), "R": (box(5, 0, 10, 5), [])},
        "hole": {"P": (box(0, 0, 20, 10), [box(6, 2, 14, 8)]), "C": (box(7, 3, 13, 7), [])},
        "twins": {"X": (box(0, 0, 5, 5), []), "Y": (box(0, 0, 5, 5), [])},
    }
    rows = [(f"{k}/{n}", k, ring, holes) for k, rooms in cases.items() for n, (ring, holes) in rooms.items()] + [("bare/P", None, box(0, 0, 9, 9), None), ("bare/C", None, box(1, 1, 2, 2), None)]
    spaces = spark.createDataFrame(rows, f"{SPACES}, holes array<{RING}>")
    assert sorted((r.parent, r.child) for r in h.nested(spaces).collect()) == [("bare/P", "bare/C"), ("flush/P", "flush/F"), ("plain/P", "plain/A"), ("plain/P", "plain/B")]
    nodes = spark.createDataFrame([(f"space:{r[0]}", "space") for r in rows], "id string, kind string")
    assert sorted(r.id for r in h.flagged(nodes, spaces).filter("nested_parent").collect()) == ["space:bare/P", "space:flush/P", "space:plain/P"]


def test_rays_meet_boundaries(spark):
    """A ray that starts on an edge meets it at once."""
    df = spark.createDataFrame([(box(0, 0, 1, 1),)], f"ring {RING}")
    t = lambda x, y: g.ray_enters(F.lit(x), F.lit(y), F.lit(1.0), F.lit(0.0), F.col("ring"))
    assert df.select(t(1.0, 0.5), t(-1.0, 0.5), t(2.0, 0.5), t(-1.0, 3.0)).first()[:] == (0.0, 1.0, None, None)
