"""Healing: links of doors, fronts and stairs that a model lacks, found by place.

A door gets two rooms at most, less those it has; candidates come from grid-cell joins,
phases are ranked in windows by door, and each link says which phase gave it.  The
phases of a whole graph (doors, fronts, stairs) are written tables, each of which the
next one is held against.

Spaces are (space, storey, ring) with complete outlines, doors (door, storey, x, y,
nx, ny, x0, y0, x1, y1) with the box of their outline, links (door, space).  A door or
space without storey meets those of every storey.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators import interfaces, spatial
from plinth.operators.graph import kept

# Fixed values, in metres, square metres or cosines.
INFLATE = 0.5  # around a door's box
RAY = 1.0  # along a door's normal
CLEARANCE = 1.0  # of a door without normal
OPPOSITE = -0.35  # of the ways to two rooms that a door lies between
OUTWARD = 0.25  # of the way to the other room and the wall's normal
SLACK = 0.2  # between contacts of a door outside both rooms
BESIDE = 0.45  # of the other room, for a door inside one
TOUCH = 1e-4  # distance that is none, overlap that is none
NESTED_SHARE, NESTED_AREA = 0.85, 0.98  # of a child's vertices, of the parent's area

#: A door's phases in order of precedence.
PHASES = ("host", "ray_plus", "ray_minus", "touch_plus", "touch_minus", "partner_ray", "between", "nearest", "partner_between")


def boxed(df: DataFrame) -> DataFrame:
    """With x0, y0, x1, y1 of the ring, for rings of three vertices or more."""
    box = df.filter(F.size("ring") >= 3).withColumn("__box", g.bbox(F.col("ring")))
    return box.select("*", *(F.col(f"__box.{m}_{c}").alias(f"{c}{i}") for i, m in enumerate(("min", "max")) for c in "xy")).drop("__box")


def met_on_storeys(left: DataFrame, right: DataFrame, *, pad: float = 0.0) -> DataFrame:
    """Pairs of boxes within `pad` (columns end in _l and _r) on one storey; rows without storey meet those of all.

    One join: a row stands under its storey and under a key for the other side's
    rows without one; a pair shares one key alone.
    """
    storey, named = F.col("storey"), F.col("storey").isNotNull()
    key = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"))
    none = F.lit(None).cast("string")
    own, bare, every = key("own", storey), key("bare", none), key("every", none)
    spread = lambda df, keys: df.withColumn("__key", F.explode(keys)).withColumns({"__kind": F.col("__key.kind"), "__at": F.coalesce("__key.at", F.lit(""))}).drop("__key", "storey")
    l = spread(left, F.when(named, F.array(own, bare)).otherwise(F.array(every)))
    r = spread(right, F.when(named, F.array(own, every)).otherwise(F.array(bare, every)))
    return spatial.boxes_to_boxes(l, r, on=["__kind", "__at"], pad=pad).drop("__kind", "__at")


# --- a door between two rooms ---------------------------------------------------------


def contact(x: Column, y: Column, ring: Column) -> Column:
    """struct<d, x, y, nx, ny>: distance (0 inside), closest point (itself inside), outward normal of the closest edge (null without length)."""
    sides = F.transform(g.ring_edges(ring), lambda e, i: F.struct(i.alias("i"), g.closest_on_segment(x, y, e).alias("p"), e.alias("e")))
    far = F.transform(sides, lambda s: F.struct(g.distance(x, y, s["p"]["x"], s["p"]["y"]).alias("d"), s["i"].alias("i"), s["p"].alias("p"), s["e"].alias("e")))
    turn = F.when(g.signed_area(ring) < 0, -1.0).otherwise(1.0)

    def told(near: Column) -> Column:
        dx, dy, inside = near["m"]["e"]["bx"] - near["m"]["e"]["ax"], near["m"]["e"]["by"] - near["m"]["e"]["ay"], near["inside"]
        normal = lambda v: F.when(F.hypot(dx, dy) >= 1e-12, near["turn"] * v / F.hypot(dx, dy))
        mine = lambda own, other: F.when(inside, own).otherwise(other)
        return F.struct(mine(F.lit(0.0), near["m"]["d"]).alias("d"), mine(x, near["m"]["p"]["x"]).alias("x"), mine(y, near["m"]["p"]["y"]).alias("y"), normal(dy).alias("nx"), normal(-dx).alias("ny"))

    return g.once(F.struct(F.array_min(far).alias("m"), g.point_in_ring(x, y, ring).alias("inside"), turn.alias("turn")), told)


def between(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Whether a place lies between two rooms, given its contacts with them.

    Inside both it does; inside one, the other must be close and through the wall
    beside it; outside both, the contacts must lie opposite each other.
    """
    in_a, in_b = a["d"] <= TOUCH, b["d"] <= TOUCH

    def through(host: Column, other: Column) -> Column:
        vx, vy = other["x"] - x, other["y"] - y
        size = F.hypot(vx, vy)
        ahead = (vx * host["nx"] + vy * host["ny"]) / size > OUTWARD
        return (other["d"] <= BESIDE) & host["nx"].isNotNull() & F.when(size < 1e-9, True).otherwise(ahead)

    ax, ay, bx, by = a["x"] - x, a["y"] - y, b["x"] - x, b["y"] - y
    size_a, size_b = F.hypot(ax, ay), F.hypot(bx, by)
    close = F.hypot(a["x"] - b["x"], a["y"] - b["y"]) <= a["d"] + b["d"] + SLACK
    facing = F.when((size_a < 1e-9) | (size_b < 1e-9), False).otherwise((ax * bx + ay * by) / (size_a * size_b) < OPPOSITE)
    return F.when(in_a & in_b, True).when(in_a, through(a, b)).when(in_b, through(b, a)).otherwise(close & facing)


def _ranked(votes: DataFrame, most: Column, by: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy("key", "space"))
    return votes.withColumn("__place", place).filter(F.col("__place") <= most).drop("__place")


def _by_rays(met: DataFrame) -> DataFrame:
    """(door, space, phase) of doors with a normal, from candidates with inside, area, plus, minus, n, own, own_inside."""
    beyond = lambda t: (t > 1e-6) & (t <= RAY + 1e-9)
    within = lambda t: t <= RAY + 1e-9
    plus, minus, none, one = F.col("plus"), F.col("minus"), F.col("n") == 0, F.col("n") == 1
    reach = lambda t: F.when(within(t) & ~(F.col("own_inside") & (t <= 1e-6)), t)
    partner = F.least(reach(plus), reach(minus))
    vote = lambda phase, key, when: F.struct(F.lit(phase).alias("phase"), F.round(key, 9).alias("key"), F.coalesce(when, F.lit(False)).alias("holds"))
    votes = F.array(
        vote(0, F.col("area"), none & F.col("inside")), vote(1, plus, none & beyond(plus)), vote(2, minus, none & beyond(minus)),
        vote(3, plus, none & within(plus)), vote(4, minus, none & within(minus)), vote(5, partner, one & (F.col("space") != F.col("own")) & partner.isNotNull()),
    )
    rows = met.repartition("door").select("door", "space", F.explode(F.filter(votes, lambda v: v["holds"])).alias("v")).select("door", "space", "v.phase", "v.key")
    first = _ranked(rows, F.when(F.col("phase").isin(0, 2, 4), 2).otherwise(1), ["door", "phase"])
    new = first.withColumn("__first", F.min("phase").over(Window.partitionBy("door", "space"))).filter("phase = __first")  # a room counts once
    new = _ranked(new, F.when(F.col("phase") == 0, 2).otherwise(1), ["door", "phase"])
    new = new.withColumn("__least", F.min("phase").over(Window.partitionBy("door"))).filter("phase < 3 or __least >= 3")
    order = F.row_number().over(Window.partitionBy("door").orderBy("phase", "key", "space"))
    return new.withColumn("__order", order).filter("__order <= 2").select("door", "space", "phase")


def _by_distance(met: DataFrame) -> DataFrame:
    """(door, space, phase) of doors without normal, from candidates with x, y, c (contact), n, own, own_c."""
    x, y = F.col("x"), F.col("y")
    near = met.filter(F.col("c.d") <= CLEARANCE)
    open_ = near.filter("n = 0").select("door", "space", "x", "y", "c", F.struct("c.d", "space").alias("key"))
    b = open_.select("door", *(F.col(c).alias(f"{c}_b") for c in ("space", "c", "key")))
    pairs = open_.join(b, "door").filter((F.col("key") < F.col("key_b")) & between(x, y, F.col("c"), F.col("c_b")))
    best = pairs.groupBy("door").agg(F.min(F.struct((F.col("key.d") + F.col("key_b.d")).alias("score"), "key", "key_b")).alias("m"))
    two = best.select("door", F.explode(F.array("m.key.space", "m.key_b.space")).alias("space"), F.lit(6).alias("phase"))
    rest = open_.groupBy("door").agg(F.min("key").alias("m")).join(best, "door", "left_anti").select("door", "m.space", F.lit(7).alias("phase"))
    one = near.filter("n = 1 and space <> own").filter(between(x, y, F.col("own_c"), F.col("c")))
    second = one.groupBy("door").agg(F.min(F.struct("c.d", "space")).alias("m")).select("door", "m.space", F.lit(8).alias("phase"))
    return two.union(rest).union(second)


def match_doors(doors: DataFrame, spaces: DataFrame, links: DataFrame) -> DataFrame:
    """(door, space, phase): new links of doors with fewer than two; phase is one of PHASES.

    Doors with a normal take the rooms around them (the smallest first), then the
    first beyond them on either side, and touching ones where there is none; others
    the nearest two that they lie between, or the nearest one.  A door with one room
    gets a second one in the same way; if that room has no outline, nothing.
    """
    rooms = boxed(spaces.select("space", "storey", "ring"))
    had = links.filter("door is not null and space is not null").groupBy("door").agg(F.count_distinct("space").alias("n"), F.min("space").alias("own"))
    outlines = rooms.select(F.col("space").alias("own"), F.col("ring").alias("own_ring"))
    open_ = doors.filter("x is not null and y is not null").join(had, "door", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < 2")
    open_ = open_.join(outlines, "own", "left").filter("n = 0 or own_ring is not null")
    size, aimed = F.hypot("nx", "ny"), F.col("nx").isNotNull() & F.col("ny").isNotNull()
    x, y, ring = F.col("x"), F.col("y"), F.col("ring")
    open_ = open_.withColumns({"aimed": aimed, "ux": F.col("nx") / F.when(size >= 1e-9, size), "uy": F.col("ny") / F.when(size >= 1e-9, size)}).filter("not aimed or ux is not null")
    reach = {f"{c}{i}": F.when(F.col("aimed"), F.col(f"{c}{i}") + side * INFLATE).otherwise(F.col(c) + side * CLEARANCE) for c in "xy" for i, side in ((0, -1), (1, 1))}
    own_in = F.coalesce(g.point_in_ring(x, y, F.col("own_ring")), F.lit(False))
    asked = open_.select("door", "storey", "x", "y", "ux", "uy", "aimed", "n", "own", own_in.alias("own_inside"), F.when(~F.col("aimed"), contact(x, y, F.col("own_ring"))).alias("own_c"), *(v.alias(k) for k, v in reach.items()))
    met = met_on_storeys(asked, rooms)
    own = ("door", "x", "y", "ux", "uy", "aimed", "n", "own", "own_inside", "own_c")
    met = kept(met.select(*(F.col(f"{c}_l").alias(c) for c in own), F.col("space_r").alias("space"), F.col("ring_r").alias("ring")))
    ray = lambda side: g.ray_enters(x, y, side * F.col("ux"), side * F.col("uy"), ring)
    rays = met.filter("aimed").select("door", "space", "n", "own", "own_inside", g.point_in_ring(x, y, ring).alias("inside"), g.area(ring).alias("area"), ray(1).alias("plus"), ray(-1).alias("minus"))
    measured = kept(met.filter("not aimed").select("door", "space", "x", "y", "n", "own", "own_c", contact(x, y, ring).alias("c")))
    found = _by_rays(rays).union(_by_distance(measured))
    names = F.array(*map(F.lit, PHASES))
    return found.select("door", "space", F.element_at(names, F.col("phase") + 1).alias("phase")).join(links.select("door", "space"), ["door", "space"], "left_anti")


# --- stairs --------------------------------------------------------------------------------


def clipped(subject: Column, clip: Column) -> Column:
    """The part of one ring within a convex one (either direction): half-planes cut one after another, in a fold over its edges."""
    turned = F.when(g.signed_area(clip) < 0, F.reverse(clip)).otherwise(clip)

    def cut(ring: Column, e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        inside = lambda p: dx * (p["y"] - e["ay"]) - dy * (p["x"] - e["ax"]) >= -TOUCH

        def crossing(p: Column, q: Column) -> Column:
            den = (p["x"] - q["x"]) * (e["ay"] - e["by"]) - (p["y"] - q["y"]) * (e["ax"] - e["bx"])
            t = ((p["x"] - e["ax"]) * (e["ay"] - e["by"]) - (p["y"] - e["ay"]) * (e["ax"] - e["bx"])) / F.when(F.abs(den) >= 1e-18, den)
            return g.point(F.coalesce(p["x"] + t * (q["x"] - p["x"]), q["x"]), F.coalesce(p["y"] + t * (q["y"] - p["y"]), q["y"]))

        def kept_points(p: Column, q: Column) -> Column:
            none = F.array().cast("array<struct<x:double,y:double>>")
            return F.when(inside(q) & ~inside(p), F.array(crossing(p, q), q)).when(inside(q), F.array(q)).when(inside(p), F.array(crossing(p, q))).otherwise(none)

        before = F.concat(F.slice(ring, F.size(ring), F.lit(1)), F.slice(ring, F.lit(1), F.size(ring) - 1))
        return F.when(F.size(ring) >= 3, F.flatten(F.zip_with(before, ring, kept_points))).otherwise(F.slice(ring, 1, 0))

    points = F.transform(subject, lambda p: g.point(p["x"], p["y"]))
    return F.when((F.size(subject) >= 3) & (F.size(clip) >= 3), F.aggregate(g.ring_edges(turned), points, cut)).otherwise(F.slice(points, 1, 0))


def overlap(a: Column, b: Column) -> Column:
    """Area that two rings share if b, or else a, is convex."""
    sized = lambda ring: F.when(F.size(ring) >= 3, g.area(ring))
    return F.coalesce(g.once(clipped(a, b), sized), g.once(clipped(b, a), sized), F.lit(0.0))


def stair_storeys(stairs: DataFrame, storeys: DataFrame) -> DataFrame:
    """Stairs on their own storey and the next higher one; only their own where its elevation is unknown, none without storey."""
    after = Window.orderBy("elevation", "storey")  # a building's storeys
    following = storeys.filter("storey is not null and elevation is not null").select("storey", F.lead("storey").over(after).alias("__next"))
    on = stairs.filter("storey is not null").join(F.broadcast(following), "storey", "left")
    both = F.filter(F.array("storey", "__next"), lambda s: s.isNotNull())
    return on.withColumn("__on", F.explode(both)).drop("storey", "__next").withColumnRenamed("__on", "storey")


def stair_overlaps(stairs: DataFrame, spaces: DataFrame) -> DataFrame:
    """(stair, storey, space, area, ratio, place): rooms that a stair's hull overlaps on a storey, the largest overlap first.

    Equal overlaps (nine digits): the room whose size is nearer the stair's, then
    the smaller name.
    """
    met = spatial.boxes_to_boxes(boxed(stairs.select("stair", "storey", "ring")), boxed(spaces.filter("storey is not null").select("space", "storey", "ring")), on=["storey"])
    own, room = g.area(F.col("ring_l")), g.area(F.col("ring_r"))
    ratio = F.when(room > TOUCH, F.abs(own / F.when(room > 0, room) - 1)).otherwise(F.lit(float("inf")))
    sized = met.filter(own > TOUCH).select(F.col("stair_l").alias("stair"), "storey", F.col("space_r").alias("space"), overlap(F.col("ring_l"), F.col("ring_r")).alias("area"), ratio.alias("ratio"))
    order = Window.partitionBy("stair", "storey").orderBy(F.round("area", 9).desc(), F.round("ratio", 9), "space")
    return sized.filter(F.col("area") > TOUCH).withColumn("place", F.row_number().over(order))


def match_stairs(stairs: DataFrame, spaces: DataFrame, storeys: DataFrame, links: DataFrame, space_storeys: DataFrame) -> DataFrame:
    """(stair, storey, space, area, ratio): one room a stair and storey, where links (stair, space) have none.

    space_storeys: (space, storey) of all rooms, with or without outline.
    """
    on = stair_storeys(stairs, storeys)
    had = links.join(space_storeys.select("space", "storey"), "space").select("stair", "storey").distinct()
    open_ = on.join(had, ["stair", "storey"], "left_anti")
    return stair_overlaps(open_, spaces).filter("place = 1").drop("place")


# --- fronts -----------------------------------------------------------------------------------


def on_every_storey(df: DataFrame, storeys: DataFrame) -> DataFrame:
    """Rows without storey on each storey (storey)."""
    bare = df.filter("storey is null").drop("storey").crossJoin(F.broadcast(storeys.select("storey").distinct()))
    return df.filter("storey is not null").unionByName(bare)


def near_rooms(places: DataFrame, spaces: DataFrame, reach: Column) -> DataFrame:
    """(void, space): places (void, storey, x, y) and the rooms of their storey within `reach` of them."""
    x, y = F.col("x"), F.col("y")
    box = places.withColumn("__far", reach).withColumns({"x0": x - F.col("__far"), "y0": y - F.col("__far"), "x1": x + F.col("__far"), "y1": y + F.col("__far")})
    met = spatial.boxes_to_boxes(box.select("void", "storey", "x", "y", "__far", "x0", "y0", "x1", "y1"), boxed(spaces.select("space", "storey", "ring")), on=["storey"])
    return met.filter(g.polygon_distance(F.col("x_l"), F.col("y_l"), F.col("ring_r")) <= F.col("__far_l")).select(F.col("void_l").alias("void"), F.col("space_r").alias("space"))


def match_fronts(spaces: DataFrame, walls: DataFrame, openings: DataFrame, doors: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, storey, opening, span, x, y): rooms of one storey, a before b, that someone can pass between through their common front.

    Neither linked yet (pairs (a, b) in either order) nor by a door of both.  Walls
    (storey, ring) close the front; openings (opening, ord, storey, x, y, ring,
    host_is_wall, sill_z, head_z, door, window) and doors near both rooms carve it
    open.  opening: the first unfilled one between the two, if any.
    """
    rooms = spaces.filter("storey is not null").select("space", "storey", "ring")
    storeys = kept(rooms.select("storey").distinct())
    box = boxed(rooms)
    met = spatial.boxes_to_boxes(box, box, on=["storey"], pad=interfaces.GAP).filter("space_l < space_r")
    met = met.select(F.col("space_l").alias("a"), F.col("space_r").alias("b"), "storey", F.col("ring_l").alias("ring_a"), F.col("ring_r").alias("ring_b"))
    side = links.select("door", "space").distinct()
    shared = side.select("door", F.col("space").alias("a")).join(side.select("door", F.col("space").alias("b")), "door").filter("a < b").select("a", "b")
    linked = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(shared).distinct()
    met = kept(met.join(linked, ["a", "b"], "left_anti"))
    fronts = kept(met.join(interfaces.interface_lengths(met).select("a", "b"), ["a", "b"], "left_semi"))

    carving = interfaces.walkable_voids(openings).select(F.concat(F.lit("o:"), "opening").alias("void"), "storey", "x", "y", "ring")
    ways = doors.filter("x is not null and y is not null").select(F.concat(F.lit("d:"), "door").alias("void"), "storey", "x", "y", F.lit(None).cast("array<struct<x:double,y:double>>").alias("ring"))
    voids = kept(on_every_storey(carving.unionByName(ways), storeys))
    corner = F.array_max(F.transform("ring", lambda p: g.distance(p["x"], p["y"], F.col("x"), F.col("y"))))
    reach = interfaces.GAP + F.when(F.size("ring") >= 3, corner + interfaces.SLACK).otherwise(F.lit(interfaces.CARVE))
    near = kept(near_rooms(voids, rooms, reach))
    samples = interfaces.blocked_samples(kept(interfaces.strip_samples(fronts)), on_every_storey(walls.select("storey", "ring"), storeys), voids, near)
    ways_through = kept(interfaces.strip_portals(samples).join(fronts, ["a", "b"]))

    free = on_every_storey(openings.filter("x is not null and y is not null and door is null and window is null").select(F.col("opening").alias("void"), "ord", "storey", "x", "y"), storeys)
    beside = near_rooms(free, rooms, F.lit(interfaces.CARVE + 0.3))
    first, second = (beside.select("void", F.col("space").alias(c)) for c in "ab")
    both = first.join(second, "void").filter("a < b").join(free.select("void", "ord", "storey", F.col("x").alias("ox"), F.col("y").alias("oy")), "void")
    on_front = both.join(ways_through.select("a", "b", "storey", "ring_a", "ring_b"), ["a", "b", "storey"])
    ox, oy = F.col("ox"), F.col("oy")
    lies = on_front.filter(between(ox, oy, contact(ox, oy, F.col("ring_a")), contact(ox, oy, F.col("ring_b"))))
    named = lies.groupBy("a", "b").agg(F.min(F.struct("ord", "void"))["void"].alias("opening"))
    return ways_through.join(named, ["a", "b"], "left").select("a", "b", "storey", "opening", "span", "x", "y")


# --- nested rooms --------------------------------------------------------------------------------


def nested(spaces: DataFrame) -> DataFrame:
    """(child, parent): rooms (space, storey, ring, holes) within a larger one of their storey, or both without one; not within its holes."""
    rooms = boxed(spaces.select("space", F.coalesce("storey", F.lit("")).alias("storey"), "ring", "holes")).withColumn("area", g.area(F.col("ring")))
    middle = rooms.withColumn("__c", g.centroid(F.col("ring"))).select("space", "storey", "ring", "area", F.col("__c.x").alias("cx"), F.col("__c.y").alias("cy"), "x0", "y0", "x1", "y1")
    met = spatial.boxes_to_boxes(middle, rooms, on=["storey"]).filter("space_l <> space_r")
    met = met.filter((F.col("area_r") > TOUCH) & (F.col("area_l") < F.col("area_r") * NESTED_AREA))
    inside = lambda x, y: g.point_in_space(x, y, F.col("ring_r"), F.col("holes_r"))
    share = F.size(F.filter(g.inset(F.col("ring_l")), lambda p: inside(p["x"], p["y"]))) / F.size("ring_l")
    return met.filter((share >= NESTED_SHARE) & inside(F.col("cx_l"), F.col("cy_l"))).select(F.col("space_l").alias("child"), F.col("space_r").alias("parent"))


# --- the whole graph --------------------------------------------------------------------------------

_EDGE = ["id", "kind", "source", "target", "global_id", "method", "inferred", "x", "y"]


@dataclass(frozen=True)
class Model:
    """A building's footprints and its graph as the model has it.

    nodes: (id, kind, global_id, storey); edges: (id, kind, source, target, global_id,
    method, inferred, x, y) with ids of nodes like door:D and the portal's place.
    """

    storeys: DataFrame
    spaces: DataFrame
    doors: DataFrame
    stairs: DataFrame
    walls: DataFrame
    openings: DataFrame
    nodes: DataFrame
    edges: DataFrame


def _linked(edges: DataFrame, kind: str, what: tuple[str, ...]) -> DataFrame:
    """(thing, space) by the ends of edges of a kind; either end may be the room."""
    one = edges.filter(F.col("kind") == kind).select("source", "target")
    both = one.union(one.select("target", "source"))
    is_thing = F.substring_index("source", ":", 1).isin(*what) & F.col("target").startswith("space:")
    return both.filter(is_thing).select(F.expr("substring(source, instr(source, ':') + 1)").alias("thing"), F.expr("substring(target, 7)").alias("space")).distinct()


def _inferred(rows: DataFrame, id_: Column, kind: str, source: Column, target: Column, method: str, *, global_id: Column | None = None, x: Column | None = None, y: Column | None = None) -> DataFrame:
    null = F.lit(None)
    return rows.select(
        id_.alias("id"), F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"), (null.cast("string") if global_id is None else global_id).alias("global_id"), F.lit(method).alias("method"),
        F.lit(True).alias("inferred"), *((null.cast("double") if v is None else v).alias(n) for n, v in (("x", x), ("y", y))),
    )


def healed(model: Model, *, excluded: DataFrame | None = None, storeys: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """Edges of the model and those that healing adds: doors, then fronts, then stairs, each seeing the links before it.

    excluded: nodes (id) that are no candidates and whose links don't count.
    storeys: (storey) to heal; edges inferred on others are taken from `previous`
    (without it, all are healed).
    """
    nodes, edges = model.nodes, kept(model.edges.select(*_EDGE))
    gone = (excluded if excluded is not None else nodes.limit(0)).select("id").filter("id is not null").distinct()
    only = storeys.select("storey").distinct() if storeys is not None and previous is not None else None
    if only is not None:
        touched = nodes.filter("kind in ('space', 'door')").join(only, "storey", "left_semi").select("id")
        before = previous.filter("inferred").join(edges.select("id"), "id", "left_anti")
        for end in ("source", "target"):
            before = before.join(touched.select(F.col("id").alias(end)), end, "left_anti")
        edges = kept(edges.unionByName(before.select(*_EDGE)))

    def usable(df: DataFrame, kind: str, name: str) -> DataFrame:
        """Rows whose node is in the graph and isn't excluded."""
        ids = nodes.filter(F.col("kind") == kind).select("id").join(gone, "id", "left_anti").select(F.expr(f"substring(id, {len(kind) + 2})").alias(name))
        return df.join(ids, name, "left_semi")

    def here(df: DataFrame) -> DataFrame:
        return df if only is None else df.join(only, "storey", "left_semi")

    counted = edges
    for end in ("source", "target"):
        counted = counted.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    counted = kept(counted)
    spaces = kept(usable(model.spaces, "space", "space"))
    doors = usable(model.doors, "door", "door")

    links = _linked(counted, "space_door", ("door",)).withColumnRenamed("thing", "door")
    of_doors = kept(match_doors(here(doors), spaces, links))
    new_doors = _inferred(of_doors, F.concat_ws(":", F.lit("space_door"), "space", "door", F.lit("geom")), "space_door", F.concat(F.lit("space:"), "space"), F.concat(F.lit("door:"), "door"), "geom_door_space")

    side = counted.filter("kind = 'space_space' and source like 'space:%' and target like 'space:%'")
    pairs = side.select(F.expr("substring(source, 7)").alias("a"), F.expr("substring(target, 7)").alias("b"))
    of_fronts = match_fronts(here(spaces), model.walls, model.openings, model.doors, links.unionByName(of_doors.select("door", "space")), pairs)
    a, b = F.concat(F.lit("space:"), "a"), F.concat(F.lit("space:"), "b")
    id_ = F.concat_ws(":", F.lit("space_space"), a, b, F.when(F.col("opening").isNull(), "strip").otherwise(F.concat(F.lit("opening:"), "opening")), F.lit("geom"))
    new_fronts = kept(_inferred(of_fronts, id_, "space_space", a, b, "geom_opening_space", global_id=F.col("opening"), x=F.col("x"), y=F.col("y")))

    stair_links = _linked(counted, "vertical", ("stair", "lift")).withColumnRenamed("thing", "stair")
    every = nodes.filter("kind = 'space'").select(F.expr("substring(id, 7)").alias("space"), "storey")
    on = here(stair_storeys(usable(model.stairs, "stair", "stair"), model.storeys))
    had = stair_links.join(every, "space").select("stair", "storey").distinct()
    best = stair_overlaps(on.join(had, ["stair", "storey"], "left_anti"), spaces).filter("place = 1")
    new_stairs = _inferred(best, F.concat_ws(":", F.lit("vertical"), "stair", "space", F.lit("geom")), "vertical", F.concat(F.lit("space:"), "space"), F.concat(F.lit("stair:"), "stair"), "geom_stair_space")
    added = new_doors.unionByName(new_fronts).unionByName(new_stairs).join(edges.select("id"), "id", "left_anti")
    return edges.unionByName(added)


def flagged(nodes: DataFrame, spaces: DataFrame) -> DataFrame:
    """Nodes with nested_parent: rooms that hold a smaller one."""
    parents = nested(spaces).select(F.concat(F.lit("space:"), "parent").alias("id")).distinct().withColumn("__parent", F.lit(True))
    return nodes.join(parents, "id", "left").withColumn("nested_parent", F.coalesce("__parent", F.lit(False))).drop("__parent")


def rehealed(model: Model, previous: DataFrame, excluded: DataFrame) -> DataFrame:
    """The previous edges where nothing is excluded, else healed anew on the storeys of the excluded nodes."""
    gone = kept(excluded.select("id").filter("id is not null").distinct())
    if gone.isEmpty():
        return previous
    touched = kept(model.nodes.join(gone, "id", "left_semi").filter("storey is not null").select("storey").distinct())
    return healed(model, excluded=gone, storeys=None if touched.isEmpty() else touched, previous=previous)


def without(model: Model, excluded: DataFrame) -> Model:
    """The model without the excluded nodes."""
    return replace(model, nodes=model.nodes.join(excluded.select("id"), "id", "left_anti"))
