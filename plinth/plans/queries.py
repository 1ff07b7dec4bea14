"""Registered queries on the derived building, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators import evacuation, graph, spatial
from plinth.plans.building import SQL, Building

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Building under its name; `sql` goes on from the building's expressions."""

    def register(f: Callable[[Building], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Building(spark, sf_dir))
        if sql:
            head = "WITH RECURSIVE " if sql.startswith("WITH RECURSIVE ") else "WITH "
            more = ", " + sql.removeprefix(head) if sql.startswith(head) else sql
            ORACLE_SQL[f.__name__] = SQL.replace("WITH ", head, 1) + more
        return f

    return register


r6 = lambda c: F.round(c, 6)

# --- projections and predicates -------------------------------------------------

#: Words that mark an exit, in order of precedence.
EXIT_WORDS = ("exit", "evac", "fire escape", "emergency")


@query("""SELECT space AS global_id, trim(coalesce(nullif(name, ''), space)) AS name, storey, 'space' AS kind FROM spaces
UNION ALL SELECT stair, trim(name), storey, 'stair' FROM stairs UNION ALL SELECT item, trim(name), storey, 'furniture' FROM furniture
UNION ALL SELECT door, door, storey, 'door' FROM doors""")
def entity_projection(b: Building) -> DataFrame:
    """Entities of all classes as (global_id, name, storey, kind); names fall back to the id."""
    s = b.spaces().select(F.col("space").alias("global_id"), F.trim(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("space"))).alias("name"), "storey", F.lit("space").alias("kind"))
    st = b.stairs().select("stair", F.trim("name"), "storey", F.lit("stair"))
    f = b.furniture().select("item", F.trim("name"), "storey", F.lit("furniture"))
    return s.union(st).union(f).union(b.doors().select("door", "door", "storey", F.lit("door")))


@query("""WITH n AS (SELECT c_custkey, lower(c_name || CASE c_custkey % 7 WHEN 0 THEN ' Exit' WHEN 1 THEN ' evac point' WHEN 2 THEN ' FIRE ESCAPE' WHEN 3 THEN ' Emergency exit' ELSE '' END || ' ' || c_mktsegment) AS hay FROM customer)
SELECT c_custkey, 'name/object_type matched ''' || CASE WHEN hay LIKE '%exit%' THEN 'exit' WHEN hay LIKE '%evac%' THEN 'evac' WHEN hay LIKE '%fire escape%' THEN 'fire escape' ELSE 'emergency' END || '''' AS reason
FROM n WHERE hay LIKE '%exit%' OR hay LIKE '%evac%' OR hay LIKE '%fire escape%' OR hay LIKE '%emergency%'""")
def exit_candidates(b: Building) -> DataFrame:
    """Names that mark an exit, with the first word that does."""
    suffix = F.element_at(F.create_map(*(F.lit(x) for kv in enumerate((" Exit", " evac point", " FIRE ESCAPE", " Emergency exit")) for x in kv)), (F.col("c_custkey") % 7).cast("int"))
    hay = F.lower(F.concat("c_name", F.coalesce(suffix, F.lit("")), F.lit(" "), "c_mktsegment"))
    word = F.coalesce(*(F.when(hay.contains(w), w) for w in EXIT_WORDS))
    return b.table("customer").select("c_custkey", word.alias("word")).filter("word is not null").select("c_custkey", F.concat(F.lit("name/object_type matched '"), "word", F.lit("'")).alias("reason"))


@query("""SELECT p_partkey, CASE WHEN p_type LIKE '%ECONOMY%' OR p_type LIKE '%PROMO%' THEN 'Lift' ELSE p_type END AS name FROM part""")
def lift_class(b: Building) -> DataFrame:
    """Default name of transport elements by their type."""
    t = F.col("p_type")
    return b.table("part").select("p_partkey", F.when(t.contains("ECONOMY") | t.contains("PROMO"), "Lift").otherwise(t).alias("name"))


@query("""SELECT item, storey FROM furniture JOIN storeys USING (storey) WHERE z_min <= elevation + 2.10e0 AND z_max >= elevation + 0.15e0""")
def walk_band(b: Building) -> DataFrame:
    """Furniture in the way of people on its storey; unknown heights stay."""
    s = b.storeys().select("storey", "elevation")
    inside = F.coalesce((F.col("z_min") <= F.col("elevation") + 2.10) & (F.col("z_max") >= F.col("elevation") + 0.15), F.lit(True))
    return b.furniture().join(F.broadcast(s), "storey").filter(inside).select("item", "storey")  # a row for each region


@query("""SELECT item, round(w * d, 6) AS area FROM furniture WHERE w * d >= 0.05e0""")
def tiny_drop(b: Building) -> DataFrame:
    """Furniture of at least 0.05 square metres."""
    return b.furniture().withColumn("area", F.col("w") * F.col("d")).filter("area >= 0.05").select("item", r6("area").alias("area"))


@query("""SELECT item, round(least(w, d), 6) AS thickness, least(w, d) <= 0.8e0 AND z_max - z_min >= 0.4e0 AS walkable FROM furniture""")
def void_walkable(b: Building) -> DataFrame:
    """Measured openings that can be walked: thin enough by their calipers, and high enough."""
    f = b.furniture().withColumn("ring", g.box_ring(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("d")))
    thin = g.calipers(F.col("ring"))["least"]
    return f.select("item", r6(thin).alias("thickness"), ((r6(thin) <= 0.8) & (F.col("z_max") - F.col("z_min") >= 0.4)).alias("walkable"))


# --- rings ------------------------------------------------------------------------

@query("SELECT space, round((x1 - x0) * (y1 - y0), 6) AS area, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(2 * (x1 - x0) + 2 * (y1 - y0), 6) AS perimeter FROM spaces")
def ring_measures(b: Building) -> DataFrame:
    """Area, centroid and perimeter of every room's ring."""
    ring = F.col("ring")
    c = g.centroid(ring)
    return b.spaces().select("space", r6(g.area(ring)).alias("area"), r6(c["x"]).alias("cx"), r6(c["y"]).alias("cy"), r6(g.perimeter(ring)).alias("perimeter"))


@query("SELECT storey, round(min(x0), 6) AS min_x, round(min(y0), 6) AS min_y, round(max(x1), 6) AS max_x, round(max(y1), 6) AS max_y FROM spaces GROUP BY storey")
def ring_bbox(b: Building) -> DataFrame:
    """Bounding box of each storey."""
    s = b.spaces().withColumn("box", g.bbox(F.col("ring")))
    return s.groupBy("storey").agg(r6(F.min("box.min_x")).alias("min_x"), r6(F.min("box.min_y")).alias("min_y"), r6(F.max("box.max_x")).alias("max_x"), r6(F.max("box.max_y")).alias("max_y"))


@query("""WITH e AS (SELECT space, unnest([1, 2, 3, 4]) AS i, unnest([x1 - x0, y1 - y0, x1 - x0, y1 - y0]) AS size FROM spaces)
SELECT space, i, round(sum(size) OVER (PARTITION BY space ORDER BY i), 6) AS arc FROM e""")
def perimeter_arc(b: Building) -> DataFrame:
    """Running length along every room's edges."""
    e = b.spaces().select("space", F.posexplode(g.ring_edges(F.col("ring"))).alias("i", "e"))
    size = g.distance(F.col("e.ax"), F.col("e.ay"), F.col("e.bx"), F.col("e.by"))
    w = Window.partitionBy("space").orderBy("i")
    return e.select("space", (F.col("i") + 1).cast("bigint").alias("i"), r6(F.sum(size).over(w)).alias("arc"))


@query("""SELECT space, round(greatest((x1 - x0) * (y1 - y0) - (CASE WHEN s % 5 = 0 THEN 1e0 ELSE 0e0 END), 0e0), 6) AS area,
round(greatest(greatest((x1 - x0) * (y1 - y0) - (CASE WHEN s % 5 = 0 THEN 1e0 ELSE 0e0 END), 0e0) / 10, 1e0), 6) AS weight FROM spaces""")
def occupant_weight(b: Building) -> DataFrame:
    """Area less holes (every fifth room has a shaft of one square metre), and its occupants."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    s = b.spaces().withColumn("holes", F.when(F.col("s") % 5 == 0, F.array(g.box_ring(cx - 0.5, cy - 0.5, cx + 0.5, cy + 0.5))).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>")))
    net = F.greatest(g.area(F.col("ring")) - F.aggregate(F.transform("holes", g.area), F.lit(0.0), lambda a, v: a + v), F.lit(0.0))
    return s.select("space", r6(net).alias("area"), r6(evacuation.occupants(net)).alias("weight"))


# --- places -------------------------------------------------------------------------

@query("""WITH n AS (SELECT pin, z, storey, row_number() OVER (PARTITION BY pin ORDER BY abs(elevation - z), elevation, storey) AS k FROM pins, storeys) SELECT pin, storey FROM n WHERE k = 1""")
def nearest_storey(b: Building) -> DataFrame:
    """Storey of the nearest elevation."""
    return spatial.nearest_storey(b.pins(), b.storeys()).select("pin", "storey")


@query("""WITH bands AS (SELECT storey, elevation, coalesce(lead(elevation) OVER (ORDER BY elevation, storey) - 0.35e0, elevation + 3.5e0) AS until FROM storeys),
inside AS (SELECT pin, storey FROM pins JOIN bands ON z >= elevation - 0.35e0 AND z < until),
near AS (SELECT pin, storey, abs(elevation - z) AS d, row_number() OVER (PARTITION BY pin ORDER BY abs(elevation - z), elevation, storey) AS k FROM pins, storeys)
SELECT pin, coalesce(i.storey, CASE WHEN d <= 0.6e0 * 3.5e0 THEN n.storey END) AS storey FROM near n LEFT JOIN inside i USING (pin) WHERE k = 1""")
def storey_band(b: Building) -> DataFrame:
    """Storey whose band of heights holds the pin."""
    return spatial.storey_band(b.pins(), b.storeys()).select("pin", "storey")


@query("""WITH z AS (SELECT DISTINCT floor(c_acctbal / 10e0) AS z FROM customer), s AS (SELECT z, CASE WHEN z - lag(z) OVER (ORDER BY z) > 1.5e0 THEN 1 ELSE 0 END AS step FROM z),
c AS (SELECT z, sum(step) OVER (ORDER BY z) AS cluster FROM s) SELECT CAST(cluster AS BIGINT) AS cluster, min(z) * 1e0 AS low, count(*) AS n FROM c GROUP BY cluster""")
def storey_gap_clusters(b: Building) -> DataFrame:
    """Clusters of heights (balances in tens) that steps of over 1.5 divide."""
    z = b.table("customer").select(F.floor(F.col("c_acctbal") / 10.0).cast("double").alias("z"))
    return spatial.gap_clusters(z, "z").select(F.col("cluster").cast("bigint").alias("cluster"), "low", "n")


@query("""SELECT pin, max(storey) AS storey FROM (SELECT pin, first_value(storey) OVER (PARTITION BY pin ORDER BY elevation DESC) AS storey FROM pins JOIN storeys ON elevation <= z + 1e-6) GROUP BY pin""")
def storey_asof(b: Building) -> DataFrame:
    """The last storey at or below the pin."""
    every = b.storeys().agg(F.array_sort(F.collect_list(F.struct("elevation", "storey"))).alias("all"))
    below = F.filter("all", lambda s: s["elevation"] <= F.col("z") + 1e-6)
    return b.pins().crossJoin(F.broadcast(every)).select("pin", F.element_at(below, -1)["storey"].alias("storey")).filter("storey is not null")


@query("""WITH p AS (SELECT pin, x, y, 'L' || CAST(CAST(floor(z / 3e0) AS BIGINT) AS VARCHAR) AS storey FROM pins)
SELECT pin, storey, min(space) AS space FROM p JOIN spaces USING (storey) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY pin, storey""")
def region_at_point(b: Building) -> DataFrame:
    """The room that holds each pin."""
    p = b.pins().withColumn("storey", F.concat(F.lit("L"), F.floor(F.col("z") / 3.0)))
    return spatial.rooms_at(p, b.spaces()).select("pin", "storey", "space")


@query("""WITH p AS (SELECT pin, x, y, 'L' || CAST(CAST(floor(z / 3e0) AS BIGINT) AS VARCHAR) AS storey FROM pins),
m AS (SELECT pin, door, row_number() OVER (PARTITION BY pin ORDER BY round(sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y)), 9), door DESC) AS k, round(sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y)), 6) AS distance
      FROM p JOIN doors d USING (storey) WHERE round(sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y)), 9) <= 1.5e0)
SELECT pin, door, distance FROM m WHERE k = 1""")
def nearest_portal(b: Building) -> DataFrame:
    """The nearest door within 1.5 metres of each pin; the last name wins ties."""
    p = b.pins().withColumn("storey", F.concat(F.lit("L"), F.floor(F.col("z") / 3.0)))
    d = b.doors().select("door", "storey", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    met = spatial.points_to_boxes(p, d, on=["storey"], pad=1.5, size=4.0).withColumn("d", F.round(g.distance(F.col("x"), F.col("y"), F.col("x0"), F.col("y0")), 9)).filter("d <= 1.5")
    best = met.groupBy("pin").agg(F.max(F.struct((-F.col("d")).alias("d"), F.col("door").alias("door"))).alias("m"))
    return best.select("pin", "m.door", r6(-F.col("m.d")).alias("distance"))


# --- joins of healing -----------------------------------------------------------------

@query("""WITH w AS (SELECT stair, n, unnest([storey, 'L' || CAST(CAST(substr(storey, 2) AS INT) + 1 AS VARCHAR)]) AS storey, x0, y0, x1, y1 FROM stairs),
o AS (SELECT w.stair, w.storey, s.space, (least(w.x1, s.x1) - greatest(w.x0, s.x0)) * (least(w.y1, s.y1) - greatest(w.y0, s.y0)) AS area
      FROM w JOIN spaces s USING (storey) WHERE least(w.x1, s.x1) > greatest(w.x0, s.x0) AND least(w.y1, s.y1) > greatest(w.y0, s.y0))
SELECT stair, storey, space, round(area, 6) AS area, row_number() OVER (PARTITION BY stair, storey ORDER BY round(area, 9) DESC, space) AS rank FROM o WHERE area > 1e-4""")
def stair_overlap_rank(b: Building) -> DataFrame:
    """Rooms that a stair's box overlaps on its own storey and the next, by overlap."""
    st = b.stairs()
    above = st.withColumn("storey", F.concat(F.lit("L"), F.substring("storey", 2, 9).cast("int") + 1))
    met = spatial.boxes_to_boxes(st.union(above).drop("name", "n"), b.spaces().select("space", "storey", "x0", "y0", "x1", "y1"), on=["storey"])
    area = (F.least("x1_l", "x1_r") - F.greatest("x0_l", "x0_r")) * (F.least("y1_l", "y1_r") - F.greatest("y0_l", "y0_r"))
    w = Window.partitionBy("stair", "storey").orderBy(F.round("area", 9).desc(), "space")
    return met.select(F.col("stair_l").alias("stair"), "storey", F.col("space_r").alias("space"), area.alias("area")).filter("area > 1e-4").select("stair", "storey", "space", r6("area").alias("area"), F.row_number().over(w).cast("bigint").alias("rank"))


@query("SELECT storey, lead(storey) OVER (ORDER BY elevation) AS next_storey, lead(elevation) OVER (ORDER BY elevation) - elevation AS rise FROM storeys")
def next_storey(b: Building) -> DataFrame:
    """The next higher storey."""
    w = Window.orderBy("elevation")  # a row for each region
    return b.storeys().select("storey", F.lead("storey").over(w).alias("next_storey"), (F.lead("elevation").over(w) - F.col("elevation")).alias("rise"))


@query("""SELECT door, space FROM doors d JOIN spaces s ON s.storey = d.storey AND d.x - 0.5e0 <= s.x1 AND d.x + 0.5e0 >= s.x0 AND d.y - 0.5e0 <= s.y1 AND d.y + 0.5e0 >= s.y0""")
def door_inflate_join(b: Building) -> DataFrame:
    """Doors, inflated by half a metre, and the rooms they meet."""
    d = b.doors().select("door", "storey", "x", "y")
    return spatial.points_to_boxes(d, b.spaces().select("space", "storey", "x0", "y0", "x1", "y1"), on=["storey"], pad=0.5).select("door", "space")


@query("""WITH h AS (SELECT door, space, CASE WHEN nx = 1 THEN (CASE WHEN x < x0 THEN x0 - x WHEN x > x1 THEN x - x1 ELSE 0 END) ELSE (CASE WHEN y < y0 THEN y0 - y WHEN y > y1 THEN y - y1 ELSE 0 END) END AS t,
   CASE WHEN nx = 1 THEN (CASE WHEN x < x0 THEN 1 ELSE -1 END) ELSE (CASE WHEN y < y0 THEN 1 ELSE -1 END) END AS side
 FROM doors JOIN spaces USING (storey) WHERE (nx = 1 AND y > y0 AND y < y1 AND NOT (x >= x0 AND x < x1)) OR (ny = 1 AND x > x0 AND x < x1 AND NOT (y >= y0 AND y < y1)))
SELECT door, side, arg_min(space, (round(t, 9), space)) AS space, round(min(t), 6) AS t FROM h WHERE t > 1e-6 AND t <= 1.0 GROUP BY door, side""")
def door_ray_pick(b: Building) -> DataFrame:
    """The first room that a door's normal meets on either side within a metre."""
    d = b.doors().select("door", "storey", "x", "y", "nx", "ny").withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    met = spatial.points_to_boxes(d, b.spaces().select("space", "storey", "ring", "x0", "y0", "x1", "y1"), on=["storey"], pad=1.0)
    t = g.ray_enters(F.col("x"), F.col("y"), F.col("nx") * F.col("side"), F.col("ny") * F.col("side"), F.col("ring"))
    hits = met.withColumn("t", t).filter("t > 1e-6 and t <= 1.0")
    return hits.groupBy("door", "side").agg(F.min(F.struct(F.round("t", 9).alias("t"), F.col("space").alias("space"))).alias("m")).select("door", "side", "m.space", r6("m.t").alias("t"))


@query("""SELECT a.space AS a, b.space AS b FROM spaces a JOIN spaces b ON a.storey = b.storey AND a.s < b.s AND a.x0 - 0.45e0 <= b.x1 AND b.x0 <= a.x1 + 0.45e0 AND a.y0 - 0.45e0 <= b.y1 AND b.y0 <= a.y1 + 0.45e0
WHERE NOT EXISTS (SELECT 1 FROM doors d WHERE least(d.a, d.b) = least(a.space, b.space) AND greatest(d.a, d.b) = greatest(a.space, b.space))""")
def space_pairs_bbox(b: Building) -> DataFrame:
    """Neighbouring rooms (boxes within 0.45 metres) that no door links."""
    s = b.spaces().select("space", "s", "storey", "x0", "y0", "x1", "y1")
    met = spatial.boxes_to_boxes(s, s, on=["storey"], pad=0.45).filter("s_l < s_r").select(F.col("space_l").alias("a"), F.col("space_r").alias("b"))
    linked = graph.display_edges(b.doors()).select("source", "target").distinct()
    return met.join(linked, (F.least(met.a, met.b) == linked.source) & (F.greatest(met.a, met.b) == linked.target), "left_anti")


@query("""WITH p AS (SELECT a.space AS a, b.space AS b, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS side, b.x0 - a.x1 AS gap FROM spaces a JOIN spaces b ON a.storey = b.storey AND a.row = b.row AND b.col = a.col + 1)
SELECT a, b, round(side, 6) AS length, round(gap, 6) AS gap FROM p WHERE gap <= 0.45e0 AND side >= 0.5e0""")
def interface_length(b: Building) -> DataFrame:
    """Length and gap of the common front of rooms side by side."""
    s = b.spaces().select("space", "col", "row", "storey", "x0", "y0", "x1", "y1")
    met = spatial.boxes_to_boxes(s, s, on=["storey"], pad=0.45).filter("row_l = row_r and col_r = col_l + 1")
    side, gap = F.least("y1_l", "y1_r") - F.greatest("y0_l", "y0_r"), F.col("x0_r") - F.col("x1_l")
    return met.filter((gap <= 0.45) & (side >= 0.5)).select(F.col("space_l").alias("a"), F.col("space_r").alias("b"), r6(side).alias("length"), r6(gap).alias("gap"))


@query("""WITH f AS (SELECT item, storey, x + w / 2 AS cx, y + d / 2 AS cy FROM furniture) SELECT item, space FROM f JOIN spaces USING (storey) WHERE cx >= x0 AND cx < x1 AND cy >= y0 AND cy < y1""")
def furniture_in_room(b: Building) -> DataFrame:
    """The room that holds the middle of each piece of furniture."""
    f = b.furniture().select(F.col("item").alias("pin"), "storey", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("d") / 2).alias("y"))
    return spatial.rooms_at(f, b.spaces()).select(F.col("pin").alias("item"), "space")


@query("""WITH r AS (SELECT l_partkey AS element, l_orderkey, l_linenumber, l_suppkey FROM lineitem) SELECT element, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS host, arg_max(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS filler, count(*) AS n FROM r GROUP BY element""")
def host_first_filler_last(b: Building) -> DataFrame:
    """Of an element's relations in order, the first names its host, the last its filler."""
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey")
    return b.table("lineitem").groupBy(F.col("l_partkey").alias("element")).agg(F.min_by("l_suppkey", order).alias("host"), F.max_by("l_suppkey", order).alias("filler"), F.count(F.lit(1)).alias("n"))


@query("""SELECT 'rel_' || l.door || '_' || l.space AS edge, 'space:' || l.space AS source, 'door:' || l.door AS target, 'ifc_rel_space_boundary' AS method FROM links l""")
def boundary_join(b: Building) -> DataFrame:
    """Edges between rooms and the doors on their boundaries; both ends exist."""
    l = b.links().join(b.spaces().select("space"), "space", "left_semi").join(b.doors().select("door"), "door", "left_semi")
    return l.select(F.concat(F.lit("rel_"), "door", F.lit("_"), "space").alias("edge"), F.concat(F.lit("space:"), "space").alias("source"), F.concat(F.lit("door:"), "door").alias("target"), F.lit("ifc_rel_space_boundary").alias("method"))


# --- graphs -----------------------------------------------------------------------------

@query("SELECT 'viz-door:' || door || ':' || least(a, b) || ':' || greatest(a, b) AS edge, door, least(a, b) AS source, greatest(a, b) AS target FROM doors WHERE b IS NOT NULL")
def display_graph(b: Building) -> DataFrame:
    """Doors as edges between rooms."""
    return graph.display_edges(b.doors())


@query("SELECT door, count(DISTINCT space) AS n_spaces, CASE WHEN count(DISTINCT space) = 1 THEN 'exit' ELSE 'door' END AS kind FROM links GROUP BY door")
def navmesh_portals(b: Building) -> DataFrame:
    """Portals and whether they lead outside."""
    return graph.portals(b.links())


@query("""WITH pt AS (SELECT door, space, x, y FROM links JOIN doors USING (door))
SELECT p.door AS source, q.door AS target, min(space) AS space, round(min(sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))), 6) AS cost FROM pt p JOIN pt q USING (space) WHERE p.door <> q.door GROUP BY p.door, q.door""")
def portal_edges(b: Building) -> DataFrame:
    """Walks between portals of one room."""
    return graph.portal_steps(b.links(), b.doors()).withColumn("cost", r6("cost"))


@query("SELECT stair, storey, lead(storey) OVER (PARTITION BY stair ORDER BY storey) AS next_storey, greatest(3e0, 1e0) AS cost FROM (SELECT stair, unnest([storey, 'L' || CAST(CAST(substr(storey, 2) AS INT) + 1 AS VARCHAR)]) AS storey FROM stairs) QUALIFY next_storey IS NOT NULL")
def vertical_chain(b: Building) -> DataFrame:
    """A stair's landings, each with the next."""
    s = b.stairs().select("stair", "storey")
    both = s.union(s.withColumn("storey", F.concat(F.lit("L"), F.substring("storey", 2, 9).cast("int") + 1)))
    w = Window.partitionBy("stair").orderBy("storey")
    return both.select("stair", "storey", F.lead("storey").over(w).alias("next_storey"), F.lit(3.0).alias("cost")).filter("next_storey is not null")


@query("""WITH ex AS (SELECT DISTINCT least(a, b) AS source, greatest(a, b) AS target FROM doors JOIN events ON event_type = 'error' AND door = 'D' || (event_id % 97) || '_' || (event_id % 97 + 1) WHERE b IS NOT NULL)
SELECT DISTINCT door FROM doors JOIN ex ON least(a, b) = source AND greatest(a, b) = target""")
def exclusion_expand(b: Building) -> DataFrame:
    """All doors between pairs of rooms of which one door is excluded."""
    k = F.col("event_id") % 97
    named = b.table("events").filter("event_type = 'error'").select(F.concat(F.lit("D"), k, F.lit("_"), k + 1).alias("door")).distinct()
    return graph.excluded_edges(graph.display_edges(b.doors()).join(named, "door", "left_semi"), b.doors())


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id FROM events WHERE value > 250) (SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_symdiff(b: Building) -> DataFrame:
    """Ids in one of two exclusion sets but not both."""
    e = b.table("events")
    return graph.symmetric_difference(e.filter("event_type = 'error'").select("user_id").distinct(), e.filter("value > 250").select("user_id").distinct())


@query("""WITH t AS (SELECT DISTINCT storey FROM stairs WHERE n % 4 = 0) SELECT door, storey, 'kept' AS origin FROM doors WHERE storey NOT IN (SELECT storey FROM t) UNION ALL SELECT door, storey, 'new' FROM doors WHERE storey IN (SELECT storey FROM t) AND door NOT LIKE 'V%'""")
def incremental_merge(b: Building) -> DataFrame:
    """Edges of untouched storeys kept, those of touched ones built anew (without doors between rows)."""
    d = b.doors().select("door", "storey")
    touched = b.stairs().filter("n % 4 = 0").select("storey").distinct()
    return graph.merged(d.withColumn("origin", F.lit("kept")), d.filter("door not like 'V%'").withColumn("origin", F.lit("new")), touched, "storey")


@query("""WITH RECURSIVE u AS (SELECT a, b FROM doors WHERE b IS NOT NULL UNION SELECT b, a FROM doors WHERE b IS NOT NULL),
w(node, hops) USING KEY (node) AS (SELECT DISTINCT a, 0::BIGINT FROM doors WHERE b IS NULL UNION SELECT u.b, min(w.hops + 1) FROM w JOIN u ON u.a = w.node LEFT JOIN recurring.w r ON r.node = u.b WHERE r.hops IS NULL OR w.hops + 1 < r.hops GROUP BY u.b)
SELECT node, hops FROM w""")
def hop_distance(b: Building) -> DataFrame:
    """Doors to pass from each room to an exit."""
    d = b.doors()
    return graph.hops(d, d.filter("b is null").select(F.col("a").alias("node")))


@query("""WITH RECURSIVE u AS (SELECT a, b FROM doors WHERE b IS NOT NULL UNION SELECT b, a FROM doors WHERE b IS NOT NULL),
w AS (SELECT space AS node, space AS root FROM spaces UNION SELECT u.b, w.root FROM w JOIN u ON u.a = w.node)
SELECT node, min(root) AS component FROM w GROUP BY node""")
def room_components(b: Building) -> DataFrame:
    """Rooms that doors connect."""
    return graph.components(b.spaces().select(F.col("space").alias("node")), b.doors().filter("b is not null"))


def _evacuation(b: Building, blocked: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rooms with their ways, and distances of portals and landings."""
    spaces, doors = graph.kept(b.spaces()), graph.kept(b.doors())  # each is read several times
    links = graph.kept(doors.select("door", F.col("a").alias("space")).union(doors.filter("b is not null").select("door", "b")))
    st = b.stairs().select("stair", "storey", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    landing = graph.kept(evacuation.landings(st, spaces, b.storeys()))
    distances = evacuation.exit_distances(links, doors, landing, spaces, b.storeys(), **(blocked or {}))
    return evacuation.room_exits(spaces, links, doors, landing, distances, **(blocked or {})), distances


#: Nodes, steps, distances, parents and rooms' ways in SQL, without blocked portals bp, rooms br and landings bl.
_OPEN = "bp AS (SELECT NULL::VARCHAR AS door WHERE false), br AS (SELECT NULL::VARCHAR AS space WHERE false), bl AS (SELECT NULL::VARCHAR AS node WHERE false)"
_EVACUATION = """WITH RECURSIVE {blocked}, pn AS (SELECT door, count(DISTINCT space) AS n FROM links GROUP BY door),
lk AS (SELECT * FROM links WHERE door NOT IN (SELECT door FROM bp) AND space NOT IN (SELECT space FROM br)),
lv AS (SELECT storey, elevation, row_number() OVER (ORDER BY elevation, storey) AS k FROM storeys),
l0 AS (SELECT s.stair, t.storey, t.elevation, min(r.space) AS space FROM (SELECT *, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM stairs) s JOIN lv o ON o.storey = s.storey JOIN lv t ON t.k IN (o.k, o.k + 1)
       JOIN spaces r ON r.storey = t.storey AND s.x BETWEEN r.x0 AND r.x1 AND s.y BETWEEN r.y0 AND r.y1 GROUP BY s.stair, t.storey, t.elevation),
ls AS (SELECT * FROM l0 WHERE space NOT IN (SELECT space FROM br) AND stair || '@' || storey NOT IN (SELECT node FROM bl)),
nd AS (SELECT 'p:' || l.door AS node, l.space, d.x, d.y, n = 1 AS is_exit FROM lk l JOIN doors d USING (door) JOIN pn ON pn.door = l.door
       UNION ALL SELECT 'v:' || stair || '@' || ls.storey, ls.space, (x0 + x1) / 2, (y0 + y1) / 2, false FROM ls JOIN spaces USING (space)),
ed AS (SELECT a.node AS f, b.node AS t, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS cost FROM nd a JOIN nd b ON a.space = b.space AND a.node <> b.node
       UNION ALL SELECT 'v:' || a.stair || '@' || a.storey, 'v:' || b.stair || '@' || b.storey, greatest(abs(a.elevation - b.elevation), 1e0) FROM ls a JOIN ls b ON a.stair = b.stair AND a.elevation <> b.elevation),
di(node, d) USING KEY (node) AS (SELECT DISTINCT node, 0e0 FROM nd WHERE is_exit
       UNION SELECT ed.t, min(round(di.d + ed.cost, 9)) FROM di JOIN ed ON ed.f = di.node LEFT JOIN recurring.di r ON r.node = ed.t WHERE r.d IS NULL OR round(di.d + ed.cost, 9) < r.d GROUP BY ed.t),
ex AS (SELECT DISTINCT node FROM nd WHERE is_exit),
sp AS (SELECT ed.t AS node, ed.f, ed.cost, a.d AS near, b.d FROM ed JOIN di a ON a.node = ed.f JOIN di b ON b.node = ed.t WHERE a.d + ed.cost <= b.d + 1e-7 AND ed.t NOT IN (SELECT node FROM ex)),
pr AS (SELECT node, min(f) AS parent FROM sp WHERE near < d - 1e-7 GROUP BY node),
tr AS (SELECT * FROM pr UNION ALL SELECT node, min(f) FROM sp WHERE cost <= 1e-7 AND node NOT IN (SELECT node FROM pr) AND f IN (SELECT node FROM pr UNION SELECT node FROM ex) GROUP BY node),
rt AS (SELECT node, node AS root FROM ex UNION ALL SELECT tr.node, rt.root FROM tr JOIN rt ON rt.node = tr.parent),
rm AS (SELECT space, storey, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my, greatest((x1 - x0) * (y1 - y0) / 10, 1e0) AS weight FROM spaces WHERE space NOT IN (SELECT space FROM br)),
wy AS (SELECT DISTINCT rm.space, nd.node, round(sqrt((nd.x - mx) * (nd.x - mx) + (nd.y - my) * (nd.y - my)) + di.d, 9) AS total FROM rm JOIN nd USING (space) JOIN di ON di.node = nd.node),
bs AS (SELECT space, node, total FROM (SELECT *, row_number() OVER (PARTITION BY space ORDER BY round(total, 7), node) AS k FROM wy) WHERE k = 1),
ld AS (SELECT bs.node, rm.weight FROM bs JOIN rm USING (space) UNION ALL SELECT tr.parent, ld.weight FROM ld JOIN tr ON tr.node = ld.node),
sm AS (SELECT node, round(sum(weight), 6) AS load FROM ld GROUP BY node)
"""
_ALL_OPEN = _EVACUATION.format(blocked=_OPEN)


def _ways(rooms: DataFrame, distances: DataFrame) -> DataFrame:
    led = rooms.join(evacuation.exit_of(distances), "node", "left")
    return led.select("space", "storey", r6("weight").alias("weight"), "node", r6("distance").alias("distance"), "exit")


@query(_ALL_OPEN + "SELECT rm.space, rm.storey, round(weight, 6) AS weight, bs.node, round(bs.total, 6) AS distance, rt.root AS exit FROM rm LEFT JOIN bs USING (space) LEFT JOIN rt ON rt.node = bs.node")
def evac_rooms(b: Building) -> DataFrame:
    """Each room's way to the nearest exit of the building; null where there is none."""
    return _ways(*_evacuation(b))


@query(_ALL_OPEN + "SELECT node, load FROM sm")
def evac_load(b: Building) -> DataFrame:
    """Occupants that pass each portal and landing."""
    return evacuation.loads(*_evacuation(b))


@query(_ALL_OPEN + "SELECT node, load FROM sm ORDER BY load DESC, node LIMIT 8")
def top_bottlenecks(b: Building) -> DataFrame:
    """The eight portals and landings of the largest loads."""
    return evacuation.bottlenecks(evacuation.loads(*_evacuation(b)))


def _blocked(b: Building) -> dict[str, DataFrame]:
    """Some exits, doors between rooms and rooms by their keys, every seventh stair's upper landing."""
    k = F.substring("a", 2, 18).cast("bigint")
    portals = b.doors().filter(F.when(F.col("b").isNull(), k % 3 == 1).otherwise(k % 29 == 3)).select("door")
    upper = b.stairs().filter("n % 7 = 0").select("stair", F.concat(F.lit("L"), F.substring("storey", 2, 9).cast("int") + 1).alias("storey"))
    return {"blocked_portals": graph.kept(portals), "blocked_spaces": graph.kept(b.spaces().filter("s % 13 = 5").select("space")), "blocked_landings": graph.kept(upper)}


_SOME_BLOCKED = _EVACUATION.format(blocked="""bp AS (SELECT door FROM doors WHERE CASE WHEN b IS NULL THEN CAST(substr(a, 2) AS BIGINT) % 3 = 1 ELSE CAST(substr(a, 2) AS BIGINT) % 29 = 3 END), br AS (SELECT space FROM spaces WHERE s % 13 = 5),
bl AS (SELECT stair || '@L' || (CAST(substr(storey, 2) AS INT) + 1) AS node FROM stairs WHERE n % 7 = 0)""")


@query(_SOME_BLOCKED + """SELECT rm.space, rm.storey, round(weight, 6) AS weight, bs.node, round(bs.total, 6) AS distance, rt.root AS exit, CASE WHEN bs.node IS NULL THEN 'unreachable' ELSE 'reached' END AS class FROM rm LEFT JOIN bs USING (space) LEFT JOIN rt ON rt.node = bs.node
UNION ALL SELECT space, storey, NULL, NULL, NULL, NULL, 'blocked' FROM spaces JOIN br USING (space)""")
def evac_blocked(b: Building) -> DataFrame:
    """The ways out while some exits, doors, rooms and landings are blocked; rooms by class."""
    blocked = _blocked(b)
    ways = _ways(*_evacuation(b, blocked)).withColumn("class", F.when(F.col("node").isNull(), "unreachable").otherwise("reached"))
    shut = b.spaces().join(blocked["blocked_spaces"], "space", "left_semi").select("space", "storey", F.lit("blocked").alias("class"))
    return ways.unionByName(shut, allowMissingColumns=True)


@query(_SOME_BLOCKED + "SELECT node, load FROM sm")
def evac_blocked_load(b: Building) -> DataFrame:
    """Occupants that pass each portal and landing while some are blocked."""
    return evacuation.loads(*_evacuation(b, _blocked(b)))


# --- catalogue, heat ----------------------------------------------------------------------

@query("""WITH c AS (SELECT 'region' AS section, space AS id, name AS title, storey FROM spaces UNION ALL SELECT CASE WHEN b IS NULL THEN 'exit' ELSE 'ifc_door' END, door, door, storey FROM doors UNION ALL SELECT 'stair', stair, name, storey FROM stairs)
SELECT * FROM c WHERE lower(concat_ws(' ', title, id, storey)) LIKE '%1%'""")
def catalog_search(b: Building) -> DataFrame:
    """Entities whose names, ids or storeys contain the text searched for."""
    c = b.spaces().select(F.lit("region").alias("section"), F.col("space").alias("id"), F.col("name").alias("title"), "storey")
    c = c.union(b.doors().select(F.when(F.col("b").isNull(), "exit").otherwise("ifc_door"), "door", "door", "storey")).union(b.stairs().select(F.lit("stair"), "stair", "name", "storey"))
    return c.filter(F.lower(F.concat_ws(" ", "title", "id", "storey")).contains("1"))


@query("""WITH n AS (SELECT a AS space, b AS other FROM doors WHERE b IS NOT NULL UNION ALL SELECT b, a FROM doors WHERE b IS NOT NULL)
SELECT n.space, count(DISTINCT s.name) AS n_neighbours, string_agg(DISTINCT s.name, '|' ORDER BY s.name) AS neighbours FROM n JOIN spaces s ON s.space = n.other GROUP BY n.space""")
def connections(b: Building) -> DataFrame:
    """Names of the rooms next to each room."""
    e = graph.display_edges(b.doors())
    n = e.select(F.col("source").alias("space"), F.col("target").alias("other")).union(e.select("target", "source"))
    named = n.join(b.spaces().select(F.col("space").alias("other"), "name"), "other").groupBy("space").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return named.select("space", F.size("names").cast("bigint").alias("n_neighbours"), F.array_join("names", "|").alias("neighbours"))


@query("""WITH v AS (SELECT storey, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, (s % 10) / 10e0 AS value FROM spaces),
px AS (SELECT storey, 2e0 * i + 1 AS px, 2e0 * j + 1 AS py FROM (SELECT storey, max(y1) AS top, unnest(range(0, CAST(floor((max(y1) - 1) / 2) AS BIGINT) + 1)) AS j FROM spaces GROUP BY storey), range(15) t(i)),
w AS (SELECT px.storey, px, py, value, exp(-((x - px) * (x - px) + (y - py) * (y - py)) / 12.5e0) AS w FROM px JOIN v ON v.storey = px.storey AND (x - px) * (x - px) + (y - py) * (y - py) <= 56.25e0)
SELECT storey, px, py, round(sum(w * value) / sum(w), 6) AS heat, round(least(1e0, sum(w) / 1.1e0), 6) AS coverage FROM w GROUP BY storey, px, py HAVING sum(w) >= 1e-4""")
def heat_field(b: Building) -> DataFrame:
    """Gaussian mean (sigma 2.5, cut at three) of the rooms' values at pixels two metres apart."""
    s = b.spaces()
    v = s.select("storey", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), (F.col("s") % 10 / 10.0).alias("value"))
    v = v.select("storey", "value", F.col("x").alias("vx"), F.col("y").alias("vy"), *(f(F.col("x"), F.col("y")).alias(n) for n, f in (("x0", lambda x, y: x), ("y0", lambda x, y: y), ("x1", lambda x, y: x), ("y1", lambda x, y: y))))
    top = s.groupBy("storey").agg(F.max("y1").alias("top"))
    rows = top.select("storey", "top", F.explode(F.sequence(F.lit(0), F.floor((F.col("top") - 1) / 2).cast("int"))).alias("j"))
    px = rows.select("storey", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("i"), "j").select("storey", (F.col("i") * 2.0 + 1).alias("x"), (F.col("j") * 2.0 + 1).alias("y"))
    d2 = F.pow(F.col("vx") - F.col("x"), 2) + F.pow(F.col("vy") - F.col("y"), 2)
    near = spatial.points_to_boxes(px, v, on=["storey"], pad=7.5).withColumn("d2", d2).filter("d2 <= 56.25").withColumn("w", F.exp(-F.col("d2") / 12.5))
    total = F.sum("w")
    out = near.groupBy("storey", "x", "y").agg(total.alias("w"), F.sum(F.col("w") * F.col("value")).alias("wv")).filter("w >= 1e-4")
    return out.select("storey", F.col("x").alias("px"), F.col("y").alias("py"), r6(F.col("wv") / F.col("w")).alias("heat"), r6(F.least(F.lit(1.0), F.col("w") / 1.1)).alias("coverage"))


@query("""WITH d AS (SELECT storey, kind, count(*) AS n FROM (SELECT storey, 'space' AS kind FROM spaces UNION ALL SELECT storey, 'door' FROM doors UNION ALL SELECT storey, 'furniture' FROM furniture) GROUP BY ROLLUP (storey, kind)) SELECT * FROM d""")
def summary_counts(b: Building) -> DataFrame:
    """Entities by storey and kind, with totals."""
    every = b.spaces().select("storey", F.lit("space").alias("kind")).union(b.doors().select("storey", F.lit("door"))).union(b.furniture().select("storey", F.lit("furniture")))
    return every.rollup("storey", "kind").agg(F.count(F.lit(1)).alias("n"))


# --- streams (additions) --------------------------------------------------------------------

@query("""SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(b: Building) -> DataFrame:
    """Events by type and tumbling windows of ten minutes, from a stream over the table."""
    from plinth.streaming import poses

    stored = b.table("events")
    stream = b.spark.readStream.schema(stored.schema).parquet(f"{b.sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = poses.drained(b.spark, poses.window_counts(stream), graph.scratch(b.spark, "windows"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# --- footprints ---------------------------------------------------------------------------------

def _faces(b: Building) -> DataFrame:
    """Floor and ceiling of every room as four triangles."""
    s = b.spaces().select(F.col("space").alias("element"), "x0", "y0", "x1", "y1")
    corner = {"p": ("x0", "y0"), "q": ("x1", "y0"), "r": ("x1", "y1"), "t": ("x0", "y1")}
    face = lambda names, z: F.struct(*(v.alias(f"{to}{k}") for to, n in zip("abc", names, strict=True) for k, v in zip("xyz", (F.col(corner[n][0]), F.col(corner[n][1]), F.lit(z)), strict=True)))
    return s.select("element", F.explode(F.array(face("pqr", 2.5), face("prt", 2.5), face("prq", 0.0), face("ptr", 0.0))).alias("f")).select("element", "f.*")


@query("SELECT space AS element, true AS up, round((x1 - x0) * (y1 - y0), 6) AS area FROM spaces")
def horizontal_band(b: Building) -> DataFrame:
    """The side, up or down, of each room's mesh with the larger plan area."""
    from plinth.operators import footprints

    return footprints.widest_band(_faces(b)).select("element", "up", r6("area").alias("area"))


@query("""SELECT space AS element, unnest([round(x0, 4), round(x0, 4), round(x0, 4), round(x1, 4)]) AS ax, unnest([round(y0, 4), round(y0, 4), round(y1, 4), round(y0, 4)]) AS ay,
unnest([round(x1, 4), round(x0, 4), round(x1, 4), round(x1, 4)]) AS bx, unnest([round(y0, 4), round(y1, 4), round(y1, 4), round(y1, 4)]) AS by FROM spaces""")
def mesh_boundary(b: Building) -> DataFrame:
    """Plan edges of each room's floor that one triangle alone has."""
    from plinth.operators import footprints

    return footprints.boundary_edges(_faces(b).filter("az = 0"))


@query("SELECT space AS element, 4 AS n_points, round((x1 - x0) * (y1 - y0), 6) AS area FROM spaces")
def outline_rings(b: Building) -> DataFrame:
    """Stitched outlines: points and area of each room's exterior."""
    from plinth.operators import footprints

    p = footprints.outlines(_faces(b).filter("az = 0")).filter("ring_no = 0").groupBy("element").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return p.select("element", F.size("ring").cast("bigint").alias("n_points"), r6(g.area(F.col("ring"))).alias("area"))


@query("""WITH f AS (SELECT item, storey, w, d, x + w / 2 AS cx, y + d / 2 AS cy, sqrt(w * w + d * d) / 2 AS half FROM furniture WHERE w > 0),
v AS (SELECT *, (1 - least(0.05e0, half / 2) / half) AS keep FROM f)
SELECT item, min(space) AS parent FROM v JOIN spaces USING (storey) WHERE cx - w / 2 * keep >= x0 AND cx + w / 2 * keep < x1 AND cy - d / 2 * keep >= y0 AND cy + d / 2 * keep < y1 AND w * d < 0.98e0 * (x1 - x0) * (y1 - y0) GROUP BY item""")
def nested_parents(b: Building) -> DataFrame:
    """Footprints that lie within a larger one of their storey: at least 85 % of the inset vertices, and the centroid."""
    f = b.furniture().filter("w > 0").withColumn("inner", g.box_ring(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("d")))
    middle = f.select("item", "storey", "inner", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("d") / 2).alias("y"))
    met = spatial.points_to_boxes(middle, b.spaces().select("space", "storey", "ring", "x0", "y0", "x1", "y1"), on=["storey"])
    ring = F.col("ring")
    inside = F.size(F.filter(g.inset(F.col("inner")), lambda p: g.point_in_ring(p["x"], p["y"], ring))) / F.size("inner")
    nested = met.filter((inside >= 0.85) & g.point_in_ring(F.col("x"), F.col("y"), ring) & (g.area(F.col("inner")) < 0.98 * g.area(ring)))
    return nested.groupBy("item").agg(F.min("space").alias("parent"))
