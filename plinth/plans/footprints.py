"""Registered queries of footprints on the derived building: rings within rings, oriented rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.functions import rectangles, registered
from plinth.operators import extraction, rings
from plinth.plans.building import Building
from plinth.plans.queries import query

r6 = lambda c: F.round(c, 6)

# --- rings of every room: its outline, one within it, one within that, a copy, and one apart, by s % 2 and s % 3 -------------


def nested_rings(b: Building) -> DataFrame:
    x0, y0, x1, y1, s = (F.col(c) for c in ("x0", "y0", "x1", "y1", "s"))
    within = lambda by: g.box_ring(x0 + by, y0 + by, x1 - by, y1 - by)
    row = lambda no, ring, when: F.when(when, F.struct(F.lit(no).alias("ring_no"), ring.alias("ring")))
    every = F.lit(True)
    all_ = F.array(
        row(0, within(0.6), every), row(1, within(0.0), every), row(2, within(1.3), s % 2 == 0), row(3, within(0.05), s % 3 == 0), row(4, g.box_ring(x1 + 0.01, y0, x1 + 0.15, y0 + 1), every),
        row(5, g.box_ring(x0 + 1.5, y0 + 1.5, x0 + 1.55, y0 + 1.55), s % 5 == 0), row(6, g.box_ring(x1 + 0.02, y0 + 0.01, x1 + 0.14, y0 + 0.99), s % 4 == 0),
    )
    return b.spaces().select(F.col("space").alias("element"), F.explode(F.filter(all_, lambda r: r.isNotNull())).alias("r")).select("element", "r.ring_no", "r.ring")


_RINGS = """rg AS (SELECT * FROM (
 SELECT space AS element, 0 AS no, x0 + 0.6e0 AS x0, y0 + 0.6e0 AS y0, x1 - 0.6e0 AS x1, y1 - 0.6e0 AS y1 FROM spaces UNION ALL SELECT space, 1, x0, y0, x1, y1 FROM spaces UNION ALL
 SELECT space, 2, x0 + 1.3e0, y0 + 1.3e0, x1 - 1.3e0, y1 - 1.3e0 FROM spaces WHERE s % 2 = 0 UNION ALL SELECT space, 3, x0 + 0.05e0, y0 + 0.05e0, x1 - 0.05e0, y1 - 0.05e0 FROM spaces WHERE s % 3 = 0 UNION ALL
 SELECT space, 4, x1 + 0.01e0, y0, x1 + 0.15e0, y0 + 1 FROM spaces UNION ALL SELECT space, 5, x0 + 1.5e0, y0 + 1.5e0, x0 + 1.55e0, y0 + 1.55e0 FROM spaces WHERE s % 5 = 0 UNION ALL
 SELECT space, 6, x1 + 0.02e0, y0 + 0.01e0, x1 + 0.14e0, y0 + 0.99e0 FROM spaces WHERE s % 4 = 0) WHERE (x1 - x0) * (y1 - y0) >= {least}),
mr AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, row_number() OVER (PARTITION BY element ORDER BY round((x1 - x0) * (y1 - y0), 9) DESC, no) AS k FROM rg)"""
_DEEP = _RINGS.format(least="1e-8")
_LEAST = 0.01


@query("WITH " + _DEEP + """, cn AS (SELECT a.element, a.no, count(o.no) AS depth, arg_max(o.no, o.k) AS parent FROM mr a LEFT JOIN mr o ON o.element = a.element AND o.k < a.k AND a.cx >= o.x0 AND a.cx < o.x1 AND a.cy >= o.y0 AND a.cy < o.y1 GROUP BY a.element, a.no)
SELECT element, no AS ring_no, depth, parent, depth % 2 = 1 AS is_hole FROM cn""")
def ring_forest(b: Building) -> DataFrame:
    """How deep each ring lies within others of its element, and in which."""
    return rings.forest(nested_rings(b))


@query("WITH RECURSIVE " + _RINGS.format(least=_LEAST) + """, st(element, k, solids) AS (SELECT DISTINCT element, 0::BIGINT, []::STRUCT(no INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] FROM mr UNION ALL
 SELECT m.element, m.k, CASE WHEN len(list_filter(solids, lambda q: m.cx >= q.x0 AND m.cx < q.x1 AND m.cy >= q.y0 AND m.cy < q.y1)) = 0 THEN list_append(solids, {'no': m.no, 'x0': m.x0, 'y0': m.y0, 'x1': m.x1, 'y1': m.y1}) ELSE solids END
 FROM st JOIN mr m ON m.element = st.element AND m.k = st.k + 1),
so AS (SELECT m.element, m.no, m.area, list_filter(solids, lambda q: m.cx >= q.x0 AND m.cx < q.x1 AND m.cy >= q.y0 AND m.cy < q.y1)[1] AS q FROM mr m JOIN st ON st.element = m.element AND st.k = m.k - 1)
SELECT element, no AS ring_no, coalesce(q.no, no) AS solid, CASE WHEN q IS NULL THEN 'solid' WHEN round(area / ((q.x1 - q.x0) * (q.y1 - q.y0)), 9) >= 0.9e0 THEN 'copy' ELSE 'hole' END AS role FROM so""")
def occupied_rings(b: Building) -> DataFrame:
    """Solids, holes and copies among the rings of a hundredth of a square metre or more."""
    return rings.occupied(nested_rings(b), _LEAST)


@query("WITH " + _DEEP + """, ex AS (SELECT * FROM mr WHERE k = 1), ho AS (SELECT m.element, count(*) AS n, sum(m.area) AS area FROM mr m JOIN ex ON ex.element = m.element AND m.k > 1 AND m.cx >= ex.x0 AND m.cx < ex.x1 AND m.cy >= ex.y0 AND m.cy < ex.y1 GROUP BY m.element)
SELECT ex.element, round(ex.area, 6) AS area, coalesce(n, 0) AS n_holes, round(coalesce(ho.area, 0), 6) AS hole_area FROM ex LEFT JOIN ho USING (element)""")
def exterior_and_holes(b: Building) -> DataFrame:
    """The largest ring of each room, and what lies within it."""
    found = rings.exteriors(nested_rings(b))
    total = F.aggregate(F.transform("holes", g.area), F.lit(0.0), lambda a, v: a + v)
    return found.select("element", r6(g.area(F.col("ring"))).alias("area"), F.size("holes").cast("bigint").alias("n_holes"), r6(total).alias("hole_area"))


# --- every element's footprint by what it has: rules on keys decide on meshes, parts, sizes and storeys --------------------


def _plates(rows: DataFrame, *plates: tuple) -> DataFrame:
    """Faces of level rectangles (x0, y0, x1, y1, z, up, when), two triangles each, of rows with a column element."""
    face = lambda *corners: F.struct(*(v.alias(f"{p}{k}") for p, c in zip("abc", corners, strict=True) for k, v in zip("xyz", c, strict=True)))
    every = []
    for x0, y0, x1, y1, z, up, when in plates:
        p, q, r, t = (x0, y0, z), (x1, y0, z), (x1, y1, z), (x0, y1, z)
        every += [F.when(when, face(p, *pair[::1 if up else -1])) for pair in ((q, r), (r, t))]
    return rows.select("element", F.explode(F.filter(F.array(*every), lambda f: f.isNotNull())).alias("f")).select("element", "f.*")


def surveyed(b: Building) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements, faces and parts of rooms (one in ten meshes cancels out, two in ten have none), stairs of two flights, furniture."""
    none, yes = F.lit(None).cast("double"), F.lit(True)
    e = lambda df, kind, storey, *rest: df.select("element", F.lit(kind).alias("kind"), storey.alias("storey"), *(v.alias(c) for c, v in zip(("width", "depth", "ox", "oy", "oz"), rest, strict=True)))
    rooms, s = b.spaces().withColumn("element", F.col("space")), F.col("s") % 10
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    stairs, n = b.stairs().withColumn("element", F.col("stair")), F.col("n") % 5
    goods, p = b.furniture().withColumn("element", F.col("item")), F.col("p") % 4
    x, y, w, d, low, high = (F.col(c) for c in ("x", "y", "w", "d", "z_min", "z_max"))
    placed = F.when(s == 3, 1.0)
    elements = e(rooms, "space", F.col("storey"), placed * 3, none, placed * x0, placed * y0, placed * 0)
    elements = elements.unionByName(e(stairs, "stair", F.col("storey"), none, none, x0, y0, F.lit(0.0)))
    storey, size = F.when(F.col("p") % 3 != 0, F.col("storey")), F.when(p == 2, 1.0)
    elements = elements.unionByName(e(goods, "furniture", storey, size * w, size * d, x, y, low))
    ground, top = F.lit(0.0), F.lit(2.5)
    faces = _plates(rooms, (x0, y0, x1, y1, ground, False, (s != 3) & (s != 4)), (x0, y0, x1, y1, ground, False, s == 5), (x0, y0, x1, y1, top, True, (s != 3) & (s != 4) & (s != 5)))
    up, down = stairs.withColumn("element", F.concat("stair", F.lit("u"))), stairs.withColumn("element", F.concat("stair", F.lit("d")))
    faces = faces.unionByName(_plates(up, (x0, y0, x1, y1, ground, True, yes))).unionByName(_plates(down, (x1, y0, x1 + 1, y1, top, True, yes)))
    meshed = (p == 0) | (p == 1)
    faces = faces.unionByName(_plates(goods, (x, y, x + w, y + d, low, True, meshed), (x, y, x + w, y + d, high, True, meshed), (x + 3, y, x + 3.5, y + d, high, True, p == 1)))
    flights = stairs.filter(n != 0)
    parts = flights.select("element", F.concat("stair", F.lit("u")).alias("part")).union(flights.select("element", F.concat("stair", F.lit("d"))))
    return elements, faces, parts


@query("""WITH g0 AS (SELECT *, p % 4 AS k, w * d AS own, z_min AS lo, CASE WHEN p % 4 <= 1 THEN z_max ELSE z_min + 1 END AS hi, CASE p % 4 WHEN 0 THEN z_min + 0.25e0 WHEN 1 THEN z_min + 1e0 / 3 ELSE z_min END AS mid FROM furniture),
g1 AS (SELECT g0.*, CASE WHEN p % 3 <> 0 THEN g0.storey ELSE (SELECT arg_min(s.storey, {'d': abs(s.elevation - mid), 'e': s.elevation}) FROM storeys s) END AS st FROM g0),
g2 AS (SELECT g1.*, CASE WHEN NOT (lo <= e.elevation + 2.10e0 AND hi >= e.elevation + 0.15e0) THEN 'overhead' WHEN k = 3 THEN 'unmeasured' WHEN k = 0 AND own < 0.05e0 THEN 'tiny' END AS dropped, (own >= 0.05e0)::INT + (k = 1)::INT AS solids FROM g1 LEFT JOIN storeys e ON e.storey = g1.st)
SELECT space AS element, 'space' AS kind, storey, CASE WHEN s % 10 = 3 THEN 'ifc_placement_bbox' WHEN s % 10 = 4 THEN 'unavailable' WHEN s % 10 = 5 THEN 'ifc_mesh_xy_hull' ELSE 'ifc_mesh_xy_outline' END AS method, s % 10 = 4 AS incomplete, NULL AS dropped,
 round(CASE s % 10 WHEN 3 THEN 3e0 WHEN 4 THEN 0e0 ELSE (x1 - x0) * (y1 - y0) END, 6) AS area, 0 AS n_parts FROM spaces
UNION ALL SELECT stair, 'stair', storey, CASE WHEN n % 5 = 0 THEN 'ifc_placement_bbox' ELSE 'ifc_mesh_xy_hull' END, false, NULL, CASE WHEN n % 5 = 0 THEN 1e0 ELSE 2e0 END, 0 FROM stairs
UNION ALL SELECT item, 'furniture', st, CASE WHEN dropped IS NULL THEN CASE WHEN k = 2 THEN 'ifc_placement_bbox' ELSE 'ifc_mesh_xy_outline' END END, false, dropped,
 CASE WHEN dropped IS NULL THEN round(CASE WHEN k = 1 AND (own < 0.05e0 OR w < 0.5e0) THEN 0.5e0 * d ELSE own END, 6) END, CASE WHEN dropped IS NULL THEN CASE WHEN k = 1 THEN solids - 1 ELSE 0 END END FROM g2""")
def element_footprints(b: Building) -> DataFrame:
    """How each room, stair and piece of furniture gets its footprint, its area and further solids; what is dropped, and why."""
    found = extraction.element_footprints(*surveyed(b), b.storeys().select("storey", "elevation"))
    return found.select("element", "kind", "storey", "method", "incomplete", "dropped", r6(g.area(F.col("ring"))).alias("area"), F.size("parts").alias("n_parts"))


# --- rectangles ------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT item, p, x, y, CASE WHEN p % 7 = 0 THEN 0e0 ELSE w END AS w, d FROM furniture), t AS (SELECT *, greatest(w, d) AS long, least(w, d) AS short,
  CASE WHEN w >= d THEN 0.8e0 ELSE -0.6e0 END AS ux, CASE WHEN w >= d THEN 0.6e0 ELSE 0.8e0 END AS uy FROM f WHERE p % 11 <> 0)
SELECT item, 'ifc_mesh_xy_centroid' AS method, round(x, 6) AS x, round(y, 6) AS y, round(abs(uy), 6) AS nx, round(abs(ux), 6) AS ny, round(2 * greatest(long / 2, 0.15e0), 6) AS along, CASE WHEN w = 0 THEN 0.1e0 ELSE round(2 * greatest(short / 2, 0.04e0), 6) END AS through FROM t
UNION ALL SELECT item, CASE WHEN p % 22 = 0 THEN 'unavailable' ELSE 'ifc_object_placement' END, CASE WHEN p % 22 <> 0 THEN round(x, 6) END, CASE WHEN p % 22 <> 0 THEN round(y, 6) END, CASE WHEN p % 22 <> 0 THEN CASE WHEN ww >= d THEN 0.6e0 ELSE 0.8e0 END END,
 CASE WHEN p % 22 <> 0 THEN CASE WHEN ww >= d THEN 0.8e0 ELSE 0.6e0 END END, CASE WHEN p % 22 <> 0 THEN round(greatest(ww, d), 6) END, CASE WHEN p % 22 <> 0 THEN round(2 * greatest(least(ww, d) / 2, 0.04e0), 6) END
FROM (SELECT *, CASE WHEN w = 0 THEN 0.9e0 ELSE w END AS ww FROM f WHERE p % 11 = 0)""")
def oriented_rectangles(b: Building) -> DataFrame:
    """Rectangles of turned furniture: by its hull (some are lines), by its placement where it has no mesh, or none."""
    f = b.furniture().withColumn("w", F.when(F.col("p") % 7 == 0, 0.0).otherwise(F.col("w")))
    x, y, w, d = (F.col(c) for c in "xywd")
    corner = lambda a, t: g.point(x + 0.8 * a * w / 2 - 0.6 * t * d / 2, y + 0.6 * a * w / 2 + 0.8 * t * d / 2)
    none = F.array().cast("array<struct<x:double,y:double>>")
    hull = F.when(F.col("p") % 11 == 0, none).when(w == 0, F.array(corner(0, -1), corner(0, 1))).otherwise(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)))
    origin = F.when(F.col("p") % 22 != 0, g.point(x, y))
    staged = f.select("item", "w", "d", hull.alias("hull"), origin.alias("origin"))
    axis = lambda ax, ay: g.point(F.lit(ax), F.lit(ay))
    portal = rectangles.door_portal(F.col("hull"), F.col("hull"), F.col("origin"), axis(4.0, 3.0), axis(-0.6, 0.8), F.col("w"), F.col("d"))
    found = staged.select("item", portal.alias("r"))
    side = lambda i, j: g.distance(F.col("r.ring")[i]["x"], F.col("r.ring")[i]["y"], F.col("r.ring")[j]["x"], F.col("r.ring")[j]["y"])
    return found.select("item", "r.method", r6("r.point.x").alias("x"), r6("r.point.y").alias("y"), r6(F.abs("r.normal.x")).alias("nx"), r6(F.abs("r.normal.y")).alias("ny"), r6(side(0, 1)).alias("along"), r6(side(1, 2)).alias("through"))


# --- SQL functions -------------------------------------------------------------------------------------------


@query("""SELECT space, 'space' AS kind, round((x1 - x0) * (y1 - y0), 6) AS area, round(2 * (x1 - x0) + 2 * (y1 - y0), 6) AS perimeter, s % 2 = 0 AS inside, round(sqrt(2), 6) AS distance,
CAST(2 * (greatest(1, ceil((x1 - x0) / 0.5e0)) + 1) + 2 * (greatest(1, ceil((y1 - y0) / 0.5e0)) + 1) AS BIGINT) AS samples, round(x1 - x0, 6) AS front FROM spaces""")
def sql_functions(b: Building) -> DataFrame:
    """Rooms measured in Spark SQL by the functions that a session registers."""
    registered.register(b.spark)
    return b.spark.sql(
        """WITH m AS (SELECT space, ring, node_kind('space:' || space) AS kind, ring_area(ring) AS area, ring_perimeter(ring) AS perimeter,
                             point_in_ring(CASE WHEN s % 2 = 0 THEN ring_centroid(ring).x ELSE ring_box(ring).x1 + 1 END, ring_centroid(ring).y, ring) AS inside,
                             ring_distance(ring_box(ring).x0 - 1, ring_box(ring).y0 - 1, ring) AS distance FROM {rooms}),
                p AS (SELECT m.space, p.i, count(*) AS n FROM m, LATERAL boundary_samples(m.ring, 0.5D) p GROUP BY m.space, p.i),
                e AS (SELECT m.space, e.i, e.bx - e.ax AS dx FROM m, LATERAL ring_edges(m.ring) e),
                t AS (SELECT space, sum(n) AS samples, round(max(dx), 6) AS front FROM p JOIN e USING (space, i) GROUP BY space)
           SELECT space, kind, round(area, 6) AS area, round(perimeter, 6) AS perimeter, inside, round(distance, 6) AS distance, samples, front FROM m JOIN t USING (space)""",
        rooms=b.spaces(),
    )
