"""Registered queries of healing on the derived building: doors, stairs, the graph with all that healing adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators import healing
from plinth.plans import interfaces as fronts
from plinth.plans.building import Building
from plinth.plans.queries import query

r6 = lambda c: F.round(c, 6)

# --- doors --------------------------------------------------------------------------------
# By the keys ka, kb of a door's rooms: doors stand in the wall or half a metre inside one room (ka % 4); their normals are the
# wall's, none or slanted (kb % 3); some have no storey; the model knows both rooms of some, one of others, none of most.


def doors_to_heal(b: Building) -> DataFrame:
    """door, storey, x, y, nx, ny, x0, y0, x1, y1, and the rooms a, b of the derived door."""
    ka, kb = F.substring("a", 2, 18).cast("bigint"), F.coalesce(F.substring("b", 2, 18).cast("bigint"), F.lit(0))
    d = b.doors().withColumns({"ka": ka, "kb": kb})
    shift = F.when(F.col("ka") % 4 == 1, -0.45).when(F.col("ka") % 4 == 2, 0.45).otherwise(0.0)
    d = d.withColumns({"x": F.col("x") + shift * F.col("nx"), "y": F.col("y") + shift * F.col("ny")})
    wide, thin = 0.06 * F.col("nx") + 0.45 * F.col("ny"), 0.06 * F.col("ny") + 0.45 * F.col("nx")
    normal = lambda own, other: F.when(F.col("kb") % 3 == 0, F.col(own)).when(F.col("kb") % 3 == 2, 2 * F.col(own) + F.col(other))
    return d.select(
        "door", F.when((F.col("ka") + F.col("kb")) % 11 != 0, F.col("storey")).alias("storey"), "x", "y", normal("nx", "ny").alias("nx"), normal("ny", "nx").alias("ny"),
        (F.col("x") - wide).alias("x0"), (F.col("y") - thin).alias("y0"), (F.col("x") + wide).alias("x1"), (F.col("y") + thin).alias("y1"), "a", "b", ((F.col("ka") + F.col("kb")) % 5).alias("known"),
    )


def known_links(doors: DataFrame) -> DataFrame:
    """door, space: the links that the model has."""
    a = doors.filter("known in (0, 1)").select("door", F.col("a").alias("space"))
    return a.union(doors.filter("known in (0, 2) and b is not null").select("door", "b"))


#: Rooms are boxes here: a distance is one from a box, a ray's first edge one of four, the closest edge the first of the least distance.
_DOORS = """hd AS (SELECT door, CASE WHEN (ka + kb) % 11 <> 0 THEN storey END AS storey, x + sh * nx AS x, y + sh * ny AS y, CASE kb % 3 WHEN 0 THEN nx WHEN 2 THEN 2 * nx + ny END AS nx,
   CASE kb % 3 WHEN 0 THEN ny WHEN 2 THEN 2 * ny + nx END AS ny, 0.06e0 * nx + 0.45e0 * ny AS wide, 0.06e0 * ny + 0.45e0 * nx AS thin, a, b, (ka + kb) % 5 AS known
 FROM (SELECT *, CASE ka % 4 WHEN 1 THEN -0.45e0 WHEN 2 THEN 0.45e0 ELSE 0e0 END AS sh FROM (SELECT *, CAST(substr(a, 2) AS BIGINT) AS ka, coalesce(CAST(substr(b, 2) AS BIGINT), 0) AS kb FROM doors))),
kl AS (SELECT door, a AS space FROM hd WHERE known IN (0, 1) UNION SELECT door, b FROM hd WHERE known IN (0, 2) AND b IS NOT NULL),
kn AS (SELECT hd.*, coalesce(n, 0) AS n, own FROM hd LEFT JOIN (SELECT door, count(*) AS n, min(space) AS own FROM kl GROUP BY door) USING (door) WHERE coalesce(n, 0) < 2),
cd AS (SELECT d.door, d.x, d.y, d.n, d.own, d.nx / sqrt(d.nx * d.nx + d.ny * d.ny) AS ux, d.ny / sqrt(d.nx * d.nx + d.ny * d.ny) AS uy, s.space, s.x0, s.y0, s.x1, s.y1
  FROM kn d JOIN spaces s ON (d.storey IS NULL OR d.storey = s.storey) AND CASE WHEN d.nx IS NULL THEN d.x - 1 <= s.x1 AND d.x + 1 >= s.x0 AND d.y - 1 <= s.y1 AND d.y + 1 >= s.y0
    ELSE d.x - wide - 0.5e0 <= s.x1 AND d.x + wide + 0.5e0 >= s.x0 AND d.y - thin - 0.5e0 <= s.y1 AND d.y + thin + 0.5e0 >= s.y0 END),
ins AS (SELECT *, x >= x0 AND x < x1 AND y >= y0 AND y < y1 AS inside, (x1 - x0) * (y1 - y0) AS area FROM cd),
ed AS (SELECT *, unnest([0, 1, 2, 3]) AS i, unnest([x0, x1, x1, x0]) AS ax, unnest([y0, y0, y1, y1]) AS ay, unnest([x1 - x0, 0e0, x0 - x1, 0e0]) AS ex, unnest([0e0, y1 - y0, 0e0, y0 - y1]) AS ey FROM ins),
hit AS (SELECT *, CASE WHEN abs(side * (ux * ey - uy * ex)) >= 1e-12 THEN ((ax - x) * ey - (ay - y) * ex) / (side * (ux * ey - uy * ex)) END AS t,
          CASE WHEN abs(side * (ux * ey - uy * ex)) >= 1e-12 THEN ((ax - x) * side * uy - (ay - y) * side * ux) / (side * (ux * ey - uy * ex)) END AS u FROM ed, (SELECT unnest([1, -1]) AS side) WHERE ux IS NOT NULL),
ray AS (SELECT door, space, n, own, side, any_value(inside) AS inside, any_value(area) AS area,
   CASE WHEN any_value(inside) THEN 0e0 ELSE min(greatest(t, 0e0)) FILTER (t >= -1e-9 AND u >= -1e-9 AND u <= 1 + 1e-9) END AS t FROM hit GROUP BY door, space, n, own, side),
od AS (SELECT d.door, x >= s.x0 AND x < s.x1 AND y >= s.y0 AND y < s.y1 AS own_inside FROM kn d JOIN spaces s ON s.space = d.own WHERE d.n = 1),
v0 AS (SELECT door, space, 0 AS phase, round(area, 9) AS key FROM ray WHERE n = 0 AND inside AND side = 1 UNION ALL
       SELECT door, space, CASE side WHEN 1 THEN 1 ELSE 2 END, round(t, 9) FROM ray WHERE n = 0 AND t > 1e-6 AND t <= 1 + 1e-9 UNION ALL
       SELECT door, space, CASE side WHEN 1 THEN 3 ELSE 4 END, round(t, 9) FROM ray WHERE n = 0 AND t <= 1 + 1e-9 UNION ALL
       SELECT ray.door, space, 5, min(round(t, 9)) FROM ray JOIN od ON od.door = ray.door WHERE n = 1 AND space <> own AND t <= 1 + 1e-9 AND NOT (own_inside AND t <= 1e-6) GROUP BY ray.door, space),
v1 AS (SELECT * FROM v0 QUALIFY row_number() OVER (PARTITION BY door, phase ORDER BY key, space) <= CASE WHEN phase IN (0, 2, 4) THEN 2 ELSE 1 END),
v2 AS (SELECT * FROM v1 QUALIFY phase = min(phase) OVER (PARTITION BY door, space)),
v3 AS (SELECT * FROM v2 QUALIFY row_number() OVER (PARTITION BY door, phase ORDER BY key, space) <= CASE WHEN phase = 0 THEN 2 ELSE 1 END),
v4 AS (SELECT * FROM v3 QUALIFY phase < 3 OR min(phase) OVER (PARTITION BY door) >= 3),
v5 AS (SELECT * FROM v4 QUALIFY row_number() OVER (PARTITION BY door ORDER BY phase, key, space) <= 2),
bc AS (SELECT d.door, d.x, d.y, d.n, d.own, d.space, d.space AS of, d.x0, d.y0, d.x1, d.y1 FROM cd d WHERE ux IS NULL UNION ALL
       SELECT DISTINCT d.door, d.x, d.y, d.n, d.own, s.space, 'own', s.x0, s.y0, s.x1, s.y1 FROM kn d JOIN spaces s ON s.space = d.own WHERE d.n = 1 AND d.nx IS NULL),
ct AS (SELECT *, greatest(x0, least(x, x1)) AS px, greatest(y0, least(y, y1)) AS py, x >= x0 AND x < x1 AND y >= y0 AND y < y1 AS inside,
   list_min([{'d': sqrt(power(x - greatest(x0, least(x, x1)), 2) + power(y - y0, 2)), 'i': 0}, {'d': sqrt(power(x - x1, 2) + power(y - greatest(y0, least(y, y1)), 2)), 'i': 1},
             {'d': sqrt(power(x - greatest(x0, least(x, x1)), 2) + power(y - y1, 2)), 'i': 2}, {'d': sqrt(power(x - x0, 2) + power(y - greatest(y0, least(y, y1)), 2)), 'i': 3}]) AS near FROM bc),
cn AS (SELECT *, CASE WHEN inside THEN 0e0 ELSE near.d END AS d, CASE near.i WHEN 1 THEN 1e0 WHEN 3 THEN -1e0 ELSE 0e0 END AS ox, CASE near.i WHEN 0 THEN -1e0 WHEN 2 THEN 1e0 ELSE 0e0 END AS oy FROM ct),
pp AS (SELECT p.door, p.x, p.y, p.n, p.own, p.space AS s1, q.space AS s2, p.of AS of1, p.d AS d1, q.d AS d2, p.px - p.x AS vx1, p.py - p.y AS vy1, q.px - p.x AS vx2, q.py - p.y AS vy2, p.ox AS ox1, p.oy AS oy1, q.ox AS ox2, q.oy AS oy2,
         sqrt(power(p.px - q.px, 2) + power(p.py - q.py, 2)) AS apart FROM cn p JOIN cn q ON q.door = p.door AND q.of <> 'own' AND q.d <= 1 AND CASE p.n WHEN 0 THEN p.d <= 1 AND (p.d, p.space) < (q.d, q.space) ELSE p.of = 'own' AND q.space <> p.space END),
pq AS (SELECT *, sqrt(vx1 * vx1 + vy1 * vy1) AS l1, sqrt(vx2 * vx2 + vy2 * vy2) AS l2 FROM pp),
bt AS (SELECT * FROM pq WHERE CASE WHEN d1 <= 1e-4 AND d2 <= 1e-4 THEN true
   WHEN d1 <= 1e-4 THEN d2 <= 0.45e0 AND (l2 < 1e-9 OR (vx2 * ox1 + vy2 * oy1) / l2 > 0.25e0) WHEN d2 <= 1e-4 THEN d1 <= 0.45e0 AND (l1 < 1e-9 OR (vx1 * ox2 + vy1 * oy2) / l1 > 0.25e0)
   ELSE apart <= d1 + d2 + 0.2e0 AND l1 >= 1e-9 AND l2 >= 1e-9 AND (vx1 * vx2 + vy1 * vy2) / (l1 * l2) < -0.35e0 END),
b1 AS (SELECT * FROM bt WHERE n = 0 QUALIFY row_number() OVER (PARTITION BY door ORDER BY d1 + d2, d1, s1, d2, s2) = 1),
lv AS (SELECT door, unnest([s1, s2]) AS space, 6 AS phase FROM b1 UNION ALL
       SELECT door, arg_min(space, (d, space)), 7 FROM cn WHERE n = 0 AND d <= 1 AND door NOT IN (SELECT door FROM b1) GROUP BY door UNION ALL
       SELECT door, arg_min(s2, (d2, s2)), 8 FROM bt WHERE n = 1 GROUP BY door),
md AS (SELECT door, space, ['host', 'ray_plus', 'ray_minus', 'touch_plus', 'touch_minus', 'partner_ray', 'between', 'nearest', 'partner_between'][phase + 1] AS phase FROM (SELECT door, space, phase FROM v5 UNION ALL SELECT * FROM lv)
       WHERE (door, space) NOT IN (SELECT (door, space) FROM kl))
"""


@query("WITH " + _DOORS + "SELECT door, space, phase FROM md")
def door_healing(b: Building) -> DataFrame:
    """Rooms that doors get which the model doesn't link, and how each was found."""
    doors = doors_to_heal(b)
    return healing.match_doors(doors, b.spaces().select("space", "storey", "ring"), known_links(doors))


# --- stairs ----------------------------------------------------------------------------------


def stairs_to_heal(b: Building) -> DataFrame:
    """stair, storey, ring: slanted hulls over the corner of four rooms or within one, by n % 3; none on the last storey's stairs of n % 5 = 0."""
    s = b.stairs()
    cx = F.col("x0") + F.when(F.col("n") % 3 == 0, 0.5).otherwise(3.8)
    cy = F.when(F.col("n") % 3 == 2, 4.9).otherwise(1.5)
    long, short = 1.6 + F.col("n") % 4 * 0.3, 0.7 + F.col("n") % 2 * 0.4
    corner = lambda dx, dy: g.point(cx + 0.8 * dx - 0.6 * dy, cy + 0.6 * dx + 0.8 * dy)
    return s.select("stair", "n", "storey", F.array(corner(-long, -short), corner(long, -short), corner(long, short), corner(-long, short)).alias("ring"))


def _half_plane(name: str, before: str, axis: str, sign: int, bound: str, size: str) -> str:
    """SQL that cuts polygons (rows by stair, storey, space and i) at a line along an axis: what is beyond its bound goes."""
    f = f"{sign} * ({{p}}{axis} - {bound}) * {size}"
    inner, prior = f.format(p=""), f.format(p="p")
    return f"""{name}r AS (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly, last_value(x) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ex, last_value(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ey FROM {before} WINDOW w AS (PARTITION BY stair, storey, space ORDER BY i)),
{name}p AS (SELECT *, coalesce(lx, ex) AS px, coalesce(ly, ey) AS py FROM {name}r),
{name}s AS (SELECT *, {inner} >= -1e-4 AS here, {prior} >= -1e-4 AS before, (({bound}) - p{axis}) / CASE WHEN {axis} <> p{axis} THEN {axis} - p{axis} END AS t FROM {name}p),
{name}u AS (SELECT stair, storey, space, x0, y0, x1, y1, 2 * i AS i, px + t * (x - px) AS x, py + t * (y - py) AS y FROM {name}s WHERE here <> before UNION ALL SELECT stair, storey, space, x0, y0, x1, y1, 2 * i + 1, x, y FROM {name}s WHERE here),
{name} AS (SELECT * FROM {name}u QUALIFY count(*) OVER (PARTITION BY stair, storey, space) >= 3)"""


_STAIRS = f"""sh AS (SELECT stair, n, storey, x0 + CASE WHEN n % 3 = 0 THEN 0.5e0 ELSE 3.8e0 END AS cx, CASE WHEN n % 3 = 2 THEN 4.9e0 ELSE 1.5e0 END AS cy, 1.6e0 + n % 4 * 0.3e0 AS l, 0.7e0 + n % 2 * 0.4e0 AS w FROM stairs),
nx AS (SELECT storey, lead(storey) OVER (ORDER BY elevation, storey) AS nxt FROM storeys),
st AS (SELECT stair, n, s AS storey, cx, cy, l, w FROM (SELECT sh.*, unnest([sh.storey, nxt]) AS s FROM sh LEFT JOIN nx ON nx.storey = sh.storey) WHERE s IS NOT NULL),
hv AS (SELECT stair, storey FROM st WHERE n % 5 = 0 AND storey <> 'L0' AND EXISTS (SELECT 1 FROM sh WHERE sh.stair = st.stair AND sh.storey = st.storey)),
v AS (SELECT stair, st.storey, space, s.x0, s.y0, s.x1, s.y1, unnest([0, 1, 2, 3]) AS i, unnest([cx - 0.8e0 * l + 0.6e0 * w, cx + 0.8e0 * l + 0.6e0 * w, cx + 0.8e0 * l - 0.6e0 * w, cx - 0.8e0 * l - 0.6e0 * w]) AS x,
   unnest([cy - 0.6e0 * l - 0.8e0 * w, cy + 0.6e0 * l - 0.8e0 * w, cy + 0.6e0 * l + 0.8e0 * w, cy - 0.6e0 * l + 0.8e0 * w]) AS y FROM st JOIN spaces s ON s.storey = st.storey
   WHERE (stair, st.storey) NOT IN (SELECT (stair, storey) FROM hv)),
{_half_plane("c1", "v", "y", 1, "y0", "(x1 - x0)")}, {_half_plane("c2", "c1", "x", -1, "x1", "(y1 - y0)")}, {_half_plane("c3", "c2", "y", -1, "y1", "(x1 - x0)")}, {_half_plane("c4", "c3", "x", 1, "x0", "(y1 - y0)")},
c5 AS (SELECT *, lead(x) OVER w AS qx, lead(y) OVER w AS qy, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM c4 WINDOW w AS (PARTITION BY stair, storey, space ORDER BY i)),
c6 AS (SELECT stair, storey, space, abs(sum(x * coalesce(qy, fy) - coalesce(qx, fx) * y)) / 2 AS area, any_value((x1 - x0) * (y1 - y0)) AS room FROM c5 GROUP BY stair, storey, space),
c7 AS (SELECT c6.stair, c6.storey, space, area, abs(4 * l * w / room - 1) AS ratio FROM c6 JOIN sh ON sh.stair = c6.stair WHERE area > 1e-4)
"""


def _stair_links(b: Building) -> tuple[DataFrame, DataFrame]:
    """The model's links (stair, space): stairs of n % 5 = 0 above the lowest storey know their own storey's first room; and every room's storey."""
    rooms = b.spaces().select("space", "storey")
    first = rooms.groupBy("storey").agg(F.min("space").alias("space"))
    known = stairs_to_heal(b).filter("n % 5 = 0 and storey <> 'L0'").join(first, "storey").select("stair", "space")
    return known, rooms


@query("WITH " + _STAIRS + "SELECT stair, storey, space, round(area, 6) AS area, row_number() OVER (PARTITION BY stair, storey ORDER BY round(area, 9) DESC, round(ratio, 9), space) AS place FROM c7")
def stair_overlap_places(b: Building) -> DataFrame:
    """Rooms that slanted stairs overlap where the model links none, by their share."""
    known, rooms = _stair_links(b)
    on = healing.stair_storeys(stairs_to_heal(b), b.storeys())
    open_ = on.join(known.join(rooms, "space").select("stair", "storey").distinct(), ["stair", "storey"], "left_anti")
    return healing.stair_overlaps(open_, b.spaces()).select("stair", "storey", "space", r6("area").alias("area"), F.col("place").cast("bigint").alias("place"))


@query("WITH " + _STAIRS + "SELECT stair, storey, space, round(area, 6) AS area FROM c7 QUALIFY row_number() OVER (PARTITION BY stair, storey ORDER BY round(area, 9) DESC, round(ratio, 9), space) = 1")
def stair_healing(b: Building) -> DataFrame:
    """The room that each stair gets on its storey and the next."""
    known, rooms = _stair_links(b)
    return healing.match_stairs(stairs_to_heal(b), b.spaces(), b.storeys(), known, rooms).select("stair", "storey", "space", r6("area").alias("area"))


# --- the whole graph ----------------------------------------------------------------------------


def model(b: Building) -> healing.Model:
    """The derived building with the links that its model knows; openings of every third key are filled by a window."""
    doors = doors_to_heal(b)
    links, spaces, stairs = known_links(doors), b.spaces(), stairs_to_heal(b)
    known, _ = _stair_links(b)
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    node = lambda df, kind, c: df.select(named(kind, c).alias("id"), F.lit(kind).alias("kind"), F.col(c).alias("global_id"), "storey")
    nodes = node(spaces, "space", "space").unionByName(node(doors, "door", "door")).unionByName(node(stairs, "stair", "stair"))
    null = [F.lit(None).cast("string").alias("global_id"), F.lit("ifc_rel_space_boundary").alias("method"), F.lit(False).alias("inferred"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")]
    edge = lambda df, kind, thing, c: df.select(F.concat(F.lit("rel_"), c, F.lit("_"), "space").alias("id"), F.lit(kind).alias("kind"), named("space", "space").alias("source"), named(thing, c).alias("target"), *null)
    voids = fronts.openings(b).select(F.concat(F.lit("O"), "s").alias("opening"), F.col("s").alias("ord"), "storey", "x", "y", "ring", "host_is_wall", "sill_z", "head_z", F.lit(None).cast("string").alias("door"), F.when(F.col("s") % 3 == 0, F.concat(F.lit("W"), "s")).alias("window"))
    return healing.Model(b.storeys(), spaces.select("space", "storey", "ring", F.array().cast("array<array<struct<x:double,y:double>>>").alias("holes")), doors, stairs, fronts.walls(b), voids, nodes, edge(links, "space_door", "door", "door").unionByName(edge(known, "vertical", "stair", "stair")))


_RUNS_BETWEEN = fronts.RUNS.replace("a.space <> b.space", "a.space < b.space AND (a.space, b.space) NOT IN (SELECT (p.space, q.space) FROM al p JOIN al q ON p.door = q.door)").split("hv AS (")
_NEAR = "sqrt(power(greatest({r}.x0 - {x}, 0, {x} - {r}.x1), 2) + power(greatest({r}.y0 - {y}, 0, {y} - {r}.y1), 2)) <= {far}"
_BOTH = " AND ".join(_NEAR.format(r=r, x="w.cx", y="w.cy", far="w.far") for r in "pq")
_FRONT_EDGES = _RUNS_BETWEEN[0] + f"""vs AS (SELECT storey, x0, y0, x1, y1, x0 + 0.12e0 AS cx, (y0 + y1) / 2 AS cy, 0.45e0 + sqrt(power(0.12e0, 2) + power((y1 - y0) / 2, 2)) + 0.06e0 AS far, 0.06e0 AS pad FROM voids
  UNION ALL SELECT coalesce(d.storey, t.storey), x, y, x, y, x, y, 1e0, 0.55e0 FROM hd0 d JOIN storeys t ON d.storey IS NULL OR d.storey = t.storey),
hv AS (SELECT DISTINCT a, b, i, k FROM md m JOIN vs w USING (storey) JOIN spaces p ON p.space = m.a JOIN spaces q ON q.space = m.b
  WHERE sqrt(power(greatest(w.x0 - mx, 0, mx - w.x1), 2) + power(greatest(w.y0 - my, 0, my - w.y1), 2)) <= w.pad AND {_BOTH}),
bl AS (""" + _RUNS_BETWEEN[1].split("bl AS (", 1)[1] + """, tot AS (SELECT a, b, count(*) AS n FROM md GROUP BY a, b),
bs AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(span, 9) DESC, start) AS place, sum(n) OVER w AS clear, sum(sx) OVER w AS tx, sum(sy) OVER w AS ty FROM runs WINDOW w AS (PARTITION BY a, b)),
op AS (SELECT least(l.space, r.space) AS a, greatest(l.space, r.space) AS b, 'O' || l.s AS opening FROM spaces l JOIN spaces r ON r.storey = l.storey AND r.row = l.row AND r.col = l.col + 1 WHERE l.s % 4 = 0 AND l.s % 3 <> 0)
SELECT bs.a, bs.b, opening, CASE WHEN clear / tot.n >= 0.7e0 THEN tx / clear ELSE x END AS x, CASE WHEN clear / tot.n >= 0.7e0 THEN ty / clear ELSE y END AS y
FROM bs JOIN tot ON tot.a = bs.a AND tot.b = bs.b LEFT JOIN op ON op.a = bs.a AND op.b = bs.b WHERE place = 1 AND tot.n >= 2 AND round(span, 9) >= 0.7e0"""


@query("WITH hd0 AS (WITH " + _DOORS + "SELECT * FROM hd), kl0 AS (WITH " + _DOORS + "SELECT * FROM kl), md0 AS (WITH " + _DOORS + "SELECT * FROM md), al AS (SELECT door, space FROM kl0 UNION SELECT door, space FROM md0), st0 AS (WITH " + _STAIRS
       + "SELECT stair, space FROM c7 QUALIFY row_number() OVER (PARTITION BY stair, storey ORDER BY round(area, 9) DESC, round(ratio, 9), space) = 1), ks AS (SELECT stair, min(space) AS space FROM stairs JOIN spaces USING (storey) WHERE n % 5 = 0 AND storey <> 'L0' GROUP BY stair), fr AS (WITH "
       + _FRONT_EDGES + """)
SELECT 'rel_' || door || '_' || space AS id, 'space_door' AS kind, 'space:' || space AS source, 'door:' || door AS target, NULL AS global_id, 'ifc_rel_space_boundary' AS method, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM kl0
UNION ALL SELECT 'rel_' || stair || '_' || space, 'vertical', 'space:' || space, 'stair:' || stair, NULL, 'ifc_rel_space_boundary', NULL, NULL FROM ks
UNION ALL SELECT 'space_door:' || space || ':' || door || ':geom', 'space_door', 'space:' || space, 'door:' || door, NULL, 'geom_door_space', NULL, NULL FROM md0
UNION ALL SELECT 'vertical:' || stair || ':' || space || ':geom', 'vertical', 'space:' || space, 'stair:' || stair, NULL, 'geom_stair_space', NULL, NULL FROM st0
UNION ALL SELECT 'space_space:space:' || a || ':space:' || b || CASE WHEN opening IS NULL THEN ':strip' ELSE ':opening:' || opening END || ':geom', 'space_space', 'space:' || a, 'space:' || b, opening, 'geom_opening_space', round(x, 6), round(y, 6) FROM fr""")  # fmt: skip
def healed_edges(b: Building) -> DataFrame:
    """The graph of the building with all that healing adds: doors, fronts without doors, stairs."""
    found = healing.healed(model(b))
    return found.select("id", "kind", "source", "target", "global_id", "method", r6("x").alias("x"), r6("y").alias("y"))
