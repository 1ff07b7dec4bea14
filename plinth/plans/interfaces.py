"""Registered queries about the fronts that rooms share on the derived building: lengths, clear runs, portals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators import graph, interfaces, spatial
from plinth.plans.building import Building
from plinth.plans.queries import query

r6 = lambda c: F.round(c, 6)

#: Boxes are apart, so a distance is one from a point outside and the closest point is the point held within the box.
FRONTS = """pr AS (SELECT a.space AS a, b.space AS b, a.storey, a.x0, a.y0, a.x1, a.y1, b.x0 AS u0, b.y0 AS v0, b.x1 AS u1, b.y1 AS v1 FROM spaces a JOIN spaces b
  ON a.storey = b.storey AND a.space <> b.space AND a.x0 - 0.45e0 <= b.x1 AND b.x0 <= a.x1 + 0.45e0 AND a.y0 - 0.45e0 <= b.y1 AND b.y0 <= a.y1 + 0.45e0),
ed AS (SELECT *, 0 AS i, x0 AS ex, y0 AS ey, x1 - x0 AS dx, 0e0 AS dy, x1 - x0 AS size, 0e0 AS bef FROM pr UNION ALL SELECT *, 1, x1, y0, 0e0, y1 - y0, y1 - y0, x1 - x0 FROM pr
  UNION ALL SELECT *, 2, x1, y1, x0 - x1, 0e0, x1 - x0, (x1 - x0) + (y1 - y0) FROM pr UNION ALL SELECT *, 3, x0, y1, 0e0, y0 - y1, y1 - y0, (x1 - x0) + (y1 - y0) + (x1 - x0) FROM pr),
sm AS (SELECT *, ex + (k / n) * dx AS px, ey + (k / n) * dy AS py, bef + k / n * size AS s FROM (SELECT *, unnest(range(0, CAST(n AS BIGINT) + 1)) AS k FROM (SELECT *, greatest(1, ceil(size / 0.12e0)) AS n FROM ed))),
cl AS (SELECT *, greatest(u0, least(px, u1)) AS qx, greatest(v0, least(py, v1)) AS qy FROM sm),
nr AS (SELECT *, sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)) AS d FROM cl WHERE sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)) <= 0.45e0)"""

RUNS = FRONTS + """, walls AS (SELECT storey, x1 + 0.02e0 AS x0, y0 - 0.1e0 AS y0, x1 + 0.18e0 AS x1, CASE WHEN s % 4 = 0 THEN y1 + 0.1e0 ELSE y0 + 1.2e0 END AS y1 FROM spaces WHERE s % 4 < 2),
voids AS (SELECT storey, x1 - 0.02e0 AS x0, CASE WHEN s % 8 = 0 THEN y0 + 1.55e0 ELSE y0 + 1.875e0 END AS y0, x1 + 0.22e0 AS x1, CASE WHEN s % 8 = 0 THEN y0 + 2.45e0 ELSE y0 + 2.125e0 END AS y1 FROM spaces WHERE s % 4 = 0 AND s % 12 <> 4),
md AS (SELECT a, b, storey, i, k, s, 2 * (x1 - x0) + 2 * (y1 - y0) AS around, (px + qx) / 2 AS mx, (py + qy) / 2 AS my FROM nr WHERE k < n),
hw AS (SELECT DISTINCT a, b, i, k FROM md m JOIN walls w USING (storey) WHERE sqrt(power(greatest(w.x0 - mx, 0, mx - w.x1), 2) + power(greatest(w.y0 - my, 0, my - w.y1), 2)) <= 0.08e0),
hv AS (SELECT DISTINCT a, b, i, k FROM md m JOIN voids w USING (storey) WHERE sqrt(power(greatest(w.x0 - mx, 0, mx - w.x1), 2) + power(greatest(w.y0 - my, 0, my - w.y1), 2)) <= 0.06e0),
bl AS (SELECT m.*, (a, b, i, k) IN (SELECT (a, b, i, k) FROM hw) AND (a, b, i, k) NOT IN (SELECT (a, b, i, k) FROM hv) AS blocked FROM md m),
p1 AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY a, b ORDER BY s, i, k) > 0.4e0 THEN 1 ELSE 0 END AS step FROM bl),
p2 AS (SELECT *, sum(step) OVER (PARTITION BY a, b ORDER BY s, i, k) AS part FROM p1),
p3 AS (SELECT *, max(part) OVER w AS lastp, min(s) OVER w + around - max(s) OVER w <= 0.4e0 AS wraps, min(s) FILTER (blocked) OVER w AS wall FROM p2 WINDOW w AS (PARTITION BY a, b)),
p4 AS (SELECT *, CASE WHEN wraps AND lastp > 0 AND part = lastp THEN s - around WHEN wraps AND lastp = 0 AND s < wall THEN s + around ELSE s END AS t FROM p3),
p5 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY a, b ORDER BY t, i, k) > 0.4e0 OR blocked <> lag(blocked) OVER (PARTITION BY a, b ORDER BY t, i, k) THEN 1 ELSE 0 END AS cut FROM p4),
p6 AS (SELECT *, sum(cut) OVER (PARTITION BY a, b ORDER BY t, i, k) AS run FROM p5),
runs AS (SELECT a, b, min(t) AS start, CASE WHEN max(t) - min(t) < 1e-9 THEN 0.12e0 ELSE max(t) - min(t) END AS span, count(*) AS n, avg(mx) AS x, avg(my) AS y, sum(mx) AS sx, sum(my) AS sy FROM p6 WHERE NOT blocked GROUP BY a, b, run)"""


def fronts(b: Building) -> DataFrame:
    """Ordered pairs of rooms with boxes within reach of each other."""
    s = b.spaces().select("space", "storey", "x0", "y0", "x1", "y1", "ring")
    met = spatial.boxes_to_boxes(s, s, on=["storey"], pad=interfaces.GAP).filter("space_l <> space_r")
    return met.select(F.col("space_l").alias("a"), F.col("space_r").alias("b"), "storey", F.col("ring_l").alias("ring_a"), F.col("ring_r").alias("ring_b"))


def walls(b: Building) -> DataFrame:
    """To the right of rooms whose key's remainder by four is 0 (all along) or 1 (the first 1.2 metres)."""
    top = F.when(F.col("s") % 4 == 0, F.col("y1") + 0.1).otherwise(F.col("y0") + 1.2)
    return b.spaces().filter("s % 4 < 2").select("storey", g.box_ring(F.col("x1") + 0.02, F.col("y0") - 0.1, F.col("x1") + 0.18, top).alias("ring"))


def openings(b: Building) -> DataFrame:
    """In the walls along whole rooms: doorways where the key's remainder by eight is 0, else slots; some are low, so nobody passes."""
    wide = F.col("s") % 8 == 0
    low, high = F.col("y0") + F.when(wide, 1.55).otherwise(1.875), F.col("y0") + F.when(wide, 2.45).otherwise(2.125)
    head = F.when(F.col("s") % 12 == 4, 1.2).otherwise(2.1)
    ring = g.box_ring(F.col("x1") - 0.02, low, F.col("x1") + 0.22, high)
    middle = [(F.col("x1") + 0.1).alias("x"), ((low + high) / 2).alias("y")]
    return b.spaces().filter("s % 4 = 0").select("s", "storey", *middle, ring.alias("ring"), F.lit(True).alias("host_is_wall"), F.lit(0.0).alias("sill_z"), head.alias("head_z"))


def voids(b: Building) -> DataFrame:
    return interfaces.walkable_voids(openings(b))


def strips(b: Building) -> DataFrame:
    return interfaces.blocked_samples(graph.kept(interfaces.strip_samples(fronts(b))), walls(b), voids(b))


@query("WITH " + FRONTS + """, both_ways AS (SELECT a, b, d FROM nr UNION ALL SELECT b, a, d FROM nr)
SELECT a, b, round(count(*) * 0.12e0 / 2, 6) AS length, round(avg(d), 6) AS gap FROM both_ways GROUP BY a, b HAVING count(*) * 0.12e0 / 2 >= 0.5e0""")
def front_lengths(b: Building) -> DataFrame:
    """Length and mean gap of the front that two rooms share, from samples of both outlines."""
    return interfaces.interface_lengths(fronts(b)).select("a", "b", r6("length").alias("length"), r6("gap").alias("gap"))


@query("WITH " + RUNS + "SELECT a, b, round(start, 6) AS start, round(span, 6) AS span, n, round(x, 6) AS x, round(y, 6) AS y FROM runs")
def frontage_runs(b: Building) -> DataFrame:
    """Runs of the front that no wall blocks, doorways cut out of walls."""
    return interfaces.clear_runs(strips(b)).select("a", "b", *(r6(c).alias(c) for c in ("start", "span")), "n", r6("x").alias("x"), r6("y").alias("y"))


@query("WITH " + RUNS + """, al AS (SELECT a, b, count(*) AS n FROM md GROUP BY a, b),
bs AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(span, 9) DESC, start) AS place, sum(n) OVER w AS clear, sum(sx) OVER w AS tx, sum(sy) OVER w AS ty FROM runs WINDOW w AS (PARTITION BY a, b))
SELECT bs.a, bs.b, round(span, 6) AS span, round(CASE WHEN clear / al.n >= 0.7e0 THEN tx / clear ELSE x END, 6) AS x, round(CASE WHEN clear / al.n >= 0.7e0 THEN ty / clear ELSE y END, 6) AS y
FROM bs JOIN al ON al.a = bs.a AND al.b = bs.b WHERE place = 1 AND al.n >= 2 AND round(span, 9) >= 0.7e0""")
def strip_portals(b: Building) -> DataFrame:
    """Where someone gets from one room to the other through the front."""
    return interfaces.strip_portals(strips(b)).select("a", "b", *(r6(c).alias(c) for c in ("span", "x", "y")))
