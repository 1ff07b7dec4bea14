"""Registered queries of what a plan shows on the derived building: places of portals, rooms within reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators import display, graph
from plinth.plans.building import Building
from plinth.plans.queries import query

_KEYS = "k AS (SELECT *, CAST(substr(a, 2) AS BIGINT) AS ka, CAST(substr(b, 2) AS BIGINT) AS kb FROM doors WHERE b IS NOT NULL)"


@query("WITH " + _KEYS + """, m AS (SELECT space, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM spaces),
re AS (SELECT least(a, b) AS p, greatest(a, b) AS q, min(door) AS door FROM k WHERE ka % 4 <> 3 GROUP BY 1, 2),
pt AS (SELECT 'viz-door:' || k.door || ':' || least(a, b) || ':' || greatest(a, b) AS edge, CASE ka % 4 WHEN 0 THEN x WHEN 1 THEN x + 0.5e0 * ny ELSE coalesce(r.rx, (ma.cx + mb.cx) / 2) END AS x, CASE ka % 4 WHEN 0 THEN y WHEN 1 THEN y + 0.5e0 * nx ELSE coalesce(r.ry, (ma.cy + mb.cy) / 2) END AS y
 FROM k LEFT JOIN (SELECT p, q, x + 0.25e0 AS rx, y - 0.25e0 AS ry FROM re JOIN doors USING (door)) r ON r.p = least(k.a, k.b) AND r.q = greatest(k.a, k.b) JOIN m ma ON ma.space = a JOIN m mb ON mb.space = b)
SELECT edge, round(x, 6) AS x, round(y, 6) AS y FROM pt""")
def portal_places(b: Building) -> DataFrame:
    """Where display edges stand: doors with a place, with a segment, with an edge of their rooms, with neither."""
    ka = F.substring("a", 2, 18).cast("bigint")
    d = b.doors().filter("b is not null").withColumn("ka", ka)
    x, y, side = F.col("x"), F.col("y"), F.col("ka") % 4
    ends = F.array(g.point(x, y), g.point(x + F.col("ny"), y + F.col("nx")))
    doors = d.select("door", F.when(side == 0, x).alias("x"), F.when(side == 0, y).alias("y"), F.when(side == 1, ends).alias("segment"))
    room = lambda c: F.concat(F.lit("space:"), c)
    edges = graph.display_edges(b.doors()).select("edge", "door", room("source").alias("source"), room("target").alias("target"))
    real = d.filter(side != 3).select(F.col("door").alias("id"), room("a").alias("source"), room("b").alias("target"), (x + 0.25).alias("x"), (y - 0.25).alias("y"))
    found = display.portal_points(edges, doors, real, b.spaces().select("space", "ring"))
    return found.select("edge", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH RECURSIVE fr AS (SELECT door, space FROM links WHERE space NOT IN (SELECT space FROM spaces WHERE s % 13 = 5) AND door NOT IN (SELECT door FROM doors WHERE CAST(substr(a, 2) AS BIGINT) % 29 = 3)),
w AS (SELECT space FROM spaces WHERE col = 0 AND s % 13 <> 5 AND row % 4 = 0 UNION SELECT q.space FROM w JOIN fr p ON p.space = w.space JOIN fr q ON q.door = p.door) SELECT space FROM w""")
def rooms_in_reach(b: Building) -> DataFrame:
    """Open rooms that open portals lead to from the first room of every fourth row."""
    s = b.spaces()
    shut = b.doors().filter(F.substring("a", 2, 18).cast("bigint") % 29 == 3).select("door")
    return display.reachable(s.filter("col = 0 and row % 4 = 0").select("space"), b.links(), s.filter("s % 13 = 5").select("space"), shut)
