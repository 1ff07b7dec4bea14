"""Registered queries of lines of sight on the derived building: what stands in rooms, doorways, lines between corners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators import sight
from plinth.plans import interfaces as fronts
from plinth.plans.building import Building
from plinth.plans.queries import query


def rooms(b: Building) -> DataFrame:
    return b.spaces().select("space", "storey", "ring", F.array().cast("array<array<struct<x:double,y:double>>>").alias("holes"))


def furniture(b: Building) -> DataFrame:
    """Every ninth piece, so that some lines are free."""
    x, y = F.col("x"), F.col("y")
    return b.furniture().filter("p % 9 = 0").select("item", "storey", g.box_ring(x, y, x + F.col("w"), y + F.col("d")).alias("ring"))


def openings(b: Building) -> DataFrame:
    return fronts.openings(b).select(F.concat(F.lit("O"), "s").alias("opening"), "x", "y", "ring", "host_is_wall", F.when(F.col("s") % 3 == 0, F.concat(F.lit("W"), "s")).alias("window"))


#: Boxes: a vertex, an edge's middle or the middle in the other, half-open as the even-odd rule is.
_FURNITURE = """fu AS (SELECT item, storey, x AS u0, y AS v0, x + w AS u1, y + d AS v1 FROM furniture WHERE p % 9 = 0),
fr AS (SELECT DISTINCT item, space, u0, v0, u1, v1 FROM (SELECT *, unnest([u0, u1, u1, u0, (u0 + u1) / 2, (u0 + u1) / 2, u1, (u0 + u1) / 2, u0]) AS px, unnest([v0, v0, v1, v1, (v0 + v1) / 2, v0, (v0 + v1) / 2, v1, (v0 + v1) / 2]) AS py,
   unnest([x0, x1, x1, x0, x0, x0, x0, x0, x0]) AS qx, unnest([y0, y0, y1, y1, y0, y0, y0, y0, y0]) AS qy FROM fu JOIN spaces USING (storey) WHERE u0 <= x1 AND x0 <= u1 AND v0 <= y1 AND y0 <= v1)
   WHERE (px >= x0 AND px < x1 AND py >= y0 AND py < y1) OR (qx >= u0 AND qx < u1 AND qy >= v0 AND qy < v1))"""


@query("WITH " + _FURNITURE + "SELECT item, space FROM fr")
def obstacles_in_rooms(b: Building) -> DataFrame:
    """Furniture that overlaps a room."""
    return sight.in_rooms(furniture(b), rooms(b))


_DOORWAYS = """vd AS (SELECT 'O' || s AS opening, x1 - 0.02e0 AS u0, CASE WHEN s % 8 = 0 THEN y0 + 1.55e0 ELSE y0 + 1.875e0 END AS v0, x1 + 0.22e0 AS u1, CASE WHEN s % 8 = 0 THEN y0 + 2.45e0 ELSE y0 + 2.125e0 END AS v1 FROM spaces WHERE s % 4 = 0 AND s % 3 <> 0),
dw AS (SELECT DISTINCT opening, space, u0, v0, u1, v1 FROM (SELECT *, unnest([u0, u1, u1, u0, u0 + 0.12e0]) AS px, unnest([v0, v0, v1, v1, (v0 + v1) / 2]) AS py FROM vd JOIN spaces ON u0 <= x1 AND x0 <= u1 AND v0 <= y1 AND y0 <= v1) WHERE px >= x0 AND px < x1 AND py >= y0 AND py < y1)"""


@query("WITH " + _DOORWAYS + "SELECT opening, space FROM dw")
def doorways_in_rooms(b: Building) -> DataFrame:
    """Openings in walls that reach into a room, of all storeys."""
    return sight.doorways(openings(b), rooms(b))


@query("WITH " + _FURNITURE + """, ln AS (SELECT space, x0, y0, x1, y1, unnest(['d', 'u', 'l', 'r', 'w']) AS way, unnest([x0 + 0.6e0, x0 + 0.6e0, x0 + 0.7e0, x1 - 0.7e0, x0 + 0.3e0]) AS ax, unnest([y0 + 0.6e0, y1 - 0.6e0, y0 + 0.5e0, y0 + 0.5e0, y0 + 0.5e0]) AS ay,
   unnest([x1 - 0.6e0, x1 - 0.6e0, x0 + 0.7e0, x1 - 0.7e0, x0 + 0.3e0]) AS ex, unnest([y1 - 0.6e0, y0 + 0.6e0, y1 - 0.5e0, y1 - 0.5e0, y1 - 0.5e0]) AS ey FROM spaces),
nl AS (SELECT *, greatest(1, ceil(sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) / 0.05e0)) AS n FROM ln),
sm AS (SELECT space, way, x0, y0, x1, y1, ax + k / n * (ex - ax) AS x, ay + k / n * (ey - ay) AS y FROM (SELECT *, unnest(range(1, CAST(n AS BIGINT))) AS k FROM nl)),
b0 AS (SELECT DISTINCT space, way FROM sm WHERE NOT (x >= x0 AND x < x1 AND y >= y0 AND y < y1) OR least(x - x0, x1 - x, y - y0, y1 - y) < 0.4e0),
b1 AS (SELECT DISTINCT sm.space, way FROM sm JOIN fr ON fr.space = sm.space AND x BETWEEN u0 - 0.045e0 AND u1 + 0.045e0 AND y BETWEEN v0 - 0.045e0 AND v1 + 0.045e0)
SELECT space || ':' || way AS line, (space, way) NOT IN (SELECT (space, way) FROM b0) AND (space, way) NOT IN (SELECT (space, way) FROM b1) AS clear FROM ln""")
def sight_lines(b: Building) -> DataFrame:
    """Whether both diagonals, two lines along the walls and one close to a wall are free in each room."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    line = lambda way, *ends: F.struct(F.lit(way).alias("way"), *(v.alias(n) for v, n in zip(ends, ("ax", "ay", "bx", "by"), strict=True)))
    every = F.array(
        line("d", x0 + 0.6, y0 + 0.6, x1 - 0.6, y1 - 0.6), line("u", x0 + 0.6, y1 - 0.6, x1 - 0.6, y0 + 0.6), line("l", x0 + 0.7, y0 + 0.5, x0 + 0.7, y1 - 0.5), line("r", x1 - 0.7, y0 + 0.5, x1 - 0.7, y1 - 0.5),
        line("w", x0 + 0.3, y0 + 0.5, x0 + 0.3, y1 - 0.5),
    )
    lines = b.spaces().select("space", F.explode(every).alias("e")).select(F.concat_ws(":", "space", "e.way").alias("line"), "space", "e.ax", "e.ay", "e.bx", "e.by")
    items, doors = furniture(b), openings(b)
    inside = sight.in_rooms(items, rooms(b)).join(items.select("item", "ring"), "item").select("space", "ring")
    voids = sight.doorways(doors, rooms(b)).join(doors.select("opening", "ring"), "opening").select("space", "ring")
    return sight.sight(lines, rooms(b), inside, voids)
