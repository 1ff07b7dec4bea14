"""Registered queries about routes on the derived building: hops with their paths, blocked rooms and doors, steps, storeys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import evacuation, graph, paths, routing
from plinth.plans.building import Building
from plinth.plans.queries import query
from plinth.sources import artifacts

_ROUTES = """u0 AS (SELECT door, a, b FROM doors WHERE b IS NOT NULL AND a <> b {open}),
u AS (SELECT a, b, max(door) AS edge FROM (SELECT a, b, door FROM u0 UNION ALL SELECT b, a, door FROM u0) GROUP BY a, b),
h(node, hops) USING KEY (node) AS (SELECT DISTINCT a, 0::BIGINT FROM doors WHERE b IS NULL {goals} UNION SELECT u.b, min(h.hops + 1) FROM h JOIN u ON u.a = h.node LEFT JOIN recurring.h r ON r.node = u.b WHERE r.hops IS NULL OR h.hops + 1 < r.hops GROUP BY u.b),
nx AS (SELECT h.node, h.hops, min(k.node) AS next FROM h JOIN u ON u.a = h.node JOIN h k ON k.node = u.b AND k.hops = h.hops - 1 GROUP BY h.node, h.hops),
p AS (SELECT node, hops, [node] AS path FROM h WHERE hops = 0 UNION ALL SELECT nx.node, nx.hops, list_prepend(nx.node, p.path) FROM nx JOIN p ON p.node = nx.next)
"""
_OPEN = _ROUTES.format(open="", goals="")
#: Rooms whose key ends in 0 are blocked, and doors whose keys' sum ends in 7.
_BLOCKED = """br AS (SELECT space AS node FROM spaces WHERE s % 10 = 0),
bd AS (SELECT door FROM doors WHERE b IS NOT NULL AND (CAST(substr(a, 2) AS BIGINT) + CAST(substr(b, 2) AS BIGINT)) % 10 = 7),
""" + _ROUTES.format(open="AND door NOT IN (SELECT door FROM bd) AND a NOT IN (SELECT node FROM br) AND b NOT IN (SELECT node FROM br)", goals="AND a NOT IN (SELECT node FROM br)")


def _goals(b: Building) -> DataFrame:
    return b.doors().filter("b is null").select(F.col("a").alias("node"))


def _edges(b: Building) -> DataFrame:
    return b.doors().select(F.col("door").alias("edge"), "a", "b")


def _blocked(b: Building) -> tuple[DataFrame, DataFrame]:
    rooms = b.spaces().filter("s % 10 = 0").select(F.col("space").alias("node"))
    total = F.substring("a", 2, 99).cast("bigint") + F.substring("b", 2, 99).cast("bigint")
    return rooms, b.doors().filter(total % 10 == 7).select(F.col("door").alias("edge"))


@query("WITH RECURSIVE " + _OPEN + "SELECT node, hops, array_to_string(path, '>') AS path FROM p")
def hop_route(b: Building) -> DataFrame:
    """From every room that has one, the route of fewest doors to an exit: rooms in order."""
    found = routing.routes(routing.routable(_edges(b)), _goals(b))
    return found.select("node", "hops", F.array_join("path", ">").alias("path"))


@query("WITH RECURSIVE " + _BLOCKED + """SELECT s.space AS node, p.node IS NOT NULL AS found, p.hops, array_to_string(p.path, '>') AS path,
CASE WHEN s.s % 10 = 0 THEN 'Origin or destination is blocked.' WHEN p.node IS NULL THEN 'No path exists.' END AS message FROM spaces s LEFT JOIN p ON p.node = s.space""")
def hop_route_blocked(b: Building) -> DataFrame:
    """The same with rooms and doors blocked, an answer for every room."""
    rooms, doors = _blocked(b)
    goals = _goals(b).join(rooms, "node", "left_anti")
    found = routing.routes(routing.routable(_edges(b), rooms, doors), goals)
    told = routing.answers(b.spaces().select(F.col("space").alias("node")), found, rooms)
    return told.select("node", "found", "hops", F.array_join("path", ">").alias("path"), "message")


@query("WITH RECURSIVE " + _OPEN + """, e AS (SELECT node, generate_subscripts(path, 1) - 1 AS step, unnest(path) AS place FROM p),
f AS (SELECT node, step, place, lead(place) OVER (PARTITION BY node ORDER BY step) AS nxt FROM e)
SELECT f.node, CAST(f.step AS INTEGER) AS step, f.place AS "from", f.nxt AS "to", u.edge FROM f JOIN u ON u.a = f.place AND u.b = f.nxt""")
def route_steps(b: Building) -> DataFrame:
    """Each route's steps with the door that each goes through."""
    ways = graph.kept(routing.routable(_edges(b)))
    return routing.steps(routing.routes(ways, _goals(b)), ways)


@query("""WITH d AS (SELECT door FROM links WHERE space NOT IN (SELECT space FROM spaces WHERE s % 4 <> 0) UNION SELECT door FROM doors WHERE false)
SELECT door FROM d WHERE door NOT LIKE '%7'""")
def open_portals(b: Building) -> DataFrame:
    """Portals that stay open where rooms and doors are blocked: one is lost when all its rooms are."""
    rooms = b.spaces().filter("s % 4 <> 0").select("space")
    return routing.open_portals(b.links(), rooms, b.doors().filter("door like '%7'").select("door"))


@query("""WITH x AS (SELECT door FROM doors WHERE door LIKE 'D%1'), y AS (SELECT door FROM doors WHERE door LIKE '%1' AND storey <> 'L2')
SELECT DISTINCT storey FROM doors WHERE door IN ((SELECT * FROM x EXCEPT SELECT * FROM y) UNION (SELECT * FROM y EXCEPT SELECT * FROM x))""")
def affected_storeys(b: Building) -> DataFrame:
    """Storeys to build anew after the set of excluded doors has changed."""
    d = b.doors()
    return routing.touched_storeys(d.filter("door like 'D%1'"), d.filter("door like '%1' and storey <> 'L2'"), d)


@query("""WITH e AS (SELECT user_id, event_id, event_type FROM events), l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM e)
SELECT user_id, event_id, event_type FROM l WHERE was IS NULL OR was <> event_type""")
def consecutive_once(b: Building) -> DataFrame:
    """A path's regions without consecutive repeats; each user's events are a path, its types the regions."""
    return routing.without_repeats(b.table("events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("""WITH e AS (SELECT user_id, event_id, 'L' || (event_id * 7 // 40 % 5) AS storey FROM events),
l AS (SELECT *, CASE WHEN lag(storey) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM storey THEN 0 ELSE 1 END AS brk FROM e),
g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS segment FROM l)
SELECT user_id, CAST(segment AS BIGINT) AS segment, storey, min(event_id) AS "first", max(event_id) AS "last", count(*) AS n FROM g GROUP BY user_id, segment, storey""")
def path_segments(b: Building) -> DataFrame:
    """A path is cut where its storey changes."""
    storey = F.concat(F.lit("L"), F.floor(F.col("event_id") * 7 / F.lit(40)) % 5)
    return routing.segments(b.table("events").select("user_id", "event_id", storey.alias("storey")), "user_id", "event_id", "storey")


# --- walks between points ---------------------------------------------------------------------------


def _asked(b: Building) -> DataFrame:
    """From the middle of every third room to a place in the room of seven times its key and three, over all storeys."""
    s = b.spaces().select("space", "s", "storey", "x0", "y0", "x1", "y1")
    n = s.agg((F.max("s") + 1).alias("n"))  # one row
    a = s.filter("s % 3 = 0").crossJoin(F.broadcast(n)).select(F.col("space").alias("query"), ((F.col("s") * 7 + 3) % F.col("n")).alias("goal"), F.col("storey").alias("from_storey"), ((F.col("x0") + F.col("x1")) / 2).alias("from_x"), ((F.col("y0") + F.col("y1")) / 2).alias("from_y"))
    g = s.select(F.col("s").alias("goal"), F.col("storey").alias("to_storey"), (F.col("x0") + 1.0).alias("to_x"), (F.col("y0") + 1.5).alias("to_y"))
    return a.join(g, "goal").drop("goal")


def _walks(b: Building) -> DataFrame:
    spaces, doors = graph.kept(b.spaces()), graph.kept(b.doors())
    links = graph.kept(doors.select("door", F.col("a").alias("space")).union(doors.filter("b is not null").select("door", "b")))
    st = b.stairs().select("stair", "storey", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    landing = graph.kept(evacuation.landings(st, spaces, b.storeys()))
    return paths.between(_asked(b), spaces, links, doors, landing)


_WALKS = """WITH RECURSIVE lv AS (SELECT storey, elevation, row_number() OVER (ORDER BY elevation, storey) AS k FROM storeys),
ls AS (SELECT s.stair, t.storey, t.elevation, min(r.space) AS space FROM (SELECT *, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM stairs) s JOIN lv o ON o.storey = s.storey JOIN lv t ON t.k IN (o.k, o.k + 1)
       JOIN spaces r ON r.storey = t.storey AND s.x BETWEEN r.x0 AND r.x1 AND s.y BETWEEN r.y0 AND r.y1 GROUP BY s.stair, t.storey, t.elevation),
nd AS (SELECT 'p:' || door AS node, space, storey, x, y FROM links JOIN doors USING (door) UNION ALL SELECT 'v:' || stair || '@' || ls.storey, ls.space, ls.storey, (x0 + x1) / 2, (y0 + y1) / 2 FROM ls JOIN spaces USING (space)),
ed AS (SELECT f, t, min(cost) AS cost FROM (SELECT a.node AS f, b.node AS t, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS cost FROM nd a JOIN nd b ON a.space = b.space AND a.node <> b.node
       UNION ALL SELECT 'v:' || a.stair || '@' || a.storey, 'v:' || b.stair || '@' || b.storey, greatest(abs(a.elevation - b.elevation), 1e0) FROM ls a JOIN ls b ON a.stair = b.stair AND a.elevation <> b.elevation) GROUP BY f, t),
aq AS (SELECT a.space AS query, a.space AS sa, a.storey AS fs, (a.x0 + a.x1) / 2 AS fx, (a.y0 + a.y1) / 2 AS fy, b.space AS sb, b.storey AS ts, b.x0 + 1 AS tx, b.y0 + 1.5e0 AS ty FROM spaces a JOIN spaces b ON b.s = (a.s * 7 + 3) % (SELECT max(s) + 1 FROM spaces) WHERE a.s % 3 = 0),
s0 AS (SELECT query, node, min(sqrt(power(x - fx, 2) + power(y - fy, 2))) AS d FROM aq JOIN nd ON nd.space = sa GROUP BY query, node),
g0 AS (SELECT query, node, min(sqrt(power(x - tx, 2) + power(y - ty, 2))) AS rest FROM aq JOIN nd ON nd.space = sb GROUP BY query, node),
di(query, node, d) USING KEY (query, node) AS (SELECT query, node, d FROM s0
   UNION SELECT di.query, ed.t, min(di.d + ed.cost) FROM di JOIN ed ON ed.f = di.node LEFT JOIN recurring.di r ON r.query = di.query AND r.node = ed.t WHERE r.d IS NULL OR di.d + ed.cost < r.d - 1e-9 GROUP BY di.query, ed.t),
ch AS (SELECT query, d + rest AS cost, node FROM di JOIN g0 USING (query, node) UNION ALL SELECT query, sqrt(power(fx - tx, 2) + power(fy - ty, 2)), '' FROM aq WHERE sa = sb),
be AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(cost, 7), node) = 1),
pr AS (SELECT b.query, b.node, min(a.node) AS prior FROM di b JOIN ed ON ed.t = b.node JOIN di a ON a.query = b.query AND a.node = ed.f LEFT JOIN s0 ON s0.query = b.query AND s0.node = b.node
       WHERE a.d + ed.cost <= b.d + 1e-7 AND a.d < b.d - 1e-7 AND NOT coalesce(s0.d <= b.d + 1e-7, false) GROUP BY b.query, b.node),
bk AS (SELECT query, node, 0 AS k FROM be WHERE node <> '' UNION ALL SELECT bk.query, pr.prior, bk.k + 1 FROM bk JOIN pr ON pr.query = bk.query AND pr.node = bk.node),
pl AS (SELECT DISTINCT node, storey, x, y FROM nd),
wk AS (SELECT query, -k AS o, node, storey, x, y FROM bk JOIN pl USING (node) UNION ALL SELECT query, -1000000000, NULL, fs, fx, fy FROM aq JOIN be USING (query) UNION ALL SELECT query, 1, NULL, ts, tx, ty FROM aq JOIN be USING (query)),
st AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY o) - 1 AS step FROM wk)
"""


@query(_WALKS + "SELECT st.query, round(be.cost, 6) AS cost, step, st.node, storey, round(x, 6) AS x, round(y, 6) AS y FROM st JOIN be USING (query)")
def point_walks(b: Building) -> DataFrame:
    """Places of the shortest walks between pairs of points, over doors, stairs and storeys."""
    return _walks(b).select("query", F.round("cost", 6).alias("cost"), F.col("step").cast("bigint").alias("step"), "node", "storey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(_WALKS + """, sg AS (SELECT *, coalesce(lag(storey) OVER w = storey, false) AS same, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS size FROM st WINDOW w AS (PARTITION BY query ORDER BY step)),
sn AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY query ORDER BY step) - 1 AS segment FROM sg)
SELECT query, CAST(segment AS BIGINT) AS segment, storey, count(*) AS n, round(coalesce(sum(CASE WHEN same THEN size END), 0), 6) AS length FROM sn WHERE NOT same OR size > 1e-9 GROUP BY query, segment, storey""")
def walk_stretches(b: Building) -> DataFrame:
    """The walks' stretches on each storey, without places that repeat."""
    return paths.stretches(_walks(b)).select("query", F.col("segment").cast("bigint").alias("segment"), "storey", "n", F.round("length", 6).alias("length"))


# --- routes on stored variants: every room asks for the way to its storey's first room, with blocks of its own ----------------


def _stored(b: Building) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of two graphs kept as artifacts: one without the doors whose keys' sum is divisible by 7, one with all."""
    doors, total = b.doors().filter("b is not null"), F.substring("a", 2, 99).cast("bigint") + F.substring("b", 2, 99).cast("bigint")
    edges = doors.select(F.lit("ifc").alias("variant"), F.col("door").alias("edge"), "a", "b").filter(total % 7 != 0).union(doors.select(F.lit("geometry"), "door", "a", "b"))
    nodes = b.spaces().select(F.explode(F.array(F.lit("ifc"), F.lit("geometry"))).alias("variant"), F.col("space").alias("node"))
    folder = graph.scratch(b.spark, "variants")
    for name, rows in (("edges", edges), ("nodes", nodes)):
        artifacts.write_artifact(rows.withColumn("model_id", F.lit("m")), f"{folder}/{name}")
    read = lambda name: b.spark.read.parquet(f"{folder}/{name}").filter("model_id = 'm'").drop("model_id")
    return read("edges"), read("nodes")


def _variant_routes(b: Building) -> tuple[DataFrame, DataFrame]:
    rooms = graph.kept(b.spaces().select("s", "space", "storey"))
    first = rooms.groupBy("storey").agg(F.min_by("space", "s").alias("first"))
    s = F.col("s")
    variant = F.when(s % 17 == 0, "topologic").when(s % 3 == 1, "geometry").when(s % 3 == 2, "ifc")
    asked = rooms.join(first, "storey").select(F.col("space").alias("query"), "s", "storey", variant.alias("variant"), F.col("space").alias("origin"), F.when(s % 19 == 0, "none").otherwise(F.col("first")).alias("destination"))
    shut = asked.filter(s % 4 == 1).select("query", "storey").join(rooms.filter("s % 10 = 7").select("storey", F.col("space").alias("node")), "storey")
    total = F.substring("a", 2, 99).cast("bigint") + F.substring("b", 2, 99).cast("bigint")
    closed = asked.filter(s % 4 == 2).select("query", "storey").join(b.doors().filter("b is not null").filter(total % 10 == 3).select("storey", F.col("door").alias("edge")), "storey")
    return routing.asked_routes(*_stored(b), asked, shut, closed)


_VARIANTS = """nn AS (SELECT door AS edge, storey, a, b, CAST(substr(a, 2) AS BIGINT) + CAST(substr(b, 2) AS BIGINT) AS total FROM doors WHERE b IS NOT NULL),
ge AS (SELECT 'ifc' AS variant, * FROM nn WHERE total % 7 <> 0 UNION ALL SELECT 'geometry', * FROM nn),
wy AS (SELECT variant, edge, storey, total, a, b FROM ge UNION ALL SELECT variant, edge, storey, total, b, a FROM ge),
aq AS (SELECT s, space AS query, storey, CASE WHEN s % 17 = 0 THEN 'topologic' WHEN s % 3 = 1 THEN 'geometry' ELSE 'ifc' END AS variant, CASE WHEN s % 19 = 0 THEN 'none' ELSE 'R' || min(s) OVER (PARTITION BY storey) END AS dest FROM spaces),
am AS (SELECT *, CASE WHEN variant = 'topologic' THEN 'Graph variant ''topologic'' not found.' WHEN s % 4 = 1 AND (s % 10 = 7 OR coalesce(TRY_CAST(substr(dest, 2) AS BIGINT) % 10 = 7, false)) THEN 'Origin or destination is blocked.'
  WHEN dest = 'none' THEN 'Origin or destination node id not found in graph.' END AS bad FROM aq),
qw AS (SELECT q.query, w.a, w.b, w.edge FROM am q JOIN wy w ON w.variant = q.variant AND w.storey = q.storey WHERE bad IS NULL AND NOT (q.s % 4 = 1 AND (CAST(substr(w.a, 2) AS BIGINT) % 10 = 7 OR CAST(substr(w.b, 2) AS BIGINT) % 10 = 7)) AND NOT (q.s % 4 = 2 AND w.total % 10 = 3)),
fr(query, node, hops) USING KEY (query, node) AS (SELECT query, dest, 0::BIGINT FROM am WHERE bad IS NULL UNION SELECT qw.query, qw.b, min(fr.hops + 1) FROM fr JOIN qw ON qw.query = fr.query AND qw.a = fr.node LEFT JOIN recurring.fr r ON r.query = qw.query AND r.node = qw.b WHERE r.hops IS NULL OR fr.hops + 1 < r.hops GROUP BY qw.query, qw.b),
"""


@query("WITH RECURSIVE " + _VARIANTS.rstrip().rstrip(",") + """ SELECT q.query, q.variant, fr.hops IS NOT NULL AS found, fr.hops, coalesce(q.bad, CASE WHEN fr.hops IS NULL THEN 'No path exists.' ELSE 'Shortest path found.' END) AS message
FROM am q LEFT JOIN fr ON fr.query = q.query AND fr.node = q.query AND q.bad IS NULL""")
def variant_routes(b: Building) -> DataFrame:
    """Each room's answer on the stored graph that it names."""
    return _variant_routes(b)[0]


@query("WITH RECURSIVE " + _VARIANTS + """nt AS (SELECT f.query, f.node, f.hops, min(qw.b) AS nxt FROM fr f JOIN qw ON qw.query = f.query AND qw.a = f.node JOIN fr k ON k.query = f.query AND k.node = qw.b AND k.hops = f.hops - 1 GROUP BY f.query, f.node, f.hops),
sp AS (SELECT query, 0 AS step, node AS "from", nxt AS "to" FROM nt WHERE node = query UNION ALL SELECT sp.query, sp.step + 1, sp."to", nt.nxt FROM sp JOIN nt ON nt.query = sp.query AND nt.node = sp."to")
SELECT sp.query, sp.step, sp."from", sp."to", qw.edge FROM sp JOIN qw ON qw.query = sp.query AND qw.b = sp."to" AND sp."from" = qw.a""")
def variant_route_steps(b: Building) -> DataFrame:
    """The steps of these routes, with the doors."""
    return _variant_routes(b)[1]
