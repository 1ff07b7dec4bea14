"""Registered queries about catalogues, labels and level statistics on the derived building."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators import graph
from plinth.plans.building import Building
from plinth.plans.queries import query

r6 = lambda c: F.round(c, 6)


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value): each key's value at floor(n / 2) in order, from 0: the larger of the two middle ones; no key meets in one task."""
    some = rows.filter(F.col(value).isNotNull()).select(by, value)
    half = some.groupBy(by).agg((F.floor(F.count(F.lit(1)) / 2) + 1).alias("__half"))
    return placed(some, by, [value]).join(half, by).filter(F.col("place") == F.col("__half")).select(by, value)


@query("""WITH c AS (SELECT 'region' AS section, space AS id, name AS title, storey FROM spaces UNION ALL SELECT 'exit', door, door, storey FROM doors WHERE b IS NULL
UNION ALL SELECT 'stair', stair, name, CASE WHEN n % 7 = 0 THEN NULL ELSE storey END FROM stairs)
SELECT section, id, title, row_number() OVER (PARTITION BY section ORDER BY lower(title), title, id) AS place FROM c WHERE section IN ('region', 'stair') AND (storey = 'L1' OR storey IS NULL)""")
def catalog_page(b: Building) -> DataFrame:
    """Sections filtered by category and level (rows without a storey stay), in order of their titles."""
    c = b.spaces().select(F.lit("region").alias("section"), F.col("space").alias("id"), F.col("name").alias("title"), "storey")
    c = c.union(b.doors().filter("b is null").select(F.lit("exit"), "door", "door", "storey"))
    c = c.union(b.stairs().select(F.lit("stair"), "stair", "name", F.when(F.col("n") % 7 != 0, F.col("storey"))))
    shown = c.filter(F.col("section").isin("region", "stair") & ((F.col("storey") == "L1") | F.col("storey").isNull()))
    return placed(shown.select("section", "id", "title"), "section", [F.lower("title"), "title", "id"])


@query("""SELECT storey, round(list_sort(list(x1 - x0))[CAST(floor(count(*) / 2e0) AS BIGINT) + 1], 6) AS span, round(list_sort(list(y1))[CAST(floor(count(*) / 2e0) AS BIGINT) + 1], 6) AS top FROM spaces GROUP BY storey""")
def median_spans(b: Building) -> DataFrame:
    """Upper medians of the rooms' widths and tops on each storey."""
    s = b.spaces().select("storey", (F.col("x1") - F.col("x0")).alias("w"), "y1")
    return upper_median(s, "storey", "w").join(upper_median(s, "storey", "y1"), "storey").select("storey", r6("w").alias("span"), r6("y1").alias("top"))


@query("""SELECT storey, 'Level ' || row_number() OVER (ORDER BY elevation) AS label, printf('storey_%.3f', elevation) AS level_id FROM storeys""")
def level_names(b: Building) -> DataFrame:
    """Levels numbered from below, with ids from their elevations; a row for each region, five at any scale."""
    n = F.row_number().over(Window.orderBy("elevation"))
    return b.storeys().select("storey", F.concat(F.lit("Level "), n).alias("label"), F.format_string("storey_%.3f", "elevation").alias("level_id"))


@query("""WITH v AS (SELECT storey, space, s % 10 AS people, CASE WHEN s % 6 <> 0 THEN (s * 37 % 50) / 10e0 END AS metres FROM spaces)
SELECT space, round(people / max(people) OVER (PARTITION BY storey), 6) AS crowd, round(coalesce(metres / max(metres) OVER (PARTITION BY storey), 1), 6) AS far FROM v""")
def normalised_heat(b: Building) -> DataFrame:
    """Signals over the largest of the storey; what can't be reached is 1."""
    v = b.spaces().select("storey", "space", (F.col("s") % 10).alias("people"), F.when(F.col("s") % 6 != 0, F.col("s") * 37 % 50 / 10.0).alias("metres"))
    most = v.groupBy("storey").agg(F.max("people").alias("most_people"), F.max("metres").alias("most_metres"))  # one row a storey, not a window over its rooms
    far = F.coalesce(F.col("metres") / F.col("most_metres"), F.lit(1.0))
    return v.join(most, "storey").select("space", r6(F.col("people") / F.col("most_people")).alias("crowd"), r6(far).alias("far"))


@query("""WITH t AS (SELECT door AS id, 'Door ' || door AS label FROM doors UNION ALL SELECT stair, name FROM stairs WHERE n % 3 <> 0)
SELECT k.id, coalesce(t.label, k.id) AS label, coalesce(st.name, k.storey) AS level FROM (SELECT door AS id, storey FROM doors UNION ALL SELECT stair, storey FROM stairs) k LEFT JOIN t ON t.id = k.id LEFT JOIN storeys st ON st.storey = k.storey""")
def label_enrichment(b: Building) -> DataFrame:
    """Names of portals, stairs and storeys for ids, which stand for themselves where there is none."""
    ids = b.doors().select(F.col("door").alias("id"), "storey").union(b.stairs().select("stair", "storey"))
    names = b.doors().select(F.col("door").alias("id"), F.concat(F.lit("Door "), "door").alias("label")).union(b.stairs().filter("n % 3 <> 0").select("stair", "name"))
    levels = b.storeys().select("storey", F.col("name").alias("level_name"))
    named = ids.join(names, "id", "left").join(levels, "storey", "left")
    return named.select("id", F.coalesce("label", "id").alias("label"), F.coalesce("level_name", "storey").alias("level"))


@query("""WITH e AS (SELECT l.door, l.space, (s.s % 3 = 0) AS inferred FROM links l JOIN spaces s USING (space))
SELECT door, bool_or(inferred) AS inferred, string_agg(DISTINCT space, ',' ORDER BY space) AS spaces FROM e GROUP BY door""")
def inferred_links(b: Building) -> DataFrame:
    """Doors of which any link is inferred, with their distinct rooms in order."""
    e = b.links().join(b.spaces().select("space", (F.col("s") % 3 == 0).alias("inferred")), "space")
    return e.groupBy("door").agg(F.bool_or("inferred").alias("inferred"), F.array_join(F.array_sort(F.collect_set("space")), ",").alias("spaces"))


@query("""WITH f AS (SELECT item, floor(x / 0.5e0) AS i, floor(y / 0.5e0) AS j, p FROM furniture) SELECT i, j, min_by(item, p) AS item, count(*) AS n FROM f GROUP BY i, j""")
def grid_distinct(b: Building) -> DataFrame:
    """The first point of each cell of a tolerance grid."""
    cell = lambda c: F.floor(F.col(c) / 0.5).cast("double")
    return b.furniture().groupBy(cell("x").alias("i"), cell("y").alias("j")).agg(F.min_by("item", "p").alias("item"), F.count(F.lit(1)).alias("n"))


@query("""SELECT storey, round_even((z_min + z_max) / 2, 1) AS slab, count(*) AS n, min(z_min) AS low, max(z_max) AS high, round(avg((z_min + z_max) / 2), 6) AS mean FROM furniture GROUP BY 1, 2""")
def z_slabs(b: Building) -> DataFrame:
    """Faces by the slab of their mean height (rounded half to even), with the least, largest and mean heights."""
    mean = (F.col("z_min") + F.col("z_max")) / 2
    out = b.furniture().groupBy("storey", F.bround(mean, 1).alias("slab"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.min("z_min").alias("low"), F.max("z_max").alias("high"), r6(F.avg(mean)).alias("mean"))


@query("""WITH RECURSIVE u AS (SELECT a, b FROM doors WHERE b IS NOT NULL UNION SELECT b, a FROM doors WHERE b IS NOT NULL),
w AS (SELECT space AS node, space AS root FROM spaces UNION SELECT u.b, w.root FROM w JOIN u ON u.a = w.node),
c AS (SELECT node, min(root) AS component FROM w GROUP BY node)
SELECT component, n, row_number() OVER (ORDER BY n DESC, component) AS place FROM (SELECT component, count(*) AS n FROM c GROUP BY component)""")
def component_order(b: Building) -> DataFrame:
    """Components of rooms, the largest first, then by their first room."""
    c = graph.components(b.spaces().select(F.col("space").alias("node")), b.doors().filter("b is not null")).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    ranked = c.orderBy(F.desc("n"), "component").select("component", "n")  # sorted by ranges; the numbers follow the partitions' sizes
    return numbered(ranked)


def placed(rows: DataFrame, by: str, order: list) -> DataFrame:
    """Rows with their place from 1 within a key: sorted by ranges as a whole, less the rows of the keys before."""
    ranked = numbered(rows.orderBy(by, *order))
    least = ranked.groupBy(by).agg(F.min("place").alias("__first"))
    return ranked.join(least, by).withColumn("place", F.col("place") - F.col("__first") + 1).drop("__first")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows that are sorted by ranges, with their place from 1: counts of the partitions before are added, so nothing meets in one task."""
    rows = graph.kept(rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    ahead = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    start = ahead.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))  # a row for each partition
    own = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(start), "__part").withColumn("place", (own + F.col("__start") + 1).cast("bigint")).drop("__part", "__at", "__start")


@query("""SELECT item FROM furniture WHERE w > 0 AND item <> '' AND NOT (p % 11 = 0) AND x BETWEEN 0 - 2e0 AND (SELECT max(x1) FROM spaces) + 2e0 AND y BETWEEN 0 - 2e0 AND (SELECT max(y1) FROM spaces) + 2e0""")
def complete_entities(b: Building) -> DataFrame:
    """Entities with an id and a footprint, not excluded, inside the building's box with a margin of two metres."""
    box = b.spaces().agg((F.max("x1") + 2.0).alias("right"), (F.max("y1") + 2.0).alias("top"))  # one row
    f = b.furniture().filter("w > 0 and item <> '' and not (p % 11 = 0)")
    return f.join(F.broadcast(box), F.col("x").between(-2.0, F.col("right")) & F.col("y").between(-2.0, F.col("top"))).select("item")


@query("""WITH ifc AS (SELECT door AS id, a AS source, b AS target FROM doors WHERE b IS NOT NULL AND door LIKE 'D%'), healed AS (SELECT door AS id, a AS source, b AS target, 'healed' AS origin FROM doors WHERE b IS NOT NULL AND door NOT LIKE 'D%3')
SELECT id, source, target, 'ifc' AS origin FROM ifc UNION ALL SELECT * FROM healed WHERE id NOT IN (SELECT id FROM ifc)""")
def superset_graph(b: Building) -> DataFrame:
    """Stored edges and healed ones, distinct by id; stored ones win."""
    d = b.doors().filter("b is not null").select(F.col("door").alias("id"), F.col("a").alias("source"), F.col("b").alias("target"))
    stored = d.filter("id like 'D%'").withColumn("origin", F.lit("ifc"))
    return stored.unionByName(d.filter("id not like 'D%3'").withColumn("origin", F.lit("healed")).join(stored.select("id"), "id", "left_anti"))


@query("""(SELECT storey FROM stairs WHERE n % 2 = 0 INTERSECT SELECT storey FROM doors WHERE door LIKE 'V%') UNION (SELECT storey FROM furniture WHERE p % 50 = 3)""")
def storey_sets(b: Building) -> DataFrame:
    """Candidate storeys that pass a filter, and those that an exclusion touches."""
    candidates = b.stairs().filter("n % 2 = 0").select("storey").intersect(b.doors().filter("door like 'V%'").select("storey"))
    return candidates.union(b.furniture().filter("p % 50 = 3").select("storey")).distinct()
