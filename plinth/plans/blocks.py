"""Registered query of a stream of blocks on the derived building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import graph
from plinth.plans.building import Building
from plinth.plans.queries import query
from plinth.streaming import blocks


@query("""WITH n AS (SELECT max(s) + 1 AS n FROM spaces), ev AS (SELECT s.storey, s.space, arg_max(event_type = 'error', event_id) AS blocked FROM events JOIN n ON true JOIN spaces s ON s.s = event_id % n.n WHERE event_type IN ('error', 'view', 'login') GROUP BY s.storey, s.space),
tc AS (SELECT DISTINCT storey FROM ev WHERE blocked), op AS (SELECT door, count(*) AS n_open FROM links WHERE space NOT IN (SELECT space FROM ev WHERE blocked) GROUP BY door)
SELECT storey, door, n_open FROM doors JOIN op USING (door) WHERE storey IN (SELECT storey FROM tc)""")
def stream_of_blocks(b: Building) -> DataFrame:
    """Open sides of the portals on storeys that a stream of events blocks rooms of."""
    doors, links, spaces = graph.kept(b.doors()), graph.kept(b.links()), graph.kept(b.spaces().select("s", "space", "storey"))
    n = spaces.agg((F.max("s") + 1).alias("n")).first()["n"]
    stored = b.table("events")
    events = b.spark.readStream.schema(stored.schema).parquet(f"{b.sf_dir}/events.parquet*").filter("event_type in ('error', 'view', 'login')")
    named = events.join(spaces, events.event_id % n == spaces.s).select("storey", F.col("space").alias("id"), (F.col("event_type") == "error").alias("blocked"), F.col("event_id").alias("at"))

    def build(storeys: DataFrame, shut: DataFrame) -> DataFrame:
        here = doors.join(storeys, "storey", "left_semi").select("storey", "door")
        free = links.join(shut.select(F.col("id").alias("space")), "space", "left_anti")
        return here.join(free, "door").groupBy("storey", "door").agg(F.count(F.lit(1)).alias("n_open"))

    folder = graph.scratch(b.spark, "blocks")
    blocks.follow(named, f"{folder}/log", f"{folder}/out", f"{folder}/state", build).awaitTermination()
    return blocks.current(b.spark, f"{folder}/out", "door string, n_open bigint, generation bigint, storey string").select("storey", "door", "n_open")
