"""Recomputation on a stream of blocks: only the storeys that a batch changes are built anew.

Block events (storey, id, blocked, at) go to a log, a folder a batch, so a batch that
runs again after a failure replaces its own.  A batch's touched storeys are those
where what is blocked differs from before; they alone are rebuilt, and their
partitions of the result replaced.  Every row says which generation made it, so a
reader can tell a stale one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "storey string, id string, blocked boolean, at bigint, batch bigint"


def blocked(log: DataFrame) -> DataFrame:
    """(storey, id) of what the last event of each id blocks; of two at one time the larger batch's, and blocking before freeing."""
    last = log.groupBy("storey", "id").agg(F.max(F.struct("at", "batch", "blocked")).alias("e"))
    return last.filter("e.blocked").select("storey", "id")


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """(storey): storeys where the two blocked sets (storey, id) differ."""
    gone, new = before.join(after, ["storey", "id"], "left_anti"), after.join(before, ["storey", "id"], "left_anti")
    return gone.unionByName(new).select("storey").distinct()


def applied(batch: DataFrame, number: int, log_path: str, out_path: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """One batch of events: the log grows, touched storeys' rows are replaced.

    build(storeys, blocked) gives the rows of those storeys, with a column storey; a
    storey without rows keeps one with nulls alone, so that it is replaced too.
    """
    spark = batch.sparkSession
    batch.select("storey", "id", "blocked", F.col("at").cast("bigint").alias("at")).withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(log_path)
    log = spark.read.schema(_LOG).parquet(log_path)
    after = blocked(log.filter(F.col("batch") <= number))
    storeys = touched(blocked(log.filter(F.col("batch") < number)), after)
    rows = storeys.join(build(storeys, after), "storey", "left").withColumn("generation", F.lit(number).cast("bigint"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("storey").parquet(out_path)


def follow(events: DataFrame, log_path: str, out_path: str, checkpoint: str, build: Callable[[DataFrame, DataFrame], DataFrame]):
    """Runs the stream of block events over what is there; the query that does."""
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: applied(batch, n, log_path, out_path, build)).start()


def current(spark: SparkSession, out_path: str, schema: str) -> DataFrame:
    """The result's rows, storeys without any left out."""
    found = spark.read.schema(schema).parquet(out_path)
    own = [c for c in found.columns if c not in ("storey", "generation")]
    return found.filter(F.coalesce(*(F.col(c).cast("string") for c in own)).isNotNull())
