"""Streams of poses and block events (additions: a building's model has no stream of its own)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import spatial


def window_counts(poses: DataFrame, *, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows of event time; rows later than `late` are dropped once their window is out."""
    return poses.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def storey_counts(poses: DataFrame, storeys: DataFrame, *, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, storey, n): poses (ts, z) by the storey of their height; storeys are a static side."""
    return spatial.storey_band(poses.withWatermark("ts", late), storeys).groupBy(F.window("ts", window).alias("w"), "storey").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "storey", "n")


def fresh_ids(stream: DataFrame, id_column: str, *, keep: str = "7 days") -> DataFrame:
    """Rows whose id didn't come within `keep` before: state for older ids expires."""
    return stream.withWatermark("ts", keep).dropDuplicatesWithinWatermark([id_column])


def drained(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """What the stream gives over all rows that are there now, as a table; complete mode by batch overwrite."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")
