"""What the operators share: inputs, the shared scratch folder, small Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for written tables under spark.checkpoint.dir, which all executors share.

    Only where the session has no such folder and runs on one machine, as in tests, a
    local one is set; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows written to the shared folder and read back: short lineage, and nothing is computed twice."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stable(df: DataFrame) -> DataFrame:
    """The rows in an order that doesn't change when they are read again: as they are if they come straight from files, else a written table."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    straight = "Scan" in plan and not any(x in plan for x in ("Exchange", "Join", "LocalTableScan", "ExistingRDD", "Arrow", "Pandas", "InMemory", "Python"))
    return df if straight else table(df, "stable", compression="zstd")


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary column whose i-th value is the bytes of values[ends[i - 1]:ends[i]]."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """List column whose i-th value is values[ends[i - 1]:ends[i]]."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def sliced(batch: pa.RecordBatch, column: int, most_bytes: int = 8 << 20):
    """The batch in pieces whose texts are about most_bytes at most (one row at least), so that memory is bounded."""
    texts = batch.column(column)
    if not len(texts):
        return
    size = np.frombuffer(texts.buffers()[1], np.int32 if texts.type in (pa.string(), pa.binary()) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + most_bytes, "right")) - 1)
        yield batch.slice(at, min(to, len(texts)) - at)
        at = to
