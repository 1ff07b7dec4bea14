"""Tables kept by model and variant, and shared scenes with a limited life."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that can be uploaded, bytes at most, form of a share's id, days that it lives.
SUFFIXES, MOST_BYTES, SHARE_ID, SHARE_DAYS = (".ifc", ".ifczip", ".gml", ".indoorgml"), 500 << 20, "^[0-9a-f]{32}$", 7


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, format, ok) of the files of a folder; contents aren't read."""
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", suffix.alias("suffix"))
    kind = F.when(F.col("suffix").isin(".gml", ".indoorgml"), "indoorgml").when(F.col("suffix").isin(".ifc", ".ifczip"), "ifc")
    return files.select("path", "length", kind.alias("format"), (kind.isNotNull() & (F.col("length") <= MOST_BYTES)).alias("ok"))


def write_artifact(df: DataFrame, path: str) -> None:
    """Overwrites the (model_id, variant) partitions that the rows have."""
    with_variant = df if "variant" in df.columns else df.withColumn("variant", F.lit("ifc"))
    with_variant.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id", "variant").parquet(path)


def read_artifact(spark: SparkSession, path: str, model_id: str, variant: str = "ifc") -> DataFrame:
    """One artifact; a missing variant is ifc; an unknown model is an error."""
    found = spark.read.parquet(path).filter((F.col("model_id") == model_id) & (F.coalesce("variant", F.lit("ifc")) == variant))
    if found.isEmpty():
        raise FileNotFoundError(f"no {variant} artifact of {model_id}")
    return found


def _folder(spark: SparkSession, path: str):
    """The path and its file system, whatever it is."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds anything but hidden files."""
    at, fs = _folder(spark, path)
    return fs.exists(at) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(at))


def ensured(spark: SparkSession, path: str, model_id: str, variant: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The kept artifact, built and written first where there is none."""
    try:
        if has_files(spark, path):
            return read_artifact(spark, path, model_id, variant)
    except FileNotFoundError:
        pass  # other models' artifacts alone
    write_artifact(build().withColumns({"model_id": F.lit(model_id), "variant": F.lit(variant)}), path)
    return read_artifact(spark, path, model_id, variant)


def record_status(statuses: DataFrame, path: str) -> None:
    """Appends (model_id, status, at); rows are never rewritten, so writers don't meet."""
    statuses.select("model_id", "status", "at").write.mode("append").parquet(path)


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, status, at): each model's last status; of two at one time the larger name."""
    last = spark.read.parquet(path).groupBy("model_id").agg(F.max(F.struct("at", "status")).alias("s"))
    return last.select("model_id", "s.status", "s.at")


def write_shares(shares: DataFrame, path: str) -> None:
    """Adds shares (share_id, modified and what they hold), a folder a day."""
    shares.withColumn("day", F.to_date("modified")).write.mode("append").partitionBy("day").parquet(path)


def sweep_shares(spark: SparkSession, path: str, today: date) -> list[str]:
    """Removes the days whose shares are all older than seven days, and names them; the rest of the last one is for live_shares."""
    at, fs = _folder(spark, path)
    least, gone = (today - timedelta(days=SHARE_DAYS)).isoformat(), []
    for f in fs.listStatus(at) if fs.exists(at) else []:
        key, _, day = f.getPath().getName().partition("=")
        if key == "day" and day < least and fs.delete(f.getPath(), True):
            gone.append(day)
    return sorted(gone)


def live_shares(shares: DataFrame, now: Column) -> DataFrame:
    """Shares with a valid id that are at most seven days old."""
    return shares.filter(F.col("share_id").rlike(SHARE_ID) & (F.col("modified") >= now - F.expr(f"INTERVAL {SHARE_DAYS} DAYS")))


def landing_format(agent: Column, has_usdz: Column, has_glb: Column) -> Column:
    """usdz for iPhone and iPod where there is one, else glb, else usdz, else null."""
    return F.when(agent.rlike("(?i)iphone|ipod") & has_usdz, "usdz").when(has_glb, "glb").when(has_usdz, "usdz")
