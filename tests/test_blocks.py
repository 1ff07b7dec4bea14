"""A stream of blocks: batches touch only their storeys, a batch that runs again changes nothing."""

from pyspark.sql import functions as F

from plinth.streaming import blocks

OUT = "door string, generation bigint, storey string"
DOORS = [("a1", "A", "r1"), ("a2", "A", "r2"), ("b1", "B", "r3"), ("c1", "C", "r4")]


def test_blocks(spark, tmp_path):
    doors = spark.createDataFrame(DOORS, "door string, storey string, room string")
    built = []

    def build(storeys, shut):
        here = doors.join(storeys, "storey", "left_semi")
        built.append(sorted(r.storey for r in storeys.collect()))
        return here.join(shut.select(F.col("id").alias("room")), "room", "left_anti").select("storey", "door")

    log, out, source = (str(tmp_path / n) for n in ("log", "out", "in"))
    put = lambda *rows: spark.createDataFrame(rows, "storey string, id string, blocked boolean, at bigint").coalesce(1).write.mode("append").parquet(source)

    def run():
        blocks.follow(spark.readStream.schema("storey string, id string, blocked boolean, at bigint").parquet(source), log, out, str(tmp_path / "state"), build).awaitTermination()
        return sorted((r.storey, r.door, r.generation) for r in blocks.current(spark, out, OUT).collect())

    put(("A", "r1", True, 1), ("B", "r3", True, 1), ("C", "r4", False, 1))
    assert run() == [("A", "a2", 0)] and built == [["A", "B"]]  # B has no row left, C isn't touched
    files = {p.name for p in (tmp_path / "out" / "storey=A").iterdir()}
    put(("B", "r3", False, 5), ("B", "r3", True, 3), ("A", "r1", True, 4))
    assert run() == [("A", "a2", 0), ("B", "b1", 1)] and built[1:] == [["B"]]
    assert {p.name for p in (tmp_path / "out" / "storey=A").iterdir()} == files  # not rewritten
    again = spark.createDataFrame([("B", "r3", False, 5), ("B", "r3", True, 3), ("A", "r1", True, 4)], "storey string, id string, blocked boolean, at bigint")
    blocks.applied(again, 1, log, out, build)
    assert run() == [("A", "a2", 0), ("B", "b1", 1)] and spark.read.parquet(log).count() == 6
