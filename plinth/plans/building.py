"""A building derived from the given tables, by integer rules that SQL can repeat.

Storeys are regions, rooms suppliers (a grid of six columns by storey), doors join
neighbouring rooms by a rule on their keys, stairs are nations, furniture parts,
pins events.  Every table grows with the one it is derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import geometry as g


class Building:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def storeys(self) -> DataFrame:
        """storey, name, elevation."""
        r = self.table("region")
        return r.select(F.concat(F.lit("L"), F.col("r_regionkey")).alias("storey"), F.col("r_name").alias("name"), (F.col("r_regionkey") * 3.0).alias("elevation"))

    def spaces(self) -> DataFrame:
        """space, s (key), name, storey, col, row, box, ring."""
        s = self.table("supplier").join(F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
        k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("s_suppkey")) - 1
        s = s.select(F.col("s_suppkey").alias("s"), F.col("s_name").alias("name"), F.concat(F.lit("L"), F.col("n_regionkey")).alias("storey"), k.alias("k"))
        s = s.withColumn("col", F.col("k") % 6).withColumn("row", F.floor(F.col("k") / F.lit(6.0)).cast("int"))
        x0, y0 = F.col("col") * 5.0, F.col("row") * 5.0
        w = 4.8 - 0.4 * (F.col("s") % 2)
        s = s.withColumns({"x0": x0, "y0": y0, "x1": x0 + w, "y1": y0 + 4.8})
        return s.select(F.concat(F.lit("R"), F.col("s")).alias("space"), "s", "name", "storey", "col", "row", "x0", "y0", "x1", "y1", g.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))

    def doors(self) -> DataFrame:
        """door, storey, a, b (b null: exit), x, y, nx, ny."""
        s = self.spaces()
        a = s.select(*(F.col(c).alias(f"a_{c}") for c in ("s", "storey", "col", "row", "x0", "y0", "x1", "y1")))
        b = s.select(*(F.col(c).alias(f"b_{c}") for c in ("s", "storey", "col", "row", "x0", "y0", "x1", "y1")))
        both = F.col("a_s") + F.col("b_s")
        side = a.join(b, (F.col("a_storey") == F.col("b_storey")) & (F.col("a_row") == F.col("b_row")) & (F.col("b_col") == F.col("a_col") + 1)).filter(both % 3 != 0)
        above = a.join(b, (F.col("a_storey") == F.col("b_storey")) & (F.col("a_col") == F.col("b_col")) & (F.col("b_row") == F.col("a_row") + 1)).filter(both % 4 != 0)
        name = lambda letter: F.concat(F.lit(letter), F.col("a_s"), F.lit("_"), F.col("b_s")).alias("door")
        ends = [F.concat(F.lit("R"), F.col("a_s")).alias("a"), F.concat(F.lit("R"), F.col("b_s")).alias("b")]
        side = side.select(name("D"), F.col("a_storey").alias("storey"), *ends, ((F.col("a_x1") + F.col("b_x0")) / 2).alias("x"), (F.col("a_y0") + 2.4).alias("y"), F.lit(1.0).alias("nx"), F.lit(0.0).alias("ny"))
        above = above.select(name("V"), F.col("a_storey").alias("storey"), *ends, (F.col("a_x0") + 2.2).alias("x"), ((F.col("a_y1") + F.col("b_y0")) / 2).alias("y"), F.lit(0.0).alias("nx"), F.lit(1.0).alias("ny"))
        out = s.filter("storey = 'L0' and col = 0 and row % 2 = 0").select(F.concat(F.lit("X"), F.col("s")).alias("door"), "storey", F.col("space").alias("a"), F.lit(None).cast("string").alias("b"), F.col("x0").alias("x"), (F.col("y0") + 2.4).alias("y"), F.lit(1.0).alias("nx"), F.lit(0.0).alias("ny"))
        return side.unionByName(above).unionByName(out)

    def links(self) -> DataFrame:
        """door, space: a row for each side of a door."""
        d = self.doors()
        return d.select("door", F.col("a").alias("space")).union(d.filter("b is not null").select("door", "b"))

    def stairs(self) -> DataFrame:
        """stair, n (key), storey, name, x0, y0, x1, y1."""
        n = self.table("nation")
        x0 = F.col("n_nationkey") % 6 * 5.0 + 1
        return n.select(F.concat(F.lit("S"), F.col("n_nationkey")).alias("stair"), F.col("n_nationkey").alias("n"), F.concat(F.lit("L"), F.col("n_regionkey")).alias("storey"), F.col("n_name").alias("name"), x0.alias("x0"), F.lit(1.0).alias("y0"), (x0 + 1).alias("x1"), F.lit(2.0).alias("y1"))

    def furniture(self) -> DataFrame:
        """item, p (key), name, storey, x, y, w, d, z_min, z_max."""
        p, k = self.table("part"), F.col("p_partkey")
        z = F.floor(F.col("p_retailprice").cast("double")) % 4
        return p.select(F.concat(F.lit("F"), k).alias("item"), k.alias("p"), F.col("p_name").alias("name"), F.concat(F.lit("L"), k % 5).alias("storey"), ((k * 37) % 300 / 10.0).alias("x"), ((k * 91) % 200 / 10.0).alias("y"), (F.col("p_size") / 25.0).alias("w"), F.lit(0.6).alias("d"), (z * 1.0).alias("z_min"), (z + 0.5).alias("z_max"))

    def pins(self) -> DataFrame:
        """pin, x, y, z."""
        e = F.col("event_id")
        return self.table("events").select(e.alias("pin"), (e * 13 % 300 / 10.0).alias("x"), (e * 29 % 200 / 10.0).alias("y"), (F.col("user_id") % 15 * 1.0).alias("z"))


#: The same tables in SQL, as common table expressions; `x / 10.0` and the like are doubles on both sides.
SQL = """
WITH storeys AS (SELECT 'L' || r_regionkey AS storey, r_name AS name, r_regionkey * 3e0 AS elevation FROM region),
spaces0 AS (SELECT s_suppkey AS s, s_name AS name, 'L' || n_regionkey AS storey, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) - 1 AS k
            FROM supplier JOIN nation ON s_nationkey = n_nationkey),
spaces1 AS (SELECT *, k % 6 AS col, CAST(floor(k / 6e0) AS BIGINT) AS row FROM spaces0),
spaces AS (SELECT 'R' || s AS space, s, name, storey, col, row, col * 5e0 AS x0, row * 5e0 AS y0, col * 5e0 + (4.8e0 - 0.4e0 * (s % 2)) AS x1, row * 5e0 + 4.8e0 AS y1 FROM spaces1),
doors AS (
  SELECT 'D' || a.s || '_' || b.s AS door, a.storey, a.space AS a, b.space AS b, (a.x1 + b.x0) / 2e0 AS x, a.y0 + 2.4e0 AS y, 1e0 AS nx, 0e0 AS ny
  FROM spaces a JOIN spaces b ON a.storey = b.storey AND a.row = b.row AND b.col = a.col + 1 WHERE (a.s + b.s) % 3 <> 0
  UNION ALL
  SELECT 'V' || a.s || '_' || b.s, a.storey, a.space, b.space, a.x0 + 2.2e0, (a.y1 + b.y0) / 2e0, 0e0, 1e0
  FROM spaces a JOIN spaces b ON a.storey = b.storey AND a.col = b.col AND b.row = a.row + 1 WHERE (a.s + b.s) % 4 <> 0
  UNION ALL
  SELECT 'X' || s, storey, space, NULL, x0, y0 + 2.4e0, 1e0, 0e0 FROM spaces WHERE storey = 'L0' AND col = 0 AND row % 2 = 0),
links AS (SELECT door, a AS space FROM doors UNION ALL SELECT door, b FROM doors WHERE b IS NOT NULL),
stairs AS (SELECT 'S' || n_nationkey AS stair, n_nationkey AS n, 'L' || n_regionkey AS storey, n_name AS name, n_nationkey % 6 * 5e0 + 1 AS x0, 1e0 AS y0, n_nationkey % 6 * 5e0 + 2 AS x1, 2e0 AS y1 FROM nation),
furniture AS (SELECT 'F' || p_partkey AS item, p_partkey AS p, p_name AS name, 'L' || (p_partkey % 5) AS storey, (p_partkey * 37) % 300 / 10e0 AS x, (p_partkey * 91) % 200 / 10e0 AS y, p_size / 25e0 AS w, 0.6e0 AS d,
                     (CAST(floor(CAST(p_retailprice AS DOUBLE)) AS BIGINT) % 4) * 1e0 AS z_min, (CAST(floor(CAST(p_retailprice AS DOUBLE)) AS BIGINT) % 4) + 0.5e0 AS z_max FROM part),
pins AS (SELECT event_id AS pin, (event_id * 13) % 300 / 10e0 AS x, (event_id * 29) % 200 / 10e0 AS y, (user_id % 15) * 1e0 AS z FROM events)
"""
