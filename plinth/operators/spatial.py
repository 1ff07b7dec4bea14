"""Joins by place: grid cells, containment, nearest and interval matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import geometry as g


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """array<struct<cx, cy>> of the grid cells that a box touches."""
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(span(x0, x1), lambda cx: F.transform(span(y0, y1), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def points_to_boxes(points: DataFrame, boxes: DataFrame, *, on: list[str], pad: float = 0.0, size: float = 10.0) -> DataFrame:
    """Points (x, y) joined with boxes (x0 .. y1) that contain them within `pad`; a hash join on `on` and the point's cell.

    A box stands in every cell it touches, a point in one, so no pair comes twice.
    """
    p = points.withColumns({"__cx": F.floor(F.col("x") / size), "__cy": F.floor(F.col("y") / size)})
    b = boxes.withColumn("__cell", F.explode(cells(F.col("x0") - pad, F.col("y0") - pad, F.col("x1") + pad, F.col("y1") + pad, size)))
    b = b.withColumns({"__cx": F.col("__cell.cx"), "__cy": F.col("__cell.cy")}).drop("__cell")
    inside = F.col("x").between(F.col("x0") - pad, F.col("x1") + pad) & F.col("y").between(F.col("y0") - pad, F.col("y1") + pad)
    return p.join(b, [*on, "__cx", "__cy"]).filter(inside).drop("__cx", "__cy")


def boxes_to_boxes(left: DataFrame, right: DataFrame, *, on: list[str], pad: float = 0.0, size: float = 10.0) -> DataFrame:
    """Pairs of boxes (left's columns end in _l, right's in _r) that meet within `pad`.

    Both stand in all cells they touch; a pair counts in the first cell they share.
    """
    def spread(df: DataFrame, end: str, by: float) -> DataFrame:
        df = df.select(*(F.col(c) if c in on else F.col(c).alias(f"{c}{end}") for c in df.columns))
        box = [F.col(f"{c}{end}") for c in ("x0", "y0", "x1", "y1")]
        return df.withColumn("__cell", F.explode(cells(box[0] - by, box[1] - by, box[2] + by, box[3] + by, size)))

    met = spread(left, "_l", pad).join(spread(right, "_r", 0.0), [*on, "__cell"])
    first = (F.col("__cell.cx") == F.greatest(F.floor((F.col("x0_l") - pad) / size), F.floor(F.col("x0_r") / size))) & (F.col("__cell.cy") == F.greatest(F.floor((F.col("y0_l") - pad) / size), F.floor(F.col("y0_r") / size)))
    meet = (F.col("x0_l") - pad <= F.col("x1_r")) & (F.col("x0_r") <= F.col("x1_l") + pad) & (F.col("y0_l") - pad <= F.col("y1_r")) & (F.col("y0_r") <= F.col("y1_l") + pad)
    return met.filter(first & meet).drop("__cell")


def nearest_storey(points: DataFrame, storeys: DataFrame) -> DataFrame:
    """Each point's storey of the least |elevation - z|; the lower storey, then the smaller name, wins ties.

    The storeys of a building are a short list: it goes along as one array, so
    points are not shuffled.
    """
    every = storeys.agg(F.array_sort(F.collect_list(F.struct("elevation", "storey"))).alias("__all"))
    ranked = F.transform("__all", lambda s: F.struct(F.abs(s["elevation"] - F.col("z")).alias("d"), s["elevation"].alias("e"), s["storey"].alias("storey")))
    return points.crossJoin(F.broadcast(every)).withColumn("storey", F.array_min(ranked)["storey"]).drop("__all")


def storey_band(points: DataFrame, storeys: DataFrame, *, below: float = 0.35, top: float = 3.5) -> DataFrame:
    """Each point's storey whose band [elevation - below, next elevation - below) holds z; the top one's ends `top` above it.

    Outside all bands: the nearest storey within 0.6 times `top`, else null.
    """
    after = F.lead("elevation").over(Window.orderBy("elevation", "storey"))  # a building's storeys
    bands = storeys.select("storey", "elevation", F.coalesce(after - below, F.col("elevation") + top).alias("until"))
    every = bands.agg(F.array_sort(F.collect_list(F.struct("elevation", "storey", "until"))).alias("__all"))
    inside = F.filter("__all", lambda s: (F.col("z") >= s["elevation"] - below) & (F.col("z") < s["until"]))
    near = F.array_min(F.transform("__all", lambda s: F.struct(F.abs(s["elevation"] - F.col("z")).alias("d"), s["elevation"].alias("e"), s["storey"].alias("storey"))))
    found = F.coalesce(F.get(inside, F.lit(0))["storey"], F.when(near["d"] <= 0.6 * top, near["storey"]))
    return points.crossJoin(F.broadcast(every)).withColumn("storey", found).drop("__all")


def gap_clusters(values: DataFrame, column: str, *, gap: float = 1.5, by: list[str] | None = None) -> DataFrame:
    """(by, cluster, low, n): distinct values in order, a new cluster where the step from the last value is over `gap`."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(column)
    steps = values.select(*by, column).filter(F.col(column).isNotNull()).distinct()
    new = F.when(F.col(column) - F.lag(column).over(w) > gap, 1).otherwise(0)
    numbered = steps.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w))
    return numbered.groupBy(*by, "cluster").agg(F.min(column).alias("low"), F.count(F.lit(1)).alias("n"))


def rooms_at(points: DataFrame, spaces: DataFrame) -> DataFrame:
    """Each point (with storey) in a room, and that room; the smallest area, then name, wins."""
    met = points_to_boxes(points, spaces, on=["storey"]).filter(g.point_in_ring(F.col("x"), F.col("y"), F.col("ring")))
    best = F.min(F.struct(g.area(F.col("ring")).alias("area"), F.col("space").alias("space"))).alias("best")
    return met.groupBy("pin", "x", "y", "storey").agg(best).select("pin", "x", "y", "storey", "best.space")
