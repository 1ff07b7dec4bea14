"""Strips between neighbouring rooms: samples of the common front, walls and voids on it, clear runs, portals.

Pairs are rows (a, b, storey, ring_a, ring_b).  A pair's samples are bounded by the
outline of its first room, so a window over a pair is small at any scale; pairs
are spread by their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.functions import outlines
from plinth.operators import spatial

# Fixed values, in metres.
STEP = 0.12  # between samples
GAP = 0.45  # between rooms that share a front
LENGTH = 0.5  # of a front
CLEAR = 0.7  # of a way through; also the share of clear samples of a front that is open as a whole
WALL = 0.08  # from a wall that blocks
CHAIN = 0.4  # along the outline, between parts of a front
CARVE = 0.55  # around a void without outline
SLACK = 0.06  # around a void with outline
THICK = 0.8  # of a void, at most
HEIGHT = 1.8  # of a void, at least

_PAIRS = 1000  # whose samples are held at once


def _in_slices(pairs: DataFrame, columns: list[str], answer: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """answer() of some pairs at a time; few rows make many samples, so pairs are dealt to all shuffle partitions, which Spark doesn't merge again."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _PAIRS):
                yield answer(batch.slice(at, _PAIRS))

    dealt = pairs.select(*columns).repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    return dealt.mapInArrow(slices, schema)


def _typed(pairs: DataFrame, *columns: str) -> str:
    return ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in columns)


def interface_lengths(pairs: DataFrame) -> DataFrame:
    """(a, b, length, gap) of pairs with a front of half a metre or more: samples of either room near the other, mean distance.

    Every edge is sampled from its first end to its last, both included.
    """

    def answer(rows: pa.RecordBatch) -> pa.RecordBatch:
        rings = [outlines.Rings(rows.column(c)) for c in ("ring_a", "ring_b")]
        n, total = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for own, other in (rings, rings[::-1]):
            points = outlines.sampled(own, other, STEP, GAP, True)
            d, _, _, inside = outlines.closest(points["x"], points["y"], points["of"], other)
            d = np.where(inside, 0.0, d)
            near = d <= GAP
            n += np.bincount(points["of"][near], minlength=len(rows))
            total += np.bincount(points["of"][near], d[near], len(rows))
        gap = pa.array(total / np.maximum(n, 1), mask=n == 0)
        return pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(n * STEP / 2), gap], ["a", "b", "length", "gap"])

    measured = _in_slices(pairs, ["a", "b", "ring_a", "ring_b"], answer, f"{_typed(pairs, 'a', 'b')}, length double, gap double")
    return measured.filter(F.col("length") >= LENGTH)


def strip_samples(pairs: DataFrame) -> DataFrame:
    """(a, b, storey, at, s, around, x, y): samples of a's outline within reach of b, in order.

    s is the way along the outline, around the whole outline, x and y the middle
    between the sample and b's closest boundary point.
    """

    def answer(rows: pa.RecordBatch) -> pa.RecordBatch:
        own, other = (outlines.Rings(rows.column(c)) for c in ("ring_a", "ring_b"))
        p = outlines.sampled(own, other, STEP, GAP, False)
        d, qx, qy, inside = outlines.closest(p["x"], p["y"], p["of"], other)
        near = inside | (d <= GAP)
        p = {c: v[near] for c, v in p.items()}
        at = pa.StructArray.from_arrays([pa.array(p[c], pa.int32()) for c in "ik"], ["__i", "__k"])
        middle = [pa.array((v + q[near]) / 2) for v, q in ((p["x"], qx), (p["y"], qy))]
        names = [rows.column(c).take(pa.array(p["of"])) for c in ("a", "b", "storey")]
        return pa.RecordBatch.from_arrays([*names, at, pa.array(p["s"]), pa.array(p["around"]), *middle], ["a", "b", "storey", "at", "s", "around", "x", "y"])

    whole = pairs.filter((F.size("ring_a") >= 3) & (F.size("ring_b") >= 3))
    kinds = f"{_typed(pairs, 'a', 'b', 'storey')}, at struct<__i: int, __k: int>, s double, around double, x double, y double"
    return _in_slices(whole, ["a", "b", "storey", "ring_a", "ring_b"], answer, kinds)


def walkable_voids(voids: DataFrame) -> DataFrame:
    """Voids that someone walks through: in walls, thin and high; what isn't measured counts as fitting.  A null host is none."""
    thin = (F.size("ring") < 3) | F.col("ring").isNull() | (g.calipers(F.col("ring"))["least"] <= THICK)
    high = F.coalesce(F.col("head_z") - F.col("sill_z") >= HEIGHT, F.lit(True))
    return voids.filter("host_is_wall and x is not null and y is not null").filter(thin & high)


def _met(samples: DataFrame, shapes: DataFrame, within: Column, pad: float, near: DataFrame | None = None) -> DataFrame:
    """Samples for which any shape (storey, x0 .. y1 and what `within` reads) holds; a hash join by cell."""
    key = ["a", "b", "at"]
    met = spatial.points_to_boxes(samples.select(*key, "storey", "x", "y"), shapes, on=["storey"], pad=pad, size=2.0).filter(within)
    if near is not None:
        for room in ("a", "b"):
            met = met.join(near.select("void", F.col("space").alias(room)), ["void", room], "left_semi")
    return met.select(*key).distinct()


def blocked_samples(samples: DataFrame, walls: DataFrame, voids: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Samples with `blocked`: in a wall or near one (storey, ring), unless a void (storey, x, y, ring or null) opens it.

    near: (void, space), where only voids (with void) near both rooms of a pair open its front.
    """
    id_ = [] if near is None else ["void"]
    boxed = lambda df: df.withColumn("__box", g.bbox(F.col("ring"))).select("*", *(F.col(f"__box.{m}_{c}").alias(f"{c}{i}") for i, m in enumerate(("min", "max")) for c in "xy")).drop("__box")
    hit = _met(samples, boxed(walls.select("storey", "ring").filter(F.size("ring") >= 3)), g.polygon_distance(F.col("x"), F.col("y"), F.col("ring")) <= WALL, WALL)
    shaped = F.size("ring") >= 3
    own = voids.select(*id_, "storey", F.col("x").alias("vx"), F.col("y").alias("vy"), "ring")
    outlined = _met(samples, boxed(own.filter(shaped)), g.polygon_distance(F.col("x"), F.col("y"), F.col("ring")) <= SLACK, SLACK, near)
    bare = own.filter(~F.coalesce(shaped, F.lit(False))).select(*id_, "storey", "vx", "vy", *(F.col(f"v{c}").alias(f"{c}{i}") for i in (0, 1) for c in "xy"))
    around = _met(samples, bare, g.distance(F.col("x"), F.col("y"), F.col("vx"), F.col("vy")) <= CARVE, CARVE, near)
    closed = hit.join(outlined.union(around), ["a", "b", "at"], "left_anti").withColumn("__blocked", F.lit(True))
    return samples.join(closed, ["a", "b", "at"], "left").withColumn("blocked", F.coalesce("__blocked", F.lit(False))).drop("__blocked")


def clear_runs(samples: DataFrame) -> DataFrame:
    """(a, b, start, span, n, x, y): runs of clear samples of one part of the front, with the mean of their middles.

    A new part starts where the way from the last sample is over CHAIN.  The
    outline is a ring: the last part goes on in the first one where they are
    close (its samples then stand before it), and a front all around starts behind
    a blocked sample.  A single sample is as long as a step.
    """
    pair = Window.partitionBy("a", "b")
    by_s, by_t = pair.orderBy("s", "at"), pair.orderBy("t", "at")
    rows = samples.withColumn("__new", F.when(F.col("s") - F.lag("s").over(by_s) > CHAIN, 1).otherwise(0))
    rows = rows.withColumn("__part", F.sum("__new").over(by_s))
    whole = {"__last": F.max("__part"), "__low": F.min("s"), "__high": F.max("s"), "__wall": F.min(F.when(F.col("blocked"), F.col("s")))}
    rows = rows.withColumns({name: value.over(pair) for name, value in whole.items()})
    wraps = (F.col("around") > CHAIN) & (F.col("__low") + F.col("around") - F.col("__high") <= CHAIN)
    ahead = wraps & (F.col("__last") > 0) & (F.col("__part") == F.col("__last"))
    behind = wraps & (F.col("__last") == 0) & (F.col("s") < F.col("__wall"))
    rows = rows.withColumn("t", F.when(ahead, F.col("s") - F.col("around")).when(behind, F.col("s") + F.col("around")).otherwise(F.col("s")))
    cut = (F.col("t") - F.lag("t").over(by_t) > CHAIN) | (F.col("blocked") != F.lag("blocked").over(by_t))
    rows = rows.withColumn("__new", F.when(cut, 1).otherwise(0)).withColumn("__run", F.sum("__new").over(by_t)).filter("not blocked")
    way = F.max("t") - F.min("t")
    span = F.when(way < 1e-9, F.lit(STEP)).otherwise(way)
    runs = rows.groupBy("a", "b", "__run").agg(F.min("t").alias("start"), span.alias("span"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return runs.drop("__run")


def strip_portals(samples: DataFrame) -> DataFrame:
    """(a, b, span, x, y): pairs with a clear run of CLEAR metres or more, and where its portal stands.

    In the middle of all clear samples if their share is CLEAR or more, else of
    the longest run; of equal ones (nine digits) the first.  One sample is no front.
    """
    total = samples.groupBy("a", "b").agg(F.count(F.lit(1)).alias("__all"))
    place = F.struct(F.round("span", 9).alias("span"), (-F.col("start")).alias("back"), "x", "y")
    sums = [F.sum(F.col(c) * F.col("n")).alias(f"__{c}") for c in "xy"]
    best = clear_runs(samples).groupBy("a", "b").agg(F.max(place).alias("__best"), F.sum("n").alias("__clear"), *sums)
    both = best.join(total, ["a", "b"]).filter((F.col("__all") >= 2) & (F.col("__best.span") >= CLEAR))
    wide = F.col("__clear") / F.col("__all") >= CLEAR
    at = [F.when(wide, F.col(f"__{c}") / F.col("__clear")).otherwise(F.col(f"__best.{c}")).alias(c) for c in "xy"]
    return both.select("a", "b", F.col("__best.span").alias("span"), *at)
