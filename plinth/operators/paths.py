"""Shortest walks between many pairs of points at once, over portals, landings and storeys.

All pairs settle together, from both of their ends, over tiles of rooms: a round takes
each tile's new distances to its borders, the nodes it shares with other tiles, so the
rounds grow with the tiles on the longest walk.  Then each tile gives the nodes that a
best walk of a pair can lead over, whose distances from both ends add up to it.
Predecessors are looked up among these, by one rule for ties, and walks are read back
along them, twice as far each round.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators import evacuation, spatial
from plinth.operators.graph import kept

_EQUAL = 1e-7  # metres within which two ways are equally long
_NEAR = 1e-3  # metres over the shortest way up to which nodes are looked at, for the many steps that may each be _EQUAL longer
_TILE = 120.0  # metres of a tile's side
_PAIRS = 4096  # pairs of points whose distances a tile's task takes at once, about


def walks(links: DataFrame, doors: DataFrame, landing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, space, storey, x, y) and steps (a, b, cost, space): within a room straight, between a stair's neighbouring landings by their rise; a step's room is the one walked or the lower landing's, the smallest of several."""
    name = F.concat(F.lit("v:"), "stair", F.lit("@"), "storey")
    portal = links.join(doors.select("door", "storey", "x", "y"), "door").select(F.concat(F.lit("p:"), "door").alias("node"), "space", "storey", "x", "y")
    nodes = kept(portal.unionByName(landing.select(name.alias("node"), "space", "storey", "x", "y")))
    a, b = (nodes.select("space", *(F.col(c).alias(f"{c}_{e}") for c in ("node", "x", "y"))) for e in "ab")
    level = a.join(b, "space").filter("node_a <> node_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), g.distance(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b")).alias("cost"), "space")
    chain = Window.partitionBy("stair").orderBy("elevation", "storey")
    up = landing.select(name.alias("a"), F.lead(name).over(chain).alias("b"), F.greatest(F.lead("elevation").over(chain) - F.col("elevation"), F.lit(evacuation.LEAST_RISE)).alias("cost"), "space").filter("b is not null")
    every = level.union(up).union(up.select("b", "a", "cost", "space"))
    return nodes, kept(every.groupBy("a", "b").agg(F.min(F.struct("cost", "space")).alias("s")).select("a", "b", "s.cost", "s.space"))


def _settled(rows: pd.DataFrame) -> tuple[list[str], pd.MultiIndex, np.ndarray, np.ndarray]:
    """Of a tile: its nodes' names, its pairs' ends (query, end), their distances to the nodes by the tile's steps (kind 0) from those given (kind 2), and which nodes are borders (kind 1)."""
    steps, borders, given = (rows[rows.kind == k] for k in range(3))
    names = sorted({*steps.a, *steps.b, *given.a})
    at = {n: k for k, n in enumerate(names)}
    cost = np.full((len(names), len(names)), np.inf)
    np.minimum.at(cost, (steps.a.map(at).to_numpy(int), steps.b.map(at).to_numpy(int)), steps.cost.to_numpy(float))
    np.fill_diagonal(cost, 0.0)
    for k in range(len(names)):
        np.minimum(cost, cost[:, k : k + 1] + cost[k], out=cost)
    of, keys = pd.MultiIndex.from_frame(given[["query", "end"]]).factorize()
    far = np.full((len(keys), len(names)), np.inf)
    for name, part in given.assign(of=of).groupby("a"):  # a row for each end
        k = part.of.to_numpy()
        far[k] = np.minimum(far[k], part.cost.to_numpy(float)[:, None] + cost[at[name]])
    return names, keys, far, np.isin(names, borders.a.to_numpy(object).astype(str))


def _to_borders(rows: pd.DataFrame) -> pd.DataFrame:
    names, keys, far, border = _settled(rows)
    k, j = np.nonzero(np.isfinite(far) & border)
    return pd.DataFrame({"query": keys.get_level_values(0)[k], "end": keys.get_level_values(1)[k], "node": np.array(names, object)[j], "d": far[k, j]})


def _on_the_way(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes whose distances from both ends add up to the pair's shortest way, over borders (`best`) or within the tile."""
    names, keys, far, _ = _settled(rows)
    known = rows[rows.kind == 2].groupby("query", sort=False).best.first()
    row = pd.Series(np.arange(len(keys)), index=keys)
    ends = row.unstack().reindex(columns=["from", "to"]).dropna().astype(int) if len(row) else pd.DataFrame({"from": [], "to": []}, dtype=int)
    start = far[ends["from"].to_numpy()]
    way = start + far[ends["to"].to_numpy()]
    best = np.fmin(way.min(1, initial=np.inf), known.reindex(ends.index).fillna(np.inf).to_numpy(float))
    k, j = np.nonzero(np.isfinite(way) & (way <= best[:, None] + _NEAR))
    return pd.DataFrame({"query": ends.index.to_numpy()[k], "node": np.array(names, object)[j], "d": start[k, j]})


def _distances(ends: DataFrame, nodes: DataFrame, steps: DataFrame, spaces: DataFrame, pairs: int) -> DataFrame:
    """(query, node, d) of the nodes that a pair's best ways can lead over, from its start; ends are (query, end, node, far)."""
    kind, parts = ends.schema["query"].dataType.simpleString(), math.ceil(pairs / _PAIRS)
    tiles = kept(spaces.select("space", F.concat_ws(":", "storey", *(F.floor(F.col(c) / _TILE) for c in ("x0", "y0"))).alias("tile")).distinct())
    inside = kept(steps.join(tiles, "space").select("tile", "a", "b", "cost"))
    homes = kept(inside.select(F.col("a").alias("node"), "tile").union(inside.select("b", "tile")).union(nodes.join(tiles, "space").select("node", "tile")).distinct())
    border = homes.join(homes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node"), "node", "left_semi")
    null = {"a": "string", "b": "string", "cost": "double", "query": kind, "end": "string", "best": "double"}
    rows = lambda df, k, **named: df.select("tile", "part", F.lit(k).alias("kind"), *((F.col(named[c]) if c in named else F.lit(None)).cast(t).alias(c) for c, t in null.items()))
    every = F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))).alias("part")
    content = kept(rows(inside.select("*", every), 0, a="a", b="b", cost="cost").unionByName(rows(border.select("*", every), 1, a="node")))
    part = F.pmod(F.xxhash64("query"), F.lit(max(parts, 1))).cast("int").alias("part")

    def by_tile(given: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        given = kept(rows(given.join(homes, "node").select("*", part), 2, a="node", cost="d", query="query", end="end", best="best"))
        return content.join(given.select("tile", "part").distinct(), ["tile", "part"], "left_semi").unionByName(given).groupBy("tile", "part").applyInPandas(run, schema)

    state = kept(ends.select("query", "end", "node", F.col("far").alias("d"), F.lit(True).alias("new")))
    while not state.filter("new").isEmpty():
        found = by_tile(state.filter("new").withColumn("best", F.lit(None)), _to_borders, f"query {kind}, end string, node string, d double")
        both = state.select("query", "end", "node", "d", F.col("d").alias("was")).unionByName(found.withColumn("was", F.lit(None).cast("double")))
        merged = both.groupBy("query", "end", "node").agg(F.min("d").alias("d"), F.min("was").alias("was"))
        state = kept(merged.select("query", "end", "node", "d", (F.col("was").isNull() | (F.col("d") < F.col("was") - 1e-9)).alias("new")))
    start, goal = (state.filter(F.col("end") == e).select("query", "node", F.col("d").alias(e)) for e in ("from", "to"))
    best = start.join(goal, ["query", "node"]).groupBy("query").agg(F.min(F.col("from") + F.col("to")).alias("best"))
    last = by_tile(state.join(best, "query", "left"), _on_the_way, f"query {kind}, node string, d double")
    return kept(last.groupBy("query", "node").agg(F.min("d").alias("d")))


def between(asked: DataFrame, spaces: DataFrame, links: DataFrame, doors: DataFrame, landing: DataFrame, *, blocked_portals: DataFrame | None = None, blocked_spaces: DataFrame | None = None, blocked_landings: DataFrame | None = None) -> DataFrame:
    """(query, cost, step, node, storey, x, y): the places of each pair's shortest walk, its ends (node null) included; no rows where there is none.

    asked: (query, from_storey, from_x, from_y, to_storey, to_x, to_y).  Of equally
    long ways a node is reached from the start if it can be, else from the smallest
    nearer neighbour; of several last nodes the smallest name counts, and a straight
    walk within one room before all.
    """
    links, landing, _ = evacuation.without_blocked(links, landing, blocked_portals, blocked_spaces, blocked_landings)
    if blocked_spaces is not None:
        spaces = spaces.join(blocked_spaces.select("space"), "space", "left_anti")
    asked = kept(asked)
    ends = asked.select("query", F.explode(F.array(*(F.struct(F.lit(e).alias("end"), F.col(f"{e}_storey").alias("storey"), F.col(f"{e}_x").alias("x"), F.col(f"{e}_y").alias("y")) for e in ("from", "to")))).alias("e"))
    placed = spatial.rooms_at(ends.select(F.struct("query", "e.end").alias("pin"), "e.x", "e.y", "e.storey"), spaces)
    placed = kept(placed.select("pin.query", "pin.end", "space", F.col("x").alias("ex"), F.col("y").alias("ey")))
    nodes, steps = walks(links, doors, landing)
    away = placed.join(nodes, "space").select("query", "end", "node", g.distance(F.col("x"), F.col("y"), F.col("ex"), F.col("ey")).alias("far"))
    away = kept(away.groupBy("query", "end", "node").agg(F.min("far").alias("far")))
    start, goal = (away.filter(F.col("end") == e).select("query", "node", F.col("far").alias(n)) for e, n in (("from", "d"), ("to", "rest")))
    own, other = (placed.filter(F.col("end") == e).select("query", "space", F.col("ex").alias(f"{e}_x"), F.col("ey").alias(f"{e}_y")) for e in ("from", "to"))
    direct = kept(own.join(other, ["query", "space"]).select("query", g.distance(F.col("from_x"), F.col("from_y"), F.col("to_x"), F.col("to_y")).alias("best")))

    state = _distances(away, nodes, steps, spaces, asked.count())
    reach = state.join(goal, ["query", "node"]).select("query", F.struct(F.round(F.col("d") + F.col("rest"), 7).alias("about"), F.col("node").alias("node"), (F.col("d") + F.col("rest")).alias("cost")).alias("w"))
    straight = direct.select("query", F.struct(F.round("best", 7).alias("about"), F.lit("").alias("node"), F.col("best").alias("cost")).alias("w"))
    best = kept(reach.union(straight).groupBy("query").agg(F.min("w").alias("w")).select("query", "w.node", "w.cost"))

    near = state.select("query", F.col("node").alias("a"), F.col("d").alias("near"))
    back = state.join(steps.select("a", F.col("b").alias("node"), "cost"), "node").join(near, ["query", "a"]).filter((F.col("near") + F.col("cost") <= F.col("d") + _EQUAL) & (F.col("near") < F.col("d") - _EQUAL))
    first = state.join(start.withColumnRenamed("d", "d0"), ["query", "node"]).filter(F.col("d0") <= F.col("d") + _EQUAL).select("query", "node")
    pred = kept(back.join(first, ["query", "node"], "left_anti").groupBy("query", "node").agg(F.min("a").alias("prior")))
    over, jump = kept(best.filter("node <> ''").select("query", "node")), pred
    while not jump.isEmpty():  # over holds a walk's last nodes, jump goes as many back
        over = kept(over.union(over.join(jump, ["query", "node"]).select("query", F.col("prior").alias("node"))))
        further = jump.select("query", F.col("node").alias("prior"), F.col("prior").alias("__prior"))
        jump = kept(jump.join(further, ["query", "prior"]).select("query", "node", F.col("__prior").alias("prior")))
    place = nodes.select("node", "storey", "x", "y").distinct()
    inner = over.join(state, ["query", "node"]).join(place, "node").select("query", F.col("d").alias("order"), "node", "storey", "x", "y")
    tip = lambda e, order: asked.join(best, "query", "left_semi").select("query", F.lit(order).alias("order"), F.lit(None).cast("string").alias("node"), F.col(f"{e}_storey").alias("storey"), F.col(f"{e}_x").alias("x"), F.col(f"{e}_y").alias("y"))
    whole = inner.unionByName(tip("from", -1.0)).unionByName(tip("to", math.inf))
    step = F.row_number().over(Window.partitionBy("query").orderBy("order")) - 1  # one walk
    return whole.withColumn("step", step).join(best.select("query", "cost"), "query").select("query", "cost", "step", "node", "storey", "x", "y")


def stretches(walk: DataFrame) -> DataFrame:
    """(query, segment, storey, n, length): a walk's stretches on one storey, numbered from 0; a place that repeats the one before it on its storey is dropped."""
    w = Window.partitionBy("query").orderBy("step")
    same = F.lag("storey").over(w).eqNullSafe(F.col("storey"))
    size = F.when(same, g.distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y")))
    cut = walk.withColumns({"__new": (~same).cast("int"), "__size": size}).withColumn("segment", F.sum("__new").over(w) - 1)
    kept_ = cut.filter("__size is null or __size > 1e-9")
    return kept_.groupBy("query", "segment", "storey").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__size"), F.lit(0.0)).alias("length"))
