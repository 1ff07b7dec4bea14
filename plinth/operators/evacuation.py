"""Evacuation of a building: distances to the nearest exit, loads, bottlenecks.

Portals (doors, exits) and stair landings are nodes; two nodes of one room are a
straight walk apart, neighbouring landings of one stair max(|rise|, 1).

Distances settle over tiles: a room is in one tile of its storey, and so is each walk
in it.  Nodes of two tiles are borders.  Every tile is contracted to the distances
between its borders and from its exits, four by four (and four storeys) make a tile of
the next level, which is contracted in turn, until one is left: its borders settle
from the exits, and then each level's tiles from their borders, down to the rooms.
The rounds are twice the logarithm of the building's extent, and no group holds more
than one tile's rooms, or the borders of the tiles within a larger one.

Of several ways that are equally long, to 1e-7, a node goes by the neighbour with
the smallest name (portals before landings) among those that are nearer to an exit; a
node at the very place of another one that has such a neighbour goes by that one.  So
every node has one parent, and loads don't depend on the order of rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.graph import kept

#: Square metres for one occupant, least occupants of a room, least vertical cost.
AREA_OF_ONE, LEAST_OCCUPANTS, LEAST_RISE = 10.0, 1.0, 1.0
#: Metres within which two ways are equally long.
_EQUAL = 1e-7

#: Metres of a tile's side; tiles of one level in a row that make one of the next.
TILE, FACTOR = 40.0, 4
#: Stands for all exits at once: in every tile that has one, at no distance from it.
_OUT = ""


def occupants(area):
    return F.greatest(area / AREA_OF_ONE, F.lit(LEAST_OCCUPANTS))


def landings(stairs: DataFrame, spaces: DataFrame, storeys: DataFrame) -> DataFrame:
    """(stair, storey, elevation, space, x, y): stairs (with place x, y and own storey) meet the room around them on their storey and the next higher one; one landing a storey, the smallest room name."""
    order = storeys.agg(F.array_sort(F.collect_list(F.struct("elevation", "storey"))).alias("all"))  # a building's storeys
    own = stairs.crossJoin(F.broadcast(order))
    at = F.array_position(F.transform("all", lambda s: s["storey"]), F.col("storey")).cast("int")
    on = own.withColumn("level", F.explode(F.slice("all", at, F.lit(2)))).select("stair", "x", "y", F.col("level.storey").alias("storey"), F.col("level.elevation").alias("elevation"))
    room = spaces.select("space", "storey", "x0", "y0", "x1", "y1")
    met = on.join(room, "storey").filter("x between x0 and x1 and y between y0 and y1")
    return met.groupBy("stair", "storey", "elevation").agg(F.min(F.struct("space", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))).alias("r")).select("stair", "storey", "elevation", "r.space", "r.x", "r.y")


# --- tiles -----------------------------------------------------------------------------
# A group's function gets its nodes (node, space, x, y, border) on the lowest level or its edges (a, b, cost) on the others.


def _matrix(nodes: pd.DataFrame, edges: pd.DataFrame, marked: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Names, and costs of the steps between them: walks within rooms, and the given edges."""
    names = sorted({*nodes.node, *edges.a, *edges.b, *marked.a})
    at = {n: k for k, n in enumerate(names)}
    cost = np.full((len(names), len(names)), np.inf)
    for _, room in nodes.groupby("space", sort=False):
        k, x, y = room.node.map(at).to_numpy(), room.x.to_numpy(float), room.y.to_numpy(float)
        walk = np.hypot(x[:, None] - x, y[:, None] - y)
        cost[np.ix_(k, k)] = np.minimum(cost[np.ix_(k, k)], walk)
    if len(edges):
        i, j, c = edges.a.map(at).to_numpy(), edges.b.map(at).to_numpy(), edges.cost.to_numpy(float)
        np.minimum.at(cost, (i, j), c)
        np.minimum.at(cost, (j, i), c)
    np.fill_diagonal(cost, 0.0)
    return names, cost


def _contracted(names: list[str], cost: np.ndarray, borders: set[str]) -> pd.DataFrame:
    """(a, b, cost) between borders, the other nodes taken out one after another."""
    inner = np.array([n not in borders for n in names], bool)
    order = np.concatenate([np.flatnonzero(inner), np.flatnonzero(~inner)])
    cost, n = cost[np.ix_(order, order)], int(inner.sum())
    for k in range(n):  # what is left meets over k what is left of k
        rest = slice(k + 1, None)
        np.minimum(cost[rest, rest], cost[rest, k : k + 1] + cost[k : k + 1, rest], out=cost[rest, rest])
    left = [names[k] for k in order[n:]]
    i, j = np.nonzero(np.triu(np.isfinite(cost[n:, n:]), 1))
    return pd.DataFrame({"a": pd.Series([left[k] for k in i], dtype=object), "b": pd.Series([left[k] for k in j], dtype=object), "cost": cost[n:, n:][i, j]})


def _settled(names: list[str], cost: np.ndarray, known: dict[str, float]) -> np.ndarray:
    """Distances from what is known, by Dijkstra's rule."""
    far = np.array([known.get(n, np.inf) for n in names], float)
    heap, done = [(d, k) for k, d in enumerate(far.tolist()) if d < np.inf], np.zeros(len(names), bool)
    heapq.heapify(heap)
    while heap:
        d, k = heapq.heappop(heap)
        if done[k]:
            continue
        done[k] = True
        nearer = np.flatnonzero(d + cost[k] < far)
        far[nearer] = d + cost[k][nearer]
        for j in nearer.tolist():
            heapq.heappush(heap, (float(far[j]), j))
    return far


_KEY, _NODES, _EDGES = ["tx", "ty", "tz"], ["node", "space", "x", "y"], ["a", "b", "cost"]
_ROW = "tx bigint, ty bigint, tz bigint, kind int, a string, b string, space string, x double, y double, cost double, border boolean"


def _parts(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """A tile's nodes, edges, and known distances (with borders)."""
    return rows[rows.kind == 0].rename(columns={"a": "node"}), rows[rows.kind == 1], rows[rows.kind == 2]


def _up(factor: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, edges, borders = _parts(rows)
        out = _contracted(*_matrix(nodes, edges, borders), set(borders.a))
        return out.assign(**{k: rows[k].iloc[0] // factor for k in _KEY})[[*_KEY, *_EDGES]]

    return run


def _down(rows: pd.DataFrame) -> pd.DataFrame:
    nodes, edges, known = _parts(rows)
    names, cost = _matrix(nodes, edges, known)
    far = _settled(names, cost, dict(zip(known.a, known.cost, strict=True)))
    return pd.DataFrame([(n, d) for n, d in zip(names, far.tolist(), strict=True) if d < np.inf], columns=["node", "distance"], dtype=object)


def _down_to_rooms(rows: pd.DataFrame) -> pd.DataFrame:
    """With the smallest neighbour that is nearer, and neighbours at the very same place."""
    nodes, edges, known = _parts(rows)
    names, cost = _matrix(nodes, edges, known)
    far = np.round(_settled(names, cost, dict(zip(known.a, known.cost, strict=True))), 9)
    np.fill_diagonal(cost, np.inf)
    out = []
    for k, name in enumerate(names):
        if name != _OUT and np.isfinite(far[k]):
            step = np.flatnonzero(far + cost[k] <= far[k] + _EQUAL)
            step = step[[names[j] != _OUT for j in step.tolist()]] if len(step) else step
            nearer, same = step[far[step] < far[k] - _EQUAL], step[cost[k][step] <= _EQUAL]
            out.append((name, float(far[k]), names[nearer[0]] if len(nearer) else None, [names[j] for j in same.tolist()]))
    return pd.DataFrame(out, columns=["node", "distance", "nearer", "same"], dtype=object)


def _rows(df: DataFrame, kind: int, **columns) -> DataFrame:
    null = {"a": "string", "b": "string", "space": "string", "x": "double", "y": "double", "cost": "double", "border": "boolean"}
    return df.select(*_KEY, F.lit(kind).alias("kind"), *((F.col(columns[c]) if c in columns else F.lit(None)).cast(k).alias(c) for c, k in null.items()))


def _borders(homes: DataFrame) -> DataFrame:
    """Homes (node, tx, ty, tz) of nodes with more than one, and of all exits' stand-in."""
    several = homes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | (F.col("node") == _OUT)).select("node")
    return homes.join(several, "node", "left_semi")


def exit_distances(links: DataFrame, doors: DataFrame, landing: DataFrame, spaces: DataFrame, storeys: DataFrame, *, blocked_portals: DataFrame | None = None, blocked_spaces: DataFrame | None = None, blocked_landings: DataFrame | None = None) -> DataFrame:
    """(node, distance, parent) of every node that an exit can be reached from; an exit is its own parent.

    blocked_portals (door), blocked_spaces (space), blocked_landings (stair, storey)
    are left out; a stair's landings on either side of a blocked one are neighbours.
    """
    links, landing, exits = without_blocked(links, landing, blocked_portals, blocked_spaces, blocked_landings)
    level = storeys.select("storey", (F.row_number().over(Window.orderBy("elevation", "storey")) - 1).cast("bigint").alias("tz"))  # a building's storeys
    least = spaces.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0")).first()
    tile = lambda c: F.floor((F.col(c) - (least[c] or 0.0)) / TILE).cast("bigint")  # noqa: E731  from 0 on, so that levels come to one tile
    room = spaces.join(F.broadcast(level), "storey").select("space", tile("x0").alias("tx"), tile("y0").alias("ty"), "tz")
    portal = links.join(doors.select("door", "x", "y"), "door").select(F.concat(F.lit("p:"), "door").alias("node"), "space", "x", "y")
    name = F.concat(F.lit("v:"), "stair", F.lit("@"), "storey")
    nodes = kept(portal.unionByName(landing.select(name.alias("node"), "space", "x", "y")).join(room, "space"))
    chain = Window.partitionBy("stair").orderBy("elevation", "storey")
    rise = landing.join(room, "space").select(name.alias("a"), F.lead(name).over(chain).alias("b"), F.greatest(F.lead("elevation").over(chain) - F.col("elevation"), F.lit(LEAST_RISE)).alias("cost"), *_KEY).filter("b is not null")
    out = nodes.join(exits.select(F.concat(F.lit("p:"), "door").alias("node")), "node", "left_semi").groupBy("node").agg(F.min(F.struct(*_KEY)).alias("t")).select(F.lit(_OUT).alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("cost"), "t.*")
    edges = kept(rise.unionByName(out))
    homes = nodes.select("node", *_KEY).union(edges.select("a", *_KEY)).union(edges.select("b", *_KEY)).distinct()
    extent = nodes.agg(*(f(k).alias(f"{f.__name__}_{k}") for k in _KEY for f in (F.min, F.max))).first()

    cells, levels, at_nodes = [(extent[f"min_{k}"] or 0, extent[f"max_{k}"] or 0) for k in _KEY], [], _rows(nodes, 0, a="node", space="space", x="x", y="y")
    content = at_nodes.unionByName(_rows(edges, 1, a="a", b="b", cost="cost"))
    while any(low != high for low, high in cells):
        border = kept(_borders(homes))
        levels.append((content, border))
        up = content.unionByName(_rows(border, 2, a="node")).groupBy(*_KEY).applyInPandas(_up(FACTOR), "tx bigint, ty bigint, tz bigint, a string, b string, cost double")
        content = _rows(kept(up), 1, a="a", b="b", cost="cost")
        homes = border.select("node", *(F.floor(F.col(k) / FACTOR).cast("bigint").alias(k) for k in _KEY)).distinct()
        cells = [(low // FACTOR, high // FACTOR) for low, high in cells]
    known = content.limit(0).sparkSession.createDataFrame([(_OUT, 0.0)], "node string, distance double")
    levels.append((content, known.select("node", *(F.lit(low).cast("bigint").alias(k) for k, (low, _) in zip(_KEY, cells, strict=True)))))
    for content, border in levels[:0:-1]:
        seeds = border.join(known, "node")
        found = content.unionByName(_rows(seeds, 2, a="node", cost="distance")).groupBy(*_KEY).applyInPandas(_down, "node string, distance double")
        known = kept(found.groupBy("node").agg(F.min("distance").alias("distance")))
    content, border = levels[0]
    seeds = border.join(known, "node")
    last = content.unionByName(_rows(seeds, 2, a="node", cost="distance")).groupBy(*_KEY).applyInPandas(_down_to_rooms, "node string, distance double, nearer string, same array<string>")
    found = kept(last.groupBy("node").agg(F.min("distance").alias("distance"), F.min("nearer").alias("nearer"), F.flatten(F.collect_list("same")).alias("same")))
    return _with_parents(found, exits.select(F.concat(F.lit("p:"), "door").alias("node")))


def _with_parents(found: DataFrame, exits: DataFrame) -> DataFrame:
    """Exits are their own parents, others go by the nearer neighbour, or by one at the same place that has a parent, and so on."""
    marked = found.join(exits.withColumn("__exit", F.lit(True)), "node", "left")
    state = marked.select("node", "distance", F.when(F.col("__exit"), F.col("node")).otherwise(F.col("nearer")).alias("parent"), "same")
    while True:
        held = state.filter("parent is not null").select(F.col("node").alias("near"))
        beside = state.filter("parent is null").select("node", F.explode("same").alias("near")).join(held, "near").groupBy("node").agg(F.min("near").alias("__by"))
        state = kept(state.join(beside, "node", "left").select("node", "distance", F.coalesce("parent", "__by").alias("parent"), "same", F.col("__by").isNotNull().alias("__new")))
        if state.filter("parent is null").isEmpty() or state.filter("__new").isEmpty():
            return state.select("node", "distance", "parent")


def without_blocked(links: DataFrame, landing: DataFrame, portals: DataFrame | None, spaces: DataFrame | None, landings: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, landing, exits (door)) that are left; a door of two rooms is no exit, whichever of them is blocked."""
    exits = links.groupBy("door").agg(F.count_distinct("space").alias("n")).filter("n = 1").select("door")
    if portals is not None:
        links = links.join(portals.select("door"), "door", "left_anti")
    if spaces is not None:
        links, landing = (df.join(spaces.select("space"), "space", "left_anti") for df in (links, landing))
    if landings is not None:
        landing = landing.join(landings.select("stair", "storey"), ["stair", "storey"], "left_anti")
    return links, landing, exits.join(links.select("door"), "door", "left_semi")


def exit_of(distances: DataFrame) -> DataFrame:
    """(node, exit): where the parents lead to, by doubling pointers."""
    state = distances.select("node", "parent")
    while True:
        for _ in range(3):  # in one plan
            up = state.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
            state = state.join(up, "parent", "left").select("node", F.coalesce("further", "parent").alias("parent"), (F.col("further") != F.col("parent")).alias("moved"))
        state = kept(state)
        if state.filter("moved").isEmpty():
            return state.select("node", F.col("parent").alias("exit"))


def room_exits(spaces: DataFrame, links: DataFrame, doors: DataFrame, landing: DataFrame, distances: DataFrame, *, blocked_portals: DataFrame | None = None, blocked_spaces: DataFrame | None = None, blocked_landings: DataFrame | None = None) -> DataFrame:
    """(space, storey, weight, node, distance): each open room's way out from its middle; null where there is none."""
    links, landing, _ = without_blocked(links, landing, blocked_portals, blocked_spaces, blocked_landings)
    if blocked_spaces is not None:
        spaces = spaces.join(blocked_spaces.select("space"), "space", "left_anti")
    room = spaces.select("space", "storey", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"), occupants((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("weight"))
    portal = links.join(doors.select("door", "x", "y"), "door").select("space", F.concat(F.lit("p:"), "door").alias("node"), "x", "y")
    nodes = portal.unionByName(landing.select("space", F.concat(F.lit("v:"), "stair", F.lit("@"), "storey").alias("node"), "x", "y")).distinct()
    way = room.select("space", "mx", "my").join(nodes, "space").join(distances.select("node", "distance"), "node")
    total = F.round(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")) + F.col("distance"), 9)
    best = way.groupBy("space").agg(F.min(F.struct(F.round(total, 7).alias("about"), F.col("node").alias("node"), total.alias("distance"))).alias("b")).select("space", "b.node", "b.distance")
    return room.join(best, "space", "left").select("space", "storey", "weight", "node", "distance")


def loads(rooms: DataFrame, distances: DataFrame) -> DataFrame:
    """(node, load): occupants that pass each node on their way, summed down the exit tree.

    Pointers double: after k rounds a node has the loads of all nodes less than 2 ** k
    steps below it, so the rounds are the logarithm of the longest way.
    """
    own = rooms.filter("node is not null").groupBy("node").agg(F.sum("weight").alias("own"))
    up = distances.select("node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("up"))
    state = kept(up.join(own, "node", "left").select("node", "up", F.coalesce("own", F.lit(0.0)).alias("load")))
    while not state.filter("up is not null").isEmpty():
        for _ in range(3):  # in one plan
            more = state.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("load").alias("more"))
            further = state.select(F.col("node").alias("up"), F.col("up").alias("further"))
            lifted = state.join(further, "up", "left").join(more, "node", "left")
            state = lifted.select("node", F.col("further").alias("up"), (F.col("load") + F.coalesce("more", F.lit(0.0))).alias("load"))
        state = kept(state)
    return state.filter("load > 0").select("node", F.round("load", 6).alias("load"))


def bottlenecks(load: DataFrame, n: int = 8) -> DataFrame:
    """The n nodes of the largest loads; names break ties."""
    return load.orderBy(F.desc("load"), "node").limit(n)
