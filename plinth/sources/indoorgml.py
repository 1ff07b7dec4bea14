"""IndoorGML files as rows: cells, states, transitions and boundaries, by local names in any namespace."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS = "model string, kind string, id string, name string, refs array<string>, coords array<struct<x: double, y: double, z: double>>"


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _attribute(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


def _coordinates(element) -> list[tuple[float, float, float]]:
    out = []
    for e in element.iter():
        if _local(e.tag) in ("pos", "posList") and e.text:
            v = [float(x) for x in e.text.split()]
            out += [(v[i], v[i + 1], v[i + 2]) for i in range(0, len(v) - 2, 3)]
    return out


def parse(model: str, content: bytes) -> list[tuple]:
    """Rows of one document; a cell refers to its state, a transition to its two states and its boundary."""
    rows = []
    for e in ET.fromstring(content).iter():
        kind = _local(e.tag)
        if kind in ("CellSpace", "CellSpaceBoundary", "State", "Transition") and _attribute(e, "id"):
            wanted = ("connects", "duality")
            refs = [h.lstrip("#") for c in e.iter() if _local(c.tag) in wanted and (h := _attribute(c, "href"))]
            name = next((c.text for c in e if _local(c.tag) == "name" and c.text), None)
            rows.append((model, kind, _attribute(e, "id"), name, refs, _coordinates(e)))
    return rows


def read_indoorgml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each cell, boundary, state and transition of the files; each file is parsed in the task that reads it."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ("model", "kind", "id", "name", "refs", "coords")]
        for b in batches:
            for model, content in zip(b["path"], b["content"], strict=True):
                found = pd.DataFrame(parse(model, content), columns=columns)
                yield found.assign(coords=[[{"x": x, "y": y, "z": z} for x, y, z in c] for c in found["coords"]])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, _ROWS)


def connections(rows: DataFrame) -> DataFrame:
    """(model, transition, door, a, b, x, y): transitions as doors between the two cells; the place is the boundary's middle, else that of the cells.

    Both cells must have polygons.
    """
    middle = lambda c: F.when(F.size(c) > 0, F.struct((F.aggregate(c, F.lit(0.0), lambda a, p: a + p["x"]) / F.size(c)).alias("x"), (F.aggregate(c, F.lit(0.0), lambda a, p: a + p["y"]) / F.size(c)).alias("y")))
    state = rows.filter("kind = 'State'").select("model", F.col("id").alias("state"), F.get("refs", F.lit(0)).alias("cell"))
    cell = rows.filter("kind = 'CellSpace' and size(coords) >= 3").select("model", F.col("id").alias("cell"), middle(F.col("coords")).alias("at"))
    place = state.join(cell, ["model", "cell"])
    t = rows.filter("kind = 'Transition'").select("model", F.col("id").alias("transition"), "refs")
    a, b = (place.select(*(F.col(c).alias(f"{e}_{c}") for c in ("model", "state", "cell", "at"))) for e in ("a", "b"))
    both = t.join(a, (F.col("model") == F.col("a_model")) & F.array_contains("refs", F.col("a_state"))).join(b, (F.col("model") == F.col("b_model")) & F.array_contains("refs", F.col("b_state"))).filter("a_state < b_state")
    edge = rows.filter("kind = 'CellSpaceBoundary'").select(F.col("model").alias("e_model"), F.col("id").alias("boundary"), middle(F.col("coords")).alias("e_at"))
    both = both.join(edge, (F.col("model") == F.col("e_model")) & F.array_contains("refs", F.col("boundary")), "left")
    at = F.coalesce("e_at", F.struct(((F.col("a_at.x") + F.col("b_at.x")) / 2).alias("x"), ((F.col("a_at.y") + F.col("b_at.y")) / 2).alias("y")))
    return both.select("model", "transition", F.coalesce("boundary", F.concat(F.lit("transition_"), "transition")).alias("door"), F.col("a_cell").alias("a"), F.col("b_cell").alias("b"), at["x"].alias("x"), at["y"].alias("y"))
