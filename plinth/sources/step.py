"""STEP-21 (IFC) text as rows, and the entity tables that come from it.

A file is read as statements that end in a semicolon outside quotes and comments;
each `#id = TYPE(args)` is a row.  Arguments are split at commas outside quotes and
parentheses.  A file is a row until its statements are cut, as uploads are capped.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java patterns: a quoted string, a comment, a statement with its semicolon.  Possessive, so long statements take no stack.
_QUOTED, _COMMENT = r"'(?:[^']++|'')*+'", r"/\*(?s:.*?)\*/"
_STATEMENT = rf"(?:[^';/]++|{_QUOTED}|{_COMMENT}|/)*+;"
_TOKEN = re.compile(r"'(?:[^']|'')*'|[(),]")


def split_arguments(text: str) -> list[str]:
    """Top-level arguments, quotes and parentheses kept."""
    out, depth, start = [], 0, 0
    for token in _TOKEN.finditer(text):
        c = token.group()
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[start : token.start()].strip())
            start = token.end()
    return [*out, text[start:].strip()] if text.strip() else out


def member_text(content: bytes) -> str:
    """A file's text; of a zip archive that of its first .ifc or .ifcxml member.  An archive without one is an error."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = [n for n in archive.namelist() if n.lower().endswith((".ifc", ".ifcxml"))]
            if not names:
                raise ValueError("the archive holds no .ifc or .ifcxml file")
            content = archive.read(names[0])
    return content.decode("utf-8", "replace")


def read_step(spark: SparkSession, path: str) -> DataFrame:
    """(model, id, type, args) of every statement of the .ifc and .ifczip files; other statements are left out.

    Comments outside strings go, line ends become spaces, strings keep semicolons,
    commas, parentheses and what looks like a comment.  Empty files have no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"model": b["path"], "value": b["content"].map(member_text)})

    cut = files.mapInPandas(texts, "model string, value string")
    cut = cut.select("model", F.explode(F.regexp_extract_all("value", F.lit(_STATEMENT), 0)).alias("value"))
    cut = cut.withColumn("value", F.regexp_replace("value", f"({_QUOTED})|{_COMMENT}", "$1"))
    cut = cut.withColumn("value", F.regexp_replace("value", r"[\r\n]+", " "))
    parts = [F.regexp_extract("value", r"^\s*#(\d+)\s*=\s*(\w+)\s*\((.*)\)\s*;$", k) for k in (1, 2, 3)]
    rows = cut.select("model", parts[0].alias("id"), F.upper(parts[1]).alias("type"), parts[2].alias("args"))
    rows = rows.filter("id <> ''").withColumn("id", F.col("id").cast("bigint"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(args=b["args"].map(split_arguments))

    return rows.mapInPandas(split, "model string, id bigint, type string, args array<string>")


def unquoted(c):
    """A string argument without quotes; $ and * are null."""
    return F.when(c.isin("$", "*"), None).otherwise(F.regexp_replace(F.regexp_replace(c, r"^'|'$", ""), "''", "'"))


def reference(c):
    return F.regexp_extract(c, r"^#(\d+)$", 1).cast("bigint")


def references(c):
    return F.transform(F.expr("regexp_extract_all({}, '#(\\\\d+)', 1)".format(c)), lambda x: x.cast("bigint"))


#: Kinds of entity, each with its class and the classes below it.
CLASSES = {
    "storey": ("IFCBUILDINGSTOREY",),
    "space": ("IFCSPACE",),
    "door": ("IFCDOOR", "IFCDOORSTANDARDCASE"),
    "window": ("IFCWINDOW", "IFCWINDOWSTANDARDCASE"),
    "stair": ("IFCSTAIR",),
    "lift": ("IFCTRANSPORTELEMENT",),
    "wall": ("IFCWALL", "IFCWALLSTANDARDCASE", "IFCWALLELEMENTEDCASE"),
    "opening": ("IFCOPENINGELEMENT", "IFCOPENINGSTANDARDCASE"),
    "furniture": ("IFCFURNISHINGELEMENT", "IFCFURNITURE", "IFCSYSTEMFURNITUREELEMENT"),
}
KINDS = {name: kind for kind, names in CLASSES.items() for name in names}


def entities(step: DataFrame) -> DataFrame:
    """(model, id, kind, global_id, name, object_type): names fall back to the object type, trimmed."""
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("type")]
    at = lambda i: unquoted(F.get("args", F.lit(i)))
    rows = step.withColumn("kind", kind).filter("kind is not null")
    name = F.trim(F.coalesce(F.nullif(at(2), F.lit("")), F.nullif(at(4), F.lit("")), F.lit("")))
    return rows.select("model", "id", "kind", at(0).alias("global_id"), name.alias("name"), at(4).alias("object_type"))


def element_storeys(step: DataFrame) -> DataFrame:
    """(model, element, storey): by containment first, else by the first aggregation under a storey."""
    storey = step.filter("type = 'IFCBUILDINGSTOREY'").select("model", F.col("id").alias("storey"))
    one = lambda kind, whole, parts: step.filter(F.col("type") == kind).select("model", F.col("id").alias("rel"), reference(F.get("args", F.lit(whole))).alias("storey"), F.explode(references(f"args[{parts}]")).alias("element"))
    contained = one("IFCRELCONTAINEDINSPATIALSTRUCTURE", 5, 4).withColumn("rank", F.lit(0))
    below = one("IFCRELAGGREGATES", 4, 5).withColumn("rank", F.lit(1))
    found = contained.unionByName(below).join(storey, ["model", "storey"])
    return found.groupBy("model", "element").agg(F.min_by("storey", F.struct("rank", "rel")).alias("storey"))


def space_boundaries(step: DataFrame) -> DataFrame:
    """(model, edge, space, element): second-level relations of rooms with doors, stairs and lifts; of one id the last counts."""
    rel = step.filter(F.col("type").startswith("IFCRELSPACEBOUNDARY")).select("model", F.col("id").alias("rel"), unquoted(F.get("args", F.lit(0))).alias("edge"), reference(F.get("args", F.lit(4))).alias("space"), reference(F.get("args", F.lit(5))).alias("element"))
    e = entities(step)
    rel = rel.join(e.filter("kind = 'space'").select("model", F.col("id").alias("space")), ["model", "space"]).join(e.filter("kind in ('door', 'stair', 'lift')").select("model", F.col("id").alias("element"), "kind"), ["model", "element"])
    last = rel.groupBy("model", "edge").agg(F.max_by(F.struct("space", "element", "kind"), "rel").alias("r"))
    return last.select("model", "edge", "r.*")


def aggregated_parts(step: DataFrame) -> DataFrame:
    """(model, element, part): the parts of each whole, as the flights of a stair; each pair once, wholes that don't exist left out."""
    whole = reference(F.get("args", F.lit(4))).alias("element")
    rel = step.filter("type = 'IFCRELAGGREGATES'").select("model", whole, F.explode(references("args[5]")).alias("part"))
    return rel.distinct().join(step.select("model", F.col("id").alias("element")), ["model", "element"], "left_semi")


def openings(step: DataFrame) -> DataFrame:
    """(model, opening, global_id, name, storey, host, host_is_wall, door, window) of every opening.

    Of several hosts the first relation's counts, of several doors and windows that
    fill it the last's (global ids; a filler without one is none).  The storey is the
    opening's own, else its host's.
    """
    e = entities(step).select("model", "id", "kind", "global_id", "name")
    pair = lambda kind: step.filter(F.col("type") == kind).select("model", F.col("id").alias("rel"), reference(F.get("args", F.lit(4))).alias("first"), reference(F.get("args", F.lit(5))).alias("second"))
    voids = pair("IFCRELVOIDSELEMENT").join(step.select("model", F.col("id").alias("first")), ["model", "first"], "left_semi")
    hosts = voids.groupBy("model", F.col("second").alias("id")).agg(F.min_by("first", "rel").alias("host"))
    fillers = e.filter("kind in ('door', 'window') and global_id <> ''").select("model", F.col("id").alias("second"), "kind", F.col("global_id").alias("filler"))
    last = lambda kind: F.max_by("filler", F.when(F.col("kind") == kind, F.col("rel"))).alias(kind)
    filled = pair("IFCRELFILLSELEMENT").join(fillers, ["model", "second"]).groupBy("model", F.col("first").alias("id")).agg(last("door"), last("window"))
    storey = element_storeys(step)
    walls = e.filter("kind = 'wall'").select("model", F.col("id").alias("host"), F.lit(True).alias("is_wall"))
    found = e.filter("kind = 'opening'").join(hosts, ["model", "id"], "left").join(filled, ["model", "id"], "left").join(walls, ["model", "host"], "left")
    found = found.join(storey.select("model", F.col("element").alias("id"), F.col("storey").alias("own")), ["model", "id"], "left")
    found = found.join(storey.select("model", F.col("element").alias("host"), F.col("storey").alias("of_host")), ["model", "host"], "left")
    wall = F.coalesce("is_wall", F.lit(False)).alias("host_is_wall")
    return found.select("model", F.col("id").alias("opening"), "global_id", "name", F.coalesce("own", "of_host").alias("storey"), "host", wall, "door", "window")
