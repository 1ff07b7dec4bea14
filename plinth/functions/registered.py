"""SQL functions of a session: plane geometry, ids and units, for spark.sql.

register(spark) makes temporary functions whose bodies are SQL, so they are inlined
and optimised as any expression: no Python worker, and filters and pruning pass
through them.  Rings are array<struct<x: double, y: double>>, not closed.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_RING = "array<struct<x: double, y: double>>"
_EDGE = "struct<ax: double, ay: double, bx: double, by: double>"
_EDGES = "zip_with(ring, concat(slice(ring, 2, greatest(size(ring) - 1, 0)), slice(ring, 1, 1)), (a, b) -> named_struct('ax', a.x, 'ay', a.y, 'bx', b.x, 'by', b.y))"



def _segment(e: str) -> str:
    """SQL of the distance of (px, py) to the segment whose ends have this prefix."""
    dx, dy = f"({e}bx - {e}ax)", f"({e}by - {e}ay)"
    t = f"least(1D, greatest(0D, coalesce(((px - {e}ax) * {dx} + (py - {e}ay) * {dy}) / CASE WHEN {dx} * {dx} + {dy} * {dy} >= 1e-18D THEN {dx} * {dx} + {dy} * {dy} END, 0D)))"
    return f"hypot(px - {e}ax - {dx} * {t}, py - {e}ay - {dy} * {t})"


#: Name: (parameters, type, body).  Within lambdas and generators Spark inlines no function, so there a body is spelled out.
SCALARS = {
    "ring_edge_array": (f"ring {_RING}", f"array<{_EDGE}>", _EDGES),
    "ring_signed_area": (f"ring {_RING}", "double", "CASE WHEN size(ring) < 3 THEN 0D ELSE aggregate(ring_edge_array(ring), 0D, (s, e) -> s + e.ax * e.by - e.bx * e.ay) / 2 END"),
    "ring_area": (f"ring {_RING}", "double", "abs(ring_signed_area(ring))"),
    "ring_perimeter": (f"ring {_RING}", "double", "aggregate(ring_edge_array(ring), 0D, (s, e) -> s + hypot(e.bx - e.ax, e.by - e.ay))"),
    "ring_centroid": (f"ring {_RING}", "struct<x: double, y: double>", "CASE WHEN size(ring) > 0 THEN named_struct('x', aggregate(ring, 0D, (s, p) -> s + p.x) / size(ring), 'y', aggregate(ring, 0D, (s, p) -> s + p.y) / size(ring)) END"),
    "ring_box": (f"ring {_RING}", "struct<x0: double, y0: double, x1: double, y1: double>", "named_struct('x0', array_min(ring.x), 'y0', array_min(ring.y), 'x1', array_max(ring.x), 'y1', array_max(ring.y))"),
    "point_in_ring": (f"px double, py double, ring {_RING}", "boolean", "size(ring) >= 3 AND size(filter(ring_edge_array(ring), e -> (e.ay > py) <> (e.by > py) AND px < (e.bx - e.ax) * (py - e.ay) / (e.by - e.ay + 1e-15D) + e.ax)) % 2 = 1"),
    "segment_distance": ("px double, py double, ax double, ay double, bx double, by double", "double", _segment("")),
    "ring_distance": (f"px double, py double, ring {_RING}", "double", f"array_min(transform({_EDGES}, e -> {_segment('e.')}))"),
    "node_kind": ("id string", "string", "substring_index(id, ':', 1)"),
    "node_gid": ("id string", "string", "CASE WHEN instr(id, ':') > 0 THEN substring(id, instr(id, ':') + 1) END"),
    "viz_door": ("id string", "struct<door: string, source: string, target: string>", "CASE WHEN id LIKE 'viz-door:%' AND size(split(id, ':')) >= 6 THEN named_struct('door', concat_ws(':', slice(split(id, ':'), 2, 2)), 'source', concat_ws(':', slice(split(id, ':'), 4, 2)), 'target', concat_ws(':', slice(split(id, ':'), 6, size(split(id, ':')) - 5))) END"),
    "viz_exit": ("id string", "struct<door: string, space: string>", "CASE WHEN id RLIKE '^viz-exit:door:[^:]+:space:.+$' THEN named_struct('door', regexp_extract(id, '^viz-exit:door:([^:]+):space:(.+)$', 1), 'space', regexp_extract(id, '^viz-exit:door:([^:]+):space:(.+)$', 2)) END"),
    "landing_parts": ("id string", "struct<link: string, storey: string>", "CASE WHEN id LIKE 'vlink-evac:%@%' THEN named_struct('link', substring(substring_index(id, '@', size(split(id, '@')) - 1), 12), 'storey', substring_index(id, '@', -1)) END"),
    "fnv1a": ("text string", "double", "aggregate(filter(split(text, ''), c -> c <> ''), 2166136261L, (h, c) -> pmod(((h ^ cast(ascii(c) AS bigint)) & 4294967295L) * 16777619L, 4294967296L)) / 4294967296D"),
    "metres": ("size double, scale double", "double", "size * coalesce(scale, 1D)"),
}

#: Name: (parameters, columns, query).
TABLES = {
    "ring_edges": (f"ring {_RING}", "i int, ax double, ay double, bx double, by double", f"SELECT pos, col.ax, col.ay, col.bx, col.by FROM posexplode({_EDGES})"),
    "boundary_samples": (
        f"ring {_RING}, step double", "i int, k int, x double, y double",
        f"SELECT pos, k, col.ax + k / n * (col.bx - col.ax), col.ay + k / n * (col.by - col.ay) FROM (SELECT pos, col, cast(greatest(1, ceil(hypot(col.bx - col.ax, col.by - col.ay) / step)) AS int) AS n FROM posexplode({_EDGES}) WHERE size(ring) >= 3 AND hypot(col.bx - col.ax, col.by - col.ay) >= 1e-9D) AS e, LATERAL explode(sequence(0, n)) AS s(k)",
    ),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL; again and again does no harm."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (parameters, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
