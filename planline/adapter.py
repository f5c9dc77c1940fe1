"""Entities from the star-schema tables: parcels, labels, paths and their dictionaries.

The expressions are written once, as text that Spark and an independent SQL engine read
alike; :func:`parcels`, :func:`labels` and :func:`paths` apply them to DataFrames and
``SQL_ENTITIES`` holds them as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PARCEL_BASE = (
    "p_partkey AS handle, p_brand AS layer, p_type AS kind, CAST(p_size AS INT) AS size_code, p_retailprice AS price, "
    "(p_partkey % 40) * 40e0 AS x0, floor(p_partkey / 40e0) * 40e0 AS y0, "
    "10e0 + 5e0 * (p_size % 7) AS w, 12e0 + 4e0 * (p_size % 5) AS h"
)
_PARCEL_CORNERS = (
    "handle, layer, kind, size_code, price, w, h, w * h AS area, x0 AS x1, y0 AS y1, "
    "x0 + 8e-1 * w AS x2, y0 + 6e-1 * w AS y2, "
    "x0 + 8e-1 * w - 6e-1 * h AS x3, y0 + 6e-1 * w + 8e-1 * h AS y3, "
    "x0 - 6e-1 * h AS x4, y0 + 8e-1 * h AS y4"
)
_PARCEL_BOX = (
    "*, least(x1, x2, x3, x4) AS minx, least(y1, y2, y3, y4) AS miny, "
    "greatest(x1, x2, x3, x4) AS maxx, greatest(y1, y2, y3, y4) AS maxy, (x1 + x3) / 2e0 AS cx, (y1 + y3) / 2e0 AS cy"
)
_LABEL = (
    "o_orderkey AS handle, o_orderpriority AS layer, o_orderstatus AS status, CAST(o_orderkey % 500 AS VARCHAR(10)) AS text, "
    "((o_orderkey * 7919) % 1600000) / 1000e0 AS x, ((o_custkey * 104729 + o_orderkey * 31) % 2000000) / 1000e0 AS y"
)
_PATH = (
    "l_orderkey * 8 + l_linenumber AS handle, l_orderkey AS block, l_returnflag AS layer, l_linestatus AS layout, "
    "CASE l_linenumber % 4 WHEN 0 THEN 'LINE' WHEN 1 THEN 'ARC' WHEN 2 THEN 'LWPOLYLINE' ELSE 'CIRCLE' END AS type, "
    "CASE WHEN l_discount > 2e-2 THEN l_quantity END AS length, l_extendedprice AS price, "
    "l_orderkey * 8 + l_linenumber AS node_a, l_orderkey * 8 + l_linenumber + 1 AS node_b"
)
# ends near the nodes of a lattice, off by up to 0.002; a sixth path ends in the middle of the fourth
_PATH_ENDS = (
    "*, (node_a % 4096) * 5e0 + ((handle * 7) % 5 - 2) * 1e-3 AS ax, floor(node_a / 4096e0) * 5e0 AS ay, "
    "CASE WHEN handle % 8 = 6 THEN ((handle - 2) % 4096) * 5e0 + 25e-1 ELSE (node_b % 4096) * 5e0 + ((handle * 3) % 5 - 2) * 1e-3 END AS bx, "
    "CASE WHEN handle % 8 = 6 THEN floor((handle - 2) / 4096e0) * 5e0 ELSE floor(node_b / 4096e0) * 5e0 END AS b_y"
)

SQL_ENTITIES = f"""WITH parcels AS (SELECT {_PARCEL_BOX} FROM (SELECT {_PARCEL_CORNERS} FROM (SELECT {_PARCEL_BASE} FROM part))),
labels AS (SELECT {_LABEL} FROM orders),
paths AS (SELECT {_PATH_ENDS} FROM (SELECT {_PATH} FROM lineitem))"""

#: Outlines in their own frame, for drawings with more than rectangles: form, vertex, u, v, bulge of the span that starts there.
_OUTLINES = """
0,0,0,0,0 0,1,1,0,0 0,2,1,1,0 0,3,0,1,0
1,0,0,0,0 1,1,1,0,0 1,2,1,.4,0 1,3,.4,.4,0 1,4,.4,1,0 1,5,0,1,0
2,0,0,0,0 2,1,1,0,0 2,2,1,.3,0 2,3,.3,.3,0 2,4,.3,.7,0 2,5,1,.7,0 2,6,1,1,0 2,7,0,1,0
3,0,0,0,0 3,1,1,0,0 3,2,.3,1,0
4,0,0,0,0 4,1,1,0,.5 4,2,1,1,0 4,3,0,1,-.25
5,0,0,0,0 5,1,.5,.2,0 5,2,1,0,.4 5,3,1,1,0
6,0,0,0,0 6,1,1,0,0 6,2,1,0,0 6,3,.7,1,0 6,4,0,0,0
7,0,0,0,0 7,1,1,.5,0
8,0,0,0,0 8,1,1,1,0 8,2,1,0,0 8,3,0,1,0
10,0,0,.5,0 10,1,.5,0,0 10,2,1,.5,0 10,3,.5,1,0
11,0,0,0,0 11,1,.5,0,0 11,2,1,0,0
"""
_VERTICES = ", ".join("({0}, {1}, {2}e0, {3}e0, {4}e0)".format(*v.split(",")) for v in _OUTLINES.split())
#: The extrusion turns by handle: upright, mirrored, and two that are tilted. Form 9 has no vertices, 5 is open, 11 is flat.
_SHAPE_BASE = (
    "SELECT p_partkey AS handle, p_brand AS layer, p_type AS kind, CAST(p_partkey % 12 AS INT) AS form, p_retailprice AS price, "
    "(p_partkey % 50) * 22e0 AS x0, floor(p_partkey / 50e0) * 22e0 AS y0, 10e0 + 5e0 * (p_size % 7) AS w, 12e0 + 4e0 * (p_size % 5) AS h, "
    "CASE p_partkey % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 8e-1 WHEN 2 THEN 6e-1 ELSE 28e-2 END AS turn_c, "
    "CASE p_partkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 6e-1 WHEN 2 THEN -8e-1 ELSE 96e-2 END AS turn_s, "
    "CASE WHEN p_partkey % 7 = 3 THEN 6e-1 WHEN p_partkey % 14 = 5 THEN 5e-3 ELSE 0e0 END AS nx, "
    "CASE WHEN p_partkey % 14 = 5 THEN -3e-3 ELSE 0e0 END AS ny, "
    "CASE WHEN p_partkey % 5 = 2 THEN -1e0 WHEN p_partkey % 7 = 3 THEN 8e-1 ELSE 1e0 END AS nz, "
    "CASE WHEN p_partkey % 6 = 1 THEN 25e-1 ELSE 0e0 END AS elevation, p_partkey % 23 = 4 AS wavy FROM {part}"
)
_SHAPES = (
    f"SELECT b.handle, b.layer, b.kind, b.form, b.price, b.nx, b.ny, b.nz, b.elevation, b.form <> 5 AS closed, o.k, o.bulge, "
    "x0 + turn_c * u * w - turn_s * v * h AS x, y0 + turn_s * u * w + turn_c * v * h AS y, "
    f"CASE WHEN wavy THEN b.elevation + o.k ELSE b.elevation END AS z FROM ({_SHAPE_BASE}) b LEFT JOIN (VALUES {_VERTICES}) AS o(form, k, u, v, bulge) ON b.form = o.form"
)
SQL_SHAPES = "shape_vertices AS (" + _SHAPES.format(part="part") + ")"


def _split(text: str) -> list[str]:
    """Top-level commas cut a select list."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[at:k])
            at = k + 1
    return [*out, text[at:]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed rings with layer, kind, area, corners, box, centre and ``ring``."""
    df = table(spark, sf_dir, "part").selectExpr(*_split(_PARCEL_BASE)).selectExpr(*_split(_PARCEL_CORNERS)).selectExpr(*_split(_PARCEL_BOX))
    ring = F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(1, 5)])
    return df.withColumn("ring", ring)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text points: handle, layer, status, text, x, y."""
    return table(spark, sf_dir, "orders").selectExpr(*_split(_LABEL))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open paths: handle, block, layer, layout, type, length (null: not measurable), price, end nodes and where the ends are."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_split(_PATH)).selectExpr(*_split(_PATH_ENDS))


def shape_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices as a file states them, in the frame of their extrusion: one row a vertex, and one with nulls where an entity has none."""
    return spark.sql(_SHAPES, part=table(spark, sf_dir, "part"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines of many forms as a file states them: handle, layer, kind, form, closed, extrusion, elevation, points (x, y, z, bulge)."""
    fields = ("handle", "layer", "kind", "form", "price", "nx", "ny", "nz", "elevation", "closed")
    v = shape_vertices(spark, sf_dir)
    listed = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "x", "y", "z", "bulge"))))
    points = F.transform(listed, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), p["bulge"].alias("bulge")))
    return v.groupBy(*fields).agg(F.when(F.count("k") > 0, points).alias("points"))
