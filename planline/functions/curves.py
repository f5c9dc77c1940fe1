"""Arcs, bulges, simplification and GeoJSON."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def flatten_bulges(ring: Column, bulges: Column, tolerance: float = 0.01) -> Column:
    """A closed ring whose spans may be arcs (bulge: tan of a quarter of the sweep), as straight spans.

    Each span's circle is worked out once, as a struct, and then walked.
    """
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    spans = F.arrays_zip(ring.alias("p"), after.alias("q"), bulges.alias("b"))

    def circle(s: Column) -> Column:
        p, q, b = s["p"], s["q"], F.nullif(F.coalesce(s["b"], F.lit(0.0)), F.lit(0.0))
        # the centre lies off the chord's middle, on the left for a counter-clockwise arc
        off = (1 - b * b) / (4 * b)
        return F.struct(
            p["x"].alias("x"),
            p["y"].alias("y"),
            ((p["x"] + q["x"]) / 2 - (q["y"] - p["y"]) * off).alias("cx"),
            ((p["y"] + q["y"]) / 2 + (q["x"] - p["x"]) * off).alias("cy"),
            (F.hypot(q["x"] - p["x"], q["y"] - p["y"]) * (1 + b * b) / (4 * F.abs(b))).alias("r"),
            (4 * F.atan(b)).alias("sweep"),
        )

    def steps(c: Column) -> Column:
        step = 2 * F.acos(F.greatest(F.lit(-1.0), 1 - tolerance / F.nullif(c["r"], F.lit(0.0))))
        n = F.coalesce(F.greatest(F.lit(1), F.ceil(F.abs(c["sweep"]) / F.nullif(step, F.lit(0.0))).cast("int")), F.lit(1))
        return F.struct(c.alias("c"), n.alias("n"), F.atan2(c["y"] - c["cy"], c["x"] - c["cx"]).alias("start"))

    def walk(a: Column) -> Column:
        c = a["c"]
        turn = lambda k: a["start"] + c["sweep"] * k / a["n"]
        arc = F.transform(
            F.sequence(F.lit(0), a["n"] - 1),
            lambda k: F.struct((c["cx"] + c["r"] * F.cos(turn(k))).alias("x"), (c["cy"] + c["r"] * F.sin(turn(k))).alias("y")),
        )
        return F.when(F.coalesce(c["r"], F.lit(0.0)) == 0, F.array(F.struct(c["x"].alias("x"), c["y"].alias("y")))).otherwise(arc)

    return F.flatten(F.transform(F.transform(F.transform(spans, circle), steps), walk))


def _farthest(points: np.ndarray, first: int, last: int) -> tuple[float, int]:
    inner = points[first + 1 : last] - points[first]
    way = points[last] - points[first]
    size = way @ way
    at = np.clip(inner @ way / size, 0, 1) if size else np.zeros(len(inner))
    away = np.hypot(*(inner - at[:, None] * way).T)
    k = int(np.argmax(away))
    return float(away[k]), first + 1 + k


def simplified(points: list, tolerance: float) -> list:
    """Points that keep a line within tolerance of the given one, its ends kept."""
    if len(points) < 3:
        return points
    xy = np.array([(p["x"], p["y"]) for p in points], dtype=float)
    keep, todo = {0, len(xy) - 1}, [(0, len(xy) - 1)]
    while todo:
        first, last = todo.pop()
        if last - first > 1:
            away, k = _farthest(xy, first, last)
            if away > tolerance:
                keep.add(k)
                todo += [(first, k), (k, last)]
    return [points[k] for k in sorted(keep)]


def simplify(path: Column, tolerance: float) -> Column:
    """Line simplification in Arrow batches."""

    @F.pandas_udf(POINTS)
    def run(paths: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else [dict(x=q["x"], y=q["y"]) for q in simplified(list(p), tolerance)] for p in paths])

    return run(path)


def geojson_polygon(ring: Column, decimals: int = 7) -> Column:
    """A closed GeoJSON polygon of one counter-clockwise ring."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    pairs = F.transform(closed, lambda p: F.array(F.round(p["x"], decimals), F.round(p["y"], decimals)))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates")))


def degrees_per_pixel(zoom: Column, latitude: Column, tile: int = 256) -> Column:
    """Degrees of longitude a pixel spans on a web map, narrowed by the latitude."""
    return 360.0 / (tile * F.pow(F.lit(2.0), zoom)) * F.cos(F.radians(latitude))


def resolution_for_zoom(zoom: Column) -> Column:
    """Cell resolution for a map zoom, in bands of two."""
    return F.greatest(F.lit(0), F.least(F.lit(13), F.floor(zoom * 0.75).cast("int")))


def crs_candidates(minx: float, miny: float, maxx: float, maxy: float) -> list[int]:
    """UTM zones (EPSG) whose valid range the numbers fit, north first."""
    if not (100_000 <= minx and maxx <= 900_000 and 0 <= miny and maxy <= 10_000_000) or math.isnan(minx):
        return []
    return [*range(32601, 32661), *range(32701, 32761)]
