"""Structural, text and region filters with total order paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planline.errors import Refusal, refuse_empty
from planline.functions import geometry as G


def query_entities(
    df: DataFrame,
    *,
    layer: str | None = None,
    type: str | None = None,
    layout: str | None = None,
    text_contains: str | None = None,
    handles: list[int] | None = None,
) -> DataFrame:
    """Equality on layer, type and layout, case-insensitive substring on text, IN on handles."""
    refuse_empty(layer=layer, type=type, layout=layout, text_contains=text_contains)
    for name, value in (("layer", layer), ("type", type), ("layout", layout)):
        if value is not None:
            df = df.where(F.col(name) == value)
    if text_contains is not None:
        df = df.where(contains_ci(F.col("text"), text_contains))
    if handles is not None:
        df = df.where(F.col("handle").isin(handles))
    return df


def contains_ci(text: Column, part: str) -> Column:
    """Substring, never a pattern."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def page(df: DataFrame, order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """A stable page; ``order`` must be total."""
    return df.orderBy(*order).offset(offset).limit(limit)


def layer_filter(layer: Column, wanted: str) -> Column:
    """'A,B' keeps those, '!A,B' keeps all others, a leading '!!' means a name that begins with '!'."""
    if wanted == "":
        raise Refusal("empty_filter", "layers is empty")
    if wanted.startswith("!!"):
        return layer.isin(wanted[1:].split(","))
    if wanted.startswith("!"):
        return ~layer.isin(wanted[1:].split(","))
    return layer.isin(wanted.split(","))


def rect(df: DataFrame, box: tuple[float, float, float, float], mode: str) -> DataFrame:
    """window: wholly inside; crossing: overlapping. Both reach the scan as range predicates."""
    x0, y0, x1, y1 = box
    if x0 > x1 or y0 > y1:
        raise Refusal("reversed_box", f"{box} is reversed")
    if mode == "window":
        return df.where((F.col("minx") >= x0) & (F.col("maxx") <= x1) & (F.col("miny") >= y0) & (F.col("maxy") <= y1))
    return df.where((F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0))


def circle(df: DataFrame, cx: float, cy: float, r: float, mode: str) -> DataFrame:
    near = rect(df, (cx - r, cy - r, cx + r, cy + r), "crossing")
    return near.where(G.box_in_circle(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), cx, cy, r, mode))


def polygon(df: DataFrame, points: list[tuple[float, float]], mode: str) -> DataFrame:
    """By entity box: window is wholly inside the polygon, crossing meets it."""
    if len(points) < 3:
        raise Refusal("degenerate_polygon", "fewer than three points")
    xs, ys = zip(*points)
    near = rect(df, (min(xs), min(ys), max(xs), max(ys)), "crossing")
    test = G.box_inside_polygon if mode == "window" else G.box_crosses_polygon
    return near.where(test(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), G.literal_ring(points)))


def spread(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Rows at positions floor(i * n / size) of each group: an even spread, not the first ones."""
    w = Window.partitionBy(group).orderBy(*order)
    df = df.withColumns({"at": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(group))})
    here = F.floor(F.col("at") * size / F.col("n"))
    before = F.floor((F.col("at") - 1) * size / F.col("n"))
    return df.where((F.col("at") == 0) | (here != before)).drop("n")


def space_of(layout: Column) -> Column:
    """model, block or paper by the layout's name."""
    return F.when(layout == "Model", "model").when(layout.startswith("[block]"), "block").otherwise("paper")
