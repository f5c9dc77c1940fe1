"""Recipes over a whole drawing, their envelopes and one retry where an answer settles nothing.

A drawing is a mapping: ``parcels`` (handle, layer, kind, size_code, area, w, h, box, cx,
cy, ring), ``labels`` (handle, layer, text, x, y) and ``paths`` (handle, block, layer,
layout, type, length, ends).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planline.errors import Refusal
from planline.functions import geometry as G
from planline.operators import aggregates as A
from planline.operators import duplicates as D
from planline.operators import network as N
from planline.operators import spatial as S
from planline.operators import truth as T
from planline.operators import windows as W
from planline.plans.recipes import Param, Recipe, Registry, default_registry

Drawing = Mapping[str, DataFrame]
CELL = 40.0
RING = ("handle", "layer", "area", "minx", "miny", "maxx", "maxy", "ring")


def _layers(df: DataFrame, names: str) -> DataFrame:
    """Rows on the layers of a comma-separated list; ``*`` is all."""
    return df if names == "*" else df.where(F.col("layer").isin([n.strip() for n in names.split(",")]))


def _inside(d: Drawing, layers: str = "*") -> DataFrame:
    return S.points_in_rings(d["labels"].select("handle", "layer", "text", "x", "y"), _layers(d["parcels"], layers).select(*RING), CELL)


def label_coverage(d: Drawing, target_layers: str) -> DataFrame:
    n = _inside(d, target_layers).groupBy(F.col("r_handle").alias("handle")).agg(F.count(F.lit(1)).alias("labels"))
    return _layers(d["parcels"], target_layers).select("handle", "layer").join(n, "handle", "left").withColumn("labels", F.coalesce("labels", F.lit(0)))


def adjacency(d: Drawing, layers: str, gap_max: float) -> DataFrame:
    return S.rings_near(_layers(d["parcels"], layers).select(*RING), CELL, gap_max).select("a_handle", "b_handle", "distance")


def containment(d: Drawing, inner_layers: str, outer_layer: str) -> DataFrame:
    centres = _layers(d["parcels"], inner_layers).select("handle", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return S.points_in_rings(centres, _layers(d["parcels"], outer_layer).select(*RING), CELL).where("p_handle <> r_handle").select("p_handle", "r_handle")


def coverage_gap(d: Drawing, number_layer: str, parcel_layers: str) -> DataFrame:
    placed = _inside(d, parcel_layers).select(F.col("p_handle").alias("handle")).distinct()
    return _layers(d["labels"], number_layer).join(placed, "handle", "left_anti").select("handle", "layer", "text")


def frontage_check(d: Drawing, parcel_layers: str, road_layers: str, touch_tolerance: float) -> DataFrame:
    plots, roads = (_layers(d["parcels"], x).select(*RING) for x in (parcel_layers, road_layers))
    near = S.box_matches(plots, roads, CELL, touch_tolerance).where("a_handle <> b_handle")
    near = near.select(F.col("a_handle").alias("handle"), G.ring_to_ring(F.col("a_ring"), F.col("b_ring")).alias("distance")).where(F.col("distance") <= touch_tolerance)
    best = near.groupBy("handle").agg(F.min("distance").alias("distance"))
    return plots.select("handle", "layer").join(best, "handle", "left").withColumn("frontage", F.when(F.col("distance").isNotNull(), "established").otherwise("none"))


def junction_census(d: Drawing, layers: str, snap_tolerance: float) -> DataFrame:
    """Nodes by degree; a tolerance below 0 is taken from the paths themselves."""
    some = _layers(d["paths"], layers)
    if snap_tolerance < 0:
        snap_tolerance = N.snap_tolerance(some).first().tolerance
    return N.node_degrees(N.clustered_ends(some, snap_tolerance)).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def road_hierarchy(d: Drawing, layers: str, snap_tolerance: float) -> DataFrame:
    """How far apart the network's junctions are along its paths, what says nothing of that, and the dead ends."""
    some = _layers(d["paths"], layers)
    tolerance = N.snap_tolerance(some).first().tolerance if snap_tolerance < 0 else snap_tolerance
    return N.road_hierarchy(some, tolerance)


def dimension_truth(d: Drawing, label_layers: str, geometry_layers: str, search_radius: float, tolerance: float) -> DataFrame:
    """Every label against the edges and paths within the radius; a tolerance below 0 is taken from what each label prints."""
    labels = _layers(d["labels"], label_layers).select("handle", "text", "x", "y", F.lit(search_radius).alias("radius"))
    rings = _layers(d["parcels"], geometry_layers).select("handle", F.col("ring").alias("points"), G.edge_lengths(F.col("ring")).alias("edges"), G.perimeter(F.col("ring")).alias("length"), *RING[3:7])
    box = (("minx", F.least("ax", "bx")), ("miny", F.least("ay", "b_y")), ("maxx", F.greatest("ax", "bx")), ("maxy", F.greatest("ay", "b_y")))
    none = lambda c: F.lit(None).cast(dict(rings.dtypes)[c]).alias(c)
    lines = _layers(d["paths"], geometry_layers).select((-F.col("handle") - 1).alias("handle"), none("points"), none("edges"), "length", *[v.alias(c) for c, v in box])
    return T.label_truth(labels, rings.unionByName(lines), CELL, given=None if tolerance < 0 else tolerance)


def drafting_hygiene(d: Drawing, working_layer: str) -> DataFrame:
    return d["paths"].groupBy((F.col("layer") == working_layer).alias("on_working_layer")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("length").isNull()).alias("unmeasured"))


def cross_check_classification(d: Drawing, layers: str, least_area: float, most_area: float) -> DataFrame:
    shape = F.col("area").between(least_area, most_area)
    coded = F.lit(layers == "*") | F.col("layer").isin([n.strip() for n in layers.split(",")])
    side = F.when(shape & coded, "both").when(shape, "shape only").when(coded, "layer only")
    return d["parcels"].select("handle", side.alias("found_by")).where("found_by is not null")


def vicinity(d: Drawing, subject_layers: str, radius: float) -> DataFrame:
    points = d["parcels"].select("handle", "layer", F.col("cx").alias("x"), F.col("cy").alias("y"))
    near = S.within_radius(_layers(points, subject_layers), points, radius).where("c_handle <> o_handle")
    return near.groupBy(F.col("o_handle").alias("handle")).agg(F.min("distance").alias("distance"))


def catchment_coverage(d: Drawing, amenity_layers: str, radius: float) -> DataFrame:
    served = vicinity(d, amenity_layers, radius).select("handle")
    return _layers(d["parcels"], "*").select("handle", "layer").join(served, "handle", "left_anti")


def find_duplicates(d: Drawing, layers: str, tolerance: float) -> DataFrame:
    return D.coincident(_layers(d["parcels"], layers).select("handle", "layer", "ring"), tolerance)


def revision_diff(d: Drawing, tolerance: float) -> DataFrame:
    """Against ``before``, the paths of the drawing before."""
    from planline.operators.graph import revision

    sums = [d[k].groupBy("layer", "layout").agg(F.sum("length").alias("v")) for k in ("before", "paths")]
    return revision(*sums, ["layer", "layout"], "v", tolerance)


def drawing_registry() -> Registry:
    """Every recipe over a drawing; those over parcels alone are taken over."""
    registry = Registry()
    for r in default_registry().recipes.values():
        registry.register(Recipe(r.name, lambda d, _run=r.run, **params: _run(d["parcels"], **params), r.params, r.finding, r.says))
    layers, tolerance = (lambda name: Param(name, "text", "*")), Param("snap_tolerance", "number", -1.0)
    for name, run, params, finding, says in (
        ("label_coverage", label_coverage, (layers("target_layers"),), None, "How many labels stand in each parcel."),
        ("adjacency", adjacency, (layers("layers"), Param("gap_max", "number", 0.0)), None, "Parcels whose outlines come so close, 0 where they touch."),
        ("containment", containment, (layers("inner_layers"), layers("outer_layer")), "p_handle", "Parcels whose centre lies in another."),
        ("coverage_gap", coverage_gap, (layers("number_layer"), layers("parcel_layers")), "handle", "Labels that stand in no parcel."),
        ("frontage_check", frontage_check, (layers("parcel_layers"), Param("road_layers"), Param("touch_tolerance", "number", 1.0)), None, "Whether each parcel's outline comes to a road's."),
        ("junction_census", junction_census, (layers("layers"), tolerance), None, "Nodes of the network by how many ends meet."),
        ("road_hierarchy", road_hierarchy, (layers("layers"), tolerance), None, "How far apart junctions are along the network, and its dead ends."),
        ("dimension_truth", dimension_truth, (layers("label_layers"), layers("geometry_layers"), Param("search_radius", "number", 2.0), Param("tolerance", "number", -1.0)), None, "Printed numbers against the edges and paths in reach; paths have handles below 0."),
        ("drafting_hygiene", drafting_hygiene, (Param("working_layer", "text", "0"),), None, "What was left on the working layer."),
        ("cross_check_classification", cross_check_classification, (layers("layers"), Param("least_area", "number", 0.0), Param("most_area", "number", 1e12)), "handle", "Parcels found by shape, by layer or by both."),
        ("vicinity", vicinity, (Param("subject_layers"), Param("radius", "number", 100.0)), "handle", "Parcels near those of some layers."),
        ("catchment_coverage", catchment_coverage, (Param("amenity_layers"), Param("radius", "number", 300.0)), "handle", "Parcels that no amenity reaches."),
        ("find_duplicates", find_duplicates, (layers("layers"), Param("tolerance", "number", 0.01)), "handle", "Outlines that were drawn twice."),
        ("revision_diff", revision_diff, (Param("tolerance", "number", 1e-6),), None, "Layers and layouts added, removed or changed since the drawing before."),
    ):
        registry.register(Recipe(name, run, params, finding, says))
    return registry


@dataclass
class Envelope:
    """An answer with what it needs to be checked: the parameters that were used and what it covers."""

    recipe: str
    answers: str
    params_used: dict
    scope_note: str
    rows: DataFrame
    settled: bool = True
    before: Envelope | None = None

    def audit(self) -> Envelope:
        """Refuses an answer that does not say what it answers and covers."""
        for name in ("recipe", "answers", "scope_note"):
            if not str(getattr(self, name) or "").strip():
                raise Refusal("bad_envelope", f"{name} is empty", "state it in the recipe")
        if not self.rows.columns or len(set(self.rows.columns)) < len(self.rows.columns):
            raise Refusal("bad_envelope", "rows have no columns, or two of one name")
        return self


#: Where a finding is empty another recipe may settle the question: the recipe and what it is asked, given what the first
#: was (None: there is nothing wider to ask).
RETRY: dict[str, tuple[str, Callable[[dict], dict | None]]] = {
    "outliers": ("outliers", lambda was: {**was, "z": 2.0} if was["z"] > 2.0 else None),
    "containment": ("adjacency", lambda was: {"layers": was["outer_layer"], "gap_max": 0.0}),
}


def answer(registry: Registry, drawing: Drawing, name: str, params: dict | None = None, scope_note: str = "the whole drawing", heal: bool = True) -> Envelope:
    """Run a recipe and audit its envelope; an empty finding runs its retry once, and both answers are kept.

    The answer of a retry is marked as not settled: it was asked with other parameters. A
    retry that would ask for less than the first answer gave is not run.
    """
    recipe, bound = registry.bind(name, params or {})
    first = Envelope(name, recipe.says, dict(sorted(bound.items())), scope_note, recipe.run(drawing, **bound)).audit()
    if not heal or recipe.finding is None or name not in RETRY or first.rows.limit(1).count():
        return first
    other, asked = RETRY[name]
    wider = asked(bound)
    if wider is None:
        return first
    again = answer(registry, drawing, other, wider, scope_note, heal=False)
    first.settled = again.settled = False
    again.before = first
    return again


def size_bands(d: Drawing, shares: dict[str, float]) -> DataFrame:
    """Quantiles of area by layer, for choosing a recipe's bounds."""
    return W.nearest_rank(d["parcels"], ["layer"], "area", shares)
