"""Geometry of an entity from what a file states: out of its extrusion's frame, with the cause where there is none.

Points are array<struct<x,y,z,bulge>> in the object's own frame; everything is a column
expression, so that a drawing of any size is read without Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from planline.functions import curves
from planline.functions import geometry as G

#: Fixed value of the file format: an extrusion this near to the z axis takes its x axis from y.
NEAR_AXIS = 1 / 64
#: What counts as nothing: a bulge, a change of height, a part of an extrusion.
NOTHING = 1e-9
#: Less area than this part of the squared perimeter is none: the outline doubles back on itself.
FLAT = 1e-12
#: Longer rings are not measured.
MOST_VERTICES = 4000
#: Coordinates from here on are no places.
FAR = 1e19


def standard_extrusion(nx: Column, ny: Column, nz: Column) -> Column:
    """Whether an extrusion is (0, 0, 1), where the object's frame is the world's; null means it is."""
    near = lambda v, to: F.abs(F.coalesce(v, F.lit(float(to))) - to) < NOTHING
    return near(nx, 0) & near(ny, 0) & near(nz, 1)


def world_frame(nx: Column, ny: Column, nz: Column) -> Column:
    """Axes of an extrusion's frame by the arbitrary-axis rule of the file format; null where the extrusion has no length.

    (ax_x, ax_y, ay_x, ay_y, az_x, az_y): what each of x, y and z adds to the world's x and y.
    """
    size = F.nullif(F.sqrt(nx * nx + ny * ny + nz * nz), F.lit(0.0))
    n = F.struct((nx / size).alias("x"), (ny / size).alias("y"), (nz / size).alias("z"))

    def axes(n: Column) -> Column:
        near = (F.abs(n["x"]) < NEAR_AXIS) & (F.abs(n["y"]) < NEAR_AXIS)
        # y axis x n near the pole, z axis x n elsewhere
        return F.struct(
            n.alias("n"), F.when(near, n["z"]).otherwise(-n["y"]).alias("x"), F.when(near, 0.0).otherwise(n["x"]).alias("y"), F.when(near, -n["x"]).otherwise(0.0).alias("z")
        )

    def unit(a: Column) -> Column:
        size = F.sqrt(a["x"] * a["x"] + a["y"] * a["y"] + a["z"] * a["z"])
        return F.struct(a["n"].alias("n"), (a["x"] / size).alias("x"), (a["y"] / size).alias("y"), (a["z"] / size).alias("z"))

    def frame(a: Column) -> Column:
        n = a["n"]
        return F.struct(
            a["x"].alias("ax_x"), a["y"].alias("ax_y"),
            (n["y"] * a["z"] - n["z"] * a["y"]).alias("ay_x"), (n["z"] * a["x"] - n["x"] * a["z"]).alias("ay_y"),
            n["x"].alias("az_x"), n["y"].alias("az_y"),
        )

    return F.when(size.isNotNull(), G.bound(G.bound(G.bound(n, axes), unit), frame))


def to_world(points: Column, nx: Column, ny: Column, nz: Column, elevation: Column) -> Column:
    """Points in the world's plan, with the bulges of a turned frame reversed; null where no frame can be built.

    A mirrored extrusion (0, 0, -1) turns x over and with it the side that arcs lie on;
    lengths and areas stay, so a wrong frame shows nowhere but in where things are.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    frame = world_frame(F.coalesce(nx, zero), F.coalesce(ny, zero), F.coalesce(nz, one))
    lift = F.coalesce(elevation, zero)

    def lifted(f: Column) -> Column:
        return F.transform(
            points,
            lambda p: F.struct(
                (p["x"] * f["ax_x"] + p["y"] * f["ay_x"] + lift * f["az_x"]).alias("x"), (p["x"] * f["ax_y"] + p["y"] * f["ay_y"] + lift * f["az_y"]).alias("y"), (-p["bulge"]).alias("bulge")
            ),
        )

    plain = F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["bulge"].alias("bulge")))
    turned = G.bound(frame, lambda f: F.when(f.isNotNull(), lifted(f)))
    return F.when(standard_extrusion(nx, ny, nz), plain).otherwise(turned)


def _plan(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def _bulged(points: Column) -> Column:
    return F.exists(points, lambda p: F.abs(F.coalesce(p["bulge"], F.lit(0.0))) > NOTHING)


def heights_vary(points: Column) -> Column:
    heights = F.transform(points, lambda p: F.coalesce(p["z"], F.lit(0.0)))
    return F.coalesce(F.array_max(heights) - F.array_min(heights), F.lit(0.0)) > NOTHING


def _finite(points: Column) -> Column:
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < FAR)
    return F.forall(points, lambda p: good(p["x"]) & good(p["y"]))


def ring_block(points: Column, closed: Column, nx: Column, ny: Column, nz: Column, elevation: Column, tolerance: float = 0.01) -> Column:
    """struct(status, ring, dropped): a closed outline in the world's plan, or why there is none.

    Causes, the first that holds: unreadable (no vertices, no frame, or coordinates that are
    no places), non_planar (heights vary), open, degenerate (fewer than three places, or no
    area), oversize. Arcs of closed outlines become chords within ``tolerance``. Only
    ``complete`` rings are stored, so no test for the absence of a flag can let another in.
    """

    def flattened(world: Column) -> Column:
        return F.when(_bulged(world), curves.flatten_bulges(_plan(world), F.transform(world, lambda p: p["bulge"]), tolerance)).otherwise(_plan(world))

    def judged(ring: Column, dropped: Column) -> Column:
        status = (
            F.when(ring.isNull() | (F.size(points) == 0) | ~_finite(ring), "unreadable")
            .when(heights_vary(points), "non_planar")
            .when(~F.coalesce(closed, F.lit(False)), "open")
            .when(F.size(ring) < 3, "degenerate")
            .when(F.size(ring) > MOST_VERTICES, "oversize")
            .when(F.abs(G.signed_area(ring)) <= FLAT * F.pow(G.perimeter(ring), F.lit(2.0)), "degenerate")
            .otherwise("complete")
        )
        return G.bound(status, lambda s: F.struct(s.alias("status"), F.when(s == "complete", ring).alias("ring"), dropped.alias("dropped")))

    def cleaned(plan: Column) -> Column:
        return G.bound(G.dedupe(plan), lambda ring: judged(ring, F.size(plan) - F.size(ring)))

    return G.bound(to_world(points, nx, ny, nz, elevation), lambda world: G.bound(flattened(world), cleaned))


def ends_block(type_: Column, points: Column, closed: Column, nx: Column, ny: Column, nz: Column, elevation: Column) -> Column:
    """struct(status, a, b): the two free ends of a path in the world's plan.

    open_path with both ends; closed_ring, which has none (a measured fact); not_derived,
    where the file does not say (a spline's points need not lie on it).
    """
    from_points = type_.isin("LINE", "LWPOLYLINE", "POLYLINE", "ARC")

    def block(world: Column) -> Column:
        status = (
            F.when((type_ == "CIRCLE") | (from_points & F.coalesce(closed, F.lit(False))), "closed_ring")
            .when(~from_points | world.isNull() | (F.size(world) < 2) | ~_finite(world), "not_derived")
            .otherwise("open_path")
        )
        is_open = status == "open_path"
        return F.struct(status.alias("status"), F.when(is_open, F.get(world, F.lit(0))).alias("a"), F.when(is_open, F.element_at(world, -1)).alias("b"))

    return G.bound(_plan(to_world(points, nx, ny, nz, elevation)), block)


def path_block(points: Column, closed: Column, nx: Column, ny: Column, nz: Column, elevation: Column) -> Column:
    """struct(cause, points, bulges): vertices of an open path, its bulges with them where any span is an arc.

    Closed outlines are not told twice: theirs is the ring.
    """

    def block(world: Column) -> Column:
        cause = (
            F.when(world.isNull() | ~_finite(world), "unreadable").when(F.coalesce(closed, F.lit(False)), "closed")
            .when(F.size(world) < 2, "no span").when(F.size(world) > MOST_VERTICES, "oversize")
        )
        spans = F.slice(world, 1, F.greatest(F.size(world) - 1, F.lit(0)))
        return F.struct(
            cause.alias("cause"),
            F.when(cause.isNull(), _plan(world)).alias("points"),
            F.when(cause.isNull() & _bulged(spans), F.transform(spans, lambda p: F.coalesce(p["bulge"], F.lit(0.0)))).alias("bulges"),
        )

    return G.bound(to_world(points, nx, ny, nz, elevation), block)


def arc_path(cx: Column, cy: Column, radius: Column, start: Column, end: Column) -> Column:
    """Points of an arc given in degrees, counter-clockwise in its own frame; null where it is a full turn, which has no ends."""
    full = F.pmod(end - start, F.lit(360.0)) == 0
    flat = G.arc_points(cx, cy, radius, start * (math.pi / 180), end * (math.pi / 180))
    return F.when(~full, F.transform(flat, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("bulge"))))
