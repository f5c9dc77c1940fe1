"""Planar geometry as column expressions over rings (array<struct<x,y>>): no Python per row."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _next(ring: Column) -> Column:
    """The ring turned by one vertex."""
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dedupe(ring: Column) -> Column:
    """Consecutive equal vertices, and a closing vertex equal to the first, dropped."""

    def opened(kept: Column) -> Column:
        closed = (F.size(kept) > 1) & (F.element_at(kept, 1) == F.element_at(kept, -1))
        return F.when(closed, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)

    return bound(ring, lambda r: bound(F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1))), opened))


def origin(ring: Column) -> Column:
    """(least x, least y): the local frame for sums at projected magnitudes."""
    return F.struct(
        F.array_min(F.transform(ring, lambda p: p["x"])).alias("x"), F.array_min(F.transform(ring, lambda p: p["y"])).alias("y")
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _area_about(ring: Column, o: Column) -> Column:
    cross = F.zip_with(
        ring, _next(ring), lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])
    )
    return _sum(cross) / 2.0


def signed_area(ring: Column) -> Column:
    """Shoelace, in the ring's local frame; positive for counter-clockwise rings."""
    return bound(ring, lambda r: bound(origin(r), lambda o: _area_about(r, o)))


def centroid(ring: Column) -> Column:
    """Area centroid, null where the area is zero."""

    def about(r: Column, o: Column) -> Column:
        def moment(axis: str) -> Column:
            return _sum(
                F.zip_with(
                    r,
                    _next(r),
                    lambda p, q: (p[axis] + q[axis] - 2 * o[axis])
                    * ((p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])),
                )
            )

        def middle(six: Column) -> Column:
            part = lambda axis: (moment(axis) / F.nullif(six, F.lit(0.0)) + o[axis]).alias(axis)
            return F.when(six != 0, F.struct(part("x"), part("y")))

        return bound(6.0 * _area_about(r, o), middle)

    return bound(ring, lambda r: bound(origin(r), lambda o: about(r, o)))


def edge_lengths(ring: Column) -> Column:
    return F.zip_with(ring, _next(ring), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))


def perimeter(ring: Column) -> Column:
    return _sum(edge_lengths(ring))


def turn_angles(ring: Column) -> Column:
    """Signed turn at each vertex, in (-pi, pi]."""
    full = 2 * math.pi

    def turns(way: Column) -> Column:
        turned = F.concat(F.slice(way, -1, 1), F.slice(way, 1, F.size(way) - 1))
        return F.zip_with(turned, way, lambda a, b: b - a - full * F.ceil((b - a - math.pi) / full))

    return bound(F.zip_with(ring, _next(ring), lambda p, q: F.atan2(q["y"] - p["y"], q["x"] - p["x"])), turns)


def shape_key(ring: Column, quantum: float = 1e-3, turn_quantum: float = 1e-3) -> Column:
    """16 hex digits that name a shape whatever its place, rotation, start and winding-preserving order."""

    def steps(r: Column) -> Column:
        step = lambda e, t: F.concat_ws(":", F.round(e / quantum).cast("long"), F.round(t / turn_quantum).cast("long"))
        return F.zip_with(edge_lengths(r), turn_angles(r), step)

    def least(s: Column) -> Column:
        n = F.size(s)
        return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.concat(F.slice(s, i + 1, n), F.slice(s, F.lit(1), i)), ";")))

    # the steps are worked out once, not for each rotation
    return F.substring(F.sha1(bound(bound(ring, steps), least)), 1, 16)


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Two-valued, half-open crossing number."""
    crossings = F.zip_with(
        ring,
        _next(ring),
        lambda p, q: F.when(
            ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]), 1
        ).otherwise(0),
    )
    return F.aggregate(crossings, F.lit(0), lambda a, v: a + v) % 2 == 1


def point_segment_distance(x: Column, y: Column, p: Column, q: Column) -> Column:
    """To the nearest point of the segment."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    long = dx * dx + dy * dy
    t = F.coalesce(((x - p["x"]) * dx + (y - p["y"]) * dy) / F.nullif(long, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(x - (p["x"] + t * dx), y - (p["y"] + t * dy))


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """From a point to the ring's boundary."""
    return F.array_min(F.zip_with(ring, _next(ring), lambda p, q: point_segment_distance(x, y, p, q)))


def place_in_ring(x: Column, y: Column, ring: Column, eps_rel: float = 1e-9) -> Column:
    """'boundary' within eps_rel of the ring's diagonal, else 'inside' or 'outside'."""

    def diagonal(r: Column) -> Column:
        xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
        return F.hypot(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))

    return bound(
        ring,
        lambda r: F.when(ring_distance(x, y, r) <= diagonal(r) * eps_rel, "boundary").when(point_in_ring(x, y, r), "inside").otherwise("outside"),
    )


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether segments ab and cd share a point, touching included."""

    def side(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    def within(p: Column, q: Column, r: Column) -> Column:
        return r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    def meet(s: Column) -> Column:
        return (
            ((s["s1"] * s["s2"] < 0) & (s["s3"] * s["s4"] < 0))
            | ((s["s1"] == 0) & within(a, b, c))
            | ((s["s2"] == 0) & within(a, b, d))
            | ((s["s3"] == 0) & within(c, d, a))
            | ((s["s4"] == 0) & within(c, d, b))
        )

    return bound(F.struct(side(a, b, c).alias("s1"), side(a, b, d).alias("s2"), side(c, d, a).alias("s3"), side(c, d, b).alias("s4")), meet)


def literal_ring(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(minx, miny), corner(maxx, miny), corner(maxx, maxy), corner(minx, maxy))


def rings_cross(a: Column, b: Column) -> Column:
    """Whether any edge of one ring meets an edge of the other."""
    pairs = lambda r: F.arrays_zip(r.alias("p"), _next(r).alias("q"))
    return bound(pairs(b), lambda sides: F.exists(pairs(a), lambda e: F.exists(sides, lambda f: segments_cross(e["p"], e["q"], f["p"], f["q"]))))


def is_simple(ring: Column) -> Column:
    """Whether no two sides of a ring meet but neighbours, and these in their corner alone."""
    sides = F.transform(ring, lambda p, k: F.struct(k.alias("k"), p.alias("p"), F.coalesce(F.get(ring, k + 1), F.get(ring, F.lit(0))).alias("q")))
    last = F.size(ring) - 1

    def meets(e: Column, f: Column) -> Column:
        apart = (f["k"] - e["k"] > 1) & ~((e["k"] == 0) & (f["k"] == last))
        return apart & segments_cross(e["p"], e["q"], f["p"], f["q"])

    return ~F.exists(sides, lambda e: F.exists(sides, lambda f: meets(e, f)))


def box_distance(a: list[Column], b: list[Column]) -> Column:
    """How far two boxes (minx, miny, maxx, maxy) are apart; 0 where they meet."""
    zero = F.lit(0.0)
    return F.hypot(F.greatest(zero, a[0] - b[2], b[0] - a[2]), F.greatest(zero, a[1] - b[3], b[1] - a[3]))


def ring_to_ring(a: Column, b: Column) -> Column:
    """0 where the rings touch, cross or one holds the other, else the least distance of their boundaries.

    Both are moved to the first corner of ``a`` before, so that large coordinates cost no digits.
    """
    corner = lambda r, c: F.get(r, F.lit(0))[c]
    moved = lambda r, o: F.transform(r, lambda p: F.struct((p["x"] - o["x"]).alias("x"), (p["y"] - o["y"]).alias("y")))
    away = lambda r, s: F.array_min(F.transform(r, lambda p: ring_distance(p["x"], p["y"], s)))

    def apart(t: Column) -> Column:
        a, b = t["a"], t["b"]
        meet = rings_cross(a, b) | point_in_ring(corner(a, "x"), corner(a, "y"), b) | point_in_ring(corner(b, "x"), corner(b, "y"), a)
        return F.when(meet, 0.0).otherwise(F.least(away(a, b), away(b, a)))

    # each ring is moved once a pair
    def placed(t: Column) -> Column:
        o = F.get(t["a"], F.lit(0))
        return bound(F.struct(moved(t["a"], o).alias("a"), moved(t["b"], o).alias("b")), apart)

    return bound(F.struct(a.alias("a"), b.alias("b")), placed)


def box_crosses_polygon(minx: Column, miny: Column, maxx: Column, maxy: Column, ring: Column) -> Column:
    """A ring vertex in the box, a box corner in the ring, or crossing edges."""
    vertex = F.exists(ring, lambda p: p["x"].between(minx, maxx) & p["y"].between(miny, maxy))
    return vertex | point_in_ring(minx, miny, ring) | rings_cross(box_ring(minx, miny, maxx, maxy), ring)


def box_inside_polygon(minx: Column, miny: Column, maxx: Column, maxy: Column, ring: Column) -> Column:
    """All corners inside and no edge crossing."""
    corners = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy)]
    inside = F.lit(True)
    for x, y in corners:
        inside = inside & point_in_ring(x, y, ring)
    return inside & ~rings_cross(box_ring(minx, miny, maxx, maxy), ring)


def box_in_circle(minx: Column, miny: Column, maxx: Column, maxy: Column, cx: float, cy: float, r: float, mode: str) -> Column:
    """window: the farthest corner within r; crossing: the nearest point within r."""
    if mode == "window":
        far = F.hypot(F.greatest(F.abs(minx - cx), F.abs(maxx - cx)), F.greatest(F.abs(miny - cy), F.abs(maxy - cy)))
        return far <= r
    zero = F.lit(0.0)
    return F.hypot(F.greatest(minx - cx, zero, F.lit(cx) - maxx), F.greatest(miny - cy, zero, F.lit(cy) - maxy)) <= r


def arc_points(cx: Column, cy: Column, radius: Column, start: Column, end: Column, tolerance: float = 0.01) -> Column:
    """An arc (radians, counter-clockwise) as points whose chords stay within tolerance."""
    sweep = F.pmod(end - start, F.lit(2 * math.pi))
    step = 2 * F.acos(F.greatest(F.lit(-1.0), 1 - tolerance / F.nullif(radius, F.lit(0.0))))
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(sweep / F.nullif(step, F.lit(0.0)), F.lit(1.0))).cast("int"))
    return F.transform(
        F.sequence(F.lit(0), n),
        lambda k: F.struct((cx + radius * F.cos(start + sweep * k / n)).alias("x"), (cy + radius * F.sin(start + sweep * k / n)).alias("y")),
    )


# The WGS 84 ellipsoid and the UTM scale and offsets.
WGS84_A, WGS84_F, UTM_K0, UTM_EAST, UTM_SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0


def utm_zone(epsg: Column) -> Column:
    """Zone of EPSG 32601-32660 (north) and 32701-32760 (south), else null."""
    return F.when(epsg.between(32601, 32660), epsg - 32600).when(epsg.between(32701, 32760), epsg - 32700)


def utm_to_lat_lon(east: Column, north: Column, zone: Column, south: Column) -> Column:
    """Inverse Krüger series to the fourth order in n, as a struct (lat, lon) in degrees."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    xi = (north - F.when(south, UTM_SOUTH).otherwise(0.0)) / (UTM_K0 * radius)
    eta = (east - UTM_EAST) / (UTM_K0 * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.struct(F.degrees(lat).alias("lat"), (F.degrees(lon) + zone * 6 - 183).alias("lon"))
