"""A hexagonal lattice in axial coordinates: cells of points, rings and paths, outlines, parents and discs.

Cell (q, r) of a lattice with cells of circumradius ``size`` has its centre at
(size * sqrt(3) * (q + r / 2), size * 3 / 2 * r). Each cell has six neighbours at one
distance. A parent stands for the seven cells nearest its centre, which is a cell's own:
the coarser lattice is the finer one turned and sqrt(7) as wide, so parents are integer
arithmetic and never depend on rounding of coordinates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from planline.functions import geometry as G

ROOT3 = math.sqrt(3.0)
#: Steps to the six neighbours.
NEIGHBOURS = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))


def _half_up(v: Column) -> Column:
    return F.floor(v + 0.5)


def _rounded(q: Column, r: Column) -> Column:
    """The cell whose centre is nearest: of the three cube coordinates the one that was rounded most follows from the others."""

    def settle(c: Column) -> Column:
        a, b, s = _half_up(c["q"]), _half_up(c["r"]), _half_up(-c["q"] - c["r"])
        da, db, ds = F.abs(a - c["q"]), F.abs(b - c["r"]), F.abs(s + c["q"] + c["r"])
        return F.struct(
            F.when((da > db) & (da > ds), -b - s).otherwise(a).cast("long").alias("q"),
            F.when(~((da > db) & (da > ds)) & (db > ds), -a - s).otherwise(b).cast("long").alias("r"),
        )

    return G.bound(F.struct(q.alias("q"), r.alias("r")), settle)


def cell_of(x: Column, y: Column, size: float) -> Column:
    """struct(q, r): the cell that a point is in; null where it has no place."""
    return F.when(x.isNotNull() & y.isNotNull(), _rounded((x * (ROOT3 / 3) - y / 3) / size, y * (2 / 3) / size))


def centre(cell: Column, size: float) -> Column:
    """struct(x, y) of a cell's centre."""
    return F.struct((F.lit(size * ROOT3) * (cell["q"] + cell["r"] / 2)).alias("x"), (F.lit(size * 1.5) * cell["r"]).alias("y"))


def outline(cell: Column, size: float) -> Column:
    """The six corners, counter-clockwise from the right."""
    c = centre(cell, size)
    corner = lambda k: F.struct((c["x"] + size * math.cos(math.pi / 180 * (60 * k - 30))).alias("x"), (c["y"] + size * math.sin(math.pi / 180 * (60 * k - 30))).alias("y"))
    return F.array(*[corner(k) for k in range(6)])


def distance(a: Column, b: Column) -> Column:
    """Steps from one cell to another."""
    dq, dr = a["q"] - b["q"], a["r"] - b["r"]
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("long")


def parent(cell: Column) -> Column:
    """struct(q, r) in the lattice of the next coarser level: its centre is the cell (2q - r, q + 3r) of this one."""
    return _rounded((3 * cell["q"] + cell["r"]) / 7.0, (2 * cell["r"] - cell["q"]) / 7.0)


def parent_centre(cell: Column) -> Column:
    """The cell of the next finer level in a cell's middle."""
    return F.struct((2 * cell["q"] - cell["r"]).alias("q"), (cell["q"] + 3 * cell["r"]).alias("r"))


def disc(cell: Column, steps: int) -> Column:
    """array<struct(q, r, steps)>: cells at most ``steps`` away, 3 k (k + 1) + 1 of them."""
    offsets = [(q, r, max(abs(q), abs(r), abs(q + r))) for q in range(-steps, steps + 1) for r in range(-steps, steps + 1) if abs(q + r) <= steps]
    return F.array(*[F.struct((cell["q"] + q).alias("q"), (cell["r"] + r).alias("r"), F.lit(k).alias("steps")) for q, r, k in offsets])


def ring_cells(ring: Column, size: float) -> Column:
    """Cells whose centre is in a ring; the cell of its middle where it holds none, so that no ring is lost."""
    xs, ys = lambda r: F.transform(r, lambda p: p["x"]), lambda r: F.transform(r, lambda p: p["y"])
    box = F.struct(ring.alias("ring"), *[f(c(ring)).alias(n) for n, f, c in (("x0", F.array_min, xs), ("x1", F.array_max, xs), ("y0", F.array_min, ys), ("y1", F.array_max, ys))])

    def cells(b: Column) -> Column:
        rows = F.sequence(F.floor(b["y0"] / (size * 1.5)), F.ceil(b["y1"] / (size * 1.5)))

        def row(r: Column) -> Column:
            column = lambda x, up: (F.ceil if up else F.floor)(x / (size * ROOT3) - r / 2)
            of_row = F.transform(F.sequence(column(b["x0"], False), column(b["x1"], True)), lambda q: F.struct(q.cast("long").alias("q"), r.cast("long").alias("r")))
            return F.filter(of_row, lambda c: G.bound(centre(c, size), lambda at: G.point_in_ring(at["x"], at["y"], b["ring"])))

        middle = cell_of((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2, size)
        return G.bound(F.flatten(F.transform(rows, row)), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(middle)))

    return F.when(F.size(ring) >= 3, G.bound(box, cells))


def _span_cells(p: Column, q: Column, size: float) -> Column:
    """Cells along a span, one step apart each: the line between the two end cells' centres, cut in as many parts as they are steps apart."""

    def walk(s: Column) -> Column:
        n = distance(s["a"], s["b"])
        # off the edges between cells, where rounding would be a matter of chance
        along = lambda k, c, off: s["a"][c] + off + (s["b"][c] - s["a"][c]) * (k / F.greatest(n, F.lit(1)))
        return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: _rounded(along(k, "q", 1e-6), along(k, "r", 2e-6)))

    return G.bound(F.struct(cell_of(p["x"], p["y"], size).alias("a"), cell_of(q["x"], q["y"], size).alias("b")), walk)


def path_cells(points: Column, size: float) -> Column:
    """A contiguous walk over the cells along a path; each cell once for each time the path comes to it."""
    spans = F.arrays_zip(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))).alias("p"), F.slice(points, 2, F.size(points)).alias("q"))
    walked = F.flatten(F.transform(spans, lambda s: _span_cells(s["p"], s["q"], size)))
    once = G.bound(walked, lambda w: F.filter(w, lambda c, i: (i == 0) | (c != F.get(w, i - 1))))
    first = F.get(points, F.lit(0))
    return F.when(F.size(points) == 1, F.array(cell_of(first["x"], first["y"], size))).when(F.size(points) > 1, once)
