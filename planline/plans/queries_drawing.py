"""Geometry as files state it, dimensions, gaps, copies and hexagonal cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from planline.adapter import SQL_ENTITIES as E
from planline.adapter import SQL_SHAPES, labels, parcels, paths, shapes, table
from planline.functions import frames
from planline.functions import geometry as G
from planline.functions import hexagons as X
from planline.operators import blocks as B
from planline.operators import copies as C
from planline.operators import coverage as V
from planline.operators import network as N
from planline.operators import schedules as H
from planline.operators import truth as T
from planline.plans.queries_sources import _WAYS, _inserts, _roots
from planline.streaming import arrivals

_STATED = ("points", "closed", "nx", "ny", "nz", "elevation")


def _ringed(spark, d):
    return shapes(spark, d).withColumn("block", frames.ring_block(*[F.col(c) for c in _STATED]))


def ring_blocks(spark, d):
    """Every outline's ring status, corners after arcs are flattened, and signed area."""
    r = _ringed(spark, d).select("handle", "layer", F.col("block.status").alias("ring_status"), F.col("block.ring").alias("ring"))
    return r.select("handle", "layer", "ring_status", F.size("ring").cast("long").alias("corners"), F.round(G.signed_area(F.col("ring")), 3).alias("area"))


def ends_blocks(spark, d):
    """Free ends of every polyline in the world's plan."""
    ends = frames.ends_block(F.lit("LWPOLYLINE"), *[F.col(c) for c in _STATED])
    e = shapes(spark, d).select("handle", ends.alias("e"))
    at = lambda side, c: F.round(F.col(f"e.{side}.{c}"), 6).alias(f"{side}{c}")
    return e.select("handle", F.col("e.status").alias("ends_status"), at("a", "x"), at("a", "y"), at("b", "x"), at("b", "y"))


def path_blocks(spark, d):
    """Open paths' points and bulges, and why others have none."""
    p = shapes(spark, d).select("handle", frames.path_block(*[F.col(c) for c in _STATED]).alias("p"))
    last = F.element_at("p.points", -1)
    return p.select(
        "handle", F.col("p.cause").alias("cause"), F.size("p.points").cast("long").alias("points"), F.round(last["x"], 6).alias("last_x"),
        F.round(F.aggregate("p.bulges", F.lit(0.0), lambda a, v: a + v), 9).alias("bulge_sum"),
    )


def skip_causes(spark, d):
    """Why outlines have no ring, each under its first cause."""
    cause = _ringed(spark, d).select(F.col("block.status").alias("cause")).where("cause <> 'complete'")
    return cause.groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


def ring_census(spark, d):
    """Outlines of each layer by ring status."""
    return _ringed(spark, d).groupBy("layer", F.col("block.status").alias("ring_status")).agg(F.count(F.lit(1)).alias("n"))


TILE = 40.0


def _claims(spark, d):
    return _ringed(spark, d).where("block.ring is not null and form <> 4").select(F.col("handle").alias("ring"), F.col("block.ring").alias("points"))


#: A boundary's outline, seen from its own place.
_BOUNDARY = [(0, 0), (260, 40), (200, 120), (240, 230), (60, 180)]


def _boundary(spark, d):
    x0, y0 = (F.col("n_nationkey") % 5) * 220.0, F.floor(F.col("n_nationkey") / 5) * 180.0
    points = F.array(*[F.struct((x0 + float(x)).alias("x"), (y0 + float(y)).alias("y")) for x, y in _BOUNDARY])
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ring"), points.alias("points"))


def gap_block(spark, d):
    """Ground inside the boundary rings, claimed, shared and left over; each piece counts once."""
    return V.gap_block(_claims(spark, d), _boundary(spark, d), TILE).select(*[F.round(c, 2).alias(c) for c in ("boundary_area", "covered_area", "shared_area", "claimed_outside", "gap_area")])


def claimed_depths(spark, d):
    """Ground by how many outlines lie over it."""
    s = V.covered_slabs(_claims(spark, d).withColumn("side", F.lit(0)), TILE)
    return s.groupBy(F.col("depth0").cast("long").alias("depth")).agg(F.round(F.sum("area"), 2).alias("area")).where("area > 0")


_LABEL_TEXT = """SELECT o_orderkey AS handle, o_orderpriority AS layer, ((o_orderkey * 7919) % 1100000) / 1000e0 AS x,
CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE ((o_custkey * 104729 + o_orderkey * 31) % 900000) / 1000e0 END AS y,
CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 1e0 + o_orderkey % 3 END AS radius,
CASE o_orderkey % 9 WHEN 0 THEN concat(v, '.00') WHEN 1 THEN concat(v, '.0 m') WHEN 2 THEN concat(' ', v, ' ± 3') WHEN 3 THEN concat(v, ' x 12') WHEN 4 THEN concat(v, '.5 sqm')
 WHEN 5 THEN concat(v, '.0°') WHEN 6 THEN concat(v, '.25 mm') WHEN 7 THEN CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'as drawn' END ELSE concat('1,0', v, '.0 +/- 1005.5') END AS text
FROM (SELECT *, CASE o_custkey % 2 WHEN 0 THEN 10 + 5 * (o_custkey % 7) ELSE 12 + 4 * (o_custkey % 5) END AS v FROM {orders}) o"""
SQL_DIMENSIONS = "dimensions AS (" + _LABEL_TEXT.format(orders="orders") + ")"


def dimensions(spark, d):
    """Texts that print dimensions, areas, angles, sizes and nothing, some without a place or a height."""
    return spark.sql(_LABEL_TEXT, orders=table(spark, d, "orders"))


def _measurable(spark, d):
    """Rings with their edges, rings of form 10 with their length alone, paths with their box alone."""
    ring = F.col("block.ring")
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    rings = _ringed(spark, d).where("block.ring is not null and form <> 4").select(
        "handle", ring.alias("points"), F.when(F.col("form") != 10, G.edge_lengths(ring)).alias("edges"), F.when(F.col("form") != 1, G.perimeter(ring)).alias("length"),
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
    )
    least, most = lambda a, b: F.least(a, b), lambda a, b: F.greatest(a, b)
    lines = paths(spark, d).where("type <> 'CIRCLE'").select(
        (F.col("handle") + 1_000_000_000).alias("handle"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("points"), F.lit(None).cast("array<double>").alias("edges"), "length",
        least("ax", "bx").alias("minx"), least("ay", "b_y").alias("miny"), most("ax", "bx").alias("maxx"), most("ay", "b_y").alias("maxy"),
    )
    return rings.unionByName(lines)


def dimension_truth(spark, d):
    """Every printed dimension against the edges and paths within its reach."""
    t = T.label_truth(dimensions(spark, d), _measurable(spark, d), 32.0, "m")
    rounded = ("measured", "tolerance", "distance", "runner_up_distance", "spread")
    return t.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in t.columns])


_COPY_BASE = """SELECT p_partkey AS handle, 'ROAD' AS layer, p_partkey % 5 AS b, floor(p_partkey / 5e0) AS j FROM {part}"""
_COPIES = f"""SELECT handle, layer, x AS minx, y AS miny, x + CASE b WHEN 0 THEN 1000e0 ELSE 8e0 END AS maxx, y + 4e0 + j % 3 AS maxy FROM (
SELECT *, CASE b WHEN 0 THEN 1e5 WHEN 1 THEN 0e0 WHEN 4 THEN 105200e0 ELSE 1e5 END + (j % 20) * CASE b WHEN 0 THEN 1500e0 WHEN 4 THEN 12e0 ELSE 10e0 END AS x,
 CASE b WHEN 0 THEN 2e6 WHEN 1 THEN 0e0 WHEN 2 THEN 0e0 ELSE 1e6 END + floor(j / 20e0) * 10e0 AS y FROM ({_COPY_BASE}) p) q"""
_ANCHORS = "SELECT 1e5 + (o_orderkey * 7) % 300 - CASE WHEN o_orderkey % 5 = 0 THEN 1e5 ELSE 0e0 END AS x, CAST((o_orderkey * 3) % 90 AS DOUBLE) AS y FROM {orders}"
SQL_COPIES = f"drawn AS ({_COPIES.format(part='part')}), anchors AS ({_ANCHORS.format(orders='orders')})"


def copies_partition(spark, d):
    """Bodies of the road layer, those that are copies of one another, and the one the rest of the drawing lies on."""
    drawn, anchors = spark.sql(_COPIES, part=table(spark, d, "part")), spark.sql(_ANCHORS, orders=table(spark, d, "orders"))
    summaries = C.body_summaries(C.bodies(drawn, "layer"), "layer")
    return C.chosen_copies(summaries, anchors, "layer", 1000.0)


HEX = 3.0


def hex_ring_cells(spark, d):
    """Hexagonal cells of every ring."""
    c = _ringed(spark, d).where("block.ring is not null and form <> 4").select("handle", F.explode(X.ring_cells(F.col("block.ring"), HEX)).alias("c"))
    return c.select("handle", "c.q", "c.r")


def hex_path_cells(spark, d):
    """Hexagonal cells along every open path, in order, each one step from the last."""
    p = shapes(spark, d).select("handle", frames.path_block(*[F.col(c) for c in _STATED]).alias("p")).where("p.points is not null")
    c = p.select("handle", F.posexplode(X.path_cells(F.col("p.points"), HEX)).alias("place", "c"))
    return c.select("handle", F.col("place").cast("long").alias("place"), "c.q", "c.r")


def hex_use_rollup(spark, d):
    """Parcels of each kind in cells and in the cells' parents and grandparents; outline corner and middle of the coarse cell."""
    cell = parcels(spark, d).select("kind", "area", X.cell_of(F.col("cx"), F.col("cy"), HEX).alias("cell"))
    up = cell.select("kind", "area", X.parent(X.parent(F.col("cell"))).alias("coarse"))
    g = up.groupBy("coarse", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 4).alias("area"))
    middle = X.centre(X.parent_centre(X.parent_centre(F.col("coarse"))), HEX)
    return g.select("coarse.q", "coarse.r", "kind", "n", "area", F.round(middle["x"], 6).alias("x"), F.round(middle["y"], 6).alias("y"))


def hex_vicinity(spark, d):
    """Parcels around each parcel of Brand#11, by steps from cell to cell, up to 5."""
    cells = parcels(spark, d).select("handle", "layer", "area", X.cell_of(F.col("cx"), F.col("cy"), 12.0).alias("cell"))
    near = cells.where("layer = 'Brand#11'").select("handle", F.explode(X.disc(F.col("cell"), 5)).alias("c")).select("handle", "c.q", "c.r", "c.steps")
    others = cells.where("layer <> 'Brand#11'").groupBy("cell.q", "cell.r").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))
    return near.join(others, ["q", "r"]).groupBy("handle", F.col("steps").cast("long").alias("steps")).agg(F.sum("n").alias("n"), F.round(F.sum("area"), 4).alias("area"))


def _network(spark, d):
    """Lines and arcs whose handle stands on one row, folded into a strip of 2,560 so that many meet."""
    p = paths(spark, d)
    lone = p.where("type in ('LINE', 'ARC')").join(p.groupBy("handle").count().where("count = 1").select("handle"), "handle")
    return lone.withColumns({c: F.col(c) - F.floor(F.col(c) / 2560.0) * 2560.0 for c in ("ax", "bx")})


def road_hierarchy(spark, d):
    """Spacings between the network's junctions, and its dead ends."""
    h = N.road_hierarchy(_network(spark, d), 0.1)
    return h.select(*[F.round(c, 6).alias(c) if c in ("mean", "total", "p25", "median", "p75") else c for c in h.columns])


def corridor_widths(spark, d):
    """Widths of every layer of rings, as if they were strips."""
    r = _ringed(spark, d).where("block.ring is not null and form <> 4").select("layer", F.abs(G.signed_area(F.col("block.ring"))).alias("area"), G.perimeter(F.col("block.ring")).alias("perimeter"))
    w = N.corridor_widths(r, ["layer"])
    return w.select(*[F.round(c, 6).alias(c) if c not in ("layer", "rings") else c for c in w.columns])


def world_placement(spark, d):
    """Texts in blocks and in the model: which coordinates are positions of the drawing, by the chain of inserts."""
    t = labels(spark, d).select("handle", (F.col("handle") % 700).alias("container"), (F.col("handle") % 5 != 0).alias("in_block"), "x", F.when(F.col("handle") % 31 != 0, F.col("y")).alias("y"))
    w = B.world_placed(t, B.placements(_inserts(spark, d), _roots(spark), 10_000), (0.0, 0.0, 1500.0, 1900.0))
    return w.groupBy("space", "world").agg(F.count(F.lit(1)).alias("n"), F.sum("handle").alias("handles"))


#: Stages that end a run, and how.
ENDED = {"purchase": "done", "error": "failed"}


def closed_runs(spark, d):
    """Runs (users' events) parted where nothing is heard for half an hour, those that the last event's time leaves closed."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    runs = arrivals.closed_runs(e, "user_id", "event_type", "30 minutes", ENDED)
    now = e.agg((F.max("ts") - F.expr("INTERVAL 30 MINUTES")).alias("now"))
    closed = runs.join(now, F.col("last") <= F.col("now"))  # one row
    return closed.select("user_id", F.unix_seconds("began").alias("began"), F.unix_seconds("last").alias("last"), "events", "stage", "state")


_CELLS = """SELECT CAST(b % 3 AS BIGINT) AS drawing_id, CAST(floor(b / 3) AS BIGINT) AS "table", CAST(floor(j) AS BIGINT) AS "row", CAST(v.k AS BIGINT) AS "column",
CASE v.k WHEN 0 THEN concat(' P-', CAST(c_custkey % 400 AS VARCHAR(9)), ' ') WHEN 1 THEN c_mktsegment WHEN 2 THEN CASE WHEN j = 0 THEN 'AREA' ELSE concat('1,', CAST(100 + c_custkey % 800 AS VARCHAR(9)), '.5') END ELSE CAST(c_nationkey AS VARCHAR(9)) END AS text
FROM (SELECT *, floor(c_custkey / 24e0) AS b, c_custkey % 24 AS j FROM {customer}) c JOIN (VALUES (0), (1), (2), (3)) AS v(k) ON v.k < CASE WHEN b % 5 = 1 THEN 4 ELSE 3 END"""


def schedules(spark, d):
    """What the drawings' schedules, each drawn as several tables, say of every item."""
    cells = spark.sql(_CELLS.replace('"', "`"), customer=table(spark, d, "customer"))
    return H.schedule(H.merged_grids(cells))


_WORLD = f"""WITH {SQL_SHAPES},
unit AS (SELECT *, nx / sqrt(nx * nx + ny * ny + nz * nz) AS ux, ny / sqrt(nx * nx + ny * ny + nz * nz) AS uy, nz / sqrt(nx * nx + ny * ny + nz * nz) AS uz FROM shape_vertices),
axis AS (SELECT *, nx = 0 AND ny = 0 AND nz = 1 AS plain, CASE WHEN abs(ux) < 1 / 64e0 AND abs(uy) < 1 / 64e0 THEN uz ELSE -uy END AS a1,
  CASE WHEN abs(ux) < 1 / 64e0 AND abs(uy) < 1 / 64e0 THEN 0e0 ELSE ux END AS a2, CASE WHEN abs(ux) < 1 / 64e0 AND abs(uy) < 1 / 64e0 THEN -ux ELSE 0e0 END AS a3 FROM unit),
long AS (SELECT *, sqrt(a1 * a1 + a2 * a2 + a3 * a3) AS l FROM axis),
world AS (SELECT handle, layer, form, closed, k, z, CASE WHEN plain THEN bulge ELSE -bulge END AS bulge,
  CASE WHEN plain THEN x ELSE x * (a1 / l) + y * (uy * (a3 / l) - uz * (a2 / l)) + elevation * ux END AS x,
  CASE WHEN plain THEN y ELSE x * (a2 / l) + y * (uz * (a1 / l) - ux * (a3 / l)) + elevation * uy END AS y FROM long),
spans AS (SELECT *, lead(x) OVER w AS next_x, lead(y) OVER w AS next_y, first_value(x) OVER w AS first_x, first_value(y) OVER w AS first_y FROM world WHERE k IS NOT NULL
  WINDOW w AS (PARTITION BY handle ORDER BY k)),
steps AS (SELECT *, coalesce(next_x, first_x) AS qx, coalesce(next_y, first_y) AS qy FROM spans),
arcs AS (SELECT *, 4 * atan(bulge) AS sweep, sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)) * (1 + bulge * bulge) / nullif(4 * abs(bulge), 0) AS radius FROM steps WHERE qx <> x OR qy <> y),
chords AS (SELECT *, CASE WHEN bulge = 0 THEN 1 ELSE greatest(1, ceil(abs(sweep) / (2 * acos(greatest(-1, 1 - 1e-2 / radius))))) END AS n FROM arcs),
sums AS (SELECT handle, CAST(sum(n) AS BIGINT) AS corners, count(*) AS places,
  sum(((x - first_x) * (qy - first_y) - (qx - first_x) * (y - first_y)) / 2 + CASE WHEN bulge = 0 THEN 0 ELSE sign(bulge) * radius * radius / 2 * (n * sin(abs(sweep) / n) - sin(abs(sweep))) END) AS area,
  sum(sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y))) AS round FROM chords GROUP BY handle),
judged AS (SELECT w.handle, any_value(w.layer) AS layer, any_value(w.form) AS form, any_value(corners) AS corners, any_value(area) AS area,
  CASE WHEN count(w.k) = 0 THEN 'unreadable' WHEN max(z) - min(z) > 1e-9 THEN 'non_planar' WHEN NOT any_value(w.closed) THEN 'open' WHEN coalesce(any_value(places), 0) < 3 THEN 'degenerate'
       WHEN abs(any_value(area)) <= 1e-12 * pow(any_value(round), 2) THEN 'degenerate' ELSE 'complete' END AS ring_status
  FROM world w LEFT JOIN sums ON w.handle = sums.handle GROUP BY w.handle)"""
_RINGS = f"""{_WORLD},
kept AS (SELECT s.handle, s.k, s.x, s.y, s.qx, s.qy FROM chords s JOIN judged j ON s.handle = j.handle WHERE ring_status = 'complete' AND j.form <> 4)"""
_BOUNDARY_SQL = " UNION ALL ".join(
    f"SELECT -n_nationkey - 1, 1, (n_nationkey % 5) * 220e0 + {p[0]}, floor(n_nationkey / 5e0) * 180e0 + {p[1]}, (n_nationkey % 5) * 220e0 + {q[0]}, floor(n_nationkey / 5e0) * 180e0 + {q[1]} FROM nation"
    for p, q in zip(_BOUNDARY, [*_BOUNDARY[1:], _BOUNDARY[0]])
)
# the other axis is swept, over the whole drawing at once
_SWEPT = f"""{_RINGS},
sides(ring, side, x, y, qx, qy) AS (SELECT handle, 0, x, y, qx, qy FROM kept {{boundary}}),
edge AS (SELECT ring, side, CASE WHEN y < qy THEN x ELSE qx END AS x1, least(y, qy) AS y1, CASE WHEN y < qy THEN qx ELSE x END AS x2, greatest(y, qy) AS y2 FROM sides WHERE y <> qy),
slope AS (SELECT *, row_number() OVER () AS id, (x2 - x1) / (y2 - y1) AS s, least(x1, x2) AS lo, greatest(x1, x2) AS hi FROM edge),
cross_at AS (SELECT (b.x1 - a.x1 + a.s * a.y1 - b.s * b.y1) / nullif(a.s - b.s, 0) AS y, greatest(a.y1, b.y1) AS low, least(a.y2, b.y2) AS high
  FROM slope a JOIN slope b ON a.id < b.id AND a.y1 < b.y2 AND b.y1 < a.y2 AND a.lo <= b.hi AND b.lo <= a.hi),
cuts AS (SELECT DISTINCT y FROM (SELECT y1 AS y FROM slope UNION ALL SELECT y2 FROM slope UNION ALL SELECT y FROM cross_at WHERE y > low AND y < high)),
slab AS (SELECT y AS y0, lead(y) OVER (ORDER BY y) AS y9 FROM cuts),
met AS (SELECT y0, y9 - y0 AS wide, ring, side, x1 + s * ((y0 + y9) / 2 - y1) AS x FROM slab JOIN slope ON y1 < (y0 + y9) / 2 AND y2 > (y0 + y9) / 2),
turn AS (SELECT y0, wide, x, side, CASE WHEN row_number() OVER (PARTITION BY y0, ring ORDER BY x) % 2 = 1 THEN 1 ELSE -1 END AS t FROM met),
run AS (SELECT wide, lead(x) OVER w - x AS long, sum(CASE WHEN side = 0 THEN t ELSE 0 END) OVER w AS depth0, sum(CASE WHEN side = 1 THEN t ELSE 0 END) OVER w AS depth1 FROM turn
  WINDOW w AS (PARTITION BY y0 ORDER BY x, side, t ROWS UNBOUNDED PRECEDING)),
ground AS (SELECT depth0, depth1, wide * long AS area FROM run WHERE long > 0)"""

_UNIT = "(sqm|m2|mm|cm|km|m|ft|in|deg|°)$"
_NUMBER = r"[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[+-]?[0-9]+(?:\.[0-9]+)?"
_TRUTH = f"""{_RINGS}, {SQL_DIMENSIONS}, {E.split(" ", 1)[1]},
read AS (SELECT handle, x, y, radius, trim(text) AS t, lower(regexp_extract(trim(text), '{_UNIT}', 1)) AS unit, regexp_extract_all(trim(text), '{_NUMBER}') AS numbers FROM dimensions),
said AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '^[0-9]+ x [0-9]+$') THEN 'size' WHEN unit IN ('sqm', 'm2') THEN 'area' WHEN unit IN ('°', 'deg') THEN 'angle'
  WHEN len(numbers) = 0 THEN 'no number' WHEN unit <> '' AND unit <> 'm' THEN 'unit' END AS reason, CAST(replace(numbers[1], ',', '') AS DOUBLE) AS first_number,
  length(regexp_extract(numbers[1], '\\.([0-9]+)$', 1)) AS decimals, CASE WHEN regexp_matches(t, '±|\\+/-') THEN abs(CAST(replace(numbers[2], ',', '') AS DOUBLE)) END AS stated FROM read),
ringed AS (SELECT k.*, j.form, sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)) AS length FROM kept k JOIN judged j ON k.handle = j.handle),
ring_box AS (SELECT handle, min(form) AS form, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, CASE WHEN min(form) <> 1 THEN sum(length) END AS length FROM ringed GROUP BY handle),
asked AS (SELECT * FROM said WHERE reason IS NULL AND x IS NOT NULL AND y IS NOT NULL),
ring_pair AS (SELECT a.handle AS label, b.handle, b.form, b.length, sqrt(pow(maxx - minx, 2) + pow(maxy - miny, 2)) AS diagonal, a.radius, a.x AS px, a.y AS py FROM asked a JOIN ring_box b
  ON a.x + coalesce(radius, 0) >= minx AND a.x - coalesce(radius, 0) <= maxx AND a.y + coalesce(radius, 0) >= miny AND a.y - coalesce(radius, 0) <= maxy),
edge_pair AS (SELECT p.*, e.length AS edge, sqrt(pow(px - (e.x + u * (e.qx - e.x)), 2) + pow(py - (e.y + u * (e.qy - e.y)), 2)) AS away,
  CASE WHEN (e.y > py) <> (e.qy > py) AND px < (e.qx - e.x) * (py - e.y) / nullif(e.qy - e.y, 0) + e.x THEN 1 ELSE 0 END AS hit
  FROM (SELECT p.*, e.x AS ex, e.y AS ey, e.k, greatest(0, least(1, ((px - e.x) * (e.qx - e.x) + (py - e.y) * (e.qy - e.y)) / (e.length * e.length))) AS u FROM ring_pair p JOIN ringed e ON p.handle = e.handle) p
  JOIN ringed e ON p.handle = e.handle AND p.k = e.k),
ring_side AS (SELECT label, handle, sum(hit) % 2 = 1 OR min(away) <= 1e-9 * min(diagonal) AS contains, min(away) AS outline, min(form) AS form, min(length) AS length, min(radius) AS radius FROM edge_pair GROUP BY 1, 2),
offers AS (
  SELECT e.label, e.handle, min(away) AS distance, arg_min(edge, away) AS measured, any_value(contains) AS contains FROM edge_pair e JOIN ring_side s ON e.label = s.label AND e.handle = s.handle
  WHERE e.form <> 10 AND away <= e.radius GROUP BY e.label, e.handle, round(edge, 9)
  UNION ALL SELECT label, handle, outline, length, contains FROM ring_side WHERE form = 10 AND outline <= radius
  UNION ALL SELECT label, handle, min(distance), any_value(length), false FROM (
    SELECT a.handle AS label, p.handle + 1000000000 AS handle, length, radius,
      sqrt(pow(greatest(0, least(ax, bx) - x, x - greatest(ax, bx)), 2) + pow(greatest(0, least(ay, b_y) - y, y - greatest(ay, b_y)), 2)) AS distance
    FROM asked a JOIN paths p ON type <> 'CIRCLE' AND x + radius >= least(ax, bx) AND x - radius <= greatest(ax, bx) AND y + radius >= least(ay, b_y) AND y - radius <= greatest(ay, b_y))
  WHERE distance <= radius GROUP BY label, handle, round(length, 9)),
best AS (SELECT label, list({{'d': distance, 'h': handle, 'm': measured, 'c': contains}} ORDER BY distance, handle, measured) AS found, max(measured) - min(measured) AS spread
  FROM offers WHERE measured IS NOT NULL GROUP BY label),
lost AS (SELECT s.label, count(*) AS enclosing FROM ring_side s LEFT JOIN offers o ON s.label = o.label AND s.handle = o.handle WHERE contains_of(s.contains) AND o.handle IS NULL GROUP BY s.label),
dumb AS (SELECT label, count(*) AS unmeasured FROM offers WHERE measured IS NULL GROUP BY label),
all_of AS (SELECT s.*, found, spread, coalesce(enclosing, 0) AS enclosing, coalesce(unmeasured, 0) AS unmeasured,
  greatest(5e-1 * pow(10, -decimals), coalesce(stated, 0), 1e-6 * abs(found[1].m)) AS tol FROM said s LEFT JOIN best ON handle = best.label LEFT JOIN lost ON handle = lost.label LEFT JOIN dumb ON handle = dumb.label)
SELECT handle, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN x IS NULL OR y IS NULL THEN 'unplaced' WHEN found IS NULL THEN 'unassociated' WHEN len(found) > 1 AND spread > tol THEN 'ambiguous'
  WHEN abs(found[1].m - first_number) <= tol THEN 'agrees' ELSE 'differs' END AS status, reason, CASE WHEN reason IS NULL OR reason = 'unit' THEN first_number END AS printed, round(found[1].m, 6) AS measured,
  CASE WHEN found IS NULL THEN NULL ELSE round(tol, 6) END AS tolerance, found[1].h AS nearest, round(found[1].d, 6) AS distance, found[1].c AS contains, found[2].h AS runner_up, round(found[2].d, 6) AS runner_up_distance,
  round(spread, 6) AS spread, CAST(coalesce(len(found), 0) AS BIGINT) AS candidates, enclosing, unmeasured FROM all_of""".replace("contains_of(s.contains)", "s.contains")


def _cut(source: str, to: str, low: str, high: str, before: str) -> str:
    """One cut of bodies by an axis, as common table expressions."""
    return f"""{to}_b AS (SELECT *, CASE WHEN {low} - max({high}) OVER (PARTITION BY {before} ORDER BY {low}, {high}, handle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > wide THEN 1 ELSE 0 END AS cut FROM {source}),
{to}_n AS (SELECT * EXCLUDE (cut), sum(cut) OVER (PARTITION BY {before} ORDER BY {low}, {high}, handle ROWS UNBOUNDED PRECEDING) AS piece FROM {to}_b),
{to} AS (SELECT * EXCLUDE (piece, body), min(handle) OVER (PARTITION BY {before}, piece) AS body FROM {to}_n)"""


_CUTS = [("placed", "x1", "minx", "maxx"), ("x1", "y1", "miny", "maxy"), ("y1", "x2", "minx", "maxx"), ("x2", "y2", "miny", "maxy"), ("y2", "x3", "minx", "maxx"), ("x3", "y3", "miny", "maxy")]
_COPIES_SQL = f"""WITH {SQL_COPIES},
placed AS (SELECT *, CAST(0 AS BIGINT) AS body, (SELECT max(greatest(maxx - minx, maxy - miny)) FROM drawn) AS wide FROM drawn),
{", ".join(_cut(s, t, lo, hi, "body") for s, t, lo, hi in _CUTS)},
box AS (SELECT layer, body, count(*) AS entities, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM y3 GROUP BY layer, body),
rel AS (SELECT m.body, entities, round(m.minx - b.minx, 3) AS a, round(m.miny - b.miny, 3) AS b, round(m.maxx - b.minx, 3) AS c, round(m.maxy - b.miny, 3) AS d, count(*) AS n FROM y3 m JOIN box b ON m.body = b.body GROUP BY ALL),
same AS (SELECT p.body, q.body AS other FROM rel p JOIN rel q ON p.entities = q.entities AND p.a = q.a AND p.b = q.b AND p.c = q.c AND p.d = q.d AND p.n = q.n GROUP BY p.body, q.body HAVING sum(p.n) = max(p.entities)),
twins AS (SELECT body, count(*) AS copies, min(other) AS first_copy FROM same GROUP BY body),
held AS (SELECT body, count(*) AS anchors FROM box JOIN anchors ON x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy GROUP BY body),
full_box AS (SELECT box.*, copies, first_copy, coalesce(anchors, 0) AS anchors FROM box JOIN twins ON box.body = twins.body LEFT JOIN held ON box.body = held.body),
rule AS (SELECT max(anchors) AS most, count(*) AS bodies, (SELECT count(*) FROM full_box WHERE anchors = (SELECT max(anchors) FROM full_box)) AS leaders FROM full_box)
SELECT layer, body, entities, minx, miny, maxx, maxy, copies, first_copy, anchors, bodies = 1 OR (most > 0 AND leaders = 1 AND anchors = most) AS live,
  CASE WHEN bodies = 1 THEN 'only' WHEN most > 0 AND leaders = 1 THEN 'anchors' ELSE 'none' END AS rule FROM full_box CROSS JOIN rule"""

_R3 = "1.7320508075688772e0"


def _hex(q: str, r: str) -> tuple[str, str]:
    """Nearest cell to fractional axial coordinates."""
    a, b, s = f"floor({q} + 0.5)", f"floor({r} + 0.5)", f"floor(-({q}) - ({r}) + 0.5)"
    da, db, ds = f"abs({a} - ({q}))", f"abs({b} - ({r}))", f"abs({s} + ({q}) + ({r}))"
    first = f"({da} > {db} AND {da} > {ds})"
    return f"CAST(CASE WHEN {first} THEN -{b} - {s} ELSE {a} END AS BIGINT)", f"CAST(CASE WHEN NOT {first} AND {db} > {ds} THEN -{a} - {s} ELSE {b} END AS BIGINT)"


def _at(x: str, y: str, size: float) -> tuple[str, str]:
    return _hex(f"(({x}) * ({_R3} / 3) - ({y}) / 3e0) / {size}e0", f"({y}) * (2 / 3e0) / {size}e0")


def _up(q: str, r: str) -> tuple[str, str]:
    return _hex(f"(3 * {q} + {r}) / 7e0", f"(2 * {r} - {q}) / 7e0")


_MID = _at("(min(x) + max(x)) / 2", "(min(y) + max(y)) / 2", 3)
_HEX_RINGS = f"""{_RINGS},
span AS (SELECT handle, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, {_MID[0]} AS mq, {_MID[1]} AS mr FROM kept GROUP BY handle),
lattice AS (SELECT handle, mq, mr, r, unnest(range(CAST(floor(minx / (3 * {_R3}) - r / 2e0) AS BIGINT) - 1, CAST(ceil(maxx / (3 * {_R3}) - r / 2e0) AS BIGINT) + 2)) AS q
  FROM (SELECT *, unnest(range(CAST(floor(miny / 4.5) AS BIGINT) - 1, CAST(ceil(maxy / 4.5) AS BIGINT) + 2)) AS r FROM span)),
spot AS (SELECT *, 3 * {_R3} * (q + r / 2e0) AS cx, 4.5e0 * r AS cy FROM lattice),
inside AS (SELECT s.handle, s.q, s.r FROM spot s JOIN kept e ON s.handle = e.handle GROUP BY s.handle, s.q, s.r, cx, cy
  HAVING sum(CASE WHEN (e.y > cy) <> (e.qy > cy) AND cx < (e.qx - e.x) * (cy - e.y) / nullif(e.qy - e.y, 0) + e.x THEN 1 ELSE 0 END) % 2 = 1)
SELECT handle, q, r FROM inside UNION ALL SELECT handle, mq, mr FROM span WHERE handle NOT IN (SELECT handle FROM inside)"""

_A, _B = _at("x", "y", 3), _at("next_x", "next_y", 3)
_WALK = _hex("(aq + 1e-6 + (bq - aq) * (i / greatest(n, 1)))", "(ar + 2e-6 + (br - ar) * (i / greatest(n, 1)))")
_HEX_PATHS = f"""{_WORLD},
legs AS (SELECT s.handle, s.k, {_A[0]} AS aq, {_A[1]} AS ar, {_B[0]} AS bq, {_B[1]} AS br FROM spans s JOIN judged j ON s.handle = j.handle WHERE NOT s.closed AND next_x IS NOT NULL),
far AS (SELECT *, CAST((abs(aq - bq) + abs(ar - br) + abs(aq - bq + ar - br)) / 2 AS BIGINT) AS n FROM legs),
walked AS (SELECT handle, k, i, {_WALK[0]} AS q, {_WALK[1]} AS r FROM (SELECT *, unnest(range(n + 1)) AS i FROM far)),
fresh AS (SELECT *, lag(q) OVER w AS last_q, lag(r) OVER w AS last_r FROM walked WINDOW w AS (PARTITION BY handle ORDER BY k, i))
SELECT handle, row_number() OVER (PARTITION BY handle ORDER BY k, i) - 1 AS place, q, r FROM fresh WHERE last_q IS NULL OR last_q <> q OR last_r <> r"""

_CELL3, _CELL12, _UP = _at("cx", "cy", 3), _at("cx", "cy", 12), _up("q", "r")
_HEX_ROLLUP = f"""{E}, fine AS (SELECT kind, area, {_CELL3[0]} AS q, {_CELL3[1]} AS r FROM parcels), mid AS (SELECT kind, area, {_UP[0]} AS q, {_UP[1]} AS r FROM fine),
coarse AS (SELECT kind, area, {_UP[0]} AS q, {_UP[1]} AS r FROM mid), g AS (SELECT q, r, kind, count(*) AS n, round(sum(area), 4) AS area FROM coarse GROUP BY q, r, kind),
m AS (SELECT *, 2 * q - r AS q1, q + 3 * r AS r1 FROM g), f AS (SELECT *, 2 * q1 - r1 AS q2, q1 + 3 * r1 AS r2 FROM m)
SELECT q, r, kind, n, area, round(3 * {_R3} * (q2 + r2 / 2e0), 6) AS x, round(4.5e0 * r2, 6) AS y FROM f"""
_HEX_NEAR = f"""{E}, c AS (SELECT handle, layer, area, {_CELL12[0]} AS q, {_CELL12[1]} AS r FROM parcels),
n AS (SELECT a.handle, CAST((abs(a.q - b.q) + abs(a.r - b.r) + abs(a.q - b.q + a.r - b.r)) / 2 AS BIGINT) AS steps, b.area FROM c a JOIN c b ON a.layer = 'Brand#11' AND b.layer <> 'Brand#11')
SELECT handle, steps, count(*) AS n, round(sum(area), 4) AS area FROM n WHERE steps <= 5 GROUP BY 1, 2"""

SQL = {
    "ring_blocks": f"{_WORLD} SELECT handle, layer, ring_status, CASE WHEN ring_status = 'complete' THEN corners END AS corners, CASE WHEN ring_status = 'complete' THEN round(area, 3) END AS area FROM judged",
    "ends_blocks": f"""{_WORLD}, last AS (SELECT handle, count(k) AS n, any_value(closed) AS closed, arg_min(x, k) AS ax, arg_min(y, k) AS ay, arg_max(x, k) AS bx, arg_max(y, k) AS b_y FROM world GROUP BY handle),
        e AS (SELECT *, CASE WHEN closed THEN 'closed_ring' WHEN n < 2 THEN 'not_derived' ELSE 'open_path' END AS ends_status FROM last)
        SELECT handle, ends_status, """ + ", ".join(f"CASE WHEN ends_status = 'open_path' THEN round({c}, 6) END AS {n}" for c, n in (("ax", "ax"), ("ay", "ay"), ("bx", "bx"), ("b_y", "by"))) + " FROM e",
    "path_blocks": f"""{_WORLD}, g AS (SELECT handle, any_value(closed) AS closed, count(k) AS n, arg_max(x, k) AS last_x, sum(bulge) - arg_max(bulge, k) AS bulges, max(abs(bulge)) AS most FROM world GROUP BY handle)
        SELECT handle, CASE WHEN n = 0 THEN 'unreadable' WHEN closed THEN 'closed' END AS cause, CASE WHEN NOT closed AND n > 0 THEN n END AS points, CASE WHEN NOT closed AND n > 0 THEN round(last_x, 6) END AS last_x,
        CASE WHEN NOT closed AND most > 0 THEN round(bulges, 9) END AS bulge_sum FROM g""",
    "skip_causes": f"{_WORLD} SELECT ring_status AS cause, count(*) AS n FROM judged WHERE ring_status <> 'complete' GROUP BY 1",
    "ring_census": f"{_WORLD} SELECT layer, ring_status, count(*) AS n FROM judged GROUP BY 1, 2",
    "gap_block": _SWEPT.format(boundary=f"UNION ALL {_BOUNDARY_SQL}") + """ SELECT round(sum(CASE WHEN depth1 > 0 THEN area END), 2) AS boundary_area, round(sum(CASE WHEN depth1 > 0 AND depth0 > 0 THEN area END), 2) AS covered_area,
        round(coalesce(sum(CASE WHEN depth1 > 0 AND depth0 > 1 THEN area END), 0), 2) AS shared_area, round(sum(CASE WHEN depth1 = 0 AND depth0 > 0 THEN area ELSE 0 END), 2) AS claimed_outside,
        round(sum(CASE WHEN depth1 > 0 AND depth0 = 0 THEN area END), 2) AS gap_area FROM ground""",
    "claimed_depths": _SWEPT.format(boundary="") + " SELECT CAST(depth0 AS BIGINT) AS depth, round(sum(area), 2) AS area FROM ground WHERE depth0 > 0 GROUP BY 1 HAVING round(sum(area), 2) > 0",
    "dimension_truth": _TRUTH,
    "copies_partition": _COPIES_SQL,
    "road_hierarchy": f"""{E}, u AS (SELECT * FROM paths WHERE type IN ('LINE', 'ARC') AND handle IN (SELECT handle FROM paths GROUP BY handle HAVING count(*) = 1)),
        x AS (SELECT handle, ax - floor(ax / 2560e0) * 2560e0 AS x, ay AS y FROM u UNION ALL SELECT handle, bx - floor(bx / 2560e0) * 2560e0, b_y FROM u), e AS (SELECT handle, round(x / 25e-1) AS gx, round(y / 25e-1) AS gy FROM x),
        n AS (SELECT gx, gy, count(*) AS degree FROM e GROUP BY gx, gy), p AS (SELECT e.handle, min(degree) AS low FROM e JOIN n ON e.gx = n.gx AND e.gy = n.gy GROUP BY e.handle),
        k AS (SELECT u.handle, length, low FROM u JOIN p ON u.handle = p.handle), s AS (SELECT length FROM k WHERE low >= 3 AND length IS NOT NULL)
        SELECT count(*) AS spacings, min(length) AS least, max(length) AS most, round(avg(length), 6) AS mean, round(sum(length), 6) AS total, round(quantile_cont(length, 25e-2), 6) AS p25, round(quantile_cont(length, 5e-1), 6) AS median,
        round(quantile_cont(length, 75e-2), 6) AS p75, CAST(0 AS BIGINT) AS one_end, (SELECT count(*) FROM k WHERE low < 3) AS not_between, (SELECT count(*) FROM k WHERE low >= 3 AND length IS NULL) AS unmeasured,
        (SELECT count(*) FROM n WHERE degree = 1) AS dead_ends FROM s""",
    "corridor_widths": f"""{_WORLD}, s AS (SELECT layer, 2 * abs(j.area) / round AS width, round / 2 AS length FROM judged j JOIN sums ON j.handle = sums.handle WHERE ring_status = 'complete' AND form <> 4)
        SELECT layer, count(*) AS rings, round(min(width), 6) AS least, round(avg(width), 6) AS mean, round(max(width), 6) AS most, round(quantile_cont(width, 5e-1), 6) AS median, round(quantile_cont(length, 5e-1), 6) AS median_length FROM s GROUP BY layer""",
    "world_placement": f"""WITH RECURSIVE {_WAYS}, q AS (SELECT DISTINCT block, s, x FROM w WHERE level > 0),
        st AS (SELECT block, CASE WHEN bool_and(s = 1 AND x = 0) THEN 'identity' WHEN count(*) = 1 THEN 'placed' ELSE 'ambiguous' END AS status FROM q GROUP BY block),
        {E.split(" ", 1)[1]}, t AS (SELECT l.handle, handle % 5 <> 0 AS in_block, x, CASE WHEN handle % 31 <> 0 THEN y END AS y, st.status FROM labels l LEFT JOIN st ON st.block = handle % 700)
        SELECT CASE WHEN NOT in_block THEN 'layout' ELSE coalesce(status, 'unplaced') END AS space, NOT in_block OR (coalesce(status, '') = 'identity' AND x BETWEEN 0 AND 1500 AND coalesce(y, -1) BETWEEN 0 AND 1900) AS world,
        count(*) AS n, CAST(sum(handle) AS BIGINT) AS handles FROM t GROUP BY 1, 2""",
    "closed_runs": """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events),
        r AS (SELECT *, sum(CASE WHEN prior IS NULL OR ts - prior >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
        g AS (SELECT user_id, min(ts) AS began, max(ts) AS last, count(*) AS events, arg_max(event_type, (ts, event_id)) AS stage, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('purchase', 'error')) AS said FROM r GROUP BY user_id, run)
        SELECT user_id, CAST(floor(epoch(began)) AS BIGINT) AS began, CAST(floor(epoch(last)) AS BIGINT) AS last, events, stage, CASE said WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'abandoned' END AS state
        FROM g WHERE last <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE""",
    "schedules": f"""WITH cells AS ({_CELLS.format(customer='customer')}),
        t AS (SELECT drawing_id, "table", max("column") + 1 AS width, max("row") + 1 AS n FROM cells GROUP BY 1, 2),
        u AS (SELECT drawing_id, width, row_number() OVER (PARTITION BY drawing_id ORDER BY sum(n) DESC, min("table")) AS rn FROM t GROUP BY 1, 2),
        s AS (SELECT t.drawing_id, "table", coalesce(sum(n) OVER (PARTITION BY t.drawing_id ORDER BY "table" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t JOIN u ON t.drawing_id = u.drawing_id AND t.width = u.width AND rn = 1),
        g AS (SELECT c.drawing_id, start + "row" AS place, "column" AS k, text, TRY_CAST(replace(trim(text), ',', '') AS DOUBLE) AS v FROM cells c JOIN s ON c.drawing_id = s.drawing_id AND c."table" = s."table"),
        m AS (SELECT drawing_id, k, row_number() OVER (PARTITION BY drawing_id ORDER BY count(v) DESC, k) AS rn FROM g WHERE k > 0 GROUP BY 1, 2),
        r AS (SELECT a.drawing_id, a.place, trim(a.text) AS item, b.v FROM g a JOIN g b ON a.drawing_id = b.drawing_id AND a.place = b.place AND a.k = 0 AND b.v IS NOT NULL JOIN m ON m.drawing_id = b.drawing_id AND m.k = b.k AND rn = 1)
        SELECT drawing_id, item, arg_min(v, place) AS value, CAST(min(place) AS BIGINT) AS place, count(*) AS times FROM r GROUP BY 1, 2""",
    "hex_ring_cells": _HEX_RINGS,
    "hex_path_cells": _HEX_PATHS,
    "hex_use_rollup": _HEX_ROLLUP,
    "hex_vicinity": _HEX_NEAR,
}
QUERIES = {name: globals()[name] for name in SQL}
