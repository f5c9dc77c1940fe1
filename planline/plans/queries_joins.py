"""Spatial and key joins, components, cells and revisions over the entities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planline.adapter import SQL_ENTITIES as E
from planline.adapter import labels, parcels, paths, table
from planline.functions import geometry as G
from planline.operators import duplicates as D
from planline.operators import graph as GR
from planline.operators import network as N
from planline.operators import spatial as S
from planline.operators import windows as W

CELL = 40.0


def _inside(spark, d):
    return S.points_in_rings(labels(spark, d).select("handle", "layer", "text", "x", "y"), parcels(spark, d).select("handle", "layer", "area", "minx", "miny", "maxx", "maxy", "ring"), CELL)


def label_in_polygon(spark, d):
    return _inside(spark, d).select("p_handle", "p_text", "r_handle", F.col("r_layer").alias("layer"))


def label_coverage(spark, d):
    """Parcels by layer: how many have a label, how many have several."""
    n = _inside(spark, d).groupBy(F.col("r_handle").alias("handle")).agg(F.count(F.lit(1)).alias("n"))
    p = parcels(spark, d).join(GR.shuffled(n), "handle", "left")
    return p.groupBy("layer").agg(
        F.count(F.lit(1)).alias("parcels"), F.count("n").alias("labelled"), F.count_if(F.col("n") > 1).alias("shared"), F.coalesce(F.sum("n"), F.lit(0)).alias("labels")
    )


def containers_of_entity(spark, d):
    return _inside(spark, d).select("p_handle", "r_handle", F.row_number().over(Window.partitionBy("p_handle").orderBy("r_area", "r_handle")).cast("long").alias("place"))


def smallest_container(spark, d):
    w = W.top_n(_inside(spark, d), ["p_handle"], ["r_area", "r_handle"], 1)
    return w.select("p_handle", "r_handle", F.round("r_area", 4).alias("area"))


def containment(spark, d):
    """Parcel centres inside other parcels."""
    p = parcels(spark, d)
    inner = p.select("handle", F.col("cx").alias("x"), F.col("cy").alias("y"))
    pairs = S.points_in_rings(inner, p.select("handle", "minx", "miny", "maxx", "maxy", "ring"), CELL)
    return pairs.where("p_handle <> r_handle").select("p_handle", "r_handle")


def coverage_gap(spark, d):
    """Texts that stand in some parcel and those that stand in none, by layer."""
    l = labels(spark, d)
    placed = _inside(spark, d).select(F.col("p_handle").alias("handle")).distinct().withColumn("placed", F.lit(1))
    return l.join(GR.shuffled(placed), "handle", "left").groupBy("layer").agg(F.count("placed").alias("placed"), F.count_if(F.col("placed").isNull()).alias("unplaced"))


def duplicate_labels_in_polygon(spark, d):
    """Equal texts in one parcel, each label in its first parcel only."""
    first = W.top_n(_inside(spark, d), ["p_handle"], ["r_handle"], 1)
    text = F.lower(F.trim("p_text"))
    g = first.groupBy("r_handle", text.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return g.where("n > 1")


def _centres(spark, d):
    return parcels(spark, d).select("handle", "layer", "area", F.col("cx").alias("x"), F.col("cy").alias("y"))


def proximity_count(spark, d):
    c = _centres(spark, d)
    near = S.within_radius(c.where("layer = 'Brand#11'"), c.where("layer <> 'Brand#11'"), 100.0)
    return near.groupBy("c_handle").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_area"), 4).alias("area"), F.round(F.min("distance"), 6).alias("nearest"), F.round(F.max("distance"), 6).alias("farthest")
    )


def proximity_union(spark, d):
    c = _centres(spark, d)
    near = S.within_radius(c.where("layer = 'Brand#11'"), c.where("layer <> 'Brand#11'"), 100.0)
    return near.agg(F.countDistinct("o_handle").alias("within_radius_of_any"), F.count(F.lit(1)).alias("pairs"))


def nearest_neighbour(spark, d):
    c = _centres(spark, d).where("layer = 'Brand#22'")
    return S.nearest(c, c, 80.0).withColumnRenamed("handle", "c_handle")


def distance_matrix(spark, d):
    """All pairs of the 40 largest parcels: a bounded cross join."""
    c = _centres(spark, d).orderBy(F.desc("area"), "handle").limit(40)
    a, b = c.select(F.col("handle").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), c.select(F.col("handle").alias("b"), F.col("x").alias("bx"), F.col("y").alias("b_y"))
    return a.crossJoin(F.broadcast(b)).where("a < b").select("a", "b", F.round(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("b_y")), 6).alias("distance"))


def adjacency(spark, d):
    """Pairs of parcels whose boxes touch or come within 2 of each other."""
    p = parcels(spark, d).select("handle", "minx", "miny", "maxx", "maxy")
    return S.box_pairs(p, CELL, 1.0).select("a_handle", "b_handle")


def overlap_scan(spark, d):
    """Shared area of parcels whose rings overlap."""
    p = parcels(spark, d).select("handle", "minx", "miny", "maxx", "maxy", "ring", "area")
    o = S.ring_overlap_area(S.box_pairs(p, CELL)).where("overlap > 1e-6")
    share = F.col("overlap") / F.least("a_area", "b_area")
    return o.select("a_handle", "b_handle", F.round("overlap", 4).alias("overlap"), F.round(share, 6).alias("share"))


def box_overlap_area(spark, d):
    p = parcels(spark, d).select("handle", "minx", "miny", "maxx", "maxy")
    o = S.box_pairs(p, CELL)
    w = F.least("a_maxx", "b_maxx") - F.greatest("a_minx", "b_minx")
    h = F.least("a_maxy", "b_maxy") - F.greatest("a_miny", "b_miny")
    return o.select("a_handle", "b_handle", F.round(w * h, 4).alias("overlap"))


def frontage_check(spark, d):
    """Parcels against roads: established where a road's ring is within the tolerance, unproven where the road has a box alone, else none.

    Roads are the parcels of size code 1 (with rings) and 2 (boxes alone); the tolerance is a part of the typical width, the root of the median area.
    """
    p = parcels(spark, d).select("handle", "size_code", "area", "minx", "miny", "maxx", "maxy", "ring")
    typical = W.values_at(p, [], "area", {"median": lambda n: F.floor(n / 2) + 1}).select(F.sqrt("median").alias("typical")).first()
    reach = (typical.typical if typical else 0.0) * 0.25
    plots, roads = p.where("size_code > 2"), p.where("size_code <= 2")
    near = S.box_matches(plots, roads, CELL, reach)
    distance = F.when(F.col("b_size_code") == 1, F.round(G.ring_to_ring(F.col("a_ring"), F.col("b_ring")), 6))
    near = near.select(F.col("a_handle").alias("handle"), distance.alias("distance"), (F.col("b_size_code") == 2).alias("box_only"))
    best = near.groupBy("handle").agg(F.min(F.when(F.col("distance") <= reach, F.col("distance"))).alias("distance"), F.max("box_only").alias("box_only"))
    status = F.when(F.col("distance").isNotNull(), "established").when(F.col("box_only"), "unproven").otherwise("none")
    return plots.join(GR.shuffled(best), "handle", "left").select("handle", "distance", status.alias("frontage"))


def adjacency_by_edges(spark, d):
    """Pairs of parcels whose outlines come within 3, with the distance between the outlines."""
    p = parcels(spark, d).select("handle", "minx", "miny", "maxx", "maxy", "ring")
    return S.rings_near(p, CELL, 3.0).select("a_handle", "b_handle", F.round("distance", 6).alias("distance"))


def corridor_ranking(spark, d):
    """Layers by the share of the labels in their parcels, times the share of other layers' parcels not in them; 0 sampled has no score."""
    i = _inside(spark, d).select(F.col("r_layer").alias("layer"), "p_handle").distinct().groupBy("layer").agg(F.count(F.lit(1)).alias("network_inside"))
    p = parcels(spark, d)
    centres = p.select("handle", "layer", F.col("cx").alias("x"), F.col("cy").alias("y"))
    held = S.points_in_rings(centres, p.select("layer", "minx", "miny", "maxx", "maxy", "ring"), CELL).where("p_layer <> r_layer")
    held = held.select(F.col("r_layer").alias("layer"), "p_handle").distinct().groupBy("layer").agg(F.count(F.lit(1)).alias("parcels_inside"))
    sampled = labels(spark, d).agg(F.count(F.lit(1)).alias("labels")).crossJoin(p.agg(F.count(F.lit(1)).alias("parcels")))  # one row
    own = p.groupBy("layer").agg(F.count(F.lit(1)).alias("own"))
    s = own.join(i, "layer", "left").join(held, "layer", "left").crossJoin(F.broadcast(sampled)).na.fill(0, ["network_inside", "parcels_inside"])
    score = F.col("network_inside") / F.nullif(F.col("labels"), F.lit(0)) * (1 - F.col("parcels_inside") / F.nullif(F.col("parcels") - F.col("own"), F.lit(0)))
    out = s.select("layer", "network_inside", "parcels_inside", F.round(score, 9).alias("score"))
    return out.orderBy(F.desc_nulls_last("score"), "layer").limit(10)


def schedule_check(spark, d):
    """Stated area (price rounded) against measured area by key, both sides kept."""
    stated = table(spark, d, "part").where("p_brand <> 'Brand#11'").select(F.col("p_partkey").alias("key"), F.round("p_retailprice").alias("stated"))
    measured = parcels(spark, d).where("size_code <> 7").select(F.col("handle").alias("key"), F.round("area", 4).alias("measured"))
    both = stated.join(measured, "key", "full_outer")
    status = (
        F.when(F.col("stated").isNull(), "not stated").when(F.col("measured").isNull(), "not measured").when(F.abs(F.col("stated") - F.col("measured")) <= 0.02 * F.col("stated"), "agrees").otherwise("differs")
    )
    return both.select("key", "stated", "measured", status.alias("status"))


def label_layer_inference(spark, d):
    """The label layer whose texts match the most different schedule keys."""
    keys = parcels(spark, d).select(F.col("handle").cast("string").alias("text"))
    l = labels(spark, d).join(keys, "text", "left_semi").groupBy("layer").agg(F.countDistinct("text").alias("n_keys"))
    return l.orderBy(F.desc("n_keys"), "layer").limit(5)


def tag_overlay(spark, d):
    """A user's tag over the configured use over none."""
    tags = table(spark, d, "supplier").select(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 60).cast("string")).alias("layer"), F.col("s_name").alias("name"))
    tags = tags.groupBy("layer").agg(F.min("name").alias("tag"))
    layers = parcels(spark, d).groupBy("layer").agg(F.min("kind").alias("configured"))
    chosen = F.coalesce("tag", F.when(F.col("configured").contains("STEEL"), F.lit("industrial")), F.lit("none"))
    return layers.join(tags, "layer", "left").select("layer", chosen.alias("effective"), F.col("tag").isNotNull().alias("by_user"))


def selection_comments(spark, d):
    """Selected handles with their comments; handles that do not exist are told apart."""
    e = table(spark, d, "events").select(F.col("user_id").alias("handle"), "event_type")
    sel = e.where("event_type = 'signup'").select("handle").distinct()
    comments = e.where("event_type IN ('purchase', 'click')").groupBy("handle").agg(F.count(F.lit(1)).alias("comments"))
    p = parcels(spark, d).select("handle", "layer")
    return sel.join(p, "handle", "left").join(comments, "handle", "left").select("handle", "layer", F.coalesce("comments", F.lit(0)).alias("comments"), F.col("layer").isNull().alias("missing"))


def predecessor_match(spark, d):
    """Drawings with exactly one earlier drawing of the same name."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("-", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100)).alias("name"))
    w = Window.partitionBy("name").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    m = c.select("id", F.count(F.lit(1)).over(w).alias("candidates"), F.first("id").over(w).alias("first")).where("candidates > 0")
    return m.select("id", "candidates", F.when(F.col("candidates") == 1, F.col("first")).otherwise(-1).alias("predecessor"))


def revision_diff(spark, d):
    before = paths(spark, d).where("type <> 'CIRCLE'").groupBy("layer", "block").agg(F.round(F.sum("length"), 4).alias("v"))
    after = paths(spark, d).where("type <> 'ARC'").withColumn("length", F.when(F.col("type") == "CIRCLE", F.col("length") + 1).otherwise(F.col("length")))
    after = after.groupBy("layer", "block").agg(F.round(F.sum("length"), 4).alias("v"))
    return GR.revision(before, after, ["layer", "block"], "v", 1e-6)


#: The tolerance of the network queries; the ends of one node are 0.004 apart at most.
SNAP = 0.01


def _network(spark, d):
    return paths(spark, d).where("type IN ('LINE', 'ARC')")


def snap_tolerance(spark, d):
    t = N.snap_tolerance(_network(spark, d))
    return t.select(F.round("tolerance", 9).alias("tolerance"), "decided_by")


def endpoint_clusters(spark, d):
    """Nodes of the network: how many path ends meet in each, which end is the first."""
    return N.node_degrees(N.clustered_ends(_network(spark, d), SNAP)).select("node", "degree")


def chains_components(spark, d):
    """Connected chains of paths over their end nodes, by how many paths they hold."""
    c = N.path_chains(_network(spark, d), SNAP)
    return c.groupBy("chain").agg(F.count(F.lit(1)).alias("paths")).groupBy("paths").agg(F.count(F.lit(1)).alias("chains"))


def junction_census(spark, d):
    """Nodes by degree."""
    n = N.node_degrees(N.clustered_ends(_network(spark, d), SNAP))
    return n.groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def interior_attachments(spark, d):
    """Ends of polylines that lie on the inside of a line."""
    p = paths(spark, d)
    nodes = N.node_degrees(N.clustered_ends(p.where("type = 'LWPOLYLINE'"), SNAP))
    return N.attachments(nodes, p.where("type = 'LINE'"), SNAP, 10.0).select("node", "handle")


def single_linkage(spark, d):
    """Clusters of parcel centres linked within 30."""
    c = _centres(spark, d)
    e = S.within_radius(c, c, 30.0).where("c_handle < o_handle").select(F.col("c_handle").alias("a"), F.col("o_handle").alias("b"))
    k = GR.connected_components(c.select(F.col("handle").alias("node")), e)
    return k.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where("members > 1")


def _drawn_twice(spark, d):
    """The parcels, and those of the largest size class once more, off by 0.001, under handles of their own."""
    p = parcels(spark, d).select("handle", "layer", "size_code", "ring")
    again = p.where("size_code = 50").withColumn("handle", -F.col("handle"))
    moved = F.transform("ring", lambda q: F.struct((q["x"] + 1e-3).alias("x"), (q["y"] - 1e-3).alias("y")))
    return p.unionByName(again.withColumn("ring", moved))


def duplicate_geometry(spark, d):
    """Rings that were drawn twice: one shape, centroids within 0.01, areas alike."""
    return D.coincident(_drawn_twice(spark, d), 0.01)


def duplicate_shapes(spark, d):
    """Parcels of one shape, by their sides: candidates for copies of a plot type."""
    p = parcels(spark, d).groupBy("w", "h", "layer").agg(F.count(F.lit(1)).alias("n"), F.min("handle").alias("first_handle"), F.max("handle").alias("last_handle"))
    return p.where("n > 1")


def modal_edges(spark, d):
    """The most frequent edge lengths of each shape, as sides in rising order."""
    m = D.modal_edges(parcels(spark, d))
    sides = F.transform(F.array_sort("edges"), lambda e: F.round(e, 4))
    return m.select(F.element_at(sides, 1).alias("short"), F.element_at(sides, -1).alias("long"), "n")


def same_size_bodies(spark, d):
    """Layers' parcels of one size code as bodies: groups of equal number, width and height."""
    p = parcels(spark, d).groupBy("layer", "size_code").agg(F.count(F.lit(1)).alias("entities"), F.max("w").alias("width"), F.max("h").alias("height"), F.min("handle").alias("body"))
    return D.size_groups(p.select("body", "entities", "width", "height"))


def reachable_blocks(spark, d):
    """Blocks reachable from the roots over an insert graph drawn from the keys."""
    p = table(spark, d, "part").select("p_partkey")
    edges = p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") * 2).alias("b")).union(p.select("p_partkey", F.col("p_partkey") * 3 + 1))
    edges = edges.join(GR.shuffled(p), F.col("b") == F.col("p_partkey"), "left_semi")
    roots = spark.range(1, 3).select(F.col("id").alias("node"))
    return GR.reachable(spark, edges, roots).select("node", F.col("depth").cast("long").alias("depth"))


def definition_shadow(spark, d):
    """The same filter inside block definitions: placed (reachable) against unplaced."""
    reach = reachable_blocks(spark, d).select(F.col("node").alias("handle"))
    placed = parcels(spark, d).where("size_code > 25").join(GR.shuffled(reach.withColumn("placed", F.lit(1))), "handle", "left")
    return placed.agg(F.count("placed").alias("placed"), F.count_if(F.col("placed").isNull()).alias("unplaced"))


def _cells(spark, d, size):
    p = parcels(spark, d)
    return p.withColumns({"cell_x": F.floor(F.col("cx") / size).cast("long"), "cell_y": F.floor(F.col("cy") / size).cast("long")})


def cells_per_use(spark, d):
    use = F.element_at(F.split("kind", " "), -1)
    return _cells(spark, d, 160.0).groupBy("cell_x", "cell_y", use.alias("use_name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 4).alias("area"))


def cell_hierarchy(spark, d):
    """Distinct parent cells at each coarser level."""
    c = _cells(spark, d, 40.0).select("cell_x", "cell_y")
    level = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("level")
    up = c.select("cell_x", "cell_y", level).select("level", F.floor(F.col("cell_x") / F.pow(F.lit(2.0), "level")).cast("long").alias("x"), F.floor(F.col("cell_y") / F.pow(F.lit(2.0), "level")).cast("long").alias("y"))
    return up.distinct().groupBy("level").agg(F.count(F.lit(1)).alias("cells"))


def vicinity_rings(spark, d):
    """Parcels around subjects by ring of cells (0 to 3), each other parcel once, in its nearest ring."""
    c = _cells(spark, d, 80.0).select("handle", "layer", "cell_x", "cell_y")
    s = c.where("layer = 'Brand#11'").select(F.col("handle").alias("subject"), "cell_x", "cell_y")
    step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-3, 4) for j in range(-3, 4)])
    disk = s.select("subject", F.explode(step).alias("d"), "cell_x", "cell_y").select(
        "subject", (F.col("cell_x") + F.col("d.i")).alias("cell_x"), (F.col("cell_y") + F.col("d.j")).alias("cell_y"), F.greatest(F.abs("d.i"), F.abs("d.j")).alias("ring")
    )
    near = disk.join(c, ["cell_x", "cell_y"]).where("handle <> subject")
    nearest = near.groupBy("handle").agg(F.min("ring").alias("ring"))
    return nearest.groupBy(F.col("ring").cast("long").alias("ring")).agg(F.count(F.lit(1)).alias("parcels"))


def catchment_coverage(spark, d):
    """Parcels served by an amenity's disk of cells, at two radii, and those not served."""
    c = _cells(spark, d, 80.0).select("handle", "size_code", "cell_x", "cell_y")
    out = None
    for k in (2, 5):
        step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-k, k + 1) for j in range(-k, k + 1)])
        a = c.where("size_code = 50").select(F.explode(step).alias("d"), "cell_x", "cell_y")
        disk = a.select((F.col("cell_x") + F.col("d.i")).alias("cell_x"), (F.col("cell_y") + F.col("d.j")).alias("cell_y")).distinct()
        served = c.join(disk.withColumn("s", F.lit(1)), ["cell_x", "cell_y"], "left")
        part = served.agg(F.lit(k).cast("long").alias("radius"), F.count("s").alias("served"), F.count_if(F.col("s").isNull()).alias("unserved"))
        out = part if out is None else out.unionByName(part)
    return out


def content_bounds(spark, d):
    """Box of the fullest cells that together hold 98 % of the parcels."""
    c = _cells(spark, d, 160.0).groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.col("cell_y") * 100000 + F.col("cell_x"))
    most = W.cumulative_share(c, "n", "key", 0.98)
    return most.agg(F.min("cell_x").alias("x0"), F.min("cell_y").alias("y0"), F.max("cell_x").alias("x1"), F.max("cell_y").alias("y1"), F.count(F.lit(1)).alias("cells"))


def detached_bodies(spark, d):
    """Bodies of a layer apart on the x axis, then on the y axis."""
    i = W.islands(parcels(spark, d), ["layer"], "minx", "maxx", ["handle"], 30.0).withColumnRenamed("island", "body_x")
    i = W.islands(i, ["layer", "body_x"], "miny", "maxy", ["handle"], 30.0)
    return i.groupBy("layer", F.col("body_x").cast("long").alias("body_x"), F.col("island").cast("long").alias("body_y")).agg(F.count(F.lit(1)).alias("members"))


_HIT = """edge AS (SELECT handle, layer, area, w, minx, miny, maxx, maxy, x1 AS ax, y1 AS ay, x2 AS qx, y2 AS qy FROM parcels UNION ALL
 SELECT handle, layer, area, w, minx, miny, maxx, maxy, x2, y2, x3, y3 FROM parcels UNION ALL SELECT handle, layer, area, w, minx, miny, maxx, maxy, x3, y3, x4, y4 FROM parcels UNION ALL
 SELECT handle, layer, area, w, minx, miny, maxx, maxy, x4, y4, x1, y1 FROM parcels),
hit AS (SELECT l.handle AS p_handle, l.text AS p_text, e.handle AS r_handle, max(e.layer) AS r_layer, max(area) AS r_area, max(w) AS r_w
 FROM pts l JOIN edge e ON l.x BETWEEN minx AND maxx AND l.y BETWEEN miny AND maxy
 GROUP BY 1, 2, 3 HAVING sum(CASE WHEN (ay > l.y) <> (qy > l.y) AND l.x < (qx - ax) * (l.y - ay) / nullif(qy - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1)"""
H = f"{E}, pts AS (SELECT handle, text, x, y FROM labels), {_HIT}"
_C = "c AS (SELECT handle, layer, area, cx AS x, cy AS y FROM parcels)"
_DIST = "sqrt((o.x - c.x) * (o.x - c.x) + (o.y - c.y) * (o.y - c.y))"
_PROX = f"n AS (SELECT c.handle AS c_handle, o.handle AS o_handle, o.area AS o_area, {_DIST} AS distance FROM c JOIN c o ON c.layer = 'Brand#11' AND o.layer <> 'Brand#11' AND {_DIST} <= 100)"
_BOX = "a.handle < b.handle AND a.minx - {p} <= b.maxx + {p} AND b.minx - {p} <= a.maxx + {p} AND a.miny - {p} <= b.maxy + {p} AND b.miny - {p} <= a.maxy + {p}"
_ENDS = """x AS (SELECT handle * 2 AS id, ax AS x, ay AS y FROM paths WHERE type IN ('LINE', 'ARC') UNION ALL SELECT handle * 2 + 1, bx, b_y FROM paths WHERE type IN ('LINE', 'ARC')),
e AS (SELECT id, round(x / 25e-1) AS gx, round(y / 25e-1) AS gy FROM x)"""
_GAP = "pow(greatest(0, greatest(a.u, b.u) - least(a.u + a.w, b.u + b.w)), 2) + pow(greatest(0, greatest(a.v, b.v) - least(a.v + a.h, b.v + b.h)), 2)"
_CELL = "k AS (SELECT *, CAST(floor(cx / {s}e0) AS BIGINT) AS cell_x, CAST(floor(cy / {s}e0) AS BIGINT) AS cell_y FROM parcels)"
_REACH = """e AS (SELECT p_partkey AS a, p_partkey * 2 AS b FROM part UNION ALL SELECT p_partkey, p_partkey * 3 + 1 FROM part),
r AS (SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT 2, 0 UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE e.b IN (SELECT p_partkey FROM part))"""
_ER = E.replace("WITH ", "WITH RECURSIVE ", 1)

SQL = {
    "label_in_polygon": f"{H} SELECT p_handle, p_text, r_handle, r_layer AS layer FROM hit",
    "label_coverage": f"{H}, n AS (SELECT r_handle, count(*) AS n FROM hit GROUP BY 1) SELECT layer, count(*) AS parcels, count(n) AS labelled, count(CASE WHEN n > 1 THEN 1 END) AS shared, CAST(coalesce(sum(n), 0) AS BIGINT) AS labels FROM parcels LEFT JOIN n ON handle = r_handle GROUP BY layer",
    "containers_of_entity": f"{H} SELECT p_handle, r_handle, row_number() OVER (PARTITION BY p_handle ORDER BY r_area, r_handle) AS place FROM hit",
    "smallest_container": f"{H} SELECT p_handle, r_handle, round(r_area, 4) AS area FROM (SELECT *, row_number() OVER (PARTITION BY p_handle ORDER BY r_area, r_handle) AS rn FROM hit) WHERE rn = 1",
    "containment": f"{E}, pts AS (SELECT handle, '' AS text, cx AS x, cy AS y FROM parcels), {_HIT} SELECT p_handle, r_handle FROM hit WHERE p_handle <> r_handle",
    "coverage_gap": f"{H} SELECT layer, count(CASE WHEN handle IN (SELECT p_handle FROM hit) THEN 1 END) AS placed, count(CASE WHEN handle NOT IN (SELECT p_handle FROM hit) THEN 1 END) AS unplaced FROM labels GROUP BY layer",
    "duplicate_labels_in_polygon": f"{H} SELECT r_handle, lower(trim(p_text)) AS text, count(*) AS n FROM (SELECT p_text, p_handle, min(r_handle) AS r_handle FROM hit GROUP BY 1, 2) GROUP BY 1, 2 HAVING count(*) > 1",
    "proximity_count": f"{E}, {_C}, {_PROX} SELECT c_handle, count(*) AS n, round(sum(o_area), 4) AS area, round(min(distance), 6) AS nearest, round(max(distance), 6) AS farthest FROM n GROUP BY c_handle",
    "proximity_union": f"{E}, {_C}, {_PROX} SELECT count(DISTINCT o_handle) AS within_radius_of_any, count(*) AS pairs FROM n",
    "nearest_neighbour": f"""{E}, {_C}, n AS (SELECT c.handle AS c_handle, o.handle AS h, round({_DIST}, 6) AS d FROM c JOIN c o ON c.layer = 'Brand#22' AND o.layer = 'Brand#22' AND c.handle <> o.handle)
        SELECT c_handle, h AS nearest, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY c_handle ORDER BY d, h) AS rn FROM n) WHERE rn = 1""",
    "distance_matrix": f"{E}, {_C}, m AS (SELECT * FROM c ORDER BY area DESC, handle LIMIT 40) SELECT c.handle AS a, o.handle AS b, round({_DIST}, 6) AS distance FROM m c JOIN m o ON c.handle < o.handle",
    "adjacency": f"{E} SELECT a.handle AS a_handle, b.handle AS b_handle FROM parcels a JOIN parcels b ON {_BOX.format(p=1)}",
    "box_overlap_area": f"{E} SELECT a.handle AS a_handle, b.handle AS b_handle, round((least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)), 4) AS overlap FROM parcels a JOIN parcels b ON {_BOX.format(p=0)}",
    # all parcels are turned by one angle, so in the turned frame their rings are boxes
    "overlap_scan": f"""{E}, t AS (SELECT handle, area, w, h, 8e-1 * x1 + 6e-1 * y1 AS u, 8e-1 * y1 - 6e-1 * x1 AS v FROM parcels),
        o AS (SELECT a.handle AS a_handle, b.handle AS b_handle, least(a.area, b.area) AS least_area,
        greatest(0, least(a.u + a.w, b.u + b.w) - greatest(a.u, b.u)) * greatest(0, least(a.v + a.h, b.v + b.h) - greatest(a.v, b.v)) AS overlap FROM t a JOIN t b ON a.handle < b.handle)
        SELECT a_handle, b_handle, round(overlap, 4) AS overlap, round(overlap / least_area, 6) AS share FROM o WHERE overlap > 1e-6""",
    # all parcels are turned by one angle, so in the turned frame their outlines are boxes and the distance of two is that of the boxes
    "frontage_check": f"""{E}, t AS (SELECT *, 8e-1 * x1 + 6e-1 * y1 AS u, 8e-1 * y1 - 6e-1 * x1 AS v FROM parcels),
        m AS (SELECT sqrt(area) * 0.25 AS reach FROM (SELECT area, row_number() OVER (ORDER BY area, handle) AS rn, count(*) OVER () AS n FROM parcels) WHERE rn = floor(n / 2) + 1),
        f AS (SELECT a.handle, min(CASE WHEN b.size_code = 1 AND round(sqrt({_GAP}), 6) <= reach THEN round(sqrt({_GAP}), 6) END) AS distance, bool_or(b.size_code = 2) AS box_only
          FROM m, t a JOIN t b ON a.size_code > 2 AND b.size_code <= 2 AND a.minx - reach <= b.maxx + reach AND b.minx - reach <= a.maxx + reach AND a.miny - reach <= b.maxy + reach AND b.miny - reach <= a.maxy + reach GROUP BY 1)
        SELECT p.handle, distance, CASE WHEN distance IS NOT NULL THEN 'established' WHEN box_only THEN 'unproven' ELSE 'none' END AS frontage FROM parcels p LEFT JOIN f ON p.handle = f.handle WHERE size_code > 2""",
    "adjacency_by_edges": f"""{E}, t AS (SELECT *, 8e-1 * x1 + 6e-1 * y1 AS u, 8e-1 * y1 - 6e-1 * x1 AS v FROM parcels)
        SELECT a.handle AS a_handle, b.handle AS b_handle, round(sqrt({_GAP}), 6) AS distance FROM t a JOIN t b ON a.handle < b.handle AND sqrt({_GAP}) <= 3""",
    "corridor_ranking": f"""{H}, i AS (SELECT r_layer, count(DISTINCT p_handle) AS n FROM hit GROUP BY 1),
        held AS (SELECT l.handle, e.handle AS r_handle, max(l.layer) AS own, max(e.layer) AS r_layer FROM (SELECT handle, layer, cx AS x, cy AS y FROM parcels) l JOIN edge e ON l.x BETWEEN minx AND maxx AND l.y BETWEEN miny AND maxy
          GROUP BY 1, 2 HAVING sum(CASE WHEN (ay > l.y) <> (qy > l.y) AND l.x < (qx - ax) * (l.y - ay) / nullif(qy - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1),
        h AS (SELECT r_layer, count(DISTINCT handle) AS n FROM held WHERE own <> r_layer GROUP BY 1),
        o AS (SELECT layer, count(*) AS own FROM parcels GROUP BY 1)
        SELECT layer, coalesce(i.n, 0) AS network_inside, coalesce(h.n, 0) AS parcels_inside,
        round(coalesce(i.n, 0) / (SELECT count(*) FROM labels) * (1 - coalesce(h.n, 0) / ((SELECT count(*) FROM parcels) - own)), 9) AS score
        FROM o LEFT JOIN i ON i.r_layer = layer LEFT JOIN h ON h.r_layer = layer ORDER BY score DESC NULLS LAST, layer LIMIT 10""",
    "schedule_check": f"""{E}, s AS (SELECT p_partkey AS key, round(p_retailprice) AS stated FROM part WHERE p_brand <> 'Brand#11'), m AS (SELECT handle AS key, round(area, 4) AS measured FROM parcels WHERE size_code <> 7)
        SELECT coalesce(s.key, m.key) AS key, stated, measured, CASE WHEN stated IS NULL THEN 'not stated' WHEN measured IS NULL THEN 'not measured' WHEN abs(stated - measured) <= 0.02e0 * stated THEN 'agrees' ELSE 'differs' END AS status FROM s FULL OUTER JOIN m ON s.key = m.key""",
    "label_layer_inference": f"{E} SELECT layer, count(DISTINCT text) AS n_keys FROM labels WHERE text IN (SELECT CAST(handle AS VARCHAR) FROM parcels) GROUP BY layer ORDER BY n_keys DESC, layer LIMIT 5",
    "tag_overlay": f"""{E}, t AS (SELECT 'Brand#' || CAST(s_suppkey % 60 AS VARCHAR) AS layer, min(s_name) AS tag FROM supplier GROUP BY 1), l AS (SELECT layer, min(kind) AS configured FROM parcels GROUP BY layer)
        SELECT l.layer, coalesce(tag, CASE WHEN contains(configured, 'STEEL') THEN 'industrial' END, 'none') AS effective, tag IS NOT NULL AS by_user FROM l LEFT JOIN t ON l.layer = t.layer""",
    "selection_comments": f"""{E}, s AS (SELECT DISTINCT user_id AS handle FROM events WHERE event_type = 'signup'), c AS (SELECT user_id AS handle, count(*) AS comments FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1)
        SELECT s.handle, layer, coalesce(comments, 0) AS comments, layer IS NULL AS missing FROM s LEFT JOIN parcels p ON p.handle = s.handle LEFT JOIN c ON c.handle = s.handle""",
    "predecessor_match": "SELECT a.c_custkey AS id, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(b.c_custkey) ELSE -1 END AS predecessor FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND floor(a.c_acctbal / 100) = floor(b.c_acctbal / 100) AND b.c_custkey < a.c_custkey GROUP BY 1",
    "revision_diff": f"""{E}, b AS (SELECT layer, block, round(sum(length), 4) AS v FROM paths WHERE type <> 'CIRCLE' GROUP BY 1, 2), a AS (SELECT layer, block, round(sum(CASE WHEN type = 'CIRCLE' THEN length + 1 ELSE length END), 4) AS v FROM paths WHERE type <> 'ARC' GROUP BY 1, 2)
        SELECT coalesce(a.layer, b.layer) AS layer, coalesce(a.block, b.block) AS block, b.v AS before, a.v AS after,
        CASE WHEN b.block IS NULL THEN 'added' WHEN a.block IS NULL THEN 'removed' WHEN abs(a.v - b.v) <= 1e-6 OR (a.v IS NULL AND b.v IS NULL) THEN 'same' ELSE 'changed' END AS status, round(a.v - b.v, 4) AS delta FROM b FULL OUTER JOIN a ON a.layer = b.layer AND a.block = b.block""",
    # the ends of one node round to one place of the lattice
    "snap_tolerance": f"{E} SELECT round(greatest(1e-4 * quantile_cont(CASE WHEN length > 0 THEN length END, 0.5), 1e-12 * max(greatest(abs(ax), abs(ay), abs(bx), abs(b_y)))), 9) AS tolerance, 'median' AS decided_by FROM paths WHERE type IN ('LINE', 'ARC')",
    "endpoint_clusters": f"{E}, {_ENDS} SELECT min(id) AS node, count(*) AS degree FROM e GROUP BY gx, gy",
    "chains_components": f"""{E}, g AS (SELECT handle, CASE WHEN lag(handle) OVER (ORDER BY handle) = handle - 1 THEN 0 ELSE 1 END AS begins FROM (SELECT DISTINCT handle FROM paths WHERE type IN ('LINE', 'ARC'))),
        c AS (SELECT handle, sum(begins) OVER (ORDER BY handle) AS chain FROM g) SELECT paths, count(*) AS chains FROM (SELECT chain, count(*) AS paths FROM c GROUP BY chain) GROUP BY paths""",
    "junction_census": f"{E}, {_ENDS} SELECT degree, count(*) AS nodes FROM (SELECT count(*) AS degree FROM e GROUP BY gx, gy) GROUP BY degree",
    "interior_attachments": f"{E} SELECT a.handle * 2 + 1 AS node, b.handle FROM (SELECT DISTINCT handle FROM paths) a JOIN paths b ON a.handle % 8 = 6 AND b.handle = a.handle - 2",
    "duplicate_geometry": f"{E} SELECT handle, -handle AS first FROM parcels WHERE size_code = 50 UNION ALL SELECT -handle, -handle FROM parcels WHERE size_code = 50",
    "modal_edges": f"{E} SELECT least(w, h) AS short, greatest(w, h) AS long, count(*) AS n FROM parcels GROUP BY 1, 2",
    "same_size_bodies": f"""{E}, b AS (SELECT layer, size_code, count(*) AS entities, max(w) AS width, max(h) AS height, min(handle) AS body FROM parcels GROUP BY 1, 2),
        g AS (SELECT body, min(body) OVER (PARTITION BY entities, width, height) AS "group", count(*) OVER (PARTITION BY entities, width, height) AS n FROM b WHERE entities > 1) SELECT body, "group" FROM g WHERE n > 1""",
    "duplicate_shapes": f"{E} SELECT w, h, layer, count(*) AS n, min(handle) AS first_handle, max(handle) AS last_handle FROM parcels GROUP BY w, h, layer HAVING count(*) > 1",
    "reachable_blocks": f"WITH RECURSIVE {_REACH} SELECT node, min(depth) AS depth FROM r GROUP BY node",
    "definition_shadow": f"{_ER}, {_REACH} SELECT count(CASE WHEN handle IN (SELECT node FROM r) THEN 1 END) AS placed, count(CASE WHEN handle NOT IN (SELECT node FROM r) THEN 1 END) AS unplaced FROM parcels WHERE size_code > 25",
    "cells_per_use": f"{E}, {_CELL.format(s=160)} SELECT cell_x, cell_y, list_last(string_split(kind, ' ')) AS use_name, count(*) AS n, round(sum(area), 4) AS area FROM k GROUP BY 1, 2, 3",
    "cell_hierarchy": f"{E}, {_CELL.format(s=40)}, u AS (SELECT DISTINCT level, floor(cell_x / 2e0 ** level) AS x, floor(cell_y / 2e0 ** level) AS y FROM k, range(0, 6) t(level)) SELECT level, count(*) AS cells FROM u GROUP BY level",
    "vicinity_rings": f"{E}, {_CELL.format(s=80)}, n AS (SELECT k.handle, min(greatest(abs(k.cell_x - s.cell_x), abs(k.cell_y - s.cell_y))) AS ring FROM k JOIN k s ON s.layer = 'Brand#11' AND k.handle <> s.handle AND abs(k.cell_x - s.cell_x) <= 3 AND abs(k.cell_y - s.cell_y) <= 3 GROUP BY 1) SELECT ring, count(*) AS parcels FROM n GROUP BY ring",
    "catchment_coverage": f"{E}, {_CELL.format(s=80)}, r(radius) AS (VALUES (CAST(2 AS BIGINT)), (CAST(5 AS BIGINT))), s AS (SELECT radius, k.handle, bool_or(abs(k.cell_x - a.cell_x) <= radius AND abs(k.cell_y - a.cell_y) <= radius) AS yes FROM k, r, (SELECT DISTINCT cell_x, cell_y FROM k WHERE size_code = 50) a GROUP BY 1, 2) SELECT radius, count(CASE WHEN yes THEN 1 END) AS served, count(CASE WHEN NOT yes THEN 1 END) AS unserved FROM s GROUP BY radius",
    "content_bounds": f"""{E}, {_CELL.format(s=160)}, c AS (SELECT cell_x, cell_y, count(*) AS n FROM k GROUP BY 1, 2), o AS (SELECT *, sum(n) OVER (ORDER BY n DESC, cell_y * 100000 + cell_x ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS total FROM c)
        SELECT min(cell_x) AS x0, min(cell_y) AS y0, max(cell_x) AS x1, max(cell_y) AS y1, count(*) AS cells FROM o WHERE before < 0.98e0 * total""",
    "detached_bodies": f"""{E}, p AS (SELECT * FROM parcels),
        g AS (SELECT *, max(maxx) OVER (PARTITION BY layer ORDER BY minx, maxx, handle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p),
        i AS (SELECT *, CAST(sum(CASE WHEN seen IS NULL OR minx - seen > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY layer ORDER BY minx, maxx, handle ROWS UNBOUNDED PRECEDING) AS BIGINT) AS body_x FROM g),
        j AS (SELECT *, max(maxy) OVER (PARTITION BY layer, body_x ORDER BY miny, maxy, handle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_y FROM i),
        l AS (SELECT *, CAST(sum(CASE WHEN seen_y IS NULL OR miny - seen_y > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY layer, body_x ORDER BY miny, maxy, handle ROWS UNBOUNDED PRECEDING) AS BIGINT) AS body_y FROM j)
        SELECT layer, body_x, body_y, count(*) AS members FROM l GROUP BY 1, 2, 3""",
}
# these have no SQL: a recursive query over whole tables does not end in time
QUERIES = {name: globals()[name] for name in SQL} | {"single_linkage": single_linkage}
