"""Drawing profiles: facts, summaries, censuses, cross checks, legends and run states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planline.adapter import SQL_ENTITIES as E
from planline.adapter import labels, parcels, paths, table
from planline.functions import geometry as G
from planline.operators import aggregates as A
from planline.operators import spatial as S
from planline.operators import text as T
from planline.operators import windows as W
from planline.plans.queries_measures import RULES
from planline.plans.queries_sources import _CONFIG, _PATTERN, _config, _objects


def file_facts(spark, d):
    """One row on the whole drawing: objects, layers, layouts, blocks, texts and what has no measure."""
    p = paths(spark, d).agg(
        F.count(F.lit(1)).alias("paths"), F.countDistinct("layer").alias("layers"), F.countDistinct("layout").alias("layouts"), F.countDistinct("block").alias("blocks"),
        F.count_if(F.col("length").isNull()).alias("unmeasured"),
    )
    others = parcels(spark, d).agg(F.count(F.lit(1)).alias("rings")).crossJoin(labels(spark, d).agg(F.count(F.lit(1)).alias("texts")))  # one row each
    return p.crossJoin(others)


def layout_block(spark, d):
    """Objects of each layout by type, a column for each."""
    types = ["LINE", "ARC", "LWPOLYLINE", "CIRCLE"]
    return paths(spark, d).groupBy("layout").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("type") == t).alias(t.lower()) for t in types])


def layouts_of_layer(spark, d):
    return paths(spark, d).groupBy("layer", "layout").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block").alias("blocks"))


def dossier_summary(spark, d):
    """Each layer's leading family, commonest type, measure with its denominator and share of all objects."""
    p = paths(spark, d)
    role = A.role(p, ["layer"]).select("layer", "entities", "role")
    top = W.top_n(p.groupBy("layer", "type").agg(F.count(F.lit(1)).alias("n")), ["layer"], [F.desc("n"), "type"], 1).select("layer", F.col("type").alias("commonest"))
    measured = A.measure(p, ["layer"], "length").select("layer", "measured", "sum_measured_only", "total_for_all_matched")
    every = p.agg(F.count(F.lit(1)).alias("every"))
    out = role.join(top, "layer").join(measured, "layer").crossJoin(F.broadcast(every))  # one row
    return out.withColumn("share", F.round(F.col("entities") / F.col("every"), 6)).drop("every")


def blind_spots(spark, d):
    """Blocks none of whose objects has a measure, by layer."""
    b = paths(spark, d).groupBy("layer", "block").agg(F.count("length").alias("measured"), F.count(F.lit(1)).alias("n"))
    return b.where("measured = 0").groupBy("layer").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("objects"))


def duplicate_warning(spark, d):
    """Whether so many parcels of a layer share a shape that counts by shape may count copies."""
    p = parcels(spark, d).groupBy("layer", "w", "h").agg(F.count(F.lit(1)).alias("n"))
    g = p.groupBy("layer").agg(F.sum("n").alias("parcels"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("shared"))
    return g.withColumn("warn", F.col("shared") > 0.5 * F.col("parcels"))


def classification_cross_check(spark, d):
    """Objects by the use that the configuration gives their layer and the one that their own name speaks for."""
    o = _objects(spark, d).join(_config(spark, d).select("layer", F.col("land_use").alias("configured")), "layer", "left")
    return o.groupBy("configured", F.col("land_use").alias("by_name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 4).alias("area"))


def shape_against_layer(spark, d):
    """Parcels that pass a test of shape against those on the coded layers: both, one or the other."""
    shape, coded = F.col("area").between(300, 700), F.col("layer").isin("Brand#11", "Brand#12", "Brand#13")
    side = F.when(shape & coded, "both").when(shape, "shape only").when(coded, "layer only")
    return parcels(spark, d).select(side.alias("found_by"), "area").where("found_by is not null").groupBy("found_by").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 4).alias("area"))


def labels_in_largest(spark, d):
    """The labels inside the largest parcel."""
    ring = parcels(spark, d).orderBy(F.desc("area"), "handle").limit(1).select("handle", "minx", "miny", "maxx", "maxy", "ring")
    inside = S.points_in_rings(labels(spark, d).select("handle", "text", "x", "y"), ring)
    return inside.select("p_handle", "p_text", "r_handle")


def text_census_samples(spark, d):
    """Texts by class with the three first by text of each."""
    t = labels(spark, d).select("text", T.text_class(F.concat("text", F.when(F.col("handle") % 3 == 0, ".5 m").otherwise(""))).alias("class"))
    n = t.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    few = W.top_n(t.distinct(), ["class"], ["text"], 3).groupBy("class").agg(F.array_join(F.array_sort(F.collect_list("text")), ",").alias("samples"))
    return n.join(few, "class")


def revision_summary(spark, d):
    """Objects of two revisions by status, and those not compared as one side has no measure."""
    before = paths(spark, d).where("type <> 'CIRCLE'").groupBy("block").agg(F.sum("length").alias("v"), F.count_if(F.col("length").isNull()).alias("holes"))
    after = paths(spark, d).where("type <> 'ARC'").groupBy("block").agg(F.sum("length").alias("v"), F.count_if(F.col("length").isNull()).alias("holes"))
    a, b = before.select("block", F.col("v").alias("v0"), F.col("holes").alias("h0")), after.select("block", F.col("v").alias("v1"), F.col("holes").alias("h1"))
    status = (
        F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when((F.col("h0") > 0) | (F.col("h1") > 0), "not compared")
        .when(F.abs(F.col("v0") - F.col("v1")) <= 1e-6, "same").otherwise("changed")
    )
    return a.join(b, "block", "full_outer").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("blocks"))


def legend_rows(spark, d):
    """The four largest uses by area and the others as one."""
    p = parcels(spark, d)
    uses = p.join(A.classify(p.select("kind").distinct(), "kind", RULES, {}, "none"), "kind").groupBy("land_use").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))
    place = F.row_number().over(Window.orderBy(F.desc("area"), "land_use"))  # one row for each use
    named = uses.select(F.when(place <= 4, F.col("land_use")).otherwise("others").alias("label"), "n", "area")
    return named.groupBy("label").agg(F.sum("n").alias("n"), F.round(F.sum("area"), 4).alias("area"))


def cell_density(spark, d):
    """Cells by how full they are: parcels' area over the cell's, in tenths, one at most."""
    size = 80.0
    p = parcels(spark, d).select(F.floor(F.col("cx") / size).cast("long").alias("cx"), F.floor(F.col("cy") / size).cast("long").alias("cy"), "area")
    c = p.groupBy("cx", "cy").agg(F.sum("area").alias("area"))
    tenth = F.least(F.lit(10), F.floor(F.round(F.col("area") / (size * size), 9) * 10)).cast("long")
    return c.groupBy(tenth.alias("tenth")).agg(F.count(F.lit(1)).alias("cells"))


def viewport_cells(spark, d):
    """Cells of a viewport that hold parcels, less those of the part already held."""
    size, view, have = 80.0, (200.0, 100.0, 800.0, 600.0), (200.0, 100.0, 500.0, 600.0)
    c = parcels(spark, d).select(F.floor(F.col("cx") / size).cast("long").alias("cell_x"), F.floor(F.col("cy") / size).cast("long").alias("cell_y")).distinct()
    meets = lambda b: ((F.col("cell_x") + 1) * size >= b[0]) & (F.col("cell_x") * size <= b[2]) & ((F.col("cell_y") + 1) * size >= b[1]) & (F.col("cell_y") * size <= b[3])
    return c.where(meets(view) & ~meets(have))


def simple_rings(spark, d):
    """Parcels and the same with two corners exchanged: whether no two sides cross."""
    twisted = F.array(*[F.get("ring", F.lit(k)) for k in (0, 2, 1, 3)])
    return parcels(spark, d).select("handle", G.is_simple(F.col("ring")).alias("simple"), G.is_simple(twisted).alias("twisted"))


def box_gaps(spark, d):
    """Parcels of the largest size code by how far their box is from that of a fixed area."""
    b = (100.0, 100.0, 300.0, 250.0)
    away = G.box_distance([F.col(c) for c in ("minx", "miny", "maxx", "maxy")], [F.lit(v) for v in b])
    return parcels(spark, d).where("size_code = 50").select("handle", F.round(away, 4).alias("distance"))


def lat_lon_bounds(spark, d):
    """The drawing's bounds in degrees, its frame moved to zone 38 north."""
    p = parcels(spark, d).select(F.explode("ring").alias("c")).select((F.col("c.x") + 691942.0).alias("x"), (F.col("c.y") + 2750756.0).alias("y"))
    at = p.select(G.utm_to_lat_lon(F.col("x"), F.col("y"), G.utm_zone(F.lit(32638)), F.lit(False)).alias("at"))
    return at.agg(*[F.round(f(f"at.{c}"), 6).alias(f"{n}_{c}") for n, f in (("least", F.min), ("most", F.max)) for c in ("lat", "lon")])


def clipped_texts(spark, d):
    """Document texts clipped to 40 characters at a word's edge, with whether more follows."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.clip(F.col("text"), 40).alias("clipped"), (F.length("text") > 40).alias("more"))


def response_budget(spark, d):
    """A page by handle that ends before its rows' text exceeds 2,000 characters: of the first 500 rows."""
    rows = parcels(spark, d).select("handle", F.concat_ws("|", "layer", "kind").alias("row")).orderBy("handle").limit(500)
    upto = F.sum(F.length("row")).over(Window.orderBy("handle"))  # 500 rows
    return rows.withColumn("upto", upto).where("upto <= 2000").select("handle", "row", F.col("upto").cast("long").alias("upto"))


def run_stages(spark, d):
    """Runs (users) by their last stage, and whether they ended, failed, stalled or were abandoned: silent for an hour, or for four."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("ts")).crossJoin(F.broadcast(now))  # one row
    silent = lambda h: F.col("now") - F.col("ts") > F.expr(f"INTERVAL {h} HOUR")
    state = F.when(F.col("stage") == "purchase", "done").when(F.col("stage") == "error", "failed").when(silent(4), "abandoned").when(silent(1), "stalled").otherwise("running")
    return last.groupBy("stage", state.alias("state")).agg(F.count(F.lit(1)).alias("runs"))


def tag_history(spark, d):
    """Each user's last value of each kind with the one before it, as a store that keeps the previous value would hold."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    held = e.select("user_id", "event_type", "value", F.lead("value").over(w).alias("previous"), F.row_number().over(w).alias("rn"))
    return held.where("rn = 1").select("user_id", "event_type", F.round("value", 4).alias("value"), F.round("previous", 4).alias("previous"))


_SHARED = """t AS (SELECT handle, w, h, 8e-1 * x1 + 6e-1 * y1 AS u, 8e-1 * y1 - 6e-1 * x1 AS v FROM parcels),
o AS (SELECT greatest(0, least(a.u + a.w, b.u + b.w) - greatest(a.u, b.u)) * greatest(0, least(a.v + a.h, b.v + b.h) - greatest(a.v, b.v)) AS overlap FROM t a JOIN t b ON a.handle < b.handle)"""
_FAM = "CASE WHEN type = 'LWPOLYLINE' THEN 'region' WHEN type IN ('LINE', 'ARC') THEN 'network' ELSE 'points' END"
_VIEW = "(cell_x + 1) * 80 >= {0} AND cell_x * 80 <= {2} AND (cell_y + 1) * 80 >= {1} AND cell_y * 80 <= {3}"

SQL = {
    "file_facts": f"{E} SELECT count(*) AS paths, count(DISTINCT layer) AS layers, count(DISTINCT layout) AS layouts, count(DISTINCT block) AS blocks, count(*) - count(length) AS unmeasured, (SELECT count(*) FROM parcels) AS rings, (SELECT count(*) FROM labels) AS texts FROM paths",
    "layout_block": f"{E} SELECT layout, count(*) AS n, " + ", ".join(f"count(CASE WHEN type = '{t}' THEN 1 END) AS {t.lower()}" for t in ("LINE", "ARC", "LWPOLYLINE", "CIRCLE")) + " FROM paths GROUP BY layout",
    "layouts_of_layer": f"{E} SELECT layer, layout, count(*) AS n, count(DISTINCT block) AS blocks FROM paths GROUP BY 1, 2",
    "dossier_summary": f"""{E}, f AS (SELECT layer, {_FAM} AS family, count(*) AS n FROM paths GROUP BY 1, 2),
        r AS (SELECT layer, CAST(sum(n) AS BIGINT) AS entities, CASE WHEN max(n) >= 0.6 * sum(n) THEN arg_max(family, n) ELSE 'mixed' END AS role FROM f GROUP BY layer),
        t AS (SELECT layer, type FROM (SELECT layer, type, row_number() OVER (PARTITION BY layer ORDER BY count(*) DESC, type) AS rn FROM paths GROUP BY layer, type) WHERE rn = 1),
        m AS (SELECT layer, count(length) AS measured, round(sum(length), 4) AS s, count(*) AS n FROM paths GROUP BY layer)
        SELECT r.layer, entities, role, t.type AS commonest, measured, s AS sum_measured_only, CASE WHEN measured = n THEN s END AS total_for_all_matched, round(entities / (SELECT count(*) FROM paths), 6) AS share FROM r JOIN t ON r.layer = t.layer JOIN m ON m.layer = r.layer""",
    "blind_spots": f"{E}, b AS (SELECT layer, block, count(*) AS n FROM paths GROUP BY 1, 2 HAVING count(length) = 0) SELECT layer, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS objects FROM b GROUP BY layer",
    "duplicate_warning": f"{E}, s AS (SELECT layer, count(*) AS n FROM parcels GROUP BY layer, w, h) SELECT layer, CAST(sum(n) AS BIGINT) AS parcels, CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS shared, coalesce(sum(CASE WHEN n > 1 THEN n END), 0) > 0.5 * sum(n) AS warn FROM s GROUP BY layer",
    "classification_cross_check": f"{E}, {_CONFIG} SELECT c.land_use AS configured, {_PATTERN.format(c='kind')} AS by_name, count(*) AS n, round(sum(area), 4) AS area FROM parcels p LEFT JOIN c ON c.layer = p.layer GROUP BY 1, 2",
    "shape_against_layer": f"""{E}, s AS (SELECT area, area BETWEEN 300 AND 700 AS shape, layer IN ('Brand#11', 'Brand#12', 'Brand#13') AS coded FROM parcels)
        SELECT CASE WHEN shape AND coded THEN 'both' WHEN shape THEN 'shape only' ELSE 'layer only' END AS found_by, count(*) AS n, round(sum(area), 4) AS area FROM s WHERE shape OR coded GROUP BY 1""",
    "labels_in_largest": f"""{E}, b AS (SELECT * FROM parcels ORDER BY area DESC, handle LIMIT 1),
        q AS (SELECT l.handle AS p_handle, l.text AS p_text, b.handle AS r_handle, 8e-1 * (l.x - x1) + 6e-1 * (l.y - y1) AS u, 8e-1 * (l.y - y1) - 6e-1 * (l.x - x1) AS v, w, h FROM labels l, b)
        SELECT p_handle, p_text, r_handle FROM q WHERE u > 0 AND u < w AND v > 0 AND v < h""",
    "text_census_samples": f"""{E}, t AS (SELECT text, CASE WHEN handle % 3 = 0 THEN 'dimension' ELSE 'integer' END AS class FROM labels), r AS (SELECT class, text, row_number() OVER (PARTITION BY class ORDER BY text) AS rn FROM (SELECT DISTINCT class, text FROM t))
        SELECT t.class, count(*) AS n, (SELECT string_agg(text, ',' ORDER BY text) FROM r WHERE rn <= 3 AND r.class = t.class) AS samples FROM t GROUP BY t.class""",
    "revision_summary": f"""{E}, a AS (SELECT block, sum(length) AS v, count(*) - count(length) AS holes FROM paths WHERE type <> 'CIRCLE' GROUP BY block), b AS (SELECT block, sum(length) AS v, count(*) - count(length) AS holes FROM paths WHERE type <> 'ARC' GROUP BY block)
        SELECT CASE WHEN a.block IS NULL THEN 'added' WHEN b.block IS NULL THEN 'removed' WHEN a.holes > 0 OR b.holes > 0 THEN 'not compared' WHEN abs(a.v - b.v) <= 1e-6 THEN 'same' ELSE 'changed' END AS status, count(*) AS blocks FROM a FULL OUTER JOIN b ON a.block = b.block GROUP BY 1""",
    "legend_rows": f"""{E}, u AS (SELECT coalesce({_PATTERN.format(c='kind')}, 'none') AS land_use, count(*) AS n, sum(area) AS area FROM parcels GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY area DESC, land_use) AS rn FROM u)
        SELECT CASE WHEN rn <= 4 THEN land_use ELSE 'others' END AS label, CAST(sum(n) AS BIGINT) AS n, round(sum(area), 4) AS area FROM r GROUP BY 1""",
    "cell_density": f"{E}, c AS (SELECT floor(cx / 80e0) AS x, floor(cy / 80e0) AS y, sum(area) AS area FROM parcels GROUP BY 1, 2) SELECT CAST(least(10, floor(round(area / 6400e0, 9) * 10)) AS BIGINT) AS tenth, count(*) AS cells FROM c GROUP BY 1",
    "viewport_cells": f"{E}, c AS (SELECT DISTINCT CAST(floor(cx / 80e0) AS BIGINT) AS cell_x, CAST(floor(cy / 80e0) AS BIGINT) AS cell_y FROM parcels) SELECT * FROM c WHERE {_VIEW.format(200, 100, 800, 600)} AND NOT ({_VIEW.format(200, 100, 500, 600)})",
    # a rectangle's sides never cross; with two corners exchanged two of them do
    "simple_rings": f"{E} SELECT handle, true AS simple, w * h = 0 AS twisted FROM parcels",
    "box_gaps": f"{E} SELECT handle, round(sqrt(pow(greatest(0, minx - 300, 100 - maxx), 2) + pow(greatest(0, miny - 250, 100 - maxy), 2)), 4) AS distance FROM parcels WHERE size_code = 50",
    "clipped_texts": r"SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE regexp_replace(substr(text, 1, 40), '\s+\S*\z', '') || '…' END AS clipped, length(text) > 40 AS more FROM documents",
    "response_budget": f"""{E}, r AS (SELECT handle, layer || '|' || kind AS "row" FROM parcels ORDER BY handle LIMIT 500), u AS (SELECT *, CAST(sum(length("row")) OVER (ORDER BY handle) AS BIGINT) AS upto FROM r) SELECT * FROM u WHERE upto <= 2000""",
    "run_stages": """WITH m AS (SELECT max(ts) AS now_ts FROM events), l AS (SELECT user_id, event_type AS stage, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)
        SELECT stage, CASE WHEN stage = 'purchase' THEN 'done' WHEN stage = 'error' THEN 'failed' WHEN now_ts - ts > INTERVAL 4 HOUR THEN 'abandoned' WHEN now_ts - ts > INTERVAL 1 HOUR THEN 'stalled' ELSE 'running' END AS state, count(*) AS runs FROM l, m GROUP BY 1, 2""",
    "tag_history": """SELECT user_id, event_type, round(value, 4) AS value, round(previous, 4) AS previous FROM (SELECT *, lead(value) OVER w AS previous, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)) WHERE rn = 1""",
}
QUERIES = {name: globals()[name] for name in SQL} | {"lat_lon_bounds": lat_lon_bounds}
