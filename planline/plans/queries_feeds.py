"""Map feeds, near misses and pages that say whether more follows."""

from __future__ import annotations

from pyspark.sql import functions as F

from planline.adapter import SQL_ENTITIES as E
from planline.adapter import labels, parcels, paths, table
from planline.functions import curves as C
from planline.functions import geometry as G
from planline.operators import filters as O


def page_with_truncation(spark, d):
    """A page of 100 and whether more rows follow: one row more is read, never the whole."""
    one_more = O.page(O.query_entities(paths(spark, d), layer="N").select("handle", "layer"), ["handle"], 101)
    rows = F.sort_array(F.collect_list(F.struct("handle", "layer"))).alias("rows")  # 101 at most
    page = one_more.agg(rows).select(F.explode(F.slice("rows", 1, 100)).alias("r"), (F.size("rows") > 100).alias("truncated"))
    return page.select("r.handle", "r.layer", "truncated")


def text_near_misses(spark, d):
    """Names that match where no text does: layers, kinds and styles."""
    q = "rass"
    sides = [
        ("layer", parcels(spark, d).select(F.col("layer").alias("name"))),
        ("kind", parcels(spark, d).select(F.col("kind").alias("name"))),
        ("style", table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"))),
    ]
    out = None
    for where, names in sides:
        part = names.where(O.contains_ci(F.col("name"), q)).groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit(where).alias("found_in"), "name", "n")
        out = part if out is None else out.unionByName(part)
    return out


def viewport_feed(spark, d):
    """Rings that meet a viewport but not the part already held."""
    view, have = (200.0, 100.0, 800.0, 600.0), (200.0, 100.0, 500.0, 600.0)
    seen = O.rect(parcels(spark, d), have, "crossing").select("handle")
    fresh = O.rect(parcels(spark, d), view, "crossing").join(seen, "handle", "left_anti")
    return fresh.select("handle", "layer", F.round("minx", 4).alias("minx"), F.round("miny", 4).alias("miny"))


def layers_in_scope(spark, d):
    """Layers of each feed kind in one pass."""
    p = paths(spark, d)
    return p.groupBy("layer").agg(
        F.count_if(F.col("type") == "LWPOLYLINE").alias("path"), F.count_if(F.col("type").isin("LINE", "ARC")).alias("segment"), F.count_if(F.col("type") == "CIRCLE").alias("ring")
    )


def extents_by_layer(spark, d):
    return parcels(spark, d).groupBy("layer").agg(*[F.round(f(c), 4).alias(c) for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))])


def zoom_resolutions(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("double").alias("zoom"))
    return n.select("zoom", C.resolution_for_zoom(F.col("zoom")).cast("long").alias("resolution"), F.round(C.degrees_per_pixel(F.col("zoom"), F.lit(0.0)), 9).alias("degrees"))


def bulged_area(spark, d):
    """Area of each parcel with one side bulged to a half circle, flattened to within 0.001."""
    p = parcels(spark, d)
    flat = C.flatten_bulges(F.col("ring"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), 0.001)
    p = p.withColumn("flat", flat)
    return p.select("handle", F.round(G.signed_area(F.col("flat")), 4).alias("flat_area"), F.size("flat").cast("long").alias("points"))


def simplified_rings(spark, d):
    """Parcel outlines with a vertex added in the middle of each side, simplified: the corners stay."""
    p = parcels(spark, d)
    after = F.concat(F.slice("ring", 2, 4), F.slice("ring", 1, 1))
    mid = F.zip_with("ring", after, lambda a, b: F.array(F.struct(a["x"].alias("x"), a["y"].alias("y")), F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))))
    dense = F.concat(F.flatten(mid), F.slice("ring", 1, 1))
    return p.select("handle", F.size(C.simplify(dense, 0.01)).cast("long").alias("vertices"))


def geojson_rings(spark, d):
    j = C.geojson_polygon(F.col("ring"), 3)
    p = parcels(spark, d).select("handle", j.alias("j"))
    pairs = F.from_json("j", "type string, coordinates array<array<array<double>>>")
    return p.select("handle", pairs["type"].alias("type"), F.size(pairs["coordinates"][0]).cast("long").alias("points"), (pairs["coordinates"][0][0] == pairs["coordinates"][0][4]).alias("closed"))


def answer_handles(spark, d):
    """Numbers named in texts that are handles of parcels."""
    found = labels(spark, d).select("text").distinct()
    return found.join(parcels(spark, d).select(F.col("handle").cast("string").alias("text"), "layer"), "text").select("text", "layer")


def role_of_layout(spark, d):
    """Layers whose paths stand on one layout only, and on which."""
    p = paths(spark, d).groupBy("layer", "block").agg(F.countDistinct("layout").alias("layouts"), F.min("layout").alias("layout"))
    return p.groupBy("layer", F.when(F.col("layouts") == 1, F.col("layout")).otherwise("several").alias("stands_on")).agg(F.count(F.lit(1)).alias("blocks"))


def anomaly_duplicates(spark, d):
    """Repeated rows of one block: same type, price and length."""
    p = paths(spark, d).groupBy("layer", "type", "length").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block").alias("blocks"))
    return p.where("n > 1")


SQL = {
    "page_with_truncation": f"{E} SELECT handle, layer, (SELECT count(*) FROM paths WHERE layer = 'N') > 100 AS truncated FROM paths WHERE layer = 'N' ORDER BY handle LIMIT 100",
    "text_near_misses": f"""{E} SELECT 'layer' AS found_in, layer AS name, count(*) AS n FROM parcels WHERE contains(lower(layer), 'rass') GROUP BY layer
        UNION ALL SELECT 'kind', kind, count(*) FROM parcels WHERE contains(lower(kind), 'rass') GROUP BY kind
        UNION ALL SELECT 'style', c_mktsegment, count(*) FROM customer WHERE contains(lower(c_mktsegment), 'rass') GROUP BY c_mktsegment""",
    "viewport_feed": f"{E} SELECT handle, layer, round(minx, 4) AS minx, round(miny, 4) AS miny FROM parcels WHERE minx <= 800 AND maxx >= 200 AND miny <= 600 AND maxy >= 100 AND NOT minx <= 500",
    "layers_in_scope": f"{E} SELECT layer, count(CASE WHEN type = 'LWPOLYLINE' THEN 1 END) AS path, count(CASE WHEN type IN ('LINE', 'ARC') THEN 1 END) AS segment, count(CASE WHEN type = 'CIRCLE' THEN 1 END) AS ring FROM paths GROUP BY layer",
    "extents_by_layer": f"{E} SELECT layer, round(min(minx), 4) AS minx, round(min(miny), 4) AS miny, round(max(maxx), 4) AS maxx, round(max(maxy), 4) AS maxy FROM parcels GROUP BY layer",
    "zoom_resolutions": "SELECT CAST(n_nationkey AS DOUBLE) AS zoom, CAST(greatest(0, least(13, floor(n_nationkey * 0.75))) AS BIGINT) AS resolution, round(360e0 / (256 * 2e0 ** n_nationkey), 9) AS degrees FROM nation",
    # a half circle of n chords has the area n r r sin(pi / n) / 2; n follows from the tolerance
    "bulged_area": f"""{E}, b AS (SELECT handle, area, w / 2 AS r, ceil(pi() / (2 * acos(1 - 1e-3 / (w / 2)))) AS n FROM parcels)
        SELECT handle, round(area + n * r * r * sin(pi() / n) / 2, 4) AS flat_area, CAST(n + 3 AS BIGINT) AS points FROM b""",
    "simplified_rings": f"{E} SELECT handle, CAST(5 AS BIGINT) AS vertices FROM parcels",
    "geojson_rings": f"{E} SELECT handle, 'Polygon' AS type, CAST(5 AS BIGINT) AS points, true AS closed FROM parcels",
    "answer_handles": f"{E} SELECT DISTINCT l.text, p.layer FROM labels l JOIN parcels p ON l.text = CAST(p.handle AS VARCHAR)",
    "role_of_layout": f"{E}, b AS (SELECT layer, block, CASE WHEN count(DISTINCT layout) = 1 THEN min(layout) ELSE 'several' END AS stands_on FROM paths GROUP BY 1, 2) SELECT layer, stands_on, count(*) AS blocks FROM b GROUP BY 1, 2",
    "anomaly_duplicates": f"{E} SELECT layer, type, length, count(*) AS n, count(DISTINCT block) AS blocks FROM paths GROUP BY 1, 2, 3 HAVING count(*) > 1",
}
QUERIES = {name: globals()[name] for name in SQL}
