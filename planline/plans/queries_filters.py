"""Filters, projections, sets and paging over the entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from planline.adapter import SQL_ENTITIES as E
from planline.adapter import labels, parcels, paths, table
from planline.operators import filters as O

BOX = (400.0, 100.0, 900.0, 700.0)
TRIANGLE = [(100.0, 50.0), (1300.0, 250.0), (500.0, 1500.0)]
_HANDLE = ["handle", "layer", "area"]


def _out(df):
    return df.select("handle", "layer", F.round("area", 4).alias("area"))


def query_entities_page(spark, d):
    found = O.query_entities(paths(spark, d), layer="A", type="LINE", layout="F")
    return O.page(found.select("handle", "layer", "type", "length"), ["layer", "handle"], 100, 50)


def entity_handles(spark, d):
    return O.query_entities(paths(spark, d), type="ARC", layout="O").select("handle")


def points_by_handle(spark, d):
    return O.query_entities(labels(spark, d), handles=[7, 12, 100, 1999, -1]).select("handle", "x", "y")


def text_search_ci(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(O.contains_ci(F.col("text"), "The ONON")).select("doc_id", "lang", "source")


def dictionary_search(spark, d):
    parts = [
        table(spark, d, t).select(F.lit(kind).alias("kind"), F.col(c).alias("name")).distinct()
        for t, kind, c in (("nation", "drawing", "n_name"), ("region", "project", "r_name"), ("part", "layer", "p_brand"), ("customer", "style", "c_mktsegment"))
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return O.page(every.where(O.contains_ci(F.col("name"), "an")), ["kind", "name"], 200)


def handle_as_text(spark, d):
    p = table(spark, d, "part").where(F.col("p_partkey").cast("string") == "42")
    return p.select(F.col("p_partkey").alias("handle"), F.lit("42").alias("query"))


def rect_window(spark, d):
    return _out(O.rect(parcels(spark, d), BOX, "window"))


def rect_crossing(spark, d):
    return _out(O.rect(parcels(spark, d), BOX, "crossing"))


def bbox_overlap(spark, d):
    return _out(O.rect(parcels(spark, d), (0.0, 0.0, 333.0, 222.0), "crossing").where(F.col("size_code") > 20))


def circle_window(spark, d):
    return _out(O.circle(parcels(spark, d), 700.0, 500.0, 250.0, "window"))


def circle_crossing(spark, d):
    return _out(O.circle(parcels(spark, d), 700.0, 500.0, 250.0, "crossing"))


def polygon_window(spark, d):
    return _out(O.polygon(parcels(spark, d), TRIANGLE, "window"))


def polygon_crossing(spark, d):
    return _out(O.polygon(parcels(spark, d), TRIANGLE, "crossing"))


def selection_summary(spark, d):
    """What a polygon selection holds: by layer with area and extents."""
    s = O.polygon(parcels(spark, d), TRIANGLE, "crossing")
    return s.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 4).alias("area"), F.round(F.min("minx"), 4).alias("minx"), F.round(F.max("maxy"), 4).alias("maxy")
    )


def region_group_rows(spark, d):
    s = O.polygon(parcels(spark, d), TRIANGLE, "crossing").where("layer = 'Brand#11'")
    return O.page(_out(s), ["handle"], 200)


def layer_include_exclude(spark, d):
    p = paths(spark, d)
    keep = p.where(O.layer_filter(F.col("layer"), "A,R")).groupBy("layer").count().select(F.lit("keep").alias("rule"), "layer", F.col("count").alias("n"))
    drop = p.where(O.layer_filter(F.col("layer"), "!A")).groupBy("layer").count().select(F.lit("drop").alias("rule"), "layer", F.col("count").alias("n"))
    return keep.unionByName(drop)


def kind_projection(spark, d):
    p = paths(spark, d)
    kind = F.when(F.col("type") == "LWPOLYLINE", "path").when(F.col("type").isin("LINE", "ARC"), "segment").otherwise("ring")
    return p.groupBy(kind.alias("kind"), "layout").agg(F.count(F.lit(1)).alias("n"), F.count("length").alias("measured"))


def hidden_layers(spark, d):
    c = table(spark, d, "customer")
    frozen, off = F.col("c_custkey") % 11 == 0, F.col("c_acctbal") < 0
    return c.where(frozen | off).select(F.col("c_name").alias("layer"), frozen.alias("frozen"), off.alias("off"))


def even_spread_sample(spark, d):
    return O.spread(parcels(spark, d), "layer", ["handle"], 5).select("layer", "handle", F.col("at").cast("long").alias("place"))


def space_of_layout(spark, d):
    n = table(spark, d, "nation")
    name = F.when(F.col("n_nationkey") % 3 == 0, "Model").when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("[block] "), "n_name")).otherwise(F.col("n_name"))
    return n.select(F.col("n_nationkey").cast("long").alias("layout_id"), name.alias("layout"), O.space_of(name).alias("space"))


def _findings(spark, d):
    p = parcels(spark, d)
    return p.where("area > 700").select("handle"), p.where("size_code > 30").select("handle")


def combine_intersect(spark, d):
    a, b = _findings(spark, d)
    return a.intersect(b)


def combine_union(spark, d):
    a, b = _findings(spark, d)
    return a.union(b).distinct()


def combine_difference(spark, d):
    a, b = _findings(spark, d)
    return a.subtract(b)


def combine_result_rows(spark, d):
    a, b = _findings(spark, d)
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "handle", "full_outer")
    return both.select("handle", F.col("l").isNotNull().alias("in_left"), F.col("r").isNotNull().alias("in_right"))


def selection_union(spark, d):
    a, b = _findings(spark, d)
    u = a.union(b)
    return u.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("handle").alias("distinct_handles")).withColumn(
        "overlap", F.col("rows") - F.col("distinct_handles")
    )


_SEL = "SELECT handle, layer, round(area, 4) AS area FROM parcels WHERE "
_X0, _Y0, _X1, _Y1 = BOX
#: the triangle's edges as rows
_TRI = """tri(ax, ay, qx, qy) AS (VALUES (100e0, 50e0, 1300e0, 250e0), (1300e0, 250e0, 500e0, 1500e0), (500e0, 1500e0, 100e0, 50e0)),
corner AS (SELECT handle, minx AS px, miny AS py, 1 AS k FROM parcels UNION ALL SELECT handle, maxx, miny, 2 FROM parcels
           UNION ALL SELECT handle, maxx, maxy, 3 FROM parcels UNION ALL SELECT handle, minx, maxy, 4 FROM parcels),
inside AS (SELECT handle, k, sum(CASE WHEN (ay > py) <> (qy > py) AND px < (qx - ax) * (py - ay) / nullif(qy - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1 AS yes
           FROM corner, tri GROUP BY handle, k),
side AS (SELECT a.handle, a.px AS cx, a.py AS cy, b.px AS dx, b.py AS dy FROM corner a JOIN corner b ON a.handle = b.handle AND b.k = a.k % 4 + 1),
crossing AS (SELECT DISTINCT handle FROM (SELECT handle,
    sign((qx - ax) * (cy - ay) - (qy - ay) * (cx - ax)) AS s1, sign((qx - ax) * (dy - ay) - (qy - ay) * (dx - ax)) AS s2,
    sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) AS s3, sign((dx - cx) * (qy - cy) - (dy - cy) * (qx - cx)) AS s4,
        cx BETWEEN least(ax, qx) AND greatest(ax, qx) AND cy BETWEEN least(ay, qy) AND greatest(ay, qy) AS t1,
    dx BETWEEN least(ax, qx) AND greatest(ax, qx) AND dy BETWEEN least(ay, qy) AND greatest(ay, qy) AS t2,
    ax BETWEEN least(cx, dx) AND greatest(cx, dx) AND ay BETWEEN least(cy, dy) AND greatest(cy, dy) AS t3,
    qx BETWEEN least(cx, dx) AND greatest(cx, dx) AND qy BETWEEN least(cy, dy) AND greatest(cy, dy) AS t4
    FROM side, tri) WHERE (s1 * s2 < 0 AND s3 * s4 < 0) OR (s1 = 0 AND t1) OR (s2 = 0 AND t2) OR (s3 = 0 AND t3) OR (s4 = 0 AND t4)),
vertex AS (SELECT DISTINCT handle FROM parcels, tri WHERE ax BETWEEN minx AND maxx AND ay BETWEEN miny AND maxy),
window_ AS (SELECT handle FROM inside GROUP BY handle HAVING bool_and(yes) EXCEPT SELECT handle FROM crossing),
crosses AS (SELECT handle FROM inside WHERE k = 1 AND yes UNION SELECT handle FROM crossing UNION SELECT handle FROM vertex)"""
_FIND = "a AS (SELECT handle FROM parcels WHERE area > 700), b AS (SELECT handle FROM parcels WHERE size_code > 30)"
_NEAR = "sqrt(greatest(minx - 700, 0, 700 - maxx) * greatest(minx - 700, 0, 700 - maxx) + greatest(miny - 500, 0, 500 - maxy) * greatest(miny - 500, 0, 500 - maxy))"
_FAR = "sqrt(greatest(abs(minx - 700), abs(maxx - 700)) ** 2 + greatest(abs(miny - 500), abs(maxy - 500)) ** 2)"

SQL = {
    "query_entities_page": f"{E} SELECT handle, layer, type, length FROM paths WHERE layer = 'A' AND type = 'LINE' AND layout = 'F' ORDER BY layer, handle LIMIT 100 OFFSET 50",
    "entity_handles": f"{E} SELECT handle FROM paths WHERE type = 'ARC' AND layout = 'O'",
    "points_by_handle": f"{E} SELECT handle, x, y FROM labels WHERE handle IN (7, 12, 100, 1999, -1)",
    "text_search_ci": "SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'the onon')",
    "dictionary_search": """SELECT kind, name FROM (SELECT DISTINCT 'drawing' AS kind, n_name AS name FROM nation UNION ALL SELECT DISTINCT 'project', r_name FROM region
        UNION ALL SELECT DISTINCT 'layer', p_brand FROM part UNION ALL SELECT DISTINCT 'style', c_mktsegment FROM customer)
        WHERE contains(lower(name), 'an') ORDER BY kind, name LIMIT 200""",
    "handle_as_text": "SELECT p_partkey AS handle, '42' AS query FROM part WHERE p_partkey = 42",
    "rect_window": f"{E} {_SEL} minx >= {_X0} AND maxx <= {_X1} AND miny >= {_Y0} AND maxy <= {_Y1}",
    "rect_crossing": f"{E} {_SEL} NOT (minx > {_X1} OR maxx < {_X0} OR miny > {_Y1} OR maxy < {_Y0})",
    "bbox_overlap": f"{E} {_SEL} size_code > 20 AND minx <= 333 AND maxx >= 0 AND miny <= 222 AND maxy >= 0",
    "circle_window": f"{E} {_SEL} {_FAR} <= 250",
    "circle_crossing": f"{E} {_SEL} {_NEAR} <= 250",
    "polygon_window": f"{E}, {_TRI} {_SEL} handle IN (SELECT handle FROM window_)",
    "polygon_crossing": f"{E}, {_TRI} {_SEL} handle IN (SELECT handle FROM crosses)",
    "selection_summary": f"{E}, {_TRI} SELECT layer, count(*) AS n, round(sum(area), 4) AS area, round(min(minx), 4) AS minx, round(max(maxy), 4) AS maxy FROM parcels WHERE handle IN (SELECT handle FROM crosses) GROUP BY layer",
    "region_group_rows": f"{E}, {_TRI} {_SEL} layer = 'Brand#11' AND handle IN (SELECT handle FROM crosses) ORDER BY handle LIMIT 200",
    "layer_include_exclude": f"{E} SELECT 'keep' AS rule, layer, count(*) AS n FROM paths WHERE layer IN ('A', 'R') GROUP BY layer UNION ALL SELECT 'drop', layer, count(*) FROM paths WHERE layer NOT IN ('A') GROUP BY layer",
    "kind_projection": f"{E} SELECT CASE WHEN type = 'LWPOLYLINE' THEN 'path' WHEN type IN ('LINE', 'ARC') THEN 'segment' ELSE 'ring' END AS kind, layout, count(*) AS n, count(length) AS measured FROM paths GROUP BY 1, 2",
    "hidden_layers": "SELECT c_name AS layer, c_custkey % 11 = 0 AS frozen, c_acctbal < 0 AS off FROM customer WHERE c_custkey % 11 = 0 OR c_acctbal < 0",
    "even_spread_sample": f"""{E}, r AS (SELECT layer, handle, row_number() OVER (PARTITION BY layer ORDER BY handle) - 1 AS place, count(*) OVER (PARTITION BY layer) AS n FROM parcels)
        SELECT layer, handle, place FROM r WHERE place = 0 OR (place * 5) // n <> ((place - 1) * 5) // n""",
    "space_of_layout": """WITH l AS (SELECT CAST(n_nationkey AS BIGINT) AS layout_id, CASE n_nationkey % 3 WHEN 0 THEN 'Model' WHEN 1 THEN '[block] ' || n_name ELSE n_name END AS layout FROM nation)
        SELECT layout_id, layout, CASE WHEN layout = 'Model' THEN 'model' WHEN layout LIKE '[block]%' THEN 'block' ELSE 'paper' END AS space FROM l""",
    "combine_intersect": f"{E}, {_FIND} SELECT handle FROM a WHERE handle IN (SELECT handle FROM b)",
    "combine_union": f"{E} SELECT handle FROM parcels WHERE area > 700 OR size_code > 30",
    "combine_difference": f"{E} SELECT handle FROM parcels WHERE area > 700 AND NOT size_code > 30",
    "combine_result_rows": f"{E} SELECT handle, area > 700 AS in_left, size_code > 30 AS in_right FROM parcels WHERE area > 700 OR size_code > 30",
    "selection_union": f"{E} SELECT count(CASE WHEN area > 700 THEN 1 END) + count(CASE WHEN size_code > 30 THEN 1 END) AS rows, count(CASE WHEN area > 700 OR size_code > 30 THEN 1 END) AS distinct_handles, count(CASE WHEN area > 700 AND size_code > 30 THEN 1 END) AS overlap FROM parcels",
}
QUERIES = {name: globals()[name] for name in SQL}
