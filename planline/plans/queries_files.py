"""Tables written as drawing files, embedded documents and stored dossiers, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planline.adapter import SQL_ENTITIES as E
from planline.adapter import labels, parcels, paths, table
from planline.operators import dossier
from planline.session import shared_folder
from planline.sources import dxf, embedded, export, tables


def _written(spark, entities):
    path = f"{shared_folder(spark)}/drawings-{uuid.uuid4().hex}"
    missing = [c for c in export.COLUMNS if c not in entities.columns]
    types = {"text": "string", "ring": "array<struct<x:double,y:double>>", "anchor_point": "struct<x:double,y:double>", "payload": "binary"}
    export.write_dxf(entities.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in missing]).select(*export.COLUMNS), path)
    return f"{path}/*"


def dxf_round_trip(spark, d):
    """Parcels and labels, a drawing for each layer, written as DXF files and read back by byte ranges."""
    p = parcels(spark, d).select(F.col("layer").alias("drawing_id"), "handle", F.lit("LWPOLYLINE").alias("type"), "layer", F.lit(None).cast("string").alias("text"), "ring", F.lit(None).cast("struct<x:double,y:double>").alias("anchor_point"))
    t = labels(spark, d).select(F.col("layer").alias("drawing_id"), "handle", F.lit("TEXT").alias("type"), "layer", "text", F.lit(None).cast("array<struct<x:double,y:double>>").alias("ring"), F.struct("x", "y").alias("anchor_point"))
    back = dxf.read_dxf(spark, _written(spark, p.unionByName(t)))
    return back.groupBy("layer", "type", "layout").agg(
        F.count(F.lit(1)).alias("entities"), F.countDistinct("handle").alias("handles"), F.sum(F.length("text")).alias("letters"), F.count(F.when(F.col("ring_status") == "complete", 1)).alias("closed"),
        F.round(F.sum("area"), 3).alias("area"), F.round(F.min("minx"), 6).alias("minx"), F.round(F.max("maxy"), 6).alias("maxy"), F.round(F.sum("anchor_point.x"), 3).alias("anchors"),
    )


def embedded_payloads(spark, d):
    """Each part's name in a frame of its layer's drawing, as the contents of four formats or as a link; what is found there."""
    p = table(spark, d, "part")
    name = F.encode(F.col("p_name"), "UTF-8")
    four = [F.concat(F.unhex(F.lit(mark)), name) for mark in ("7B5C727466", "255044462D", "89504E470D0A1A0A")]  # RTF, PDF, PNG
    dib = F.unhex(F.concat(F.lit("28000000"), F.hex(F.reverse(F.unhex(F.lpad(F.hex(F.col("p_size").cast("long")), 8, "0")))), F.lit("02000000" + "0100" + "1800" + "00" * 24), F.repeat(F.lit("00"), 32)))
    data = F.element_at(F.array(*four, dib, F.lit(None).cast("binary")), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = p.select(F.col("p_brand").alias("drawing_id"), F.col("p_partkey").alias("handle"), F.lit("OLE2FRAME").alias("type"), F.col("p_brand").alias("layer"), data.alias("payload"))
    back = embedded.read_embedded(spark, _written(spark, rows))
    return back.select(F.conv("handle", 16, 10).cast("long").alias("handle"), "format", "media_type", "bytes", "width", "height", F.md5("data").alias("content"))


def dossier_backfill(spark, d):
    """Seven drawings entered in an entity table; the dossiers made from it and read back, each bucket with its drawing's verdict."""
    base = f"{shared_folder(spark)}/dossiers-{uuid.uuid4().hex}"
    p = paths(spark, d).select((F.col("block") % 7).cast("string").alias("drawing_id"), "layer", "layout", "type", F.col("handle").cast("string").alias("handle"), F.when(F.col("type") == "CIRCLE", F.col("price")).alias("area"), F.col("length").cast("double").alias("length"))
    tables.write_entities(p, f"{base}/entities")
    dossier.backfill(spark, f"{base}/entities", f"{base}/made")
    head = dossier.heads(spark, f"{base}/entities", f"{base}/made").select("drawing_id", "status", "accounted", "complete")
    types = F.array_join(F.transform("types", lambda t: F.concat(t["type"], F.lit(":"), t["n"].cast("string"))), ",")
    rows = dossier.read_buckets(spark, f"{base}/made").withColumn("types", types).withColumns({c: F.round(c, 2) for c in ("area_sum", "length_sum", "length_total")})
    return rows.join(head, "drawing_id").drop("area_total")


_KINDS = ("rtf", "pdf", "png", "bmp", "none")
_FORMAT = "CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_KINDS)) + " END"
_MEDIA = "CASE p_partkey % 5 WHEN 0 THEN 'application/rtf' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/bmp' ELSE 'application/octet-stream' END"
_SIZE = "octet_length(encode(p_name))"
SQL = {
    "dxf_round_trip": f"""{E}, e AS (SELECT layer, 'LWPOLYLINE' AS type, handle, NULL AS text, area, minx, maxy, NULL AS x FROM parcels UNION ALL SELECT layer, 'TEXT', handle, text, NULL, x, y, x FROM labels)
        SELECT layer, type, 'Model' AS layout, count(*) AS entities, count(DISTINCT handle) AS handles, CAST(sum(length(text)) AS BIGINT) AS letters, count(CASE WHEN type = 'LWPOLYLINE' THEN 1 END) AS closed,
        round(sum(area), 3) AS area, round(min(minx), 6) AS minx, round(max(maxy), 6) AS maxy, round(sum(x), 3) AS anchors FROM e GROUP BY 1, 2""",
    "embedded_payloads": f"""WITH h AS (SELECT p_partkey, {_FORMAT} AS format, {_MEDIA} AS media_type, CAST(CASE p_partkey % 5 WHEN 0 THEN 5 + {_SIZE} WHEN 1 THEN 5 + {_SIZE} WHEN 2 THEN 8 + {_SIZE} WHEN 3 THEN 14 + 40 + 32 ELSE 0 END AS BIGINT) AS bytes, p_size,
          CASE p_partkey % 5 WHEN 0 THEN '7B5C727466' || hex(p_name) WHEN 1 THEN '255044462D' || hex(p_name) WHEN 2 THEN '89504E470D0A1A0A' || hex(p_name)
            WHEN 3 THEN '424D560000000000000036000000' || '28000000' || lpad(hex(p_size), 2, '0') || '000000' || '02000000' || '0100' || '1800' || repeat('00', 24) || repeat('00', 32) END AS hexed FROM part)
        SELECT CAST(p_partkey AS BIGINT) AS handle, format, media_type, bytes, CAST(CASE WHEN format = 'bmp' THEN p_size END AS BIGINT) AS width, CAST(CASE WHEN format = 'bmp' THEN 2 END AS BIGINT) AS height, md5(unhex(hexed)) AS content FROM h""",
}
SQL["dossier_backfill"] = f"""{E}, e AS (SELECT CAST(block % 7 AS VARCHAR) AS drawing_id, layer, layout, type, CASE WHEN type = 'CIRCLE' THEN price END AS area, length FROM paths),
    t AS (SELECT drawing_id, layer, layout, type, count(*) AS n, count(CASE WHEN type = 'CIRCLE' THEN 1 END) AS points, count(CASE WHEN type IN ('LINE', 'ARC') THEN 1 END) AS network, count(CASE WHEN type = 'LWPOLYLINE' THEN 1 END) AS region,
      count(area) AS am, sum(area) AS a, count(length) AS lm, sum(length) AS l FROM e GROUP BY 1, 2, 3, 4),
    b AS (SELECT drawing_id, layer, layout, CAST(sum(n) AS BIGINT) AS entities, string_agg(type || ':' || n, ',' ORDER BY type) AS types, sum(points) AS points, sum(network) AS network, sum(region) AS region,
      CAST(sum(am) AS BIGINT) AS area_measured, round(CAST(sum(a) AS DOUBLE), 2) AS area_sum, CAST(sum(lm) AS BIGINT) AS length_measured, round(CAST(sum(l) AS DOUBLE), 2) AS length_sum FROM t GROUP BY 1, 2, 3)
    SELECT drawing_id, layer, layout, entities, types, CASE WHEN network >= 0.6 * entities THEN 'network' WHEN region >= 0.6 * entities THEN 'region' WHEN points >= 0.6 * entities THEN 'points' ELSE 'mixed' END AS role,
      area_measured, area_sum, length_measured, length_sum, CASE WHEN length_measured = entities THEN length_sum END AS length_total, 'computed' AS status, CAST(sum(entities) OVER (PARTITION BY drawing_id) AS BIGINT) AS accounted, true AS complete FROM b"""
QUERIES = {name: globals()[name] for name in SQL}
