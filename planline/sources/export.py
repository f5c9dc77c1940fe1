"""Entities written as DXF files, one a drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that :func:`write_dxf` reads; what a kind has not is null.
COLUMNS = ("drawing_id", "handle", "type", "layer", "text", "ring", "anchor_point", "payload")


def _pair(code: int, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.concat(F.lit(f"{code}\n"), value)


def _point(p: Column) -> Column:
    return F.concat_ws("\n", _pair(10, p["x"]), _pair(20, p["y"]))


def entity_text(type: Column, handle: Column, layer: Column, text: Column, ring: Column, anchor: Column, payload: Column) -> Column:
    """The pairs of one entity, joined by line ends: a closed LWPOLYLINE, a TEXT, or an OLE2FRAME whose bytes stand in pieces of 127."""
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(payload), F.lit(1)), F.lit(127)), lambda k: _pair(310, F.hex(F.substring(payload, k, F.lit(127)))))
    own = (
        F.when(type == "LWPOLYLINE", F.concat_ws("\n", _pair(70, "1"), F.concat_ws("\n", F.transform(ring, _point))))
        .when(type == "OLE2FRAME", F.when(F.length(payload) > 0, F.concat_ws("\n", pieces)))
        .otherwise(F.concat_ws("\n", _point(anchor), _pair(1, F.regexp_replace(text, "[\r\n]+", "\\\\P"))))
    )
    return F.concat_ws("\n", _pair(0, type), _pair(5, F.hex(handle)), _pair(8, layer), own)


def write_dxf(entities: DataFrame, path: str) -> None:
    """``drawing_id=<id>/part-*`` under ``path``, entities in order of handle (a whole number, written in hexadecimal).

    A drawing is one file and so one task, which sorts it and writes it row by row.
    """
    e = entities.select("drawing_id", F.lit(1).alias("part"), F.col("handle").cast("long").alias("place"), entity_text(*[F.col(c) for c in ("type", "handle", "layer", "text", "ring", "anchor_point", "payload")]).alias("value"))
    drawings = entities.select("drawing_id").distinct()
    frame = [F.struct(F.lit(0).alias("part"), F.lit("0\nSECTION\n2\nENTITIES").alias("value")), F.struct(F.lit(2).alias("part"), F.lit("0\nENDSEC\n0\nEOF").alias("value"))]
    frames = drawings.select("drawing_id", F.explode(F.array(*frame)).alias("f")).select("drawing_id", "f.part", F.lit(0).cast("long").alias("place"), "f.value")
    ordered = e.unionByName(frames).repartition("drawing_id").sortWithinPartitions("drawing_id", "part", "place")
    ordered.select("drawing_id", "value").write.partitionBy("drawing_id").text(path)
