"""Dossiers: what each layer and layout of a drawing holds, kept in a table and proved whole.

A dossier is one row of type ``head`` for a drawing and one of type ``bucket`` for each of
its layers and layouts, so a drawing of very many layers is no single large value. The
table is versioned like the entities', and a head names the version of the entities that
it was made from: a drawing without a dossier, one with an old dossier and one that holds
nothing are three answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planline.errors import Refusal
from planline.operators.aggregates import family
from planline.sources import tables

#: A family leads a bucket with this share of its entities.
DOMINANCE = 0.6
_MEASURES = ("area", "length")


def buckets(entities: DataFrame, dominance: float = DOMINANCE) -> DataFrame:
    """A row for each drawing, layer and layout: entities, types (with counts, by name), role and measures.

    ``entities``: drawing_id, layer, layout, type, area, length; a null measure is not
    measurable, and ``<measure>_total`` is null unless every entity was measured. Null names
    are buckets of their own. Entities are counted by type before they are shuffled; the
    rest works on those counts.
    """
    keys = ["drawing_id", "layer", "layout"]
    own = [x for m in _MEASURES for x in (F.count(m).alias(f"{m}_measured"), F.sum(m).alias(f"{m}_sum"))]
    by_type = entities.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"), *own)
    sums = [x for m in _MEASURES for x in (F.sum(f"{m}_measured").alias(f"{m}_measured"), F.round(F.sum(f"{m}_sum"), 4).alias(f"{m}_sum"))]
    families = ("annotation", "network", "other", "points", "region")
    of_family = [F.coalesce(F.sum(F.when(family(F.col("type")) == k, F.col("n"))), F.lit(0)).alias(k) for k in families]
    out = by_type.groupBy(*keys).agg(F.sum("n").alias("entities"), F.array_sort(F.collect_list(F.struct("type", "n"))).alias("types"), *sums, *of_family)
    lead = F.greatest(*[F.struct(F.col(k).alias("n"), F.lit(k).alias("family")) for k in families])
    role = F.when(lead["n"] >= dominance * F.col("entities"), lead["family"]).otherwise("mixed")
    totals = {f"{m}_total": F.when(F.col(f"{m}_measured") == F.col("entities"), F.col(f"{m}_sum")) for m in _MEASURES}
    return out.withColumns({"role": role, **totals}).drop(*families)


def coverage(of: DataFrame, stated: DataFrame) -> DataFrame:
    """A row for each of ``stated`` (drawing_id, version, total): accounted, buckets, difference and whether the dossier is complete.

    A total that is not known is never taken from the buckets: such a dossier is not complete.
    """
    found = of.groupBy("drawing_id").agg(F.sum("entities").alias("accounted"), F.count(F.lit(1)).alias("buckets"))
    out = stated.join(found, "drawing_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("accounted", "buckets")})
    difference = F.col("total") - F.col("accounted")
    verdict = F.when(F.col("total").isNull(), "no total").when(difference > 0, "entities in no bucket").when(difference < 0, "entities counted twice").otherwise("complete")
    return out.withColumns({"difference": difference, "verdict": verdict, "complete": verdict == "complete"})


def _stated(spark: SparkSession, entity_table: str) -> DataFrame:
    return tables.catalog(spark, entity_table).select("drawing_id", "version", F.col("entities").alias("total"))


def heads(spark: SparkSession, entity_table: str, dossier_table: str) -> DataFrame:
    """Each drawing's head with ``status``: computed, stale (the entities have changed since) or not_computed (all else is null)."""
    have = _rows(spark, dossier_table, "head")
    known = _stated(spark, entity_table).select("drawing_id", F.col("version").alias("now"))
    out = known.join(have.withColumnRenamed("entity_version", "then"), "drawing_id", "left")
    status = F.when(F.col("then").isNull(), "not_computed").when(F.col("then") == F.col("now"), "computed").otherwise("stale")
    return out.select("drawing_id", status.alias("status"), *_HEAD)


_HEAD = ("accounted", "buckets", "total", "difference", "verdict", "complete")
_SCHEMA = (
    "type string, layout string, layer string, handle string, entities long, types array<struct<type:string,n:long>>, role string, area_measured long, area_sum double, area_total double, "
    "length_measured long, length_sum double, length_total double, entity_version string, accounted long, buckets long, total long, difference long, verdict string, complete boolean"
)


def _rows(spark: SparkSession, dossier_table: str, kind: str) -> DataFrame:
    try:
        rows = tables.read_entities(spark, dossier_table)
    except FileNotFoundError:
        rows = spark.createDataFrame([], f"drawing_id string, {_SCHEMA}")
    return rows.where(F.col("type") == kind).select("drawing_id", *(("entity_version", *_HEAD) if kind == "head" else _BUCKET))


_BUCKET = ("layer", "layout", "entities", "types", "role", "area_measured", "area_sum", "area_total", "length_measured", "length_sum", "length_total")


def read_buckets(spark: SparkSession, dossier_table: str) -> DataFrame:
    """The buckets of every stored dossier."""
    return _rows(spark, dossier_table, "bucket")


def backfill(spark: SparkSession, entity_table: str, dossier_table: str, strict: bool = False) -> bool:
    """Make the dossiers that are missing or stale, all in one commit; whether there were any.

    Drawings whose dossier is current are not read. ``strict`` refuses to store a dossier
    that is not complete; else it is stored with its verdict.
    """
    due = heads(spark, entity_table, dossier_table).where("status <> 'computed'").select("drawing_id")
    if due.isEmpty():
        return False
    stated = _stated(spark, entity_table).join(due, "drawing_id", "left_semi")
    rows = tables.read_entities(spark, entity_table).join(due, "drawing_id", "left_semi")
    made = buckets(rows)
    head = coverage(made, stated)
    if strict and not (bad := head.where("not complete")).isEmpty():
        first = bad.orderBy("drawing_id").select("drawing_id", "verdict").first()
        raise Refusal("coverage", f"drawing {first.drawing_id}: {first.verdict}", "enter the drawing again")
    fields = [field.split() for field in _SCHEMA.split(", ")]
    shaped = lambda df, given: df.select("drawing_id", *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields])
    one = shaped(made, {"type": F.lit("bucket"), **{c: F.col(c) for c in _BUCKET}})
    two = shaped(head, {"type": F.lit("head"), "entity_version": F.col("version"), **{c: F.col(c) for c in _HEAD}})
    tables.write_entities(one.unionByName(two), dossier_table)
    return True
