"""Streams of events: idempotent requests, windowed counts and arrivals of drawings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream, ``ts`` as an event time."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def idempotent(stream: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """The first event of each key; repeats within the watermark are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, key: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Count and sum of value in tumbling windows; late rows are dropped by the watermark."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("start"), key, "n", "value")
    )


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a rerun goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def drawings(spark: SparkSession, path: str) -> DataFrame:
    """Arriving drawing files as (path, content)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)


def closed_runs(rows: DataFrame, run: str, stage: str, limit: str, ended: dict[str, str]) -> DataFrame:
    """Runs that had no news for ``limit``: run, began, last, events, stage and how each ended.

    ``rows``: event_id, ts, the run and the stage it reports. On a stream with a watermark the
    timer of event time closes a run, once, when the watermark passes its last news by
    ``limit``; news that comes late but within the watermark still belongs to its run, so the
    order of arrival does not count, and news after the limit begins another run. ``stage``
    is that of the last event (ties: greatest id); ``ended`` maps stages that end a run to
    a state, the last of them counts; a run without one was abandoned. Repeated events
    count once. On a table every run is returned, the open ones too.
    """
    said = F.element_at(F.create_map(*[F.lit(x) for pair in ended.items() for x in pair]), F.col(stage))
    last = F.struct("ts", "event_id")
    fresh = rows.dropDuplicatesWithinWatermark(["event_id"]) if rows.isStreaming else rows.dropDuplicates(["event_id"])
    named = fresh.where("ts is not null").withColumn("said", said)
    runs = named.groupBy(F.session_window("ts", limit).alias("w"), run).agg(
        F.min("ts").alias("began"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"), F.max_by(stage, last).alias("stage"), F.max(F.when(F.col("said").isNotNull(), F.struct("ts", "event_id", "said"))).alias("end")
    )
    return runs.select(run, "began", "last", "events", "stage", F.coalesce("end.said", F.lit("abandoned")).alias("state"))


def ingest_arrivals(files: DataFrame, table: str, checkpoint: str) -> None:
    """Enter the drawings of a stream of files (:func:`drawings`) into an entity table, each content once.

    A batch that is run again after a failure finds what it had committed in the catalog and
    enters the rest; equal files, in one batch or in several, are one drawing.
    """
    from planline.sources import dxf, tables

    def enter(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = tables.arriving(batch.select("path", "content"), tables.catalog(spark, table)).dropDuplicates(["drawing_id"])
        tables.write_entities(fresh.select("path", "content").mapInArrow(dxf._parse, dxf.ENTITY_DDL), table)

    run_to_end(files, enter, checkpoint)
