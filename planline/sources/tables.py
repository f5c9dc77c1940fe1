"""Entity tables on disk: versions written beside one another, and a log of commits that says which counts.

``rows/version=.../drawing_id=...`` holds entities, ``commits/<number>.json`` one line for
each drawing that a commit changes. A commit is one rename, so a reader sees a drawing's
old rows or its new ones, never a mixture, and never rows of a write that did not end.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a drawing are dealt to so many tasks, so that a large drawing is no single task.
PARTS_OF_DRAWING = 16
COMMIT = "commit long, drawing_id string, version string, entities long, catalog string"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _commits(spark: SparkSession, path: str) -> DataFrame:
    fs, at = _files(spark, f"{path}/commits")
    if not fs.exists(at):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).json(f"{path}/commits/*.json")


def _commit(spark: SparkSession, path: str, changes: list[dict]) -> int:
    """Put one commit at the end of the log: written aside, then renamed to the first free number.

    A rename does not replace a file, so of two writers one takes the number and the other the next.
    """
    fs, folder = _files(spark, f"{path}/commits")
    fs.mkdirs(folder)
    taken = [int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder) if s.getPath().getName()[0] != "_"]
    number = max(taken, default=-1) + 1
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/_{uuid.uuid4().hex}")
    while True:
        out = fs.create(aside, True)
        out.write(bytearray("".join(json.dumps(c | {"commit": number}) + "\n" for c in changes), "utf-8"))
        out.close()
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{number:012d}.json")
        if not fs.exists(place) and fs.rename(aside, place):
            return number
        number += 1


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """drawing_id, version, entities, catalog (what the writer said of it) and commit of each drawing that can be read; dropped ones are absent."""
    last = _commits(spark, path).groupBy("drawing_id").agg(F.max_by(F.struct("version", "entities", "catalog"), "commit").alias("c"), F.max("commit").alias("commit"))
    return last.where("c.version is not null").select("drawing_id", "c.version", "c.entities", "c.catalog", "commit")


def write_entities(entities: DataFrame, path: str, facts: dict[str, str] | None = None) -> str:
    """Replace the drawings in ``entities`` and return the new version.

    Rows go to files of the new version first, sorted within each for row-group pruning and
    dealt by drawing and handle; then one commit makes all of them count. ``facts``: a note
    for the catalog by drawing. A write that fails leaves files that nothing reads.
    """
    spark, version = entities.sparkSession, uuid.uuid4().hex
    part = F.pmod(F.xxhash64("handle"), F.lit(PARTS_OF_DRAWING))
    ordered = entities.repartition("drawing_id", part).sortWithinPartitions("drawing_id", "layout", "layer", "type", "handle")
    ordered.write.mode("error").partitionBy("drawing_id").parquet(f"{path}/rows/version={version}")
    counts = spark.read.schema(entities.schema).parquet(f"{path}/rows/version={version}").groupBy(F.col("drawing_id").cast("string").alias("drawing_id")).count()
    facts = facts or {}
    # a row for each drawing of one write
    changes = [{"drawing_id": r.drawing_id, "version": version, "entities": r["count"], "catalog": facts.get(r.drawing_id)} for r in counts.toLocalIterator()]
    if changes:
        _commit(spark, path, changes)
    return version


def drop_drawings(spark: SparkSession, path: str, drawing_ids: list[str]) -> None:
    """From the next read on these drawings are absent; their files stay until a sweep."""
    _commit(spark, path, [{"drawing_id": d, "version": None, "entities": 0, "catalog": None} for d in drawing_ids])


def read_entities(spark: SparkSession, path: str, drawing_id: str | None = None) -> DataFrame:
    """Rows of every drawing's last committed version, or of one drawing's; folders of other versions are not read."""
    current = catalog(spark, path).select("drawing_id", "version")
    current = current if drawing_id is None else current.where(F.col("drawing_id") == drawing_id)
    versions = [r.version for r in current.select("version").distinct().collect()]  # one for each write that still counts
    if not versions:
        raise FileNotFoundError(f"no drawing {drawing_id or ''} in {path}")
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/version={v}" for v in versions])
    rows = rows if drawing_id is None else rows.where(F.col("drawing_id") == drawing_id)
    keyed = rows.withColumn("drawing_id", F.col("drawing_id").cast("string"))
    return keyed.join(current, ["drawing_id", "version"], "left_semi").drop("version")


def sweep(spark: SparkSession, path: str, before_commit: int) -> int:
    """Delete what no commit from ``before_commit`` on, nor the catalog, refers to; returns how many folders went.

    Readers that began after that commit keep their files, and so do writes that have not
    committed yet, as only versions named by an older commit go.
    """
    log = _commits(spark, path)
    kept = catalog(spark, path).select("drawing_id", "version").unionByName(log.where(F.col("commit") >= before_commit).select("drawing_id", "version"))
    stale = log.where("version is not null").select("drawing_id", "version").distinct().join(kept, ["drawing_id", "version"], "left_anti")
    gone = 0
    for r in stale.toLocalIterator():
        fs, at = _files(spark, f"{path}/rows/version={r.version}/drawing_id={r.drawing_id}")
        gone += bool(fs.delete(at, True))
    return gone


def arriving(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files whose content is not in the catalog yet."""
    keyed = files.withColumn("drawing_id", F.substring(F.sha2("content", 256), 1, 16))
    return keyed.join(catalog.select("drawing_id").distinct(), "drawing_id", "left_anti")
