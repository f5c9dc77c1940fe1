"""Session for local runs and the settings the engine expects."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | None = None, memory: str = "8g", **more: str) -> SparkSession:
    """A session on this machine's cores; on a cluster use the one that is given."""
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("planline")
    settings = SETTINGS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cpus)} | more
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where all executors can write: ``spark.checkpoint.dir``; a session on one machine may name none."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    return (base or "file://" + tempfile.mkdtemp(prefix="planline-")).rstrip("/")
