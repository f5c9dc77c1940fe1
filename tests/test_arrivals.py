"""Runs closed by event time, whatever the order of arrival, and drawings entered once."""

import datetime as dt
import random

from pyspark.sql import functions as F

from planline.sources import tables
from planline.streaming import arrivals

DDL = "event_id long, ts timestamp, run string, stage string"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ENDED = {"done": "done", "error": "failed"}


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def told(spark, tmp_path, name, batches):
    """Final states of a stream whose files hold the batches, and of the same rows as a table."""
    folder, out = tmp_path / name, str(tmp_path / f"{name}-out")
    for k, batch in enumerate(batches):
        spark.createDataFrame([(i, at(m), r, s) for i, m, r, s in batch], DDL).coalesce(1).write.parquet(str(folder / f"{k:03d}"))
    stream = arrivals.events(spark, str(folder / "*"), spark.createDataFrame([], DDL).schema, files_per_trigger=1).withWatermark("ts", "60 minutes")
    for _ in range(2):  # the second time nothing is new
        arrivals.run_to_end(arrivals.closed_runs(stream, "run", "stage", "30 minutes", ENDED), lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / f"{name}-at"))
    return sorted(map(tuple, spark.read.schema("run string, began timestamp, last timestamp, events long, stage string, state string").parquet(out).select("run", "events", "stage", "state").collect()))


EVENTS = [(1, 0, "a", "parse"), (2, 20, "a", "render"), (3, 25, "a", "done"), (4, 5, "b", "parse"), (5, 30, "b", "parse"), (6, 100, "b", "parse"), (7, 10, "c", "error"), (8, 12, "c", "render"), (9, 400, "z", "parse")]


def test_late_and_repeated_events_give_the_same_final_states(spark, tmp_path):
    want = [("a", 3, "done", "done"), ("b", 1, "parse", "abandoned"), ("b", 2, "parse", "abandoned"), ("c", 2, "render", "failed")]
    first, last = EVENTS[:-1], EVENTS[-1:]
    mixed = first[:]
    random.Random(3).shuffle(mixed)
    assert told(spark, tmp_path, "whole", [first, last]) == want
    # event 6 lies within an hour of all others, so nothing is too late
    assert told(spark, tmp_path, "mixed", [[e for e in mixed if e[0] != 6], mixed[2:5], [e for e in mixed if e[0] == 6], last]) == want
    df = spark.createDataFrame([(i, at(m), r, s) for i, m, r, s in EVENTS + mixed], DDL)
    rows = arrivals.closed_runs(df, "run", "stage", "30 minutes", ENDED).select("run", "events", "stage", "state").where(F.col("run") != "z")
    assert sorted(map(tuple, rows.collect())) == want


def drawing(layer):
    lines = ["0", "SECTION", "2", "ENTITIES", "0", "LINE", "5", "1A", "8", layer, "10", "0", "20", "0", "11", "3", "21", "4", "0", "ENDSEC", "0", "EOF"]
    return "\n".join(lines) + "\n"


def test_each_content_is_entered_once(spark, tmp_path):
    inbox, table, seen = tmp_path / "in", f"file://{tmp_path}/table", str(tmp_path / "seen")
    inbox.mkdir()
    for name, layer in (("a.dxf", "A"), ("copy.dxf", "A"), ("b.dxf", "B")):
        (inbox / name).write_text(drawing(layer))
    arrivals.ingest_arrivals(arrivals.drawings(spark, str(inbox)), table, seen)
    assert sorted(r.layer for r in tables.read_entities(spark, table).collect()) == ["A", "B"]
    (inbox / "late.dxf").write_text(drawing("B"))
    (inbox / "new.dxf").write_text(drawing("C"))
    arrivals.ingest_arrivals(arrivals.drawings(spark, str(inbox)), table, seen)
    assert sorted(r.layer for r in tables.read_entities(spark, table).collect()) == ["A", "B", "C"]
    # a batch run again from the start enters nothing twice
    arrivals.ingest_arrivals(arrivals.drawings(spark, str(inbox)), table, str(tmp_path / "again"))
    assert sorted(r.layer for r in tables.read_entities(spark, table).collect()) == ["A", "B", "C"] and tables.catalog(spark, table).count() == 3
