"""Stored dossiers: counted, proved, made anew only where the entities changed."""

import pytest

from planline.errors import Refusal
from planline.operators import dossier as D
from planline.sources import tables as T

DDL = "drawing_id string, layer string, layout string, type string, handle string, area double, length double"


def drawing(name, *rows):
    return [(name, layer, layout, kind, str(k), area, length) for k, (layer, layout, kind, area, length) in enumerate(rows)]


ONE = drawing("d1", ("A", "Model", "LINE", None, 2.0), ("A", "Model", "ARC", None, None), ("A", "Model", "TEXT", None, None), ("B", "Sheet", "LWPOLYLINE", 4.0, 8.0), ("B", "Sheet", "LWPOLYLINE", 0.0, 1.0), (None, None, None, None, None))
TWO = drawing("d2", ("A", "Model", "INSERT", None, None))


def test_buckets(spark):
    got = {(r.drawing_id, r.layer): r for r in D.buckets(spark.createDataFrame(ONE + TWO, DDL)).collect()}
    a, b, none = got["d1", "A"], got["d1", "B"], got["d1", None]
    assert (a.entities, a.role, a.length_measured, a.length_sum, a.length_total) == (3, "network", 1, 2.0, None)
    assert [tuple(t) for t in a.types] == [("ARC", 1), ("LINE", 1), ("TEXT", 1)]
    assert (b.role, b.area_total, b.length_total) == ("region", 4.0, 9.0) and none.entities == 1 and none.role == "other"
    assert D.buckets(spark.createDataFrame([], DDL)).count() == 0


def test_coverage_is_never_assumed(spark):
    made = D.buckets(spark.createDataFrame(ONE + TWO, DDL))
    stated = spark.createDataFrame([("d1", "v", 7), ("d2", "v", 0), ("d3", "v", 0), ("d4", "v", None)], "drawing_id string, version string, total long")
    got = {r.drawing_id: (r.difference, r.verdict, r.complete) for r in D.coverage(made, stated).collect()}
    assert got == {"d1": (1, "entities in no bucket", False), "d2": (-1, "entities counted twice", False), "d3": (0, "complete", True), "d4": (None, "no total", False)}


def test_only_what_changed_is_made_anew(spark, tmp_path):
    entities, stored = str(tmp_path / "entities"), str(tmp_path / "dossiers")
    status = lambda: {r.drawing_id: (r.status, r.accounted, r.complete) for r in D.heads(spark, entities, stored).collect()}
    T.write_entities(spark.createDataFrame(ONE + TWO, DDL), entities)
    assert status() == {"d1": ("not_computed", None, None), "d2": ("not_computed", None, None)}
    assert D.backfill(spark, entities, stored, strict=True) and not D.backfill(spark, entities, stored)
    assert status() == {"d1": ("computed", 6, True), "d2": ("computed", 1, True)}
    version = {r.drawing_id: r.version for r in T.catalog(spark, stored).collect()}
    T.write_entities(spark.createDataFrame(TWO * 3, DDL), entities)
    assert status()["d2"] == ("stale", 1, True)
    assert D.backfill(spark, entities, stored) and status()["d2"] == ("computed", 3, True)
    after = {r.drawing_id: r.version for r in T.catalog(spark, stored).collect()}
    assert after["d1"] == version["d1"] and after["d2"] != version["d2"]
    assert D.read_buckets(spark, stored).where("drawing_id = 'd2'").first().entities == 3


def test_strict_stores_nothing_that_is_not_whole(spark, tmp_path, monkeypatch):
    entities, stored = str(tmp_path / "entities"), str(tmp_path / "dossiers")
    T.write_entities(spark.createDataFrame(ONE, DDL), entities)
    monkeypatch.setattr(D, "buckets", lambda rows, real=D.buckets: real(rows.where("layer = 'A'")))
    with pytest.raises(Refusal):
        D.backfill(spark, entities, stored, strict=True)
    assert D.heads(spark, entities, stored).first().status == "not_computed"
