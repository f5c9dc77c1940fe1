"""Every recipe runs on a drawing and says what it answers."""

import pytest
from pyspark.sql import functions as F

from planline import adapter
from planline.errors import Refusal
from planline.plans import drawing_recipes as R

SF = "/root/testdata/sf0.001"
NEEDED = {"frontage_check": {"road_layers": "Brand#11"}, "vicinity": {"subject_layers": "Brand#11"}, "catchment_coverage": {"amenity_layers": "Brand#11"}}


@pytest.fixture(scope="module")
def drawing(spark):
    paths = adapter.paths(spark, SF).where("layout = 'O'")
    return {"parcels": adapter.parcels(spark, SF), "labels": adapter.labels(spark, SF), "paths": paths, "before": paths.where("type <> 'ARC'")}


def test_every_recipe_answers(drawing):
    registry = R.drawing_registry()
    assert len(registry.catalog()) == 18 and all(r["says"] for r in registry.catalog())
    for name in registry.recipes:
        said = R.answer(registry, drawing, name, NEEDED.get(name))
        assert said.answers and said.params_used.keys() == {p.name for p in registry.recipes[said.recipe].params}
        said.rows.limit(1).collect()


def test_frontage_and_catchment_agree_with_distances(drawing):
    registry = R.drawing_registry()
    rows = R.answer(registry, drawing, "frontage_check", {"parcel_layers": "Brand#12", "road_layers": "Brand#12", "touch_tolerance": 1e6}).rows
    assert rows.where("frontage <> 'established'").count() == 0  # each has another one somewhere
    near = R.answer(registry, drawing, "vicinity", {"subject_layers": "Brand#12", "radius": 200}).rows
    far = R.answer(registry, drawing, "catchment_coverage", {"amenity_layers": "Brand#12", "radius": 200}).rows
    assert near.count() + far.count() == drawing["parcels"].count() and near.join(far, "handle").count() == 0


def test_an_empty_finding_is_asked_once_more(drawing):
    registry = R.drawing_registry()
    said = R.answer(registry, drawing, "outliers", {"z": 50})
    assert not said.settled and said.before.params_used["z"] == 50.0 and said.params_used["z"] == 2.0 and said.before.rows.count() == 0
    assert R.answer(registry, drawing, "outliers", {"z": 1.0}).before is None


def test_a_retry_never_asks_for_less(drawing):
    few = {"parcels": drawing["parcels"].limit(1)}
    said = R.answer(R.drawing_registry(), few, "outliers", {"z": 1.5})
    assert said.before is None and said.settled and said.params_used["z"] == 1.5


def test_dimensions_with_a_given_tolerance(drawing):
    registry = R.drawing_registry()
    said = [R.answer(registry, drawing, "dimension_truth", {"search_radius": 3.0, "tolerance": t}).rows for t in (-1.0, 1e9)]
    assert said[0].count() == drawing["labels"].count() and said[1].where("status in ('differs', 'ambiguous')").count() == 0


def test_bad_envelopes_are_refused(drawing):
    good = R.Envelope("a", "b", {}, "c", drawing["labels"])
    assert good.audit() is good
    for bad in (R.Envelope("a", "", {}, "c", drawing["labels"]), R.Envelope("a", "b", {}, " ", drawing["labels"]), R.Envelope("a", "b", {}, "c", drawing["labels"].select(F.lit(1).alias("x"), F.lit(2).alias("x")))):
        with pytest.raises(Refusal):
            bad.audit()
