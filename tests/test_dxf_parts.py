"""The dictionary, header, blocks and inserts of DXF files."""

import math

import pytest

from planline.errors import Refusal
from planline.operators import blocks as B
from planline.sources import dxf

# pairs of code and value, each on two lines in a file
PAIRS = """0 SECTION|2 HEADER|9 $INSUNITS|70 6|9 $EXTMIN|10 1.5|20 -2|0 ENDSEC
0 SECTION|2 TABLES|0 TABLE|2 LAYER|0 LAYER|2 Roads|70 5|62 -3|0 LAYER|2 Plots|70 0|62 7|290 0|0 STYLE|2 Notes|3 romans.shx|0 ENDTAB|0 ENDSEC
0 SECTION|2 BLOCKS|0 BLOCK|2 tree|70 0|10 0|20 0|0 CIRCLE|5 A1|8 Plots|10 0|20 0|40 1|0 ENDBLK|0 BLOCK|2 site|70 4|1 other.dwg|10 3|20 4|0 ENDBLK
0 BLOCK|2 row|70 0|10 0|20 0|0 INSERT|5 A2|2 tree|10 5|20 0|0 ENDBLK|0 ENDSEC
0 SECTION|2 ENTITIES|0 INSERT|5 B1|2 row|10 100|20 0|50 90|0 INSERT|5 B2|2 tree|10 0|20 0|70 2|71 3|44 10|45 20|0 ENDSEC|0 EOF"""
TEXT = "".join(pair.replace(" ", "\n", 1) + "\n" for pair in PAIRS.replace("\n", "|").split("|"))


def test_parts_of_a_file(spark, tmp_path):
    (tmp_path / "a.dxf").write_text(TEXT)
    read = lambda part: [r.asDict() for r in dxf.read_parts(spark, str(tmp_path), part).drop("drawing_id", "path").collect()]
    names = {r["name"]: r for r in read("dictionary")}
    assert names["Roads"] == {"kind": "LAYER", "name": "Roads", "font": None, "frozen": True, "off": True, "locked": True, "plots": True}
    assert not names["Plots"]["off"] and not names["Plots"]["plots"] and names["Notes"]["font"] == "romans.shx"
    assert {r["name"]: r["value"] for r in read("header")} == {"$INSUNITS": "6", "$EXTMIN": "1.5 -2"}
    assert [(r["name"], r["xref"]) for r in read("blocks")] == [("tree", None), ("site", "other.dwg"), ("row", None)]
    rows = read("inserts")
    assert len(rows) == 8 and [r["x"] for r in rows if r["block"] == "[block] row"] == [100.0]
    assert sorted((r["x"], r["y"]) for r in rows if r["container"] == "Model" and r["block"] == "[block] tree") == [(x, y) for x in (0, 10) for y in (0, 20, 40)]


def test_expansion_and_placements(spark, tmp_path):
    (tmp_path / "a.dxf").write_text(TEXT)
    inserts = dxf.read_parts(spark, str(tmp_path), "inserts")
    roots = spark.createDataFrame([("Model",)], "root string")
    times = {r.block: int(r.times) for r in B.multiplicity(inserts, roots, 10).collect()}
    assert times == {"Model": 1, "[block] row": 1, "[block] tree": 7}
    circles = spark.createDataFrame([("[block] tree",)], "container string")
    assert B.expanded_counts(circles, inserts, roots, 10).first().entities == 7
    row = {r.block: r for r in B.placements(inserts, roots, 10).collect()}
    assert row["[block] row"].status == "placed" and row["[block] tree"].status == "ambiguous" and row["[block] tree"].placements == 7
    assert math.isclose(row["[block] row"].b, 1.0) and row["[block] row"].e == 100.0


def test_circles_are_refused(spark):
    ring = spark.createDataFrame([("a", "b", 0.0, 0.0, 0.0, 1.0, 1.0), ("b", "a", 1.0, 0.0, 0.0, 1.0, 1.0)], "container string, block string, x double, y double, angle double, sx double, sy double")
    with pytest.raises(Refusal):
        B.multiplicity(ring, spark.createDataFrame([("a",)], "root string"), 2)
