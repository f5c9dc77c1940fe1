"""DXF files cut into byte ranges at any place give the rows of the whole file."""

import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from planline.sources import dxf, ranges

PAIRS = """999 made by hand|0 SECTION|2 HEADER|9 $INSUNITS|70 6|0 ENDSEC|0 SECTION|2 BLOCKS|0 BLOCK|5 7|8 0|2 DOOR|70 0|0 LINE|5 B1|8 0|10 0|20 0|11 3|21 4|0 ENDBLK|0 ENDSEC
0 SECTION|2 ENTITIES|0 TEXT|5 A0|8 0|1 0|10 1|20 2|0 LWPOLYLINE|5 A1|8 PLOTS|70 1|10 0|20 0|10 4|20 0|10 4|20 3|10 0|20 3|0 CIRCLE|5 A2|8 ZEROS|10 5|20 5|40 2|0 ENDSEC|0 EOF"""


def lines(pairs: str) -> str:
    return "".join(pair.replace(" ", "\n", 1) + "\n" for pair in pairs.replace("\n", "|").split("|"))


TEXT = lines(PAIRS)


def cut(data: bytes, borders: list[int]) -> list[tuple]:
    """The fragments of a file cut at the borders, by the two passes."""
    edges = sorted({0, len(data), *borders})
    out, before, section, block = [], 0, None, None
    for a, b in zip(edges, edges[1:]):
        out += [(f.line, f.section, f.block, f.kind, tuple(f.items), tuple(f.issues)) for f in ranges.fragments(io.BytesIO(data), a, b, before, section, block)]
        scan = ranges.scan_range(io.BytesIO(data), a, b)
        s, k = scan[f"section{before % 2}"], scan[f"block{before % 2}"]
        section, block = section if s is None else s or None, block if k is None else k or None
        before += scan["lines"]
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_cut_gives_the_same_fragments(end):
    data = TEXT.replace("\n", end).encode()
    whole = cut(data, [])
    assert [f[3] for f in whole if f[1] == "ENTITIES"] == ["SECTION", "TEXT", "LWPOLYLINE", "CIRCLE"]
    for at in range(1, len(data)):
        assert cut(data, [at]) == whole, at
    for step in (1, 2, 3, 7, 31):
        assert cut(data, list(range(step, len(data), step))) == whole, step


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from(["0", "SECTION", "2", "ENTITIES", "BLOCK", "ENDBLK", "ENDSEC", "EOF", "x", "", "10", "1.5"]), max_size=40), st.lists(st.integers(1, 120), max_size=6))
def test_broken_files_cut_anywhere(words, borders):
    data = "\n".join(words).encode()
    if data:
        assert cut(data, [b for b in borders if b < len(data)]) == cut(data, [])


def test_split_files_through_spark(spark, tmp_path):
    (tmp_path / "a b.dxf").write_text(TEXT)
    (tmp_path / "c.dxf").write_text(TEXT.replace("PLOTS", "Ünits"))
    (tmp_path / "d.dxf").write_text("junk")
    whole = sorted(map(repr, dxf.read_dxf(spark, str(tmp_path)).collect()))
    assert len(whole) == 8 and sum("ring_status='complete', ring=[Row" in r for r in whole) == 2
    assert sorted(map(repr, dxf.read_dxf(spark, str(tmp_path), 41).collect())) == whole
    assert [tuple(r)[1:] for r in ranges.read_issues(spark, str(tmp_path), 41).collect()] == [(0, "no_end_mark", "", "")]


def test_damage_is_reported_and_read_past(spark, tmp_path):
    broken = "0 SECTION|2 ENTITIES|0 LINE|5 A1|10 zero|20 0|11 3|21 4|0 CIRCLE|5 A2|1O 7|10 1|20 1|40 nan|0 TEXT|5 A3|10 2|20 2|1 ok"
    (tmp_path / "a.dxf").write_text(lines(broken) + "8\n")
    for size in (1 << 20, 13):
        rows = {r.handle: r for r in dxf.read_dxf(spark, str(tmp_path), size).collect()}
        assert set(rows) == {"A1", "A2", "A3"} and rows["A1"].length is None and rows["A2"].area is None and rows["A3"].text == "ok"
        found = {(r.line, r.problem, r.code, r.value) for r in ranges.read_issues(spark, str(tmp_path), size).collect()}
        assert found == {(4, "value_not_a_number", "10", "zero"), (20, "code_not_a_number", "1O", "7"), (16, "value_not_a_number", "40", "nan"), (38, "cut_off", "8", ""), (38, "no_end_mark", "", "")}
