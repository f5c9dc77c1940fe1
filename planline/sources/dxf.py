"""DXF text files as entity rows.

A DXF file is pairs of lines, a group code and a value. ``read_dxf`` deals files to tasks by
byte ranges (:mod:`planline.sources.ranges`) and returns one row for each top-level entity
of the ENTITIES section and of named blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from planline.sources import ranges

ENTITY_DDL = (
    "drawing_id string, path string, handle string, type string, layer string, layout string, block_name string, text string, "
    "length double, area double, ring_status string, ring array<struct<x:double,y:double>>, anchor_point struct<x:double,y:double>, "
    "minx double, miny double, maxx double, maxy double"
)

Pair = tuple[int, str]


def pairs(text: str) -> Iterator[Pair]:
    """(code, value) of each pair of lines; a file cut off inside a pair ends before it."""
    lines = text.splitlines()
    for k in range(0, len(lines) - 1, 2):
        code = lines[k].strip()
        if code.lstrip("-").isdigit():
            yield int(code), lines[k + 1].strip()


def truncated(text: str) -> str | None:
    """Why a file is incomplete, or None."""
    tail = text.rstrip().splitlines()[-1:] or [""]
    return None if tail[0].strip() == "EOF" else "no EOF mark at the end"


def _groups(items: list[Pair], code: int, second: int) -> list[tuple[float, float]]:
    xs = [float(v) for c, v in items if c == code]
    ys = [float(v) for c, v in items if c == second]
    return list(zip(xs, ys))


def _shoelace(ring: list[tuple[float, float]]) -> float:
    x0, y0 = ring[0]
    return abs(sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def entity(kind: str, items: list[Pair], layout: str) -> dict:
    """Columns of one entity from its pairs; what its type has not is None."""
    first = lambda code: next((v for c, v in items if c == code), None)
    row: dict = {"handle": first(5), "type": kind, "layer": first(8) or "0", "layout": layout}
    points = _groups(items, 10, 20)
    box = points + _groups(items, 11, 21)
    if kind == "LINE" and len(points) == 1 and _groups(items, 11, 21):
        row["length"] = math.dist(points[0], _groups(items, 11, 21)[0])
    elif kind in ("CIRCLE", "ARC") and points and first(40) is not None:
        r, (x, y) = float(first(40)), points[0]
        box = [(x - r, y - r), (x + r, y + r)]
        if kind == "CIRCLE":
            row |= {"length": 2 * math.pi * r, "area": math.pi * r * r}
        else:
            sweep = (float(first(51) or 0) - float(first(50) or 0)) % 360
            row["length"] = math.radians(sweep) * r
    elif kind in ("LWPOLYLINE", "POLYLINE") and points:
        closed = bool(int(first(70) or 0) & 1)
        bulged = any(c == 42 and float(v) != 0 for c, v in items)
        ring = [p for k, p in enumerate(points) if k == 0 or p != points[k - 1]]
        if closed and len(ring) > 1 and ring[0] == ring[-1]:
            ring.pop()
        row["ring_status"] = "bulge" if bulged else "open" if not closed else "degenerate" if len(ring) < 3 else "complete"
        if not bulged:
            row["length"] = sum(math.dist(a, b) for a, b in zip(ring, ring[1:] + (ring[:1] if closed else [])))
        if row["ring_status"] == "complete":
            row |= {"ring": [{"x": x, "y": y} for x, y in ring], "area": _shoelace(ring)}
    elif kind in ("TEXT", "MTEXT", "INSERT") and points:
        row["anchor_point"] = {"x": points[0][0], "y": points[0][1]}
        row["text"] = first(1) if kind != "INSERT" else None
        row["block_name"] = first(2) if kind == "INSERT" else None
    if box:
        xs, ys = zip(*box)
        row |= {"minx": min(xs), "miny": min(ys), "maxx": max(xs), "maxy": max(ys)}
    return row


def entities(text: str) -> Iterator[dict]:
    """Entities of the ENTITIES section (layout Model) and of blocks (layout '[block] name')."""
    section, block, kind, items = None, None, None, []

    def done():
        if kind and section in ("ENTITIES", "BLOCKS") and kind not in ("SECTION", "BLOCK", "ENDBLK", "ENDSEC", "SEQEND", "VERTEX"):
            layout = "Model" if section == "ENTITIES" else f"[block] {block}"
            if section == "ENTITIES" or block:
                yield entity(kind, items, layout)

    for code, value in pairs(text):
        if code == 0:
            yield from done()
            if value in ("ENDSEC", "EOF"):
                section = None
            if value == "ENDBLK":
                block = None
            kind, items = value, []
            continue
        if kind == "SECTION" and code == 2:
            section = value
        elif kind == "BLOCK" and code == 2:
            block = value
        items.append((code, value))
    yield from done()


def drawing_id(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    names = ["drawing_id", "path", "handle", "type", "layer", "layout", "block_name", "text", "length", "area", "ring_status", "ring", "anchor_point", "minx", "miny", "maxx", "maxy"]
    special = {"ring": pa.list_(point), "anchor_point": point}
    schema = pa.schema([(n, special.get(n, pa.float64() if n in ("length", "area", "minx", "miny", "maxx", "maxy") else pa.string())) for n in names])
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            base = {"drawing_id": drawing_id(data), "path": path}
            rows: list[dict] = []
            for e in entities(data.decode("utf-8", "replace")):
                rows.append({n: (base | e).get(n) for n in names})
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


#: Kinds that are no entities of their own.
_FRAMES = ("SECTION", "BLOCK", "ENDBLK", "ENDSEC", "SEQEND", "VERTEX")


def entity_rows(f: ranges.Fragment) -> Iterator[dict]:
    """The row of a fragment of the ENTITIES section or of a block; values that cannot be read are left out of it."""
    if f.section in ("ENTITIES", "BLOCKS") and f.kind not in _FRAMES and (f.section == "ENTITIES" or f.block):
        yield entity(f.kind, ranges.repaired(f).items, "Model" if f.section == "ENTITIES" else f"[block] {f.block}")


def read_dxf(spark: SparkSession, path: str, split_bytes: int = ranges.SPLIT_BYTES) -> DataFrame:
    """Entity rows of all files under a path or glob, by byte ranges; damage is read past (:func:`ranges.read_issues`)."""
    ddl = ENTITY_DDL.replace("drawing_id string, path string, ", "")
    rows = ranges.read_fragments(spark, path, entity_rows, ddl, split_bytes)
    return rows.join(ranges.drawing_ids(spark, path), "path").select("drawing_id", *rows.columns)


# Group codes of the dictionary tables. 70 of a layer: 1 frozen, 4 locked; a negative colour (62) is off; 290 = 0 is not plotted.
_TABLES = ("LAYER", "STYLE", "LTYPE", "DIMSTYLE")


def _whole(text: str | None, missing: int) -> int:
    """A whole number, ``missing`` where none can be read."""
    return int(text) if text is not None and text.lstrip("-").isdigit() else missing


def dictionary(f: ranges.Fragment) -> Iterator[dict]:
    """Layers, text styles, linetypes and dimension styles: kind, name, font, frozen, off, locked, plots."""
    if f.section == "TABLES" and f.kind in _TABLES and f.first(2) is not None:
        flags, layer = _whole(f.first(70), 0), f.kind == "LAYER"
        yield {
            "kind": f.kind, "name": f.first(2), "font": f.first(3) if f.kind == "STYLE" else None, "frozen": bool(flags & 1) if layer else None,
            "off": _whole(f.first(62), 7) < 0 if layer else None, "locked": bool(flags & 4) if layer else None, "plots": f.first(290) != "0" if layer else None,
        }


def header(f: ranges.Fragment) -> Iterator[dict]:
    """Header variables, name and value; of a point the coordinates, joined by blanks."""
    if f.kind != "SECTION" or f.section != "HEADER":
        return
    name, values = None, []
    for code, value in [*f.items, (9, "")]:
        if code == 9:
            if name and values:
                yield {"name": name, "value": " ".join(values)}
            name, values = value, []
        else:
            values.append(value)


def block_records(f: ranges.Fragment) -> Iterator[dict]:
    """Block definitions: name, base point, and the file of an external reference (flags 4 or 8) with whether it is an overlay."""
    if f.kind == "BLOCK" and f.first(2) is not None:
        f = ranges.repaired(f)
        flags = _whole(f.first(70), 0)
        yield {"name": f.first(2), "x": float(f.first(10) or 0), "y": float(f.first(20) or 0), "xref": f.first(1) or None if flags & 12 else None, "overlay": bool(flags & 8)}


def inserts(f: ranges.Fragment) -> Iterator[dict]:
    """INSERTs with their move: container, block, x, y, angle (radians), sx, sy; one for each row and column of an array."""
    if f.kind != "INSERT" or f.section not in ("ENTITIES", "BLOCKS"):
        return
    f = ranges.repaired(f)
    number = lambda code, missing=0.0: float(f.first(code) or missing)
    angle = math.radians(number(50))
    container = "Model" if f.section == "ENTITIES" else f"[block] {f.block}"
    for i in range(max(1, _whole(f.first(71), 1))):
        for j in range(max(1, _whole(f.first(70), 1))):
            across, up = j * number(44), i * number(45)
            x = number(10) + across * math.cos(angle) - up * math.sin(angle)
            y = number(20) + across * math.sin(angle) + up * math.cos(angle)
            yield {"container": container, "block": f"[block] {f.first(2)}", "x": x, "y": y, "angle": angle, "sx": number(41, 1.0), "sy": number(42, 1.0)}


def table_cells(f: ranges.Fragment) -> Iterator[dict]:
    """Cells of an ACAD_TABLE (91 rows, 92 columns, 302 or 1 the cells in row order) with the line where the table begins."""
    if f.kind != "ACAD_TABLE":
        return
    rows, columns, cell = 0, 0, 0
    for code, value in f.items:
        if code == 91 and not rows:
            rows = _whole(value, 0)
        elif code == 92 and not columns:
            columns = _whole(value, 0)
        elif code in (1, 302) and columns and cell < rows * columns:
            yield {"number": f.line, "row": cell // columns, "column": cell % columns, "text": value}
            cell += 1


#: What each reader of :func:`read_parts` yields.
_PARTS = {
    "dictionary": (dictionary, "kind string, name string, font string, frozen boolean, off boolean, locked boolean, plots boolean"),
    "header": (header, "name string, value string"),
    "blocks": (block_records, "name string, x double, y double, xref string, overlay boolean"),
    "inserts": (inserts, "container string, block string, x double, y double, angle double, sx double, sy double"),
    "tables": (table_cells, "number long, row int, column int, text string"),
}


def read_parts(spark: SparkSession, path: str, part: str, split_bytes: int = ranges.SPLIT_BYTES) -> DataFrame:
    """drawing_id, path and the rows of one part of all files: dictionary, header, blocks, inserts or tables (numbered by the line where they begin)."""
    rows_of, ddl = _PARTS[part]
    rows = ranges.read_fragments(spark, path, rows_of, ddl, split_bytes)
    return rows.join(ranges.drawing_ids(spark, path), "path").select("drawing_id", *rows.columns)
