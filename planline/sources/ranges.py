"""DXF files read by byte ranges, so that a large file is many tasks and no task holds it.

A DXF file is pairs of lines, so what a line means depends on how many lines stand before
it, and what an entity belongs to depends on the last section and block that began before
it. Two passes over the ranges settle both: the first counts each range's lines and notes
the section and block it leaves open, once for each parity its first line may have; a
running sum over a file's ranges (one row each) picks the right one; the second yields the
entities that begin in a range and reads on past its end for the last of them.

Damage is reported in rows and read past: a code that is no number, a value that should be
a number and is none, a file that ends inside a pair, a file without its end mark. Spark lists no file of length 0.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of a range. A task holds the lines of one range in its first pass.
SPLIT_BYTES = 16 << 20
#: Tasks for each core of the session, if the bytes ask for no more.
TASKS_A_CORE = 4
#: Bytes of binary columns that a task gathers before it hands rows on.
MOST_HELD = 8 << 20
_BLOCK = 1 << 20

#: Drawing errors: what is wrong with a pair, and whether it was read all the same.
ISSUE_DDL = "line long, problem string, code string, value string"


@dataclass
class Fragment:
    """What stands between two pairs of code 0: an entity, a table entry or a section's opening."""

    line: int
    section: str | None
    block: str | None
    kind: str
    items: list[tuple[int, str]]
    issues: list[tuple[int, str, str, str]]

    def first(self, code: int) -> str | None:
        return next((v for c, v in self.items if c == code), None)


def open_file(path: str):
    """A file of any store that Arrow can open, by the path that Spark gives."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest or len(scheme) < 2:
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/") if scheme == "file" else path)
    from urllib.parse import quote

    store, place = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(place)


def lines_from(file, start: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin at ``start`` or later, to the end of the file."""
    at = start
    if start:  # a line begins here only if the byte before ends one
        file.seek(start - 1)
        skip = True
        at = start - 1
    else:
        file.seek(0)
        skip = False
    rest: list[bytes] = []
    while block := file.read(_BLOCK):
        parts = block.split(b"\n")
        if len(parts) == 1:
            rest.append(block)
            continue
        parts[0] = b"".join([*rest, parts[0]])
        rest = [parts.pop()]
        for line in parts:
            if skip:
                skip = False
            else:
                yield at, line.strip()
            at += len(line) + 1
    last = b"".join(rest)
    if last and not skip:
        yield at, last.strip()


_OPENS, _SHUTS = {b"SECTION": 0, b"BLOCK": 1}, {b"ENDSEC": 0, b"EOF": 0, b"ENDBLK": 1}


def scan_range(file, start: int, end: int) -> dict:
    """Lines that begin in the range and, for each parity, the section and block left open ('' none, None unchanged)."""
    lines = lines_from(file, start)
    held: list[bytes] = []
    owned = 0
    for at, line in lines:
        held.append(line)
        if at >= end:
            break
        owned += 1

    def get(k: int) -> bytes | None:
        while k >= len(held):
            following = next(lines, None)
            if following is None:
                return None
            held.append(following[1])
        return held[k]

    left: list[list[str | None]] = []
    for parity in (0, 1):
        state: list[str | None] = [None, None]
        for k in range(parity, owned, 2):
            if held[k] != b"0":
                continue
            kind = get(k + 1)
            if kind in _SHUTS:
                state[_SHUTS[kind]] = ""
            elif kind in _OPENS:
                j = k + 2
                while (code := get(j)) is not None and code not in (b"0", b"2"):
                    j += 2
                name = get(j + 1) if code == b"2" else None
                state[_OPENS[kind]] = (name or b"").decode("utf-8", "replace")
        left.append(state)
    return {"lines": owned, "section0": left[0][0], "block0": left[0][1], "section1": left[1][0], "block1": left[1][1]}


def fragments(file, start: int, end: int, lines_before: int, section: str | None, block: str | None) -> Iterator[Fragment]:
    """Fragments whose code 0 begins in the range, in order; the last one is read to its end."""
    lines = lines_from(file, start)
    number = lines_before
    if lines_before % 2 and next(lines, None) is not None:
        number += 1
    now: Fragment | None = None
    while (head := next(lines, None)) is not None:
        at, raw = head
        if at >= end and now is None and start:
            break
        tail = next(lines, None)
        starts = raw == b"0" and tail is not None
        if at >= end and starts:
            break
        if tail is None:
            if now is not None and raw and now.kind != "EOF":
                now.issues.append((number, "cut_off", raw.decode("utf-8", "replace"), ""))
            continue
        text = tail[1].decode("utf-8", "replace")
        if starts:
            if now is not None:
                yield now
            if text in ("ENDSEC", "EOF"):
                section = None
            if text == "ENDBLK":
                block = None
            now = Fragment(number, section, block, text, [], [])
        elif now is not None and now.kind != "EOF":
            code = raw.decode("ascii", "replace")
            if code.lstrip("-").isdigit():
                if code == "2" and now.kind == "SECTION" and now.first(2) is None:
                    section = now.section = text
                elif code == "2" and now.kind == "BLOCK" and now.first(2) is None:
                    block = now.block = text
                now.items.append((int(code), text))
            else:
                now.issues.append((number, "code_not_a_number", code, text))
        number += 2
    else:  # the file ends here, and with it the fragment that this range began, if any
        if now is None and start == 0:
            now = Fragment(number, None, None, "", [], [])
        if now is not None and now.kind != "EOF":
            now.issues.append((number, "no_end_mark", "", ""))
    if now is not None:
        yield now


def _tasks(spark: SparkSession, pieces: DataFrame, size: str, split_bytes: int) -> int:
    """Into how many tasks to deal pieces: one for ``split_bytes`` bytes, so that small files share tasks, but enough for all cores."""
    n = pieces.agg(F.count(F.lit(1)).alias("pieces"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return max(1, min(n.pieces, max(n.bytes // split_bytes + 1, TASKS_A_CORE * spark.sparkContext.defaultParallelism)))


def _ranges(spark: SparkSession, path: str, split_bytes: int) -> tuple[DataFrame, int]:
    """path, start, end of each range and the number of tasks; contents are not read for the listing."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    cut = files.select("path", "length", F.explode(starts).alias("start"))
    cut = cut.select("path", "length", "start", F.least(F.col("start") + split_bytes, F.col("length")).alias("end"))
    return cut, _tasks(spark, cut.withColumn("bytes", F.col("end") - F.col("start")), "bytes", split_bytes)


_SCAN = "path string, length long, start long, end long, lines long, section0 string, block0 string, section1 string, block1 string"
_STATE_DDL = "path string, length long, start long, end long, before long, section string, block string"


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of columns in DDL; on the driver, as it asks the session."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def states(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, int]:
    """Each range with the lines before it and the section and block open where it begins; and into how many tasks to deal them."""
    cut, tasks = _ranges(spark, path, split_bytes)
    schema = arrow_schema(_SCAN)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open_file(r["path"]) as file:
                    yield pa.RecordBatch.from_pylist([r | scan_range(file, r["start"], r["end"])], schema=schema)

    scanned = cut.repartition(tasks).mapInArrow(scan, _SCAN)
    by_file = Window.partitionBy("path").orderBy("start")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    counted = scanned.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    odd = F.col("before") % 2 == 1
    picked = counted.withColumn("s", F.when(odd, F.col("section1")).otherwise(F.col("section0"))).withColumn("b", F.when(odd, F.col("block1")).otherwise(F.col("block0")))
    entering = lambda c: F.nullif(F.last(c, ignorenulls=True).over(before), F.lit(""))
    ready = picked.withColumn("section", entering("s")).withColumn("block", entering("b"))
    return ready.select(*[c.split()[0] for c in _STATE_DDL.split(", ")]), tasks


def read_fragments(spark: SparkSession, path: str, rows_of: Callable[[Fragment], Iterator[dict]], ddl: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``path`` and the rows that ``rows_of`` makes of each fragment of all files under a path or glob."""
    out = f"path string, {ddl}"
    schema = arrow_schema(out)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows: list[dict] = []
                held = 0
                with open_file(r["path"]) as file:
                    for f in fragments(file, r["start"], r["end"], r["before"], r["section"], r["block"]):
                        for row in rows_of(f):
                            rows.append({"path": r["path"]} | row)
                            held += len(row.get("data") or b"")
                            if len(rows) >= 4096 or held >= MOST_HELD:
                                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                                rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ready, tasks = states(spark, path, split_bytes)
    return ready.repartition(tasks).mapInArrow(parse, out)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            digest = hashlib.sha256()
            with open_file(path) as file:
                while block := file.read(_BLOCK):
                    digest.update(block)
            yield pa.RecordBatch.from_pydict({"path": [path], "drawing_id": [digest.hexdigest()[:16]]})


def drawing_ids(spark: SparkSession, path: str) -> DataFrame:
    """path, drawing_id: the first 16 digits of SHA-256 of the content, which is one chain and so one task a file, a megabyte at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.select("path").repartition(_tasks(spark, files, "length", SPLIT_BYTES)).mapInArrow(_hash, "path string, drawing_id string")


def number(text: str) -> float | None:
    """A finite number, or None."""
    try:
        value = float(text)
    except ValueError:
        return None
    return value if math.isfinite(value) else None


def is_coordinate(code: int) -> bool:
    """Group codes whose values are real numbers: coordinates, lengths, angles."""
    return 10 <= code <= 59 or 210 <= code <= 239


def repaired(f: Fragment) -> Fragment:
    """The fragment without values that should be numbers and are none; each is an issue."""
    bad = [(c, v) for c, v in f.items if is_coordinate(c) and number(v) is None]
    if bad:
        f.issues += [(f.line, "value_not_a_number", str(c), v) for c, v in bad]
        f.items = [(c, v) for c, v in f.items if not (is_coordinate(c) and number(v) is None)]
    return f


def read_issues(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, line, problem, code, value: what is wrong in each file; nothing of it stops a read."""

    def issues(f: Fragment) -> Iterator[dict]:
        for line, problem, code, value in repaired(f).issues:
            yield {"line": line, "problem": problem, "code": code, "value": value}

    return read_fragments(spark, path, issues, ISSUE_DDL, split_bytes)
