"""Removal of repeated 400-byte strings by sparse suffix arrays.

Every 400-byte window is filed under its anchor: the leftmost place in it of the
64-byte string with the least hash. Windows with equal bytes have the same anchor at
the same offset, so they are found among contexts (the bytes all windows of one
anchor cover) whose anchors begin alike. Equal contexts are one, with a count; an
anchor that stands alone has no repeat. The rest are sorted by deep-shallow sorting,
what follows the anchors as suffixes and what precedes them reversed; two windows
agree if both sorted neighbourhoods say so. A hot anchor with more than
``MOST_CONTEXTS`` different contexts is split by offset into shorter contexts, down to
single windows if need be, whose counts need no sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planline.llm.shared import dropped, mix64, only, slices, written
from planline.llm.suffix_sort import deep_shallow_sort

WINDOW = 400
GRAM = 64
#: Most different contexts of an anchor that one task sorts together.
MOST_CONTEXTS = 512
#: Offsets of one part when an anchor is split; then single windows.
PART = 16
SEGMENT = 1 << 20


def _row_key(doc_id: int | None, data: bytes) -> bytes:
    return hashlib.md5(f"{doc_id}|".encode() + data).digest()


def anchors(raw: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor's hash) of each run of windows with one anchor.

    ``raw`` holds texts in a row, up to ``SEGMENT`` bytes; ``ends`` where they end. No window
    crosses an end.
    """
    none = np.zeros(0, dtype=np.int64)
    n, span = len(raw), window - GRAM + 1
    if n < window:
        return none, none, none, np.zeros(0, dtype=np.uint64)
    padded = np.concatenate((raw, np.zeros(8, dtype=np.uint8)))
    h = mix64(np.ndarray(n, dtype="<u8", buffer=padded, strides=(1,)).astype(np.uint64))
    step = 8
    while step < GRAM:
        h = mix64(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        step *= 2
    h = h[: n - GRAM + 1]
    place = np.uint64(SEGMENT - 1)
    keyed = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    # sliding minimum over ``span`` by prefix and suffix minima of blocks
    blocks = -(-len(keyed) // span)
    full = np.full(blocks * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(keyed)] = keyed
    grid = full.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = n - window + 1
    at = (np.minimum(back[:count], ahead[span - 1 : span - 1 + count]) & place).astype(np.int64)
    whole = np.ones(count, dtype=bool)
    for e in ends.tolist():  # windows over an end
        whole[max(0, e - window + 1) : e] = False
    turn = np.concatenate(([True], (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])))
    first = np.flatnonzero(turn)
    last = np.concatenate((first[1:], [count])) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    return first, last, at[first], h[at[first]]


_ANCHORS = "row binary, begin long, windows int, offset int, anchor long, context binary"


def _find(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held: list[tuple[bytes, int, bytes]] = []  # row, place in its text, bytes
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode("utf-8", "replace")
                if len(data) < window:
                    continue
                row = _row_key(doc, data)
                # a text beyond a segment is cut so that each window is whole in one piece
                for k in range(0, len(data) - window + 1, SEGMENT - window + 1):
                    piece = data[k : k + SEGMENT]
                    if held and size + len(piece) > SEGMENT:
                        yield _segment(held, window)
                        held, size = [], 0
                    held.append((row, k, piece))
                    size += len(piece)
            if held:
                yield _segment(held, window)

    return run


def _segment(held: list[tuple[bytes, int, bytes]], window: int) -> pa.RecordBatch:
    whole = b"".join(p for _, _, p in held)
    ends = np.cumsum([len(p) for _, _, p in held])
    first, last, at, hashes = anchors(np.frombuffer(whole, dtype=np.uint8), ends, window)
    which = np.searchsorted(ends, first, side="right")
    shift = np.array([k for _, k, _ in held]) - (ends - np.array([len(p) for _, _, p in held]))
    context = [xxhash.xxh3_128_digest(whole[a : b + window]) for a, b in zip(first.tolist(), last.tolist())]
    rows = [r for r, _, _ in held]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[k] for k in which.tolist()], pa.binary()),
            pa.array(first + shift[which], pa.int64()),
            pa.array((last - first + 1).astype(np.int32), pa.int32()),
            pa.array((at - first).astype(np.int32), pa.int32()),
            pa.array(hashes.astype(np.int64), pa.int64()),
            pa.array(context, pa.binary()),
        ],
        ["row", "begin", "windows", "offset", "anchor", "context"],
    )


def _cut(window: int):
    """Bytes of contexts, from texts and the places asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "replace")
                for a in asked:
                    out.append((a["anchor"], a["context"], a["offset"], a["weight"], data[a["begin"] : a["begin"] + a["windows"] - 1 + window]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()))],
                ["anchor", "context", "offset", "weight", "bytes"],
            )

    return run


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def repeated_windows(contexts: list[bytes], offsets: list[int], weights: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For each context, which of its windows also stand in another, or in itself by its weight."""
    n = len(contexts)
    offset, weight = np.array(offsets), np.array(weights)
    windows = np.array([len(c) for c in contexts]) - window + 1
    hits = [np.zeros(w, dtype=bool) for w in windows.tolist()]
    right, right_lcp = deep_shallow_sort([c[o:] for c, o in zip(contexts, offsets)])
    left, left_lcp = deep_shallow_sort([c[:o][::-1] for c, o in zip(contexts, offsets)])
    right_class, left_class = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for before in range(int(offset.max(initial=-1)) + 1):  # bytes of the window before its anchor
        at = offset - before
        has = np.flatnonzero((at >= 0) & (at < windows))
        if not len(has):
            continue
        right_class[right] = np.cumsum(right_lcp < window - before)
        left_class[left] = np.cumsum(left_lcp < before)
        both = right_class[has] * (n + 1) + left_class[has]
        ranks = np.argsort(both, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(both[ranks]) != 0)))
        total = np.repeat(np.add.reduceat(weight[has][ranks], cut), np.diff(np.append(cut, len(has))))
        for k in has[ranks[total > 1]].tolist():
            hits[k][at[k]] = True
    return hits


def _sort(window: int):
    """Sort the anchors of a partition together, a bounded number of contexts at a time."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        hits = repeated_windows([h[4] for h in held], [h[2] for h in held], [h[3] for h in held], window)
        out = [(h[1], h[5] + a, h[5] + b) for h, hit in zip(held, hits) for a, b in _runs(hit)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.binary(), pa.int32(), pa.int32()))], ["context", "low", "high"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:  # rows of one anchor are neighbours
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if len(held) >= 8 * MOST_CONTEXTS and row[0] != held[-1][0]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    return run


def _parts(window: int, width: int):
    """Contexts cut by the windows' offset into those of up to ``width`` windows.

    The new anchor is a hash of the old one, the part and the bytes that all windows
    of the part share, so equal windows stay together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for anchor, context, offset, weight, data, shift in zip(*(batch.column(k).to_pylist() for k in range(6))):
                windows = len(data) - window + 1
                # offsets (bytes before the anchor) of the part: [part * width, part * width + width)
                for part in range((offset - windows + 1) // width, offset // width + 1):
                    low, high = max(0, offset - (part * width + width - 1)), min(windows - 1, offset - part * width)
                    piece = data[low : high + window]
                    # the bytes in every window of such a part, whether or not all are here
                    core = data[offset - part * width : offset - (part * width + width - 1) + window]
                    key = xxhash.xxh3_64_intdigest(core, seed=(anchor ^ part) & (2**64 - 1))
                    out.append((key - 2**64 if key >= 2**63 else key, context, offset - low, weight, piece, shift + low))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, _CONTEXT_TYPES)], _CONTEXT_NAMES)

    return run


_CONTEXT_TYPES = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
_CONTEXT_NAMES = ["anchor", "context", "offset", "weight", "bytes", "shift"]
_CONTEXT_DDL = "anchor long, context binary, offset int, weight long, bytes binary, shift int"


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for _, context, _, weight, data, shift in zip(*(batch.column(k).to_pylist() for k in range(6))):
                for t in range(len(data) - window + 1):
                    out.append((xxhash.xxh3_128_digest(data[t : t + window]), context, shift + t, weight))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.binary(), pa.binary(), pa.int32(), pa.int64()))],
                ["string", "context", "low", "weight"],
            )

    return run


def _strip(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data = (text or "").encode("utf-8", "replace")
                if not spans:
                    out.append((doc, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                mark = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(mark, [s["low"] for s in spans], 1)
                np.add.at(mark, [s["high"] + window for s in spans], -1)
                gone = np.cumsum(mark)[:-1] > 0
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                out.append((doc, len(data), int(gone.sum()), len(_runs(gone)), hashlib.sha256(kept).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_row_key(d, (t or "").encode("utf-8", "replace")) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], ["doc_id", "text", "row"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, most: int = MOST_CONTEXTS) -> DataFrame:
    """(row, spans): for each row with repeats, the windows [low, high] that also start elsewhere.

    ``row`` is md5 of doc_id and text; rows that share both have the same spans.
    """
    docs = only(docs, "doc_id", "text")
    found = written(docs.mapInArrow(_find(window), _ANCHORS), "anchors")
    # one row for each different context: copies are counted before the shuffle
    distinct = found.groupBy("anchor", "context").agg(
        F.count(F.lit(1)).alias("weight"), F.min_by(F.struct("row", "begin", "windows", "offset"), F.struct("row", "begin")).alias("at")
    )
    distinct = written(distinct, "contexts")
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"), F.sum("weight").alias("n")).where("n > 1")
    # an anchor with one context: its windows repeat if it stands twice
    alone = distinct.join(several.where("contexts = 1"), "anchor").where("weight > 1")
    results = alone.select("context", F.lit(0).alias("low"), (F.col("at.windows") - 1).alias("high"))

    asked = distinct.join(several.where("contexts > 1").select("anchor"), "anchor").groupBy(F.col("at.row").alias("row")).agg(
        F.collect_list(F.struct("anchor", "context", "at.begin", "at.windows", "at.offset", "weight")).alias("asked")
    )
    keyed = docs.where(F.octet_length("text") >= window).mapInArrow(_keyed, "doc_id long, text string, row binary")
    texts = keyed.join(asked, "row").select("text", "asked")
    contexts = texts.mapInArrow(_cut(window), "anchor long, context binary, offset int, weight long, bytes binary")
    # rows of equal doc_id and text answer alike
    level = written(contexts.dropDuplicates(["anchor", "context"]).withColumn("shift", F.lit(0)), "context-bytes")
    for width in (PART, 1):
        counts = level.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"))
        hot = counts.where(F.col("contexts") > most).select("anchor")
        some_hot = hot.limit(1).count() > 0
        cool = level.join(hot, "anchor", "left_anti") if some_hot else level
        results = results.unionByName(_sorted(cool, window))
        if not some_hot:
            break
        level = level.join(hot, "anchor")
        if width == 1:
            single = level.select(*_CONTEXT_NAMES).mapInArrow(_windows(window), "string binary, context binary, low int, weight long")
            single = written(single, "windows")
            twice = single.groupBy("string").agg(F.sum("weight").alias("n")).where("n > 1").select("string")
            results = results.unionByName(single.join(twice, "string").select("context", "low", F.col("low").alias("high")))
        else:
            level = written(level.select(*_CONTEXT_NAMES).mapInArrow(_parts(window, width), _CONTEXT_DDL), "parts")
    # runs of one context are joined up, so that each place of it meets one row
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("low", "high"))),
        F.array().cast("array<struct<low:int,high:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["low"] <= F.element_at(acc, -1)["high"] + 1),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["low"].alias("low"), F.greatest(F.element_at(acc, -1)["high"], x["high"]).alias("high"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    results = written(results.groupBy("context").agg(merged.alias("runs")), "repeats")
    places = found.select("row", "begin", "context").join(results, "context")
    placed = F.transform("runs", lambda r: F.struct((F.col("begin") + r["low"]).alias("low"), (F.col("begin") + r["high"]).alias("high")))
    return places.groupBy("row").agg(F.flatten(F.collect_list(placed)).alias("spans"))


def _sorted(level: DataFrame, window: int) -> DataFrame:
    parts = max(level.sparkSession.sparkContext.defaultParallelism, int(level.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = level.select(*_CONTEXT_NAMES).repartition(parts, "anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(_sort(window), "context binary, low int, high int")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Bytes covered by a ``window``-byte string that also starts anywhere else, in the
    same text or another, are removed; overlaps count. Null texts are empty; shorter
    texts keep all. Repeated rows are repeats of one another. Other columns are ignored.
    """
    docs = only(docs, "doc_id", "text")
    spans = written(repeated_spans(docs, window), "spans")
    keyed = docs.mapInArrow(_keyed, "doc_id long, text string, row binary")
    joined = keyed.join(spans, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_strip(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
