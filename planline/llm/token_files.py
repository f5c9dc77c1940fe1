"""Token-ID / binary output.

Ids are replaced by their rank in the corpus (most frequent first) and written in
a byte-aligned variable-length code: two control bits for each value say whether
it takes 1, 2, 3 or 4 bytes; control bytes and data bytes are kept apart. A block
is decoded by table lookup in numpy, with no loop over values.

The container is a Parquet table in the shared folder, one row a block:
``part``, ``block``, ``doc_ids``, ``lengths``, ``local_start``, ``control``,
``data``. Parquet is used as every Hadoop store can hold it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planline.llm.shared import dropped, only, slices, span_hashes, written

BLOCK_IDS = 1 << 20
#: most chunks that a worker keeps
CACHE_CHUNKS = 2_000_000
#: texts whose unknown chunks are learned together
TEXTS = 2000

_BLANK = np.array([i < 128 and chr(i).isspace() for i in range(256)])
_OTHER_BLANKS = {chr(i).encode() for i in range(128, 0x3001) if chr(i).isspace()}
_LEAD = np.isin(np.arange(256), [b[0] for b in _OTHER_BLANKS])
_ASCII_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
#: byte count of each of the four values of a control byte
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_block(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    padded[: len(values)] = code
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
    keep = np.arange(4)[None, :] <= code[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of a block."""
    sizes = _SIZES[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, dtype=np.uint8)
    end = np.cumsum(sizes)
    start = end - sizes
    out = raw[start].astype("<u4")
    for k in range(1, int(sizes.max(initial=1))):
        has = np.flatnonzero(sizes > k)
        out[has] |= raw[start[has] + k].astype("<u4") << np.uint32(8 * k)
    return out


class CachedEncoder:
    """The tokenizer's ids of many texts, each distinct chunk encoded once.

    Byte-level BPE never merges across pre-tokens, so the ids of a text are those of
    its pre-tokens in a row. Where no two white-space characters are neighbours every
    space or line end begins a pre-token, and so does a comma or full stop after a
    letter: a text is cut before each of these. Chunks are told
    apart by 64-bit hashes; known ones are looked up in sorted arrays, unknown ones
    are encoded in one call. Other texts, and those that hold a special token's
    string, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=self.dtype)

    def _encode(self, chunks: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """(chunks, their ids in a row, ids of each): those that may stand in one text, then the others."""
        joined = [c for c in chunks if c[0] in " \n" and len(c) > 1 and not c[-1].isspace()]
        parts = []
        if joined:
            count = np.array([(1 if c[0] == " " else 2) if c[1:].isalpha() else len(self.pieces(c)) for c in joined])
            e = self.tokenizer.encode("".join(joined), add_special_tokens=False)
            at = np.array(e.word_ids, dtype=np.int64)
            if len(at) and at[-1] + 1 == count.sum() and (np.diff(at) >= 0).all():
                ends = np.searchsorted(at, np.cumsum(count))
                parts.append((joined, np.array(e.ids, dtype=self.dtype), np.diff(ends, prepend=0)))
            else:
                joined = []
        have = set(joined)
        rest = [c for c in chunks if c not in have]
        if rest:
            ids = [e.ids for e in self.tokenizer.encode_batch(rest, add_special_tokens=False)]
            parts.append((rest, np.array([i for x in ids for i in x], dtype=self.dtype), np.array([len(x) for x in ids])))
        return parts

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        of = dict(zip(chunks, hashes.tolist()))
        fresh, begin, size = [], [], []
        for names, ids, sizes in self._encode(chunks):
            fresh += [of[c] for c in names]
            begin.append(np.cumsum(sizes) - sizes + len(self.pool))
            size.append(sizes)
            self.pool = np.concatenate((self.pool, ids))
        fresh = np.array(fresh, dtype=np.uint64)
        order = np.argsort(fresh)
        at = np.searchsorted(self.hashes, fresh[order])
        self.hashes = np.insert(self.hashes, at, fresh[order])
        self.begin = np.insert(self.begin, at, np.concatenate(begin)[order])
        self.size = np.insert(self.size, at, np.concatenate(size)[order])

    def _whole(self, raw: np.ndarray, whole: bytes, first: np.ndarray) -> list[int]:
        """Texts with neighbouring white space, white space beyond ASCII or a special token's string."""
        blank = _BLANK[raw]
        at = np.flatnonzero(blank[1:] & blank[:-1]) + 1
        places = [at[~np.isin(at, first)]]  # not where two texts meet
        lead = np.flatnonzero(_LEAD[raw])  # first bytes of the blanks beyond ASCII; rare in most texts
        places.append(np.array([k for k in lead.tolist() if whole[k : k + 2] in _OTHER_BLANKS or whole[k : k + 3] in _OTHER_BLANKS], dtype=np.int64))
        for sign in self.special:
            k = whole.find(sign.encode())
            while k >= 0:
                places.append(np.array([k]))
                k = whole.find(sign.encode(), k + 1)
        return np.unique(np.searchsorted(first, np.concatenate(places), side="right") - 1).tolist()

    def all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        data = [t.encode("utf-8", "replace") for t in texts]
        whole = b"".join(data)
        first = np.cumsum([0, *map(len, data)])
        if not whole:
            return [self.pool[:0]] * len(texts)
        raw = np.frombuffer(whole, dtype=np.uint8)
        cut = (raw == 32) | (raw == 10)
        cut[1:] |= ((raw[1:] == 44) | (raw[1:] == 46)) & _ASCII_LETTER[raw[:-1]]
        cut[first[:-1][first[:-1] < len(raw)]] = True
        start = np.flatnonzero(cut)
        end = np.concatenate((start[1:], [len(raw)]))
        inverse, known = pd.factorize(span_hashes(raw, start, end))
        if len(self.hashes) > CACHE_CHUNKS:
            self._forget()
        order = np.argsort(known)
        inverse, known = np.argsort(order)[inverse], known[order]
        at = np.searchsorted(self.hashes, known)
        miss = np.ones(len(known), dtype=bool)
        inside = at < len(self.hashes)
        miss[inside] = self.hashes[at[inside]] != known[inside]
        if miss.any():
            some = np.zeros(len(known), dtype=np.int64)
            some[inverse] = np.arange(len(inverse))  # any place of each
            places = some[miss]
            self._learn(known[miss], [whole[a:b].decode() for a, b in zip(start[places].tolist(), end[places].tolist())])
            at = np.searchsorted(self.hashes, known)
        size, begin = self.size[at][inverse], self.begin[at][inverse]
        stop = np.cumsum(size)
        ids = self.pool[np.repeat(begin - (stop - size), size) + np.arange(stop[-1])]
        cuts = np.concatenate(([0], stop))[np.searchsorted(start, first)].tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in self._whole(raw, whole, first):
            out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, dtype=self.dtype)
        return out


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder_for(path: str) -> CachedEncoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in slices(batches, TEXTS):
            packed, count = [], []
            for ids in encoder.all([t or "" for t in batch.column(1).to_pylist()]):
                packed.append(ids.tobytes() + end)
                count.append(len(ids) + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary()), pa.array(count, pa.int64())], ["doc_id", "ids", "n"]
            )

    return run


def _unpack(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        packed, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if not packed:
            continue
        own = np.bincount(np.concatenate([_unpack(ids, n) for ids, n in zip(packed, sizes)]))
        if len(own) > len(total):
            total = np.concatenate((total, np.zeros(len(own) - len(total), dtype=np.int64)))
        total[: len(own)] += own
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])


def _write_blocks(ranked: np.ndarray, block_ids: int):
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, dtype=np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def block(part, number, start, docs, values):
        lengths = [len(v) for v in values]
        control, data = encode_block(rank_of[np.concatenate(values)])
        columns = ([part], [number], [start], [sum(lengths)], [docs], [lengths], [control], [data])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOCK.types)], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start, held, docs, values = TaskContext.get().partitionId(), 0, 0, 0, [], []
        for batch in slices(batches):
            for doc, ids, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                docs.append(doc)
                values.append(_unpack(ids, n))
                held += n
                if held >= block_ids:
                    yield block(part, number, start, docs, values)
                    number, start, held, docs, values = number + 1, start + held, 0, [], []
        if docs:
            yield block(part, number, start, docs, values)

    return run


_BLOCK = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("local_start", pa.int64()),
        ("n", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("control", pa.binary()),
        ("data", pa.binary()),
    ]
)
_BLOCK_DDL = "part int, block int, local_start long, n long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def _read_blocks(ranked: np.ndarray, starts: dict[int, int]):
    table = ranked.astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row in batch.to_pylist():
                ids = table[decode_block(row["control"], row["data"], row["n"])]
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts[row["part"]] + row["local_start"] + ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


class TokenFiles:
    """A written token table: ``blocks`` (DataFrame), ``ranked`` (ids by rank), ``starts`` (first position of each part)."""

    def __init__(self, blocks: DataFrame, ranked: np.ndarray):
        self.blocks, self.ranked = blocks, ranked
        # one row for each part, that is for each task of the writing stage
        totals = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())
        self.starts, at = {}, 0
        for part, n in totals:
            self.starts[part], at = at, at + n
        self.n_ids = at

    def documents(self) -> DataFrame:
        """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
        return self.blocks.mapInArrow(
            _read_blocks(self.ranked, self.starts), "doc_id long, start long, n_tokens long, ids_crc32 long"
        )


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, block_ids: int = BLOCK_IDS) -> TokenFiles:
    """Encode whole texts, append ``end_id``, rank ids by corpus frequency, write in ascending doc_id order.

    A null text has no ids but the end id. A null doc_id sorts first. Rows that
    share a doc_id are all kept, in the order of their packed ids. An empty table
    gives no block. Columns other than doc_id and text are ignored. The tokenizer's
    own rule for special tokens' strings holds.
    """
    spark = docs.sparkSession
    tokens = written(
        only(docs, "doc_id", "text").mapInArrow(_tokenise(tokenizer_path, end_id), "doc_id long, ids binary, n long"), "token-ids"
    )
    # at most one row for each id of the vocabulary
    counts = tokens.select("ids", "n").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ranked = np.array([r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))], dtype=np.int64)
    size = tokens.agg(F.sum("n")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // (4 * BLOCK_IDS)))
    ordered = tokens.repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = written(ordered.mapInArrow(_write_blocks(ranked, block_ids), _BLOCK_DDL), "token-blocks")
    dropped(tokens)
    return TokenFiles(blocks, ranked)
