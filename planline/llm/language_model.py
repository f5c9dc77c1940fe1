"""LM scoring by masked pseudo-likelihood.

A network predicts every token of a document from the ``SPAN`` tokens on both sides,
the token itself masked: the neighbours' embeddings, side by side, go through one
matrix and tanh, and a hierarchical softmax (a class of ranks from one power of two to
the next, then a binary tree within the class) gives the token's conditional
probability. The sum of the log-probabilities scores a document.

Tokens are words that occur often enough in all documents; a rarer word is spelled in
pieces of ``PIECE`` bytes that occur as often, or in single bytes, so no word is
folded into another. What counts as often rises more slowly than the corpus, so the
vocabulary grows about as the cube root of it (:func:`least_count`).

Documents are dealt by a hash of id and text to blocks of about ``BLOCK`` tokens, and
blocks to rounds, so every document trains once, and the result does not depend on how
the table is partitioned. In a round each block trains in numpy from the common
weights and gives the rows of weights that moved; each row is averaged, by the number
of tokens, over the blocks that moved it, in a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from planline.llm.shared import folded_spans, mix64, only, slices, span_hashes, written

SPAN, DIM = 2, 15
#: Levels of a class's tree that are computed whole.
TOP = 6
#: Weights of a row: DIM and a bias.
ROW = DIM + 1
PIECE = 4
LEAST_COUNT = 5
BLOCK = 1_000_000
ROUNDS, RATE, BATCH = 3, 0.2, 16384
#: Rows of weights that are averaged together.
PART = 4096
_AROUND = np.array([*range(-SPAN, 0), *range(1, SPAN + 1)])


def least_count(tokens: int) -> int:
    """Occurrences that make a word or piece a token: (tokens / 300,000) to the power 2/3, 5 at least."""
    return max(LEAST_COUNT, math.ceil((tokens / 300_000) ** (2 / 3)))


# --- tokens


def _piece_keys(code: np.ndarray) -> np.ndarray:
    """Keys of pieces, apart from those of words: of up to PIECE bytes and, in the bits above, their number."""
    return mix64(code.astype(np.uint64) ^ np.uint64(0x5D1C3A7700000000))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the place of each key among them; Arrow hashes, where numpy would sort."""
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _pieces(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pieces of byte spans, in order, and the number of pieces of each span."""
    number = -(-(end - start) // PIECE)
    of = np.repeat(np.arange(len(start)), number)
    at = start[of] + PIECE * (np.arange(len(of)) - (np.cumsum(number) - number)[of])
    size = np.minimum(end[of] - at, PIECE)
    padded = np.concatenate((raw, np.zeros(PIECE, dtype=np.uint8)))
    wide = np.ndarray(len(raw) + 1, dtype=f"<u{PIECE}", buffer=padded, strides=(1,))
    size = size.astype(np.uint64)
    return wide[at] & ((np.uint64(1) << 8 * size) - np.uint64(1)) | size << np.uint64(8 * PIECE), number


class Vocabulary:
    """Ids by count: frequent words and pieces, then every single byte."""

    def __init__(self, keys: np.ndarray):
        single = _piece_keys(np.arange(256, dtype=np.uint64) | np.uint64(1 << 8 * PIECE))
        every = np.concatenate((keys, single[~np.isin(single, keys)]))
        self.size = len(every)
        self.order = np.argsort(every).astype(np.int32)
        self.keys = every[self.order]
        self.bits = max(1, self.size.bit_length())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids, -1 for keys that are no token."""
        each, of = _distinct(keys)  # words repeat, and a search among all keys costs more than a hash
        at = np.minimum(np.searchsorted(self.keys, each), self.size - 1)
        return np.where(self.keys[at] == each, self.order[at], -1).astype(np.int32)[of]

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other; tokens and words of each text."""
        data = [(t or "").encode("utf-8", "replace") for t in texts]
        raw, start, end = folded_spans(b" ".join(data))
        ends = np.cumsum([len(d) + 1 for d in data])
        of = np.searchsorted(ends, start, side="right")
        ids = self.find(span_hashes(raw, start, end))
        number = np.ones(len(ids), dtype=np.int64)
        rare = np.flatnonzero(ids < 0)
        if len(rare):
            code, n = _pieces(raw, start[rare], end[rare])
            known = self.find(_piece_keys(code))
            width = np.where(known < 0, code >> np.uint64(8 * PIECE), 1).astype(np.int64)
            piece = np.repeat(np.arange(len(code)), width)
            spelled = known[piece]
            lone = np.flatnonzero(spelled < 0)
            depth = lone - (np.cumsum(width) - width)[piece[lone]]
            byte = code[piece[lone]] >> (8 * depth).astype(np.uint64) & np.uint64(255)
            spelled[lone] = self.find(_piece_keys(byte | np.uint64(1 << 8 * PIECE)))
            number[rare] = np.add.reduceat(width, np.cumsum(n) - n)
            out = np.repeat(ids, number)
            out[out < 0] = spelled
            ids = out
        return ids, np.bincount(of, number, len(texts)).astype(np.int64), np.bincount(of, minlength=len(texts))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, words): counts of words and pieces; words is n for words and 0 for pieces."""
    for batch in slices(batches, 4000):
        raw, start, end = folded_spans(b" ".join((t or "").encode("utf-8", "replace") for t in batch.column(0).to_pylist()))
        words, of = _distinct(span_hashes(raw, start, end))
        n = np.bincount(of, minlength=len(words))
        one = np.empty(len(words), dtype=np.int64)
        one[of] = np.arange(len(of))  # a span of each word
        code, number = _pieces(raw, start[one], end[one])
        code, at = _distinct(code)
        each = np.bincount(at, np.repeat(n, number), len(code)).astype(np.int64)
        keys = np.concatenate((words, _piece_keys(code))).astype(np.int64)
        counts = np.concatenate((n, each))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts), pa.array(np.concatenate((n, np.zeros_like(each))))], ["key", "n", "words"])


# --- network


class Network:
    """Views into flat float32 weights: rows of ``ROW`` for tokens (and the edge), trees, classes and places."""

    def __init__(self, flat: np.ndarray, size: int, bits: int):
        self.flat, self.size, self.bits = flat, size, bits
        self.every = flat.reshape(-1, ROW)
        at = np.cumsum([size + 1, 1 << bits, bits, len(_AROUND) * ROW])
        self.word, self.tree, self.of_class, self.place, _ = np.split(self.every, at)
        self.dense = np.arange(at[1], at[3])
        self.tree_at = at[0]

    @staticmethod
    def first(size: int, bits: int, seed: int = 1) -> Network:
        rows = size + 1 + (1 << bits) + bits + len(_AROUND) * ROW
        net = Network(np.random.default_rng(seed).standard_normal(rows * ROW, dtype=np.float32) * np.float32(0.1), size, bits)
        net.tree[:] = 0
        net.of_class[:] = 0
        net.place += np.tile(np.eye(ROW, dtype=np.float32), (len(_AROUND), 1))
        net.flat[:] = net.flat.astype("<f2")
        return net

    def shipped(self, spark: SparkSession) -> Broadcast:
        """The weights for the executors, in half precision, which they keep between rounds; some 100 bytes for each token."""
        return spark.sparkContext.broadcast(self.flat.astype("<f2"))

    def hidden(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours' rows side by side; the hidden values and a 1 for the bias."""
        x = np.take(self.word, near.ravel(), axis=0).reshape(len(near), -1)
        h = np.tanh(x @ self.place)
        h[:, DIM] = 1
        return x, h


def padded(ids: np.ndarray, sizes: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents' ids with SPAN edges around each, and the places of the ids in it."""
    place = np.arange(len(ids)) + SPAN * (1 + np.repeat(np.arange(len(sizes)), sizes))
    out = np.full(len(ids) + SPAN * (len(sizes) + 1), edge, dtype=np.int32)
    out[place] = ids
    return out, place


def _classes(ids: np.ndarray) -> np.ndarray:
    """The class of each id: the bits below the leading one of id + 1."""
    return (np.frexp((ids + 1).astype(np.float32))[1] - 1).astype(np.uint8)


class Paths:
    """The steps from the root of class k down to each id: nodes and branches (-1, 1), and the scores that decide.

    All ids share the first ``TOP`` levels, so these are dense products; the levels below are looked up.
    A row holds one level of all ids, so that numpy's loops are as long as the ids.
    """

    def __init__(self, net: Network, h: np.ndarray, ids: np.ndarray, k: int):
        self.h, top = h, min(k, TOP)
        inner = ids + np.int32(1 - (1 << k))
        depth = np.arange(k, dtype=np.int32)[:, None]
        self.branch = (2 * (inner >> (k - 1 - depth) & 1) - 1).astype(np.float32)
        heap = (1 << depth) + (inner >> (k - depth))
        self.first, self.shared = (1 << k) + 1, net.tree[(1 << k) + 1 : (1 << k) + (1 << top)]
        self.column = heap[:top] + (np.arange(len(ids)) * len(self.shared) - 1)
        self.node = heap[top:] + (1 << k)
        self.z = np.empty((k, len(ids)), dtype=np.float32)
        np.take(h @ self.shared.T, self.column, out=self.z[:top], mode="clip")  # with a mode numpy needs no copy of out
        if k > top:
            self.below = np.take(net.tree, self.node, axis=0)
            np.einsum("knd,nd->kn", self.below, h, out=self.z[top:])
        self.z *= self.branch

    def log_probability(self) -> np.ndarray:
        """The steps' log-probabilities summed: one logarithm of the product, which float64 holds at these bounds."""
        return -np.log(np.prod(1 + np.exp(np.clip(-self.z, -40, 40)), axis=0, dtype=np.float64))

    def gradient(self, h: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the hidden values, and by the shared nodes; ``out`` gets that by the nodes below, a row for each weight.

        ``h``: the hidden values as columns.
        """
        e = -self.branch / (1 + np.exp(np.minimum(self.z, 60)))
        top = len(self.column)
        spread = np.zeros((e.shape[1], len(self.shared)), dtype=np.float32)
        spread.ravel()[self.column] = e[:top]
        back = spread @ self.shared
        if len(self.node):
            e = e[top:]
            back += np.einsum("kn,knd->nd", e, self.below)
            np.multiply(h[:, None, :], e.astype(np.float64), out=out.reshape(ROW, *e.shape))
        return back, spread.T @ self.h


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by class, and (class, begin, end) of each class in it."""
    c = _classes(ids)
    order = np.argsort(c, kind="stable")
    edge = np.concatenate(([0], np.cumsum(np.bincount(c))))
    return order, [(k, edge[k], edge[k + 1]) for k in range(len(edge) - 1) if edge[k] < edge[k + 1]]


_ONES = np.ones(64, dtype=np.float32)


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z), z clipped in place, and its sum by row: as a product, since rows are short."""
    e = np.exp(np.clip(z, -80, 80, out=z))
    return e, e @ _ONES[: z.shape[1]]


def log_probabilities(net: Network, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """log p(token | tokens on both sides) of each token."""
    out = np.empty(len(ids))
    for s in range(0, len(ids), BATCH):
        order, classes = _by_class(ids[s : s + BATCH])
        own = ids[s : s + BATCH][order]
        h = net.hidden(near[s : s + BATCH][order])[1]
        z = h @ net.of_class.T
        rest = np.log(_exponentials(z)[1])
        sums = np.empty(len(own), dtype=np.float32)
        for k, a, b in classes:
            sums[a:b] = z[a:b, k] - rest[a:b]
            if k:
                sums[a:b] += Paths(net, h[a:b], own[a:b], k).log_probability()
        out[s + order] = sums
    return out


def _sums(rows: np.ndarray, columns: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows (below ``most``) and the sums of their values, which are given by column."""
    distinct = np.flatnonzero(np.bincount(rows, minlength=most))
    place = np.zeros(most, dtype=np.int64)
    place[distinct] = np.arange(len(distinct))
    at = place[rows]
    return distinct, np.array([np.bincount(at, c, len(distinct)) for c in columns], dtype=np.float32).T


def moves(net: Network, ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean negative log-probability: the rows of weights it touches, each once, and it."""
    n = len(ids)
    order, classes = _by_class(ids)
    ids, near = ids[order], near[order]
    x, h = net.hidden(near)
    columns = h.T.astype(np.float64, order="C")
    g, total = _exponentials(h @ net.of_class.T)
    g /= total[:, None]
    back = np.zeros_like(h)
    rows, grads = [net.dense], []
    steps = np.cumsum([0, *((b - a) * max(k - TOP, 0) for k, a, b in classes)])
    nodes, of_nodes = np.empty(steps[-1], dtype=np.int64), np.empty((ROW, steps[-1]))
    for (k, a, b), i, j in zip(classes, steps, steps[1:]):
        g[a:b, k] -= 1
        if k:
            paths = Paths(net, h[a:b], ids[a:b], k)
            back[a:b], of_shared = paths.gradient(columns[:, a:b], of_nodes[:, i:j])
            nodes[i:j] = paths.node.ravel()
            rows.append(net.tree_at + paths.first + np.arange(len(of_shared)))
            grads.append(of_shared)
    back += g @ net.of_class
    back *= 1 - h * h  # 0 for the bias, whose h is 1
    by_weight = net.place.reshape(len(_AROUND), ROW, ROW).transpose(1, 0, 2).reshape(-1, ROW) @ back.T
    words, of_word = _sums(near.T.ravel(), by_weight.reshape(ROW, -1), net.size + 1)
    trees, of_tree = _sums(nodes, of_nodes, 1 << net.bits)
    rows = np.concatenate((*rows, words, trees + net.tree_at))
    return rows, np.concatenate((g.T @ h, x.T @ back, *grads, of_word, of_tree)) / np.float32(n)


def _mixed(n: int) -> np.ndarray:
    """0 to n - 1 in a fixed mixed order: sorted by a hash, whose low bits make way for the number, so that a plain sort does."""
    number, bits = np.arange(n, dtype=np.uint64), np.uint64(n.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    return (np.sort(mix64(number) & ~low | number) & low).astype(np.int64)


def train_block(net: Network, ids: np.ndarray, sizes: np.ndarray, rate: float) -> np.ndarray:
    """Train the network in place on one block, tokens in a fixed mixed order; the rows that moved."""
    every, squares = net.every, np.full(len(net.every), 1e-8, dtype=np.float32)
    whole = every.view(f"V{every.strides[0]}")[:, 0]  # a row as one value, which numpy puts faster than ROW of them
    moved = np.zeros(len(every), dtype=bool)
    row, place = padded(ids, sizes, net.size)
    mixed = _mixed(len(ids))
    for s in range(0, len(ids), BATCH):
        at = place[mixed[s : s + BATCH]]
        rows, g = moves(net, row[at], row[at[:, None] + _AROUND])
        square = np.take(squares, rows) + np.einsum("nd,nd->n", g, g) / np.float32(ROW)
        squares[rows] = square  # steps shrink with what each row has seen (Adagrad by row)
        g *= (np.float32(-rate) / np.sqrt(square))[:, None]
        g += np.take(every, rows, axis=0)
        whole[rows] = g.view(whole.dtype)[:, 0]
        moved[rows] = True
    return np.flatnonzero(moved)


# --- Spark


_BLOCKS = "round int, doc_ids array<long>, words binary, sizes binary, ids binary"
_MOVES = "part int, seen long, rows binary, moves binary"


def _encode(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, sizes, words = vocabulary.ids(batch.column(2).to_pylist())
            ends = np.concatenate(([0], np.cumsum(sizes)))
            tokens = [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words), pa.array(tokens, pa.binary())], ["doc_id", "place", "words", "ids"])

    return run


def _blocks(rounds: int, shards: int):
    """Blocks of the rows of one partition, which come in order of their places."""

    def row(held: list, shard: int) -> pa.RecordBatch:
        doc_ids, words, ids = zip(*held)
        numbers = [np.array(words, dtype="<i8"), np.array([len(i) // 4 for i in ids], dtype="<i8")]
        columns = [pa.array([shard % rounds], pa.int32()), pa.array([list(doc_ids)], pa.list_(pa.int64()))]
        columns += [pa.array([v.tobytes()], pa.binary()) for v in numbers] + [pa.array([b"".join(ids)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["round", "doc_ids", "words", "sizes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for shard, doc_id, words, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and (shard != last or size >= 2 * BLOCK):
                    yield row(held, last)
                    held, size = [], 0
                held.append((doc_id, words, ids))
                size, last = size + len(ids) // 4 + 16, shard
        if held:
            yield row(held, last)

    return run


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    for doc_ids, words, sizes, ids in zip(*(batch.column(k) for k in ("doc_ids", "words", "sizes", "ids"))):
        yield doc_ids.values, *(np.frombuffer(v.as_buffer(), dtype=t) for v, t in ((words, "<i8"), (sizes, "<i8"), (ids, "<i4")))


def _train(shipped: Broadcast, size: int, bits: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shipped.value.astype(np.float32), size, bits)
        for batch in batches:
            for _, _, sizes, ids in _read(batch):
                own = Network(net.flat.copy(), net.size, net.bits)
                moved = train_block(own, ids, sizes, rate)
                for part in np.unique(moved // PART):
                    rows = moved[np.searchsorted(moved, part * PART) : np.searchsorted(moved, (part + 1) * PART)]
                    yield _part(part, rows - part * PART, (own.every[rows] - net.every[rows]).astype("<f2"), len(ids))

    return run


def _part(part: int, rows: np.ndarray, by: np.ndarray, seen: int) -> pa.RecordBatch:
    """Rows of one part of the weights, and by how much they move."""
    columns = [pa.array([part], pa.int32()), pa.array([seen], pa.int64()), pa.array([rows.astype("<u2").tobytes()], pa.binary()), pa.array([by.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "seen", "rows", "moves"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean move of each row in this partition, one part at a time (sorted by part)."""
    part, total, seen = None, None, None

    def done():
        rows = np.flatnonzero(seen)
        return _part(part, rows, (total[rows] / seen[rows, None]).astype("<f4"), 0)

    for batch in batches:
        for p, n, rows, by in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if p != part:
                if part is not None:
                    yield done()
                part, total, seen = p, np.zeros((PART, ROW)), np.zeros(PART)
            rows = np.frombuffer(rows, dtype="<u2")
            total[rows] += n * np.frombuffer(by, dtype="<f2").reshape(-1, ROW).astype(np.float64)
            seen[rows] += n
    if part is not None:
        yield done()


class Model:
    """A trained network with its vocabulary, and the blocks of the documents it was trained on."""

    def __init__(self, vocabulary: Vocabulary, net: Network, blocks: DataFrame):
        self.vocabulary, self.net, self.blocks = vocabulary, net, blocks


def vocabulary_of(docs: DataFrame) -> tuple[Vocabulary, int]:
    """Vocabulary from the counts of all documents, and the number of their words."""
    observed = Observation()
    counts = docs.select("text").mapInArrow(_counts, "key long, n long, words long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    often = written(counts.observe(observed, F.sum("words").alias("words")).where(F.col("n") >= LEAST_COUNT), "counts")
    words = observed.get["words"] or 0
    # some 100,000 keys on a gigabyte, ten times as many on a thousand
    top = often.where(F.col("n") >= least_count(words)).orderBy(F.desc("n"), "key").select("key").toArrow()
    return Vocabulary(top.column("key").to_numpy().astype(np.int64).astype(np.uint64)), words


def blocks_of(docs: DataFrame, vocabulary: Vocabulary, words: int, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """Documents as ids in blocks of about ``block`` words, dealt by a hash of id and text; rows of :data:`_BLOCKS`."""
    shards = max(rounds, -(-words // block))
    place = F.xxhash64("doc_id", "text")
    encoded = only(docs, "doc_id", "text").select("doc_id", place.alias("place"), "text")
    encoded = encoded.mapInArrow(_encode(vocabulary), "doc_id long, place long, words long, ids binary")
    dealt = encoded.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).repartition(shards, "shard")
    dealt = dealt.sortWithinPartitions("shard", "place", "doc_id").select("shard", "doc_id", "words", "ids")
    return written(dealt.mapInArrow(_blocks(rounds, shards), _BLOCKS), "blocks")


def train(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE, block: int = BLOCK) -> Model:
    """Vocabulary and weights from all documents; each document trains once, in one of ``rounds`` rounds."""
    vocabulary, words = vocabulary_of(docs)
    blocks = blocks_of(docs, vocabulary, words, max(rounds, 1), block)
    net = Network.first(vocabulary.size, vocabulary.bits)
    for r in range(rounds):
        shipped = net.shipped(docs.sparkSession)
        moved = blocks.where(F.col("round") == r).select("doc_ids", "words", "sizes", "ids").mapInArrow(_train(shipped, net.size, net.bits, rate / (1 + r)), _MOVES)
        moved = moved.repartition(F.col("part")).sortWithinPartitions("part", "seen", F.xxhash64("moves"))
        for p in moved.mapInArrow(_average, _MOVES).collect():  # rows of weights, some 140 bytes for each token of the vocabulary
            net.every[p.part * PART + np.frombuffer(p.rows, dtype="<u2").astype(np.int64)] += np.frombuffer(p.moves, dtype="<f4").reshape(-1, ROW)
        net.flat[:] = net.flat.astype("<f2")
        shipped.destroy()
    return Model(vocabulary, net, blocks)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, n_words, n_tokens, log_likelihood (sum, 0 without words), mean_log_likelihood (by word, null without).

    Null and wordless texts have no words. Repeated rows and null ids are kept; other
    columns are ignored. Whole texts are scored, whatever their length.
    """
    return score_blocks(blocks_of(docs, model.vocabulary, docs.count() * 500), model)


def score_blocks(blocks: DataFrame, model: Model) -> DataFrame:
    """:func:`score` of documents that are in blocks already."""
    shipped, size, bits = model.net.shipped(blocks.sparkSession), model.net.size, model.net.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shipped.value.astype(np.float32), size, bits)
        for batch in batches:
            for doc_ids, words, sizes, ids in _read(batch):
                row, place = padded(ids, sizes, net.size)
                p = np.zeros(len(ids) + 1)
                for s in range(0, len(ids), 8 * BATCH):
                    at = place[s : s + 8 * BATCH]
                    p[s + 1 : s + 1 + len(at)] = log_probabilities(net, row[at], row[at[:, None] + _AROUND])
                p = np.cumsum(p)
                ends = np.cumsum(sizes)
                sums = p[ends] - p[ends - sizes]
                mean = pa.array(sums / np.maximum(words, 1), mask=words == 0)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(words), pa.array(sizes), pa.array(sums), mean], ["doc_id", "n_words", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    columns = blocks.select("doc_ids", "words", "sizes", "ids")
    return columns.mapInArrow(run, "doc_id long, n_words long, n_tokens long, log_likelihood double, mean_log_likelihood double")
