"""The language model against plain versions: tokens, probabilities, gradient, documents' scores."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from planline.llm import language_model as L
from planline.llm.shared import word_hashes


def keys(*words):
    return word_hashes(" ".join(words).encode())


def test_rare_words_are_spelled():
    code = sum(ord(c) << 8 * k for k, c in enumerate("abcd"))
    piece = L._piece_keys(np.array([code | 4 << 8 * L.PIECE]))
    v = L.Vocabulary(np.concatenate((keys("the", "cat"), piece)))
    assert v.size == 3 + 256
    ids, sizes, words = v.ids(["The CAT", None, "", "the abcde zabc!", "é"])
    byte = lambda b: 3 + b
    assert ids.tolist() == [0, 1, 0, 2, byte(ord("e")), byte(ord("z")), byte(ord("a")), byte(ord("b")), byte(ord("c")), byte(0xC3), byte(0xA9)]
    assert sizes.tolist() == [2, 0, 0, 7, 2] and words.tolist() == [2, 0, 0, 3, 1]


def plain_log_probability(net, ids, at):
    """One token's log-probability, step by step."""
    near = [ids[at + d] if 0 <= at + d < len(ids) else net.size for d in (-2, -1, 1, 2)]
    x = np.concatenate([net.word[i] for i in near]).astype(float)
    h = np.tanh(x @ net.place.astype(float))
    h[L.DIM] = 1
    z = net.of_class.astype(float) @ h
    code = bin(ids[at] + 1)[2:]
    k = len(code) - 1
    out = z[k] - math.log(sum(math.exp(v) for v in z))
    for depth in range(k):
        node = (1 << k) + int("1" + code[1 : 1 + depth], 2)
        s = float(net.tree[node].astype(float) @ h)
        out -= math.log1p(math.exp(-s if code[1 + depth] == "1" else s))
    return out


def random_net(size, seed=0):
    net = L.Network.first(size, max(1, size.bit_length()))
    net.flat += np.random.default_rng(seed).standard_normal(len(net.flat), dtype=np.float32) * np.float32(0.3)
    return net


def test_probabilities_equal_the_plain_ones_and_sum_to_one():
    net, rng = random_net(1000), np.random.default_rng(1)
    docs = [rng.integers(0, 1000, n).astype(np.int32) for n in (1, 5, 0, 40)]
    row, place = L.padded(np.concatenate(docs), np.array([len(d) for d in docs]), net.size)
    got = L.log_probabilities(net, row[place], row[place[:, None] + L._AROUND])
    assert got == pytest.approx([plain_log_probability(net, d.tolist(), k) for d in docs for k in range(len(d))], abs=1e-4)
    full = random_net(1023)
    every = np.arange(1023, dtype=np.int32)
    near = np.tile(np.array([[3, 1023, 700, 9]]), (1023, 1))
    assert np.exp(L.log_probabilities(full, every, near)).sum() == pytest.approx(1, abs=1e-3)


def test_gradient():
    net, rng = random_net(600), np.random.default_rng(2)
    ids = np.concatenate((np.arange(12), rng.integers(0, 600, 30))).astype(np.int32)
    row, place = L.padded(ids, np.array([len(ids)]), net.size)
    near = row[place[:, None] + L._AROUND]
    rows, g = L.moves(net, ids, near)
    assert len(set(rows.tolist())) == len(rows)
    dense = np.zeros_like(net.every)
    dense[rows] = g
    g = dense.ravel()
    for k in rng.choice(np.flatnonzero(np.abs(g) > 1e-3), 40):
        loss = []
        for d in (1e-2, -1e-2):
            moved = L.Network(net.flat.copy(), net.size, net.bits)
            moved.flat[k] += d
            loss.append(-L.log_probabilities(moved, ids, near).mean())
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(g[k], abs=2e-3)


def test_scores_equal_the_plain_ones_and_training_helps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") < 3000)
    scored = {}
    for rounds in (0, 2):
        model = L.train(docs, rounds=rounds, block=100_000)
        scored[rounds] = {r.doc_id: r for r in L.score_blocks(model.blocks, model).collect()}
    assert len(scored[2]) == docs.count()
    few = docs.where("text is not null").orderBy("doc_id").limit(20).collect()
    for r in few:
        ids = model.vocabulary.ids([r.text])[0].tolist()
        got = scored[2][r.doc_id]
        assert got.n_words == len(re.findall(rb"[0-9a-z\x80-\xff]+", r.text.encode().lower())) and got.n_tokens == len(ids)
        assert got.log_likelihood == pytest.approx(sum(plain_log_probability(model.net, ids, k) for k in range(len(ids))), rel=1e-4)
    mean = {k: sum(r.log_likelihood for r in v.values()) / sum(r.n_words for r in v.values()) for k, v in scored.items()}
    assert mean[2] > mean[0] + 0.5


def test_the_result_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = []
    for n in (1, 7):
        model = L.train(docs.repartition(n), rounds=2, block=20_000)
        out.append({r.doc_id: r.log_likelihood for r in L.score(docs.repartition(8 - n), model).collect()})
    assert out[0] == out[1]


def test_vocabulary_grows_with_the_corpus():
    assert L.least_count(0) == L.least_count(1_000_000) == L.LEAST_COUNT
    most = [n / L.least_count(n) for n in (10**k for k in range(6, 14))]  # words that can be that frequent
    assert all(b > 2 * a for a, b in zip(most, most[1:]))


def test_a_word_is_looked_up_once_however_often_it_occurs(monkeypatch):
    v = L.Vocabulary(keys("the", "cat"))
    asked, real = [], np.searchsorted

    def watched(a, x, *more, **named):
        if a is v.keys:
            asked.append(len(x))
        return real(a, x, *more, **named)

    monkeypatch.setattr(L.np, "searchsorted", watched)
    assert v.ids(["the cat " * 1000])[0].tolist() == [0, 1] * 1000
    assert asked == [2]


def test_counts_equal_the_plain_ones():
    texts = ["The cat, the dog", None, "", "catalogue zoë", "dog"]
    got = {}
    for b in L._counts(iter([L.pa.RecordBatch.from_arrays([L.pa.array(texts)], ["text"])])):
        got |= {k % 2**64: (n, w) for k, n, w in zip(*(c.to_pylist() for c in b.columns))}
    words = [w for t in texts for w in re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())]
    want = {int(keys(w.decode())[0]): (words.count(w), words.count(w)) for w in words}
    pieces = [w[k : k + L.PIECE] for w in words for k in range(0, len(w), L.PIECE)]
    code = lambda p: L._piece_keys(np.array([int.from_bytes(p, "little") | len(p) << 8 * L.PIECE], dtype=np.uint64))
    assert got == want | {int(code(p)[0]): (pieces.count(p), 0) for p in pieces}


def test_a_block_trains_as_plain_steps_do():
    for n in (0, 1, 7, 100_000):
        assert (L._mixed(n) == np.argsort(L.mix64(np.arange(n, dtype=np.uint64)), kind="stable")).all()
    ids, sizes = np.random.default_rng(3).integers(0, 600, 20_000).astype(np.int32), np.array([12_000, 8_000])
    net, plain = random_net(600), random_net(600)
    squares = np.full(len(plain.every), 1e-8)
    row, place = L.padded(ids, sizes, net.size)
    mixed = np.argsort(L.mix64(np.arange(len(ids), dtype=np.uint64)), kind="stable")
    for s in range(0, len(ids), L.BATCH):
        at = place[mixed[s : s + L.BATCH]]
        rows, g = L.moves(plain, row[at], row[at[:, None] + L._AROUND])
        squares[rows] += (g**2).sum(axis=1) / L.ROW
        plain.every[rows] -= 0.2 * g / np.sqrt(squares[rows])[:, None]
    L.train_block(net, ids, sizes, 0.2)
    assert net.flat == pytest.approx(plain.flat, abs=1e-4)
