"""Operators against plain versions of what they compute."""

import random
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import md5, sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planline.llm import jaccard_join, private_data, suffix_dedup, suffix_sort, token_files
from planline.llm import queries as Q
from planline.llm.shared import shingles, span_hashes, word_hashes

SF = "/root/testdata/sf0.001"


@given(st.lists(st.binary(max_size=40), max_size=30), st.sampled_from([0, 8, 128]))
@settings(max_examples=150, deadline=None)
def test_deep_shallow_sort(strings, shallow):
    strings = strings + [s + b"x" for s in strings[:5]] + strings[:3]
    order, lcp = suffix_sort.deep_shallow_sort(strings, shallow)
    assert [strings[k] for k in order] == sorted(strings)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == n


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300))
@settings(max_examples=100, deadline=None)
def test_byte_code_round_trip(values):
    v = np.array(values, dtype="<u4")
    assert (token_files.decode_block(*token_files.encode_block(v), len(v)) == v).all()


@given(st.integers(2, 10**18), st.data())
@settings(max_examples=150, deadline=None)
def test_feistel_is_a_permutation(size, data):
    v = data.draw(st.integers(0, size - 1))
    new = private_data.permute(v, size, b"k", b"t")
    assert 0 <= new < size and private_data.permute(new, size, b"k", b"t", back=True) == v


def test_feistel_small_ranges():
    for size in range(2, 200):
        assert len({private_data.permute(v, size, b"k", b"t") for v in range(size)}) == size


def test_pseudonyms_keep_format_and_links():
    card = "4785380592391139"
    text = f"pay {card} or 4785-3805-9239-1139, born 1999-02-28, at 10.0.0.1 or 999.1.1.1, not 4785380592391138"
    new, counts, _ = private_data.pseudonymise(text, b"key")
    a, b = new.split()[1], new.split()[3].rstrip(",")
    assert a != card and private_data.luhn(a) and b.replace("-", "") == a and counts == {"card": 2, "date": 1, "ip": 1}
    assert "999.1.1.1" in new and "4785380592391138" in new
    assert private_data.pseudonymise(f"again {card}", b"key")[0].split()[1] == a
    assert private_data.pseudonymise(f"again {card}", b"other")[0].split()[1] != a


def test_hashes_of_words():
    text = "The cat, the CAT; thé café a" + "b" * 100 + " x" + "b" * 100
    words = "the cat the cat thé café".split() + ["a" + "b" * 100, "x" + "b" * 100]
    h = word_hashes(text.encode())
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words)) and h[0] == h[2] and h[1] == h[3]
    raw = np.frombuffer(b"abcabcdefghabcdefgh", dtype=np.uint8)
    h = span_hashes(raw, np.array([0, 3, 11]), np.array([3, 6, 14]))
    assert h[0] == h[1] == h[2]


@pytest.mark.parametrize("most", [2, 512])
def test_repeats_equal_brute_force(spark, most):
    rnd = random.Random(5)
    base = [bytes(rnd.choice(b"abcdefgh ") for _ in range(1500)).decode() for _ in range(4)]
    docs = [(k, base[k % 4][rnd.randint(0, 400) : rnd.randint(700, 1500)] + rnd.choice(["", "x"]) + base[(k + 1) % 4][: rnd.randint(0, 900)]) for k in range(24)]
    docs += [(99, "z" * 1100), (100, None), (101, "short")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    window = 400
    count = Counter(t[p : p + window] for _, t in docs if t for p in range(len(t) - window + 1))
    want = {}
    for k, t in docs:
        t = t or ""
        gone = [False] * len(t)
        for p in range(len(t) - window + 1):
            if count[t[p : p + window]] > 1:
                gone[p : p + window] = [True] * window
        kept = "".join(c for c, g in zip(t, gone) if not g)
        want[k] = (len(t), sum(gone), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), sha256(kept.encode()).hexdigest())
    spans = suffix_dedup.repeated_spans
    try:
        suffix_dedup.repeated_spans = lambda d, w: spans(d, w, most)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    finally:
        suffix_dedup.repeated_spans = spans
    assert got == want


def test_join_equals_brute_force(spark):
    rnd = random.Random(9)
    docs = []
    for g in range(6):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice([6, 30, 120]))]
        for _ in range(rnd.choice([1, 3, 40])):
            own = list(words)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = f"v{rnd.randint(0, 9)}"
            docs.append((len(docs), " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {k: set(shingles(t.encode()).tolist()) for k, t in docs}
    links, root = defaultdict(int), {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    for small in (4, 512):  # the lower figure makes the join split its buckets
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df, small=small).collect()}
        assert got == {k: (root[k], links[k]) for k in sets}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in Q.op1_language(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.97 * len(rows)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in Q.op5_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in rows) >= 0.9 * len(rows)


def test_fingerprint_likeness(spark):
    rows = Q.op6_fingerprints(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    sets = lambda t: set(shingles(t.encode()).tolist())
    error = []
    by = {r.doc_id: r for r in rows}
    for k, d in enumerate(order):
        t, n = texts[d], texts[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert by[d].edited_sha256 == sha256(edited.encode()).hexdigest() and by[d].n_chars == len(t)
        error.append(by[d].near_edited - likeness(sets(t), sets(edited)))
    assert np.sqrt(np.mean(np.square(error))) < 0.06 and abs(np.mean(error)) < 0.02


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tox = corpus_pipeline.toxicity(spark, docs, SF)
    assert tox.columns == docs.columns and tox.count() > 0.8 * docs.count()
    near = corpus_pipeline.near_copies(spark, tox, SF)
    assert near.count() == near.select("text").distinct().count() and near.columns == docs.columns
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
