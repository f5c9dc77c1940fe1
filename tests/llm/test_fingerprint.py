"""Fingerprints and neighbours against plain versions."""

import random
import re
from hashlib import sha256

import xxhash
from pyspark.sql import functions as F

from planline.llm import fingerprint as P

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(parts):
    """Hash of several values, each seeded by the one before."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(4, "little", signed=True), seed=h)
    return signed(h)


def plain_fingerprint(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return ""
    n = max(1, len(words) - P.WIDTH + 1)
    bins = {}
    for h in (hashed(words[k : k + P.WIDTH]) for k in range(n)):
        b = h >> (64 - P.BIN_BITS)
        bins[b] = min(h, bins.get(b, h))
    least = {b: h & 255 for b, h in bins.items()}
    donor = lambda i: min(sorted(least), key=lambda b: hashed([i, b]))
    return "".join(f"{least[i] if i in least else least[donor(i)]:02x}" for i in range(-P.BINS // 2, P.BINS // 2))


def test_fingerprints_equal_the_plain_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = P.fingerprint_neighbours(docs).collect()
    assert len(rows) == len(texts)
    for r in random.Random(1).sample(rows, 60):
        assert r.fingerprint == plain_fingerprint(texts[r.doc_id] or "")
        if texts[r.doc_id]:
            a, b = bytes.fromhex(r.fingerprint), bytes.fromhex(r.edited_fingerprint)
            raw = (sum(x == y for x, y in zip(a, b)) / P.BINS - 1 / 256) / (1 - 1 / 256)
            assert abs(r.near_edited - min(1, max(0, raw))) < 1e-9


def neighbours_hold(spark, ids, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 10)
    rows = [(i, f"text number {k} of id {i} " * (1 + k % 3)) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tied = [(r.doc_id, r.tie, r.text) for r in docs.withColumn("tie", F.xxhash64("text")).collect()]
    order = sorted(tied, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]), reverse=True)
    want = []
    for k, (i, _, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][2], len(text) // 2
        want.append((i, sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.edited_sha256) for r in P.fingerprint_neighbours(docs).collect()), key=key) == sorted(want, key=key)
    return P._bucketed(docs.withColumn("tie", F.xxhash64("text"))).groupBy("bucket").count().agg(F.max("count")).first()[0]


def test_neighbours_of_any_ids(spark, monkeypatch):
    rnd = random.Random(3)
    assert neighbours_hold(spark, [rnd.randrange(-(2**63), 2**63) for _ in range(300)], monkeypatch) <= 30
    assert neighbours_hold(spark, [*range(200), 2**62, *range(2**60, 2**60 + 100_000, 1000), -(2**63), 2**63 - 1], monkeypatch) <= 30


def test_neighbours_of_null_and_repeated_ids(spark, monkeypatch):
    assert neighbours_hold(spark, [None] * 150 + [7] * 150 + [*range(100)], monkeypatch) <= 40
    assert neighbours_hold(spark, [None] * 60, monkeypatch) <= 30
    neighbours_hold(spark, [5], monkeypatch)
