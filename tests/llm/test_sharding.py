"""Jump hashing against the published loop, gapless slots, and hot or odd rows."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from planline.llm.ranks import ranked
from planline.llm.sharding import jump_shard, write_shards

NAMES = ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"]


def plain_jump(key, n):
    """The published loop, in whole numbers and doubles."""
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_loop(spark):
    draw = random.Random(3)
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [draw.randrange(-(2**63), 2**63) for _ in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 25, 300):
        assert all(r.s == plain_jump(r.k, n) for r in df.select("k", jump_shard(F.col("k"), n).alias("s")).collect())


def plain_shards(rows, n):
    """All rows at once: shards by the loop, slots by a sort."""
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        key = doc_id or 0
        out.append([doc_id, len(data) + 8, zlib.crc32(data), plain_jump(key, n), None, plain_jump(key, n + 1)])
    out.sort(key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    seen = Counter()
    for r in out:
        r[4] = seen[r[3]]
        seen[r[3]] += 1
    return Counter(map(tuple, out))


def test_same_as_brute_force_on_hot_and_odd_rows(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(10_000), f"text {draw.randrange(50)} ü") for _ in range(300)]
    rows += [(7, f"one id {k}") for k in range(200)] + [(8, "one row")] * 150 + [(None, "no id"), (None, None), (9, None), (9, ""), (10, "x" * 200_000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, slot string, shard int").repartition(5)
    got = write_shards(df, 6)
    assert Counter(tuple(r) for r in got.select(*NAMES).collect()) == plain_shards(rows, 6)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(20_000).select(jump_shard(F.col("id"), 24).alias("a"), jump_shard(F.col("id"), 25).alias("b"))
    moved = df.where("a <> b").agg(F.min("b"), F.max("b"), F.count("*")).first()
    assert moved[0] == moved[1] == 24 and abs(moved[2] - 20_000 / 25) < 120
    sizes = [r["count"] for r in df.groupBy("a").count().collect()]
    assert max(sizes) < 1.2 * 20_000 / 24 and min(sizes) > 0.8 * 20_000 / 24


def test_texts_and_further_columns_are_in_the_files(spark, odd, empty):
    got = write_shards(odd, 4)
    assert got.count() == odd.count() and got.where("lang = 'en'").count() == odd.where("lang = 'en'").count()
    assert write_shards(empty, 4).count() == 0


def test_ranks_count_rows_of_equal_keys_apart(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 3 < 2, F.col("id")).alias("v"))
    got = [(r.k, r.v) for r in ranked(df, ["k", "v"], "test").orderBy("rank").collect()]
    assert got == sorted(got, key=lambda r: (r[0], r[1] is not None, r[1] or 0)) and len(got) == 1000
    assert sorted(r.rank for r in ranked(df, ["k"], "test").collect()) == list(range(1000))
