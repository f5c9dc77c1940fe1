"""Budgets and prefixes against a plain recursive version."""

import random
from collections import defaultdict
from fractions import Fraction
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from planline.llm import mixing
from planline.llm import queries as Q

SF = "/root/testdata/sf0.001"


def plain_plan(leaves, weights, budget, epochs):
    """Each node's budget to its children in whole tokens, by exact fractions."""
    weight = lambda p: Fraction(max(1, round(weights[p] * mixing.UNIT)) if weights[p] > 0 else 0, mixing.UNIT) if p in weights else Fraction(1)

    def capacity(node):
        if node and not weight(node):
            return 0
        if node in leaves:
            return leaves[node] * epochs
        return sum(capacity(c) for c in {leaf[: len(node) + 1] for leaf in leaves if leaf[: len(node)] == node})

    out = {}

    def down(node, budget):
        if node in leaves:
            out[node] = budget
            return
        below = sorted({leaf[: len(node) + 1] for leaf in leaves if leaf[: len(node)] == node})
        given = {c: 0 for c in below if not capacity(c)}
        while True:
            left, total = budget - sum(given.values()), sum(weight(c) for c in below if c not in given)
            share = {c: left * weight(c) // total for c in below if c not in given}
            full = [c for c in share if share[c] >= capacity(c)]
            if not full:
                break
            given |= {c: capacity(c) for c in full}
        over = left - sum(share.values())
        for c in sorted(share, key=lambda c: md5(c[-1].encode()).hexdigest()):
            given[c] = share[c] + (over > 0)
            over -= 1
        for c, b in given.items():
            down(c, b)

    down((), min(budget, capacity(())))
    return out


def planned(spark, leaves, weights, budget, epochs):
    df = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "domain string, lang string, source string, n long")
    return {(r.domain, r.lang, r.source): r.take for r in mixing.plan(df, weights, budget, epochs).collect()}


def test_shortage_goes_to_siblings_first(spark):
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "1"): 1000, ("b", "x", "1"): 1000}
    got = planned(spark, leaves, {}, 400, 1)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "1"): 100, ("b", "x", "1"): 200}
    assert sum(planned(spark, leaves, {("a",): 9.0}, 2900, 1).values()) == 2900


def test_weight_zero_leaves_its_share_to_the_others(spark):
    leaves = {("a", "x", "1"): 100, ("a", "x", "2"): 1000, ("b", "x", "1"): 1000}
    assert planned(spark, leaves, {("a", "x", "2"): 0.0}, 1000, 1) == {("a", "x", "1"): 100, ("a", "x", "2"): 0, ("b", "x", "1"): 900}
    assert planned(spark, leaves, {("a",): 0.0}, 5000, 1) == {("a", "x", "1"): 0, ("a", "x", "2"): 0, ("b", "x", "1"): 1000}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    leaves, weights = {}, {}
    for d in range(rnd.randint(2, 4)):
        for lang in range(rnd.randint(1, 4)):
            for s in range(rnd.randint(1, 12)):
                leaves[f"d{d}", f"l{lang}", f"s{s}"] = rnd.choice([1, 7, 100, 5000])
    for leaf in leaves:
        for k in (1, 2, 3):
            if rnd.random() < 0.4:
                weights[leaf[:k]] = rnd.choice([0.0, 1e-8, 0.3, 2.5])
    for budget in (rnd.randint(1, sum(leaves.values())), 3 * sum(leaves.values())):
        assert planned(spark, leaves, weights, budget, 2) == plain_plan(leaves, weights, budget, 2)


def test_many_leaves(spark):
    df = spark.range(300_000).select(F.lit("d").alias("domain"), F.lit("en").alias("lang"), F.concat(F.lit("host"), "id").alias("source"), (F.col("id") % 100 + 1).alias("n"))
    out = mixing.plan(df, {}, 3_000_001, 1)
    assert out.agg(F.sum("take"), F.count("*"), F.max(F.col("take") - F.col("n"))).first() == (3_000_001, 300_000, 0)


def test_prefixes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs, Q.domain(), Q.DOMAIN_WEIGHTS, **Q.MIX).withColumn("h", F.xxhash64("text")).collect()
    leaf = lambda r: (r.mix_domain, r.mix_lang, r.mix_source)
    rows = defaultdict(list)
    for r in got:
        rows[leaf(r)].append(r)
    sizes = {k: n for k, v in rows.items() if (n := sum(r.mix_tokens for r in v))}
    taken = plain_plan(sizes, Q.DOMAIN_WEIGHTS, int(sum(sizes.values()) * Q.MIX["share"]), Q.MIX["epochs"])
    for k in sizes:
        full, rest = divmod(taken[k], sizes[k])
        at = 0
        for r in sorted(rows[k], key=lambda r: md5(f"1|{full}|{r.doc_id}|{r.h}".encode()).hexdigest()):
            at += r.mix_tokens
            assert r.mix_copies == (full + (at <= rest) if r.mix_tokens else 0)


def test_any_column_names_and_ties(spark):
    rows = [(1, "word " * 40, "en", "s")] * 5 + [(None, "word " * 40, None, None), (2, None, "en", "s"), (3, "", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("row", "order", "rest", "left", "range", "tokens", "full", "mix_full", "mix_rest", "mix_order", "mix_in", "in_prefix", "key", "domain", "n", "cut", "before"):
        docs = docs.withColumn(name, F.lit(name))
    out = mixing.mix(docs, F.lit("all"), {}, budget=3 * 50 + 49, epochs=1)
    assert out.columns == [*docs.columns, "mix_domain", "mix_lang", "mix_source", "mix_tokens", "mix_copies"]
    got = sorted((r.doc_id or 0, r.mix_copies) for r in out.collect())
    # the one row without language is all that its leaf has; 149 are left for the other leaf
    assert got == [(0, 1), (1, 0), (1, 0), (1, 0), (1, 1), (1, 1), (2, 0), (3, 0)]
    assert out.where("row <> 'row' or left <> 'left'").count() == 0
