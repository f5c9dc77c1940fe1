"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles; equal sets are one set from the start. In
each of ``RUNS`` runs a set goes down a tree: at a node it enters the child of every
shingle that a hash of node and shingle picks, each with probability
``BRANCH / size``. Two similar sets pick mostly the same shingles and so meet in most
runs. Buckets of up to ``SMALL`` sets are compared by brute force; larger ones are
split again on further shared shingles, unless the split would not part them (they
are then much alike), in which case they are compared in blocks. A pair that meets in
several buckets counts in the first alone. Pairs are never written: a block gives each
set its number of links and one edge to its block's component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planline.llm.components import components
from planline.llm.shared import dropped, mix64, only, shingles, slices, written

SIMILARITY = 0.8
WIDTH = 5
#: Picked shingles of a set at a node, on average.
BRANCH = 2.0
#: Wanted share of found pairs at the least similarity.
RECALL = 0.9999
SMALL = 512
#: One set in so many tells whether a split parts a bucket.
PROBE = 8
DEEPEST = 6
#: Sets and bytes of one side of a block.
BLOCK_SETS, BLOCK_BYTES = 2048, 8 << 20
#: Shingles of a block that are compared at once.
SLAB = 1024
#: A set must meet others on so many of its first paths; :func:`runs_for` counts what this may lose.
LEAST_MEETINGS = 4


def runs_for(recall: float, similarity: float, branch: float = BRANCH, depth: int = DEEPEST, least: int = LEAST_MEETINGS) -> int:
    """Runs until pairs at the least similarity are found with probability ``recall``.

    Sets of equal size share 2s/(1+s) of their shingles, of unequal size at least s of
    the larger one's, so ``branch * s`` children hold both on average; the number is
    near Poisson. Meeting at each depth is a branching process. A pair is also lost if
    it shares fewer than ``least`` of all first paths.
    """
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-branch * similarity * meet)
    runs = 1
    while True:
        mean = runs * branch * similarity
        few = sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(least))
        if (1 - meet) ** runs + few <= 1 - recall:
            return runs
        runs += 1


def _children(node: np.uint64, tokens: np.ndarray, branch: float) -> np.ndarray:
    """Nodes below ``node`` that a set enters; a set of few shingles enters them all.

    Shingles are hashes already: a product with an odd number of the node's own picks them.
    """
    limit = branch / len(tokens)
    if limit < 1:
        tokens = tokens[tokens * (node | np.uint64(1)) < np.uint64(int(limit * 2**64))]
    return mix64(tokens ^ node)


def _seed(run: int) -> np.uint64:
    return mix64(np.array([run + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]


def _set_key(tokens: np.ndarray) -> bytes:
    return hashlib.md5(tokens.tobytes()).digest()


def _sketch(runs: int, branch: float, width: int):
    seeds = [_seed(r) for r in range(runs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, paths = [], []
            for text in batch.column(1).to_pylist():
                tokens = shingles((text or "").encode("utf-8", "replace"), width)
                if len(tokens):
                    keys.append(_set_key(tokens))
                    paths.append(np.unique(np.concatenate([_children(s, tokens, branch) for s in seeds])).astype(np.int64))
                else:
                    keys.append(None)
                    paths.append(np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(paths, pa.list_(pa.int64()))], ["doc_id", "key", "paths"]
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            wanted = batch.column(0).to_pylist()
            sets = [shingles((t or "").encode("utf-8", "replace"), width) for t in batch.column(1).to_pylist()]
            meant = [(k, s.tobytes()) for k, s in zip(wanted, sets) if _set_key(s) == k]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in meant], pa.binary()), pa.array([m[1] for m in meant], pa.binary())], ["key", "tokens"]
            )

    return run


def _split(branch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parent, path, key = [], [], []
            for p, k, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
                node = np.array([p], dtype=np.int64).astype(np.uint64)[0]
                own = np.unique(_children(node, np.frombuffer(t, dtype=np.uint64), branch)).astype(np.int64).tolist()
                parent += [p] * len(own)
                key += [k] * len(own)
                path += own
            yield pa.RecordBatch.from_arrays([pa.array(parent, pa.int64()), pa.array(path, pa.int64()), pa.array(key, pa.binary())], ["parent", "path", "key"])

    return run


def similar_pairs(sets: list[np.ndarray], first: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j), i < first <= j or, where first is 0, i < j, of pairs at least that similar."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    code = pd.factorize(np.concatenate(sets))[0]
    often = np.bincount(code) > 1
    keep = often[code]
    code, owner = (np.cumsum(often) - 1)[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    left = slice(0, first or n)
    right = slice(first, n)
    both = np.zeros((left.stop, n - first), dtype=np.float32)
    total = int(code[-1]) + 1 if len(code) else 0
    for at in range(0, total, SLAB):
        a, b = np.searchsorted(code, (at, at + SLAB))
        slab = np.zeros((n, min(SLAB, total - at)), dtype=np.float32)
        slab[owner[a:b], code[a:b] - at] = 1
        both += slab[left] @ slab[right].T
    # both / (a + b - both) >= s, in whole numbers' exact range
    enough = both * (1 + similarity) >= similarity * (size[left][:, None] + size[right][None, :]) - 1e-4
    i, j = np.nonzero(enough)
    j = j + first
    pick = i < j
    i, j = i[pick], j[pick]
    common = both[i, j - first].astype(np.int64)
    exact = common / (size[i] + size[j] - common) >= similarity
    return i[exact], j[exact]


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value that rows of a and b share; rows are padded with the greatest number."""
    none = np.iinfo(np.int64).max
    out = np.full(len(a), none)
    for k in range(a.shape[1]):
        value = a[:, k]
        shared = (b == value[:, None]).any(axis=1) & (value != none)
        out = np.where(shared, np.minimum(out, value), out)
    return out


def _compare(similarity: float):
    columns = ["key", "root", "links", "text_links"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, one, two = pdf.bucket.iat[0], pdf.one.iat[0], pdf.two.iat[0]
        pdf = pdf.sort_values(["chunk", "key"])
        sets = [np.frombuffer(t, dtype=np.uint64) for t in pdf.tokens]
        first = 0 if one == two else int((pdf.chunk == one).sum())
        if len(sets) < 2 or (one != two and first in (0, len(sets))):
            return pd.DataFrame([], columns=columns)
        i, j = similar_pairs(sets, first, similarity)
        if not len(i):
            return pd.DataFrame([], columns=columns)
        most = max(map(len, pdf.buckets))
        lists = np.full((len(pdf), most), np.iinfo(np.int64).max)
        for k, own in enumerate(pdf.buckets):
            lists[k, : len(own)] = own
        mine = np.concatenate([_first_common(lists[i[s : s + 65536]], lists[j[s : s + 65536]]) == bucket for s in range(0, len(i), 65536)])
        copies = pdf.copies.to_numpy()
        links = np.bincount(i[mine], copies[j[mine]], len(sets)) + np.bincount(j[mine], copies[i[mine]], len(sets))
        texts = np.bincount(i[mine], minlength=len(sets)) + np.bincount(j[mine], minlength=len(sets))
        root = np.arange(len(sets))
        while True:  # labels fall to the least of each component
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        at = np.unique(np.concatenate((i, j)))
        keys = pdf.key.to_numpy()
        return pd.DataFrame({"key": keys[at], "root": keys[root[at]], "links": links[at].astype(np.int64), "text_links": texts[at].astype(np.int64)})

    return run


def jaccard_join(
    docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, recall: float = RECALL, branch: float = BRANCH, small: int = SMALL
) -> DataFrame:
    """Per document: doc_id, class_id, n_links, n_text_links, n_copies.

    class_id is the least doc_id of the component of documents linked by a similarity
    of at least ``similarity``; n_links counts the other documents so linked to this
    one, copies included; n_text_links the different sets; n_copies the documents with
    this one's set. Texts of fewer than ``width`` words are one shingle. Null and
    wordless texts have no set, link to nothing and are their own class (a null doc_id
    among these keeps a null class). Repeated rows are copies of one another and each
    gets a row. Other columns are ignored.
    """
    docs = only(docs, "doc_id", "text")
    runs = runs_for(recall, similarity, branch)
    sketched = written(docs.mapInArrow(_sketch(runs, branch, width), "doc_id long, key binary, paths array<long>"), "paths")
    reps = sketched.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("paths").alias("paths")
    )
    reps = written(reps, "sets")
    members = reps.select(F.explode("paths").alias("path"), "key")
    shared = _shared(members)
    # a set that meets others on a stray path alone has no partner; a small set enters all its paths
    enough = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(LEAST_MEETINGS, runs)).select("key")
    alive = written(_shared(shared.select("path", "key").join(enough, "key")), "members")

    wanted = alive.select("key").distinct().join(reps.select("key", "rep"), "key").select("rep", F.col("key").alias("want"))
    # a doc_id may stand on several rows: the set's key tells which is meant
    tokens = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.rep)).select("doc_id", "want", "text").dropDuplicates()
    tokens = written(tokens.select("want", "text").mapInArrow(_sets(width), "key binary, tokens binary"), "tokens")

    working = [alive, tokens]
    final = None
    depth = 1
    while True:
        done = alive.where((F.col("size") <= small) | F.lit(depth >= DEEPEST))
        large = alive.where((F.col("size") > small) & F.lit(depth < DEEPEST))
        if depth >= DEEPEST or not large.limit(1).count():
            final = alive if final is None else final.unionByName(alive)
            break
        # a bucket that a split would hardly part stays whole; a hash picks sets of each that tell
        some = _below(large.where(F.pmod(F.xxhash64("key"), F.lit(PROBE)) == 0), tokens, branch)
        size = some.groupBy("parent", "path").agg(F.count(F.lit(1)).alias("size"))
        together = size.groupBy("parent").agg(F.sum(F.col("size") * (F.col("size") - 1)).alias("together"))
        probed = large.where(F.pmod(F.xxhash64("key"), F.lit(PROBE)) == 0).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        judged = probed.join(together, F.col("parent") == F.col("path"), "left")
        stays = written(judged.where(F.col("together") > 0.5 * F.col("n") * (F.col("n") - 1)).select("path"), "whole")
        kept = done.unionByName(large.join(stays, "path"))
        final = kept if final is None else final.unionByName(kept)
        split = written(_below(large.join(stays, "path", "left_anti"), tokens, branch), "split")
        alive = written(_shared(split.select("path", "key")), "members")
        dropped(split)
        working += [stays, alive]
        depth += 1

    # buckets of the same sets are one
    held = final.groupBy("path").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.pmod(F.xxhash64("key"), F.lit(1 << 40))).alias("sum"),
        F.sum(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 40))).alias("sum2"),
    )
    bucket = held.groupBy("size", "sum", "sum2").agg(F.min("path").alias("path"))
    kept = written(final.select("path", "key").join(bucket.select("path", "size"), "path"), "buckets")
    lists = kept.groupBy("key").agg(F.sort_array(F.collect_list("path")).alias("buckets"))
    full = tokens.join(lists, "key").join(reps.select("key", "copies"), "key")
    placed = kept.withColumnRenamed("path", "bucket").join(full, "key")
    heavy = placed.groupBy("bucket").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum(F.length("tokens")) / BLOCK_BYTES)).alias("chunks")
    )
    placed = placed.drop("size").join(heavy, "bucket").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    blocks = placed.select("bucket", "key", "tokens", "buckets", "copies", "chunk", other.alias("other"))
    blocks = blocks.select(
        "bucket", "key", "tokens", "buckets", "copies", "chunk", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two")
    )
    found = written(
        blocks.groupBy("bucket", "one", "two").applyInPandas(_compare(similarity), "key binary, root binary, links long, text_links long"),
        "links",
    )
    degree = found.groupBy("key").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    classed = (
        reps.select("key", "rep", "copies")
        .join(degree, "key", "left")
        .join(roots.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    least = classed.groupBy("root").agg(F.min("rep").alias("class_id"))
    classed = written(classed.join(least, "root").select("key", "class_id", "copies", "links", "text_links"), "classes")
    for table in (*working, reps, kept, found):
        dropped(table)
    zero = F.lit(0).cast("long")
    return (
        sketched.select("doc_id", "key")
        .join(classed, "key", "left")
        .select(
            "doc_id",
            F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            (F.coalesce("links", zero) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
            F.coalesce("text_links", zero).alias("n_text_links"),
            F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"),
        )
    )


def _below(members: DataFrame, tokens: DataFrame, branch: float) -> DataFrame:
    """(parent, path, key): the children that the sets of buckets enter."""
    return members.select("path", "key").join(tokens, "key").select("path", "key", "tokens").mapInArrow(_split(branch), "parent long, path long, key binary")


def _shared(members: DataFrame) -> DataFrame:
    """(path, key, size) of buckets with at least two sets."""
    size = members.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return members.join(size, "path")
