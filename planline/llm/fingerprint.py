"""Document fingerprints: one-permutation MinHash. DataFrame functions only.

The hashes of a document's five-word shingles are put into ``BINS`` bins by their
leading bits, once; a bin keeps its least hash. An empty bin takes the value of the
bin that a hash of both numbers puts first among the filled ones: the order differs
from bin to bin, as in optimal densification, and always ends. Of each value the low
``BITS`` bits are stored, two hex digits a bin; chance agreement of these bits is
taken out of the likeness.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planline.llm.decontaminate import pieces
from planline.llm.shared import only

BINS, BIN_BITS, BITS, WIDTH = 128, 7, 8, 5
#: Rows meant for one bucket of neighbours, and the most buckets: beyond these a bucket holds more rows.
BUCKET_ROWS, MOST_BUCKETS = 2048, 8192


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: array<tinyint> of ``BINS`` values; empty where the text has no word."""
    parts, words, hashes, mins, bins, values = (f"__{name}_{x}" for x in ("parts", "words", "hashes", "mins", "bins", "values"))
    c = F.col
    first = F.when(F.element_at(c(parts), 1) == "", 2).otherwise(1)
    tail = F.when((F.size(parts) > 1) & (F.element_at(c(parts), -1) == ""), 1).otherwise(0)
    df = df.withColumn(parts, pieces(c(text)))
    df = df.withColumn(words, F.slice(c(parts), first, F.greatest(F.lit(0), F.size(parts) - first - tail + 1)))
    n = F.size(words)
    shingle = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - WIDTH + 1)), lambda i: F.xxhash64(F.slice(c(words), i, WIDTH)))
    df = df.withColumn(hashes, F.sort_array(F.when(n > 0, shingle).otherwise(F.array().cast("array<long>"))))
    # leading bits as a signed number: rises along the sorted hashes
    leading = lambda x: F.shiftright(x, 64 - BIN_BITS)
    df = df.withColumn(mins, F.filter(c(hashes), lambda x, i: (i == 0) | (leading(x) != leading(F.get(c(hashes), i - 1)))))
    df = df.withColumn(bins, F.transform(c(mins), lambda x: leading(x).cast("int")))
    df = df.withColumn(values, F.transform(c(mins), lambda x: F.shiftright(F.shiftleft(x, 56), 56).cast("tinyint")))

    def value(i: Column) -> Column:
        at = F.array_position(c(bins), i)
        donor = F.array_min(F.transform(c(bins), lambda b, k: F.struct(F.xxhash64(i, b).alias("h"), k.alias("k"))))["k"]
        return F.when(at > 0, F.get(c(values), (at - 1).cast("int"))).otherwise(F.get(c(values), donor))

    every = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), value)
    whole = F.when(F.size(mins) == BINS, c(values)).when(F.size(mins) > 0, every).otherwise(c(values))
    return df.withColumn(name, whole).drop(parts, words, hashes, mins, bins, values)


def packed(sketch: Column) -> Column:
    """Hex digits of the stored bits; '' where there is no word."""
    return F.array_join(F.transform(sketch, lambda v: F.lpad(F.lower(F.hex(v.cast("int").bitwiseAND(F.lit(255)))), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, with agreement by chance taken out; 1 for two texts without words."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    raw = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(
        (F.size(a) == F.size(b)).cast("double")
    )


def _bucketed(docs: DataFrame) -> DataFrame:
    """Add ``bucket``, which falls along the order of descending doc_id (nulls last), then tie.

    Borders are quantiles of doc_id, so any ids give even buckets. An id that fills more
    than one bucket alone is parted by its ties, which are hashes; so are null ids.
    """
    n, known = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    count = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    at = [k / count for k in range(1, count)]
    borders = docs.agg(F.percentile_approx("doc_id", at, 20 * count)).first()[0] if at and known else []
    own = Counter(borders)
    parts = {x: k + 1 for x, k in own.items() if k > 1}
    edges = sorted(own)
    # ids above the k-th edge and up to the next one have place k + 1; so a place holds one heavy id at most, at its end
    place = F.lit(0)
    if edges:
        found = F.aggregate(  # halves the range of edges until one place is left
            F.sequence(F.lit(1), F.lit(len(edges).bit_length())),
            F.struct(F.lit(0).alias("low"), F.lit(len(edges)).alias("high")),
            lambda r, _: F.when(r["low"] >= r["high"], r).when(
                F.get(F.lit(edges), ((r["low"] + r["high"]) / 2).cast("int")) < F.col("doc_id"), F.struct((((r["low"] + r["high"]) / 2).cast("int") + 1).alias("low"), r["high"].alias("high"))
            ).otherwise(F.struct(r["low"].alias("low"), ((r["low"] + r["high"]) / 2).cast("int").alias("high"))),
        )
        place = found["low"]
    heavy = F.create_map(*[F.lit(v) for x, k in parts.items() for v in (x, k)]) if parts else None
    spread = F.coalesce(heavy[F.col("doc_id")], F.lit(1)) if parts else F.lit(1)
    nulls = max(1, -(-(n - known) // BUCKET_ROWS))
    spread = F.when(F.col("doc_id").isNull(), F.lit(min(nulls, MOST_BUCKETS))).otherwise(spread)
    part = F.floor((F.shiftright("tie", 32) + F.lit(1 << 31)) * spread / F.lit(1 << 32)).cast("long") if parts or nulls > 1 else F.lit(0)
    # within a place: lighter ids first, then the heavy id in its parts
    alone = F.coalesce(F.col("doc_id").isin(list(parts)), F.lit(False)).cast("long") if parts else F.lit(0).cast("long")
    first = F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(2 * place.cast("long") + alone)
    return docs.withColumn("bucket", first * F.lit(MOST_BUCKETS + 1) + part)


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint each text, its edited form, and compare with the next document.

    The next document has the next lower doc_id (after the lowest: the highest).
    The edited text is the text whose last floor(n/2) code points are replaced by
    the first as many, or all, of the next text. Neighbours are found in ranges of
    doc_id, each sorted on its own; only the first row of each range is looked up
    from another, so the texts are shuffled once and no task sees all rows.

    A null text counts as empty; null ids come last. Rows with the same id are
    neighbours in the order of their texts' hashes. One row is its own neighbour; an
    empty table gives no rows. Other columns are ignored.
    """
    docs = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    docs = _bucketed(docs.withColumn("tie", F.xxhash64("text")))
    heads = docs.groupBy("bucket").agg(F.max_by("text", F.struct("doc_id", "tie", "text")).alias("text"))
    # the filled buckets in order, about MOST_BUCKETS numbers at most; each looks up the head of the next
    filled = sorted((r.bucket for r in docs.select("bucket").distinct().collect()), reverse=True)
    follows = docs.sparkSession.createDataFrame(list(zip(filled, filled[1:] + filled[:1])), "before long, bucket long")
    heads = with_sketch(heads, "text", "head_sketch").join(follows, "bucket").select(F.col("before").alias("bucket"), F.col("text").alias("head"), "head_sketch")

    rows = with_sketch(docs, "text", "sketch")
    near = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), F.desc("tie"), F.desc("text"))
    rows = rows.withColumns({"lead_text": F.lead("text").over(near), "lead_sketch": F.lead("sketch").over(near)})
    rows = rows.hint("shuffle_merge").join(heads, "bucket", "left")
    rows = rows.select(
        "doc_id",
        "text",
        "sketch",
        F.char_length("text").cast("long").alias("n_chars"),
        F.coalesce("lead_text", "head").alias("next_text"),
        F.when(F.col("lead_text").isNull(), F.col("head_sketch")).otherwise(F.col("lead_sketch")).alias("next_sketch"),
    )
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited"))
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("sketch")).alias("fingerprint"),
        packed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
