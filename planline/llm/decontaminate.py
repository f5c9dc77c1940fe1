"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions only.

Items are cut into windows of ``width`` consecutive words (a shorter item is one
window). The words of a window are ordered by rarity (document frequency over all
documents, then the word); as containment must be complete, the prefix that has to
match is the one rarest word. A document word that is some window's prefix word
puts that window at one place of the document; the length and position bounds
(the window must fit before and after that word) are applied in the join, and the
document's words at that place are compared with the window, word for word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planline.llm.shared import only

#: Whatever is no word: ASCII but 0-9 and a-z, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Pairs of window and item beyond this many are joined by a shuffle in place of a broadcast.
BROADCAST_WINDOWS = 200_000


#: Letters beyond ASCII that lower() would change.
_OTHER_UPPER = r"[\P{ASCII}&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"


def folded(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does that alone where no other capital stands."""
    return F.when(text.rlike(_OTHER_UPPER), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(
        F.lower(text)
    )


def pieces(text: Column) -> Column:
    """Words in order; an empty string may stand first and last."""
    return F.split(folded(F.coalesce(text, F.lit(""))), SEPARATORS)


def word_count(parts: Column) -> Column:
    """Number of words of :func:`pieces`."""
    size = F.size(parts)
    edge = (F.element_at(parts, 1) == "").cast("int")
    return (size - edge - ((size > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def _windows(items: DataFrame, width: int) -> DataFrame:
    """window (array of words), item_id; one row for each distinct pair."""
    words = items.select("item_id", F.filter(pieces(F.col("text")), lambda w: w != "").alias("words"))
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - width + 1))
    return (
        words.where(n > 0)
        .select("item_id", F.explode(starts).alias("at"), "words")
        .select("item_id", F.slice("words", F.col("at"), width).alias("window"))
        .distinct()
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    width: int = 13,
    share: int = 20,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or wordless text has no words and is clean; so is everything where
    ``items`` is empty. Null item texts have no windows; a null item_id counts for
    hits but not among items. Repeated rows each get their result: rows are told
    apart by doc_id and text. Only doc_id, text and item_id are read, so other
    columns may have any name.
    """
    docs = only(docs, "doc_id", "text")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit(""))))
    items = only(items, "item_id", "text")
    pairs = _windows(items, width)
    pairs = pairs.withColumn("window_id", F.md5(F.concat_ws(" ", "window")))
    windows = pairs.select("window_id", "window").distinct()

    # What is broadcast is counted first: of it only the words, ``width`` for each, are more than the pairs. Both paths give the same rows.
    small = pairs.limit(broadcast_windows + 1).count() <= broadcast_windows
    side = F.broadcast if small else (lambda df: df)

    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    frequency = (
        docs.select(F.explode(F.array_distinct(pieces(F.col("text")))).alias("word"))
        .join(side(vocabulary), "word", "left_semi" if not small else "inner")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    ranked = (
        windows.select("window_id", "window", F.posexplode("window").alias("offset", "word"))
        .join(frequency, "word", "left")
        .groupBy("window_id")
        .agg(
            F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "offset")).alias("prefix"),
            F.first("window").alias("window"),
        )
        # a window with a word that no document has cannot occur
        .where(F.col("prefix.df") > 0)
        .select("window_id", "window", F.size("window").alias("n"), F.col("prefix.offset").alias("offset"), F.col("prefix.word").alias("word"))
    )
    parts = docs.select(key.alias("key"), pieces(F.col("text")).alias("parts"))
    begin = F.col("pos") - F.col("offset")
    fits = (begin >= 0) & (begin + F.col("n") <= F.col("size"))
    same = F.slice("parts", begin + 1, F.col("n")) == F.col("window")
    placed = parts.select("key", "parts", F.size("parts").alias("size"), F.posexplode("parts").alias("pos", "word"))
    if small:
        found = placed.join(F.broadcast(ranked), "word").where(fits & same)
    else:
        found = (
            placed.drop("parts").join(ranked, "word").where(fits).join(parts.dropDuplicates(["key"]), "key").where(same)
        )
    hits = found.select("key", begin.alias("begin"), "n", "window_id").distinct()

    # Words under any window: places in order, each adds what the end so far leaves.
    cover = F.aggregate(
        F.array_sort(F.collect_set(F.struct("begin", "n"))),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["hit"] + F.greatest(F.lit(0), x["begin"] + x["n"] - F.greatest(acc["end"], x["begin"]))).cast("long").alias("hit"),
            F.greatest(acc["end"], x["begin"] + x["n"]).alias("end"),
        ),
    )["hit"]
    covered = hits.groupBy("key").agg(cover.alias("n_hit"))
    of_items = (
        hits.select("key", "window_id")
        .distinct()
        .join(side(pairs.select("window_id", F.col("item_id").cast("string").alias("item"))), "window_id")
        .groupBy("key")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    counted = docs.select("doc_id", key.alias("key"), word_count(pieces(F.col("text"))).alias("n_words"))
    out = counted.join(covered, "key", "left").join(of_items, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
