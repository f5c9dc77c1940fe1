"""Spelling variants by a variable-length gram index: words one letter apart, and which of them is the form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planline.llm.shared import dropped, written

#: Letters of a word; only A-Z are folded.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shortest word (code points) and least number of occurrences.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Gram lengths. A word of five letters has six grams with its two end marks, and one changed
#: letter touches at most GRAM_MOST of them, so at least one always survives.
GRAM_LEAST, GRAM_MOST = 2, 5
#: A gram in more words than this is frequent, or in more than one word of so many: the
#: dictionary then has at most some 4 * (letters of a word) * DICTIONARY grams.
FREQUENT, DICTIONARY = 64, 5_000
#: Longer lists are split by what one deletion leaves of the rest of the word.
LONG_LIST = 64


def damaged_runs(docs: DataFrame) -> DataFrame:
    """word: every run of letters of every whole text, folded; where 97 divides crc32 of ``doc_id:run`` one letter is gone.

    Null texts have none; a null doc_id counts as empty text.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]+"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    fate = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    rows = rows.select("run", fate.alias("fate"))
    at = (F.col("fate") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select(F.when(F.col("fate") % 97 == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(runs: DataFrame) -> DataFrame:
    """word, n of the words that are long and frequent enough; counts are combined before the shuffle."""
    words = runs.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.where(F.col("n") >= LEAST_COUNT)


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """The frequent grams of ``^word$`` and in how many words each stands.

    Shorter grams that are not frequent need no extension and are left out, as is every
    gram that extends them, so the size is bounded by DICTIONARY whatever the vocabulary.
    """
    n_words = words.count()
    least = max(FREQUENT, n_words // DICTIONARY)
    marked = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("s"))

    def of_length(q: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("s") - (q - 1)), lambda p: F.col("s").substr(p, F.lit(q)))

    each = [of_length(q) for q in range(GRAM_LEAST, GRAM_MOST + 1)]
    grams = marked.select(F.explode(F.array_distinct(F.flatten(F.array(*each)))).alias("gram")).groupBy("gram").count()
    return {r["gram"]: r["count"] for r in grams.where(F.col("count") > least).toLocalIterator()}


def decompose(s: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """Start and end of the gram at each place: the shortest that is not frequent, at most GRAM_MOST letters.

    What is taken at a place depends on the letters taken alone, so a changed letter
    changes those grams alone that hold it or that it falls between.
    """
    out = []
    for p in range(len(s) - 1):
        e = p + GRAM_LEAST
        while e < len(s) and e - p < GRAM_MOST and s[p:e] in frequent:
            e += 1
        out.append((p, e))
    return out


def affected(grams: list[tuple[int, int]], length: int) -> int:
    """The most grams that one inserted, deleted or replaced letter can touch."""
    change = [0] * (length + 1)
    for p, e in grams:
        change[p] += 1
        change[e] -= 1
    most = now = 0
    for c in change[: length - 1]:
        now += c
        most = max(most, now)
    return most


def probes(word: str, frequent: dict[str, int]) -> list[tuple[str, str]]:
    """What a near word must share with this one: (what is equal, what may differ).

    Two near words have all but ``affected`` of their grams in common, so one of the
    ``affected`` + 1 rarest of each is common to both. The changed letter stands behind
    that gram, and all before it is equal too, or before it, and all behind is.
    """
    s = f"^{word}$"
    grams = decompose(s, frequent)
    rarest = sorted((frequent.get(s[p:e], 0), s[p:e], p, e) for p, e in grams)[: affected(grams, len(s)) + 1]
    heads = [("L" + s[:e], s[e:]) for _, _, _, e in rarest if e < len(s)]
    tails = [("R" + s[p:], s[:p]) for _, _, p, _ in rarest if p > 0]
    return list(dict.fromkeys(heads + tails))


def _indexed(frequent: dict[str, int], rests: bool):
    """Rows of hashed probes; with ``rests`` only those of hot keys, parted by the rest with one letter deleted."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = batch["hot"].to_pylist() if rests else [None] * batch.num_rows
            columns = (batch["word"].to_pylist(), batch["n"].to_pylist(), hot)
            for at in range(0, batch.num_rows, 1000):
                keys, words, ns = [], [], []
                for word, n, only in zip(*(c[at : at + 1000] for c in columns), strict=True):
                    found = set()
                    for key, rest in probes(word, frequent):
                        hashed = xxhash.xxh3_64_intdigest(key.encode()) - 2**63
                        if not rests:
                            found.add(hashed)
                        elif hashed in only:
                            left = {rest} | {rest[:j] + rest[j + 1 :] for j in range(len(rest))}
                            found |= {xxhash.xxh3_64_intdigest(f"{key} {x}".encode()) - 2**63 for x in left}
                    keys += found
                    words += [word] * len(found)
                    ns += [n] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], names=["key", "word", "n"])

    return index


_INDEX = "key long, word string, n long"


def _matched(lists: DataFrame) -> DataFrame:
    """Near pairs within lists: verified as they are met, so that no other pair becomes a row."""
    a = lists.select("key", F.col("word").alias("a"), F.col("n").alias("an"))
    b = lists.select("key", F.col("word").alias("b"), F.col("n").alias("bn"))
    near = F.levenshtein("a", "b", 1) == 1
    return a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & near).select("a", "an", "b", "bn")


def near_words(words: DataFrame) -> DataFrame:
    """a, an, b, bn: every pair of words (a < b) that one inserted, deleted or replaced code point parts."""
    frequent = gram_dictionary(words)
    index = written(words.select("word", "n").mapInArrow(_indexed(frequent, False), _INDEX), "grams")
    sizes = written(index.groupBy("key").count().where("count > 1"), "lists")
    short = index.join(sizes.where(F.col("count") <= LONG_LIST).select("key"), "key")
    hot = index.join(sizes.where(F.col("count") > LONG_LIST).select("key"), "key")
    # a word has at most 2 * (GRAM_MOST + 1) probes, so it is in so many hot lists at most
    of_word = hot.groupBy("word", "n").agg(F.collect_list("key").alias("hot"))
    parted = written(of_word.mapInArrow(_indexed(frequent, True), _INDEX), "rests")
    return _matched(short).unionByName(_matched(parted)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for words with a form: forms followed to the last, each round doubling the steps.

    A form occurs twice as often at least, so a chain is as long as the logarithm of the
    largest count and rounds are the logarithm of that.
    """
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = written(
            now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots"
        )
        dropped(now)
        now = after
    return now.select("word", "root")


def group_spellings(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table (word, n) of distinct words.

    The form of a word is its near word of largest n (ties: smallest in code-point order)
    where that n is at least twice its own, else null; root follows forms to the last.
    A word of fewer than five letters could lose all its grams and must not be given.
    Words are compared through lists of rare grams; lists of more than ``LONG_LIST`` words
    are parted further, none is cut. Pairs become rows only when verified, and are combined
    to one row a word. An empty table gives no rows.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = written(near_words(words), "near")
    best: Column = F.min(F.struct((-F.col("bn")).alias("minus"), F.col("b").alias("form")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")))
    found = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(found, "word", "left").select("word", "n", "n_near", "best.form", (-F.col("best.minus")).alias("form_n"))
    kept = F.col("form_n") >= 2 * F.col("n")
    formed = written(
        joined.select("word", F.when(kept, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("form_n")).alias("form_n")),
        "forms",
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
