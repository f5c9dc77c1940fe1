"""Language ID by rank-order profiles.

A profile lists a language's most frequent letter n-grams (1 to 3 letters, a word's
edge counts as a letter) in order. A document's own list is compared with each
profile by the out-of-place distance: how far each n-gram's rank is from its rank in
the profile, the list's full length where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planline.llm.shared import only, slices

PROFILE = 400
#: Most training documents of a language; a keyed hash of the id picks them.
TRAIN_DOCS = 4000
#: Most languages with a profile, the commonest; rarer values of lang are taken for errors.
MOST_LANGS = 500

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), dtype=bool))
    return _LETTERS[0]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's n-grams, 21 bits a letter, and their counts."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    table = _letters()
    letter = table[np.minimum(raw, len(table) - 1)]
    if not letter.any():
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    # each run of other characters becomes one space; one stands at either end
    flat = np.where(letter, raw, 32).astype(np.uint64)
    flat = np.concatenate(([32], flat, [32])).astype(np.uint64)
    is_letter = flat != 32
    keep = is_letter | np.concatenate(([True], is_letter[:-1]))
    flat = flat[keep]
    is_letter = flat != 32
    bits = np.uint64(21)
    two = flat[:-1] << bits | flat[1:]
    three = two[:-1] << bits | flat[2:]
    codes = np.concatenate((flat[is_letter], two, three[is_letter[1:-1]]))
    return np.unique(codes, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, []).append(text or "")
    for lang, texts in held.items():
        codes, counts = ngram_counts("\n".join(texts))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)], ["lang", "code", "n"]
        )


def train_profiles(rows: DataFrame, size: int = PROFILE, train_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Profiles from rows (doc_id, text, lang), at most about ``train_docs`` a language.

    Rows without lang or text are left out. No rows give no profiles.
    """
    rows = only(rows, "doc_id", "text", "lang").where("lang is not null and text is not null")
    # the commonest languages alone; some 400 rows of each come to the driver
    have = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS)
    known = rows.join(F.broadcast(have), "lang")
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) * F.col("count").cast("double") < F.lit(train_docs * 1e6)).select("lang", "text")
    counts = picked.select("lang", "text").mapInArrow(_train, "lang string, code long, n long")
    counts = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    out: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r.lang, r["rank"])):
        out.setdefault(r.lang, []).append(r.code)
    return {k: np.array(v, dtype=np.uint64) for k, v in out.items()}


class Profiles:
    """Profiles laid out for lookup: all known codes sorted, and their rank in each language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([profiles[k] for k in self.langs])) if profiles else np.zeros(0, dtype=np.uint64)
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[k, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the share of its closeness (full length less mean distance) in that of all."""
        codes, counts = ngram_counts(text or "")
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = ranked(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rank = self.rank[:, np.where(self.codes[at] == own, at, len(self.codes))]
        away = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own)))).sum(axis=1)
        close = 1 - away / (self.size * len(own))
        best = int(np.argmin(away))  # ties: the first by name
        total = close.sum()
        return self.langs[best], float(close[best] / total) if total > 0 else 0.0


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """Per document: doc_id, lang_pred, score (0 to 1), from the whole text alone.

    A null text, or one without letters, is ``und`` with score 0; so is everything
    where there are no profiles. Ties go to the language first by name. Repeated rows
    and null ids are kept; other columns are ignored.
    """
    model = Profiles(profiles, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
