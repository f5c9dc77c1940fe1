"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, accents off, look-alike letters of other scripts
and digits or signs that stand for letters put back. The lexicon holds words and word
beginnings with the weight that labelled documents give them (log odds), and
exception phrases that take the weight of the words in them away. A text's weight is
normalised by its length; a logistic curve fitted to the labelled documents turns
total and rate into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planline.llm.shared import only, slices

#: Most labelled documents that are learned from; a hash of the id picks them.
TRAIN_DOCS = 4_000
#: A term stands in this many toxic documents at least, and has this log odds.
LEAST_DOCS, LEAST_WEIGHT = 3, 2.5
STEMS = range(4, 9)
FOLDS = 4
#: Share of a beginning's documents that may be those of one word.
ONE_WORD = 0.7

# Look-alike letters (Cyrillic, Greek) and their Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
# Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

_WORD = re.compile(r"[^\W_]+")
#: words with a digit or sign that may stand for a letter
_MIXED = re.compile(r"[\w@$|!]*[0-9@$|!][\w@$|!]*")
_SIGNS = str.maketrans(SUBSTITUTES)
_MARKS = re.compile("[̀-ͯ]")
_LOOKS = str.maketrans(HOMOGLYPHS)


def _letters_for_signs(m: re.Match) -> str:
    """A word with some letter gets letters for its digits and signs, but for signs at its end."""
    word = m[0]
    core = word.rstrip("!|$@")
    return core.translate(_SIGNS) + word[len(core) :] if any(c.isalpha() for c in core) else word


def fold(text: str) -> str:
    """Lower case, no accents, look-alikes and digit substitutions as Latin letters."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(_LOOKS)
    return _MIXED.sub(_letters_for_signs, text)


def folded_words(text: str | None) -> list[str]:
    return _WORD.findall(fold(text or ""))


class Lexicon:
    """Terms with weights; a term is a whole word (`` word ``) or a word's beginning (`` stem``)."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = (), curve: tuple[float, float, float] = (-2.0, 1.0, 0.0)):
        import ahocorasick

        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (term, weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (f" {phrase} ", 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions, self.curve)

    def features(self, words: list[str]) -> tuple[float, float]:
        """log(1 + weight of the matches), and the same for weight by 100 words.

        Of matches that begin at one place the heaviest counts; those inside an
        exception phrase do not. A term counts in full once, and by the logarithm of
        its number after that, so one repeated line cannot stand for many terms.
        """
        if not words or not len(self.automaton):
            return 0.0, 0.0
        best: dict[int, tuple[float, str]] = {}
        free: list[tuple[int, int]] = []
        for end, (term, weight) in self.automaton.iter(" " + " ".join(words) + " "):
            begin = end - len(term) + 1
            if weight:
                best[begin] = max(best.get(begin, (0.0, "")), (weight, term))
            else:
                free.append((begin, end))
        if free:  # ends rise; the least begin of the phrases that end beyond a place tells whether one covers it
            ends = [y for _, y in free]
            begins = list(accumulate((x for x, _ in reversed(free)), min))[::-1]
            best = {at: b for at, b in best.items() if (k := bisect_right(ends, at)) == len(ends) or begins[k] > at}
        found = Counter(best.values())
        total = sum(weight * (1 + math.log(n)) for (weight, _), n in found.items())
        return math.log1p(total), math.log1p(100 * total / len(words))

    def score(self, text: str | None) -> float:
        total, rate = self.features(folded_words(text))
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * total + c * rate))))


def learn_weights(rows: list[tuple[list[str], int]]) -> tuple[dict[str, float], tuple[str, ...]]:
    """Lexicon and exception phrases from folded documents and labels."""
    seen = [Counter(), Counter()]
    places: dict[str, set[str]] = {}
    size = [0, 0]
    for words, toxic in rows:
        size[toxic] += 1
        terms = set(words)
        for w in list(terms):
            terms.update(w[:n] + "*" for n in STEMS if len(w) > n)
        seen[toxic].update(terms)
        if toxic:
            for before, w in zip(["", *words], words):
                for t in (w, *(w[:n] + "*" for n in STEMS if len(w) > n)):
                    places.setdefault(t, set()).add(before)
    clean, bad = seen
    # copies of one document repeat a term in one place: as many places as documents are asked for
    bad = Counter({t: min(n, len(places[t])) for t, n in bad.items()})
    odds = lambda t: math.log((bad[t] + 0.5) / (size[1] + 1)) - math.log((clean[t] + 0.5) / (size[0] + 1))
    # a beginning that is nearly always one word stands back for that word
    single: dict[str, int] = {}
    for w, n in bad.items():
        if not w.endswith("*"):
            for k in STEMS:
                if len(w) > k:
                    single[w[:k] + "*"] = max(single.get(w[:k] + "*", 0), n)
    often = {t: n for t, n in bad.items() if n >= LEAST_DOCS and n > 2 * clean[t] and single.get(t, 0) < ONE_WORD * n}
    tried = sum(n + clean[t] >= LEAST_DOCS for t, n in bad.items())
    base, chance = math.log(size[1] / (size[0] + size[1])), -math.log(max(tried, 1))
    # a term's documents must not all be toxic by chance, however many terms are tried
    luck = lambda t: often[t] * base + math.lgamma(often[t] + clean[t] + 1) - math.lgamma(often[t] + 1) - math.lgamma(clean[t] + 1)
    fit = {t: w for t in often if luck(t) <= chance and (w := odds(t)) >= LEAST_WEIGHT}
    # a shorter beginning that is as telling stands for the longer ones and the words
    kept: dict[str, float] = {}
    for t in sorted(fit, key=lambda t: (len(t.rstrip("*")), t)):
        body = t.rstrip("*")
        if not any(body[:n] + "*" in kept and kept[body[:n] + "*"] >= fit[t] - 0.5 for n in STEMS if n < len(body) or (n == len(body) and t == body)):
            kept[t] = fit[t]
    top = sorted(kept, key=lambda t: (-bad[t], t))
    weights = {f" {t[:-1]}" if t.endswith("*") else f" {t} ": kept[t] for t in top}
    # pairs with a lexicon word that only clean documents hold
    whole = {t for t in top if not t.endswith("*")}
    pairs = [Counter(), Counter()]
    for words, toxic in rows:
        pairs[toxic].update({f"{a} {b}" for a, b in zip(words, words[1:]) if a in whole or b in whole})
    exceptions = tuple(sorted(p for p, n in pairs[0].items() if n >= 5 and not pairs[1][p]))
    return weights, exceptions


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (y - p) - 0.02 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def train(rows: DataFrame, train_docs: int = TRAIN_DOCS) -> Lexicon:
    """Lexicon from rows (doc_id, text, toxic) with toxic 0 or 1, at most about ``train_docs`` of them.

    Without labelled rows of both kinds the lexicon is empty. The curve is
    fitted to features of rows that had no part in their terms (``FOLDS`` folds), so
    that chance terms cannot vouch for themselves.
    """
    rows = only(rows, "doc_id", "text", "toxic").where("toxic in (0, 1) and text is not null")
    n = rows.count()
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1.0, train_docs / max(n, 1)) * 1_000_000)

    known: dict[str, str] = {}  # one string for each word, however often it stands
    local = [([known.setdefault(w, w) for w in folded_words(r.text)], int(r.toxic)) for r in picked.orderBy("doc_id").toLocalIterator()]
    if len({t for _, t in local}) < 2:
        return Lexicon({})
    weights, exceptions = learn_weights(local)
    x = np.zeros((len(local), 2))
    for fold_at in range(FOLDS):
        part = Lexicon(*learn_weights([r for k, r in enumerate(local) if k % FOLDS != fold_at]))
        for k in range(fold_at, len(local), FOLDS):
            x[k] = part.features(local[k][0])
    return Lexicon(weights, exceptions, _fit_curve(x, np.array([t for _, t in local], dtype=float)))


def score_column(lexicon: Lexicon):
    """The score as a function of a text column, for use beside other columns."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t) for t in texts], dtype="float64")

    return of


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per document: doc_id, score (0 to 1), from the whole text alone.

    Null and empty texts match nothing and get the curve's least score; so does
    everything under an empty lexicon. Repeated rows and null ids are kept; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [lexicon.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
