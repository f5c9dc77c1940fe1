"""Near words, forms and roots against brute force; bounds of the gram index."""

import random
import zlib
from collections import Counter

import pytest

from planline.llm import spelling as S


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)
    return {w: (f, root(w, out), n, k, m) for w, (f, n, k, m) in out.items()}


def root(w, rows):
    while rows[w][0]:
        w = rows[w][0]
    return w


def ours(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    rows = S.group_spellings(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len(counts)
    return {r.word: tuple(r)[1:] for r in rows}


def words(draw, n, letters="abé"):
    out = {}
    for _ in range(n):
        w = "".join(draw.choices(letters, k=draw.randrange(5, 9)))
        out[w] = draw.choice([3, 4, 6, 8, 12, 13, 24, 50, 99])
    return out


@pytest.mark.parametrize("frequent, long_list", [(64, 64), (3, 2), (1, 1), (10_000, 5)])
def test_same_as_brute_force(spark, monkeypatch, frequent, long_list):
    monkeypatch.setattr(S, "FREQUENT", frequent)
    monkeypatch.setattr(S, "LONG_LIST", long_list)
    counts = words(random.Random(frequent), 400)
    assert ours(spark, counts) == brute(counts)


def test_repeated_letters_marks_and_letters_beyond_latin(spark, monkeypatch):
    monkeypatch.setattr(S, "FREQUENT", 2)
    counts = {"a" * k: 3 * 2**k for k in range(5, 14)} | {"^aaaa": 3, "aaaa$": 7, "ÿÿÿÿÿ": 3, "ÿÿÿÿ×": 6, "x" * 3000: 3, "x" * 2999 + "y": 9}
    assert ours(spark, counts) == brute(counts)


def test_one_letter_touches_no_more_grams_than_the_bound():
    draw = random.Random(2)
    frequent = {"".join(draw.choices("^ab$", k=draw.randrange(2, 5))): 9 for _ in range(60)}

    def held(w):
        s = f"^{w}$"
        return Counter(s[p:e] for p, e in S.decompose(s, frequent)), S.affected(S.decompose(s, frequent), len(s))

    for _ in range(3000):
        w = "".join(draw.choices("ab", k=draw.randrange(5, 9)))
        k, c = draw.randrange(len(w) + 1), draw.choice("ab")
        x = draw.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
        if len(x) >= 5:
            (a, most), (b, _) = held(w), held(x)
            assert (a - b).total() <= most < a.total()
            if near(w, x):
                keys = lambda v: {key for key, _ in S.probes(v, frequent)}
                assert keys(w) & keys(x)


def test_runs_counts_nulls_and_empty_tables(spark, odd, empty):
    docs = [(i, t) for i in range(40) for t in ["Straße straße ABCDE abcde it's 12abcde3 Ünder", None, "", "éclair Éclair"]] + [(None, "nowhere nowhere nowhere")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = Counter()
    for i, t in docs:
        run = ""
        for ch in (t or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if ch < "\x80" else ch
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert {r.word: r.n for r in S.counted(S.damaged_runs(df)).collect()} == want
    assert S.group_spellings(S.counted(S.damaged_runs(odd))).count() > 0
    assert S.group_spellings(S.counted(S.damaged_runs(empty))).count() == 0


def test_forms_are_followed_to_the_last(spark):
    counts = {"aaaaa": 3, "aaaab": 7, "aaabb": 15, "aabbb": 31, "abbbb": 63, "bbbbb": 200, "zzzzz": 5}
    got = ours(spark, counts)
    assert {got[w][1] for w in counts if w != "zzzzz"} == {"bbbbb"} and got["zzzzz"] == (None, "zzzzz", 5, 0, None)
