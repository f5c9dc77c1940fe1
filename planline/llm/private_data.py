"""PII: format-preserving Feistel pseudonyms.

Found values are checked (card numbers by their check digit, IBANs by theirs, IPv4
parts and dates by range) and replaced by a keyed permutation within their format, so
that equal values stay equal everywhere under one key and lengths, separators and
validity are kept. Numbers are permuted as a whole by an alternating Feistel network
with HMAC-like rounds over two halves; where the format is narrower than the network's
domain the permutation is walked until it is back inside (cycle walking).
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from planline.llm.shared import only, slices

ROUNDS = 8
KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date", "secret")


def permute(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse."""
    if size < 2:
        return value
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    while True:
        left, right = value >> half, value & mask
        for r in rounds:
            if back:
                left, right = right ^ _round(left, r, half, key, tweak), left
            else:
                left, right = right, left ^ _round(right, r, half, key, tweak)
        value = left << half | right
        if value < size:
            return value


def _round(x: int, r: int, bits: int, key: bytes, tweak: bytes) -> int:
    width = (bits + 7) // 8
    data = bytes([r]) + x.to_bytes(width, "big") + tweak
    out = hashlib.blake2b(data, key=key, digest_size=min(64, width)).digest()
    for k in range(1, -(-width // 64)):  # a half wider than one digest, else its high bits would stay
        out += hashlib.blake2b(out[:64] + k.to_bytes(4, "big"), key=key, digest_size=64).digest()
    return int.from_bytes(out[:width], "big") & ((1 << bits) - 1)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str, new: str) -> str:
    """The digits of text replaced in order."""
    fresh = iter(new)
    return "".join(next(fresh) if c.isdecimal() else c for c in text)


def _check_digit(body: str) -> str:
    return next(d for d in "0123456789" if luhn(body + d))


ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_OF = {c: a for a in ALPHABETS for c in a}


def _letters(text: str, key: bytes, tweak: bytes) -> str:
    """Letters and digits of a text permuted together, each within its own alphabet."""
    value, size = 0, 1
    for c in text:
        if a := _OF.get(c):
            value, size = value * len(a) + a.index(c), size * len(a)
    value = permute(value, size, key, tweak)
    out = []
    for c in reversed(text):
        if a := _OF.get(c):
            value, k = divmod(value, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


_HEX = "0123456789abcdef"


#: A longer secret is permuted in blocks of so many characters.
_BLOCK = 512


def _blocks(text: str, tweak: bytes, work: Callable[[str, bytes], str]) -> str:
    """``work`` on each block, under a tweak chained from the new blocks before it."""
    out, chain = [], tweak
    for at in range(0, len(text), _BLOCK):
        out.append(work(text[at : at + _BLOCK], chain))
        chain = tweak + hashlib.blake2b(chain + out[-1].encode(), digest_size=16).digest()
    return "".join(out)


def _secret(text: str, key: bytes) -> str:
    if all(c in _HEX for c in text):
        return _blocks(text, b"hex", lambda t, tweak: f"{permute(int(t, 16), 16 ** len(t), key, tweak):0{len(t)}x}")
    return _blocks(text, b"secret", lambda t, tweak: _letters(t, key, tweak))


def _card(text: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", text)
    if not 13 <= len(d) <= 19 or not luhn(d) or d.count(d[0]) == len(d):
        return None
    body = f"{permute(int(d[:-1]), 10 ** (len(d) - 1), key, b'card%d' % len(d)):0{len(d) - 1}d}"
    return _digits(text, body + _check_digit(body))


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _letters(plain[4:], key, b"iban" + plain[:2].encode())
    check = 98 - number(body + plain[:2] + "00") % 97
    fresh = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(" " if c == " " else next(fresh) for c in text)


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = text.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    while True:  # walk within valid numbers
        d = f"{permute(int(area + group + serial), 10**9, key, b'ssn'):09d}"
        area, group, serial = d[:3], d[3:5], d[5:]
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            return f"{area}-{group}-{serial}"


def _phone(text: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", text)
    # the country code and the first digit of the area stay
    keep = max(0, len(d) - 10) + 1
    tail = d[keep:]
    return _digits(text, d[:keep] + f"{permute(int(tail), 10 ** len(tail), key, b'phone%d' % len(tail)):0{len(tail)}d}")


#: Dates of these years are moved among themselves, and so are all others.
_RECENT = (1900, 2099)


@lru_cache
def _days(leap: bool, month_digits: int, day_digits: int, late: bool) -> list[tuple[int, int]]:
    """(month, day) that a form can write: of one digit below 10; ``late``: days from 13 on alone."""
    out = []
    for m in range(1, 10 if month_digits == 1 else 13):
        length = 29 if leap and m == 2 else calendar.monthrange(1999, m)[1]
        out += [(m, d) for d in range(13 if late else 1, min(length, 9 if day_digits == 1 else 31) + 1)]
    return out


def _moved_date(y: int, m: int, d: int, form: tuple[int, int, bool], key: bytes) -> tuple[int, int, int]:
    """Another date of the same form, by a permutation; one of a recent year stays recent."""
    usual, leap = _days(False, *form), _days(True, *form)

    def before(year: int) -> int:
        leaps = (year - 1) // 4 - (year - 1) // 100 + (year - 1) // 400
        return len(usual) * (year - 1) + (len(leap) - len(usual)) * leaps

    low, high, end = before(_RECENT[0]), before(_RECENT[1] + 1), before(10_000)
    at = before(y) + (leap if calendar.isleap(y) else usual).index((m, d))
    tweak = b"date%d%d%d" % form
    if low <= at < high:
        at = low + permute(at - low, high - low, key, tweak)
    else:
        at = permute(at if at < low else at - (high - low), end - (high - low), key, tweak + b"far")
        at += (high - low) * (at >= low)
    y = bisect_right(range(1, 10_000), at, key=before)
    m, d = (leap if calendar.isleap(y) else usual)[at - before(y)]
    return y, m, d


def _date(text: str, key: bytes) -> str | None:
    """Year first, or day, month, year; where that is no date month, day, year. Each part keeps its digits."""
    a, mark, b, _, c = re.match(r"(\d+)(\D)(\d+)(\D)(\d+)", text).groups()
    year_first = len(a) == 4
    orders = [(a, b, c)] if year_first else [(c, b, a), (c, a, b)]
    for k, (y, m, d) in enumerate(orders):
        try:
            datetime.date(int(y), int(m), int(d))
        except ValueError:
            continue
        form = (len(m), len(d), k == 1)  # month before day only where the day is beyond 12
        new_y, new_m, new_d = _moved_date(int(y), int(m), int(d), form, key)
        y, m, d = f"{new_y:04d}", f"{new_m:0{len(m)}d}", f"{new_d:0{len(d)}d}"
        return mark.join((y, m, d) if year_first else (d, m, y) if k == 0 else (m, d, y))
    return None


def _email(text: str, key: bytes) -> str:
    name, _, host = text.rpartition("@")
    name = _blocks(name, b"email", lambda t, tweak: _letters(t, key, tweak))
    return f"{name}@{_letters(host[: host.rindex('.')], key, b'host')}{host[host.rindex('.') :]}"


_FIND = re.compile(
    # a name is the whole run before the @, of any length and in any script; signs before it stay
    r"(?P<mail_at>(?<![\w.%+\-])[.%+\-]*+)(?P<email>\w[\w.%+\-]*+(?<=\w)@(?:[\w\-]+\.)+[^\W\d_]{2,24})"
    r"|(?P<secret_at>(?i:\b(?:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)\b[\"']?\s*+[=:]\s*+[\"']?))(?P<secret>[A-Za-z0-9_\-+/.]{8,})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"
    r"|(?P<date>(?<!\d)(?:\d{4}(?P<mark1>[\-/.])\d{1,2}(?P=mark1)\d{1,2}|\d{1,2}(?P<mark2>[\-/.])\d{1,2}(?P=mark2)\d{4})(?!\d))"
    r"|(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
    r"|(?P<phone>(?<![\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|(?<!\d)\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)|(?<!\d)\+\d{10,14}(?!\d))"
    r"|(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?P<mark3>[ \-])\d{4}(?P=mark3)\d{4}(?P=mark3)\d{1,7}|\d{4}(?P<mark4>[ \-])\d{6}(?P=mark4)\d{5})(?!\d))"
    r"|(?P<access>(?<![A-Za-z0-9])(?:(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk-|xox[abprs]-)[A-Za-z0-9_\-]{16,}|eyJ[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{8,}){2}))"
)
#: The start of an access key names its kind and stays.
_KEY_START = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|sk-|xox[abprs]-|eyJ")


def _access(text: str, key: bytes) -> str:
    start = _KEY_START.match(text)[0]
    return start + _blocks(text[len(start) :], b"access", lambda t, tweak: _letters(t, key, tweak))


_WORK = {"access": _access, "email": _email, "phone": _phone, "card": _card, "iban": _iban, "ssn": _ssn, "ip": _ip, "date": _date, "secret": _secret}
#: Without one of these no pattern can match.
_HINT = re.compile(r"[@0-9]|(?i:token|secret|passw|key)|AKIA|ASIA|gh[pousr]_|github_pat_|sk-|xox|eyJ")


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int], list[tuple[str, int, int]]]:
    """New text, found values by kind, and (kind, begin, end) of each in the old text."""
    counts: dict[str, int] = {}
    spans: list[tuple[str, int, int]] = []
    if not _HINT.search(text):
        return text, counts, spans

    def put(m: re.Match) -> str:
        group = next(k for k in (*KINDS, "access") if m[k] is not None)
        kind = "secret" if group == "access" else group
        old = m[group]
        new = _WORK[group](old, key)
        if new is None:
            return m[0]
        counts[kind] = counts.get(kind, 0) + 1
        spans.append((kind, m.start(group), m.end(group)))
        return (m["secret_at"] or m["mail_at"] or "") + new

    return _FIND.sub(put, text), counts, spans


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """Per document: doc_id, text (with pseudonyms), counts (map of kind to number), spans.

    Null texts stay null and count nothing. Values that fail their check stay. Repeated
    rows and null ids are kept; other columns are ignored. The key must not be empty.
    """
    if not key:
        raise ValueError("a key is needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(None, {}, []) if t is None else pseudonymise(t, key) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([list(f[1].items()) for f in found], pa.map_(pa.string(), pa.int64())),
                    pa.array(
                        [[dict(zip(("kind", "begin", "end"), s)) for s in f[2]] for f in found],
                        pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])),
                    ),
                ],
                ["doc_id", "text", "counts", "spans"],
            )

    ddl = "doc_id long, text string, counts map<string,long>, spans array<struct<kind:string,begin:long,end:long>>"
    return only(docs, "doc_id", "text").mapInArrow(run, ddl)
