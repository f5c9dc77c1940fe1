"""Found values are replaced whole, whatever their length or year."""

import calendar
import datetime
import random
import re
from collections import Counter

import pytest

from planline.llm import private_data
from planline.llm import queries as Q


def test_long_secrets_have_no_tail_in_clear():
    rnd = random.Random(1)
    for alphabet in ("abcdefghijklmnopqrstuvwxyzABC0123456789", "0123456789abcdef"):
        secret = "".join(rnd.choice(alphabet) for _ in range(1500))
        new, counts, spans = private_data.pseudonymise(f"token={secret} end", b"key")
        got = new[6:-4]
        assert counts == {"secret": 1} and spans == [("secret", 6, 1506)] and len(got) == 1500
        assert all(got[at : at + 100] != secret[at : at + 100] for at in range(0, 1500, 100))
    key = "sk-" + "a1B2c3D4" * 15
    new, counts, _ = private_data.pseudonymise(f"use {key} now", b"key")
    assert counts == {"secret": 1} and new.startswith("use sk-") and key[3:] not in new and len(new) == len(key) + 8


def test_dates_of_every_year():
    new, counts, _ = private_data.pseudonymise("born 1850-03-04, until 2150-12-31 and 31/12/9999", b"key")
    assert counts == {"date": 3} and not any(d in new for d in ("1850-03-04", "2150-12-31", "31/12/9999"))


def test_dates_are_permuted_within_their_form():
    """One to one, the digits of each part kept, recent years kept recent; day first and month first never meet."""
    first = datetime.date(2019, 1, 1)
    days = [first + datetime.timedelta(k) for k in range(4000)]
    for write in (
        lambda d: f"{d:%Y-%m-%d}",
        lambda d: f"{d.day}/{d.month}/{d.year}",
        lambda d: f"{d.month}/{d.day}/{d.year}",
        lambda d: f"{d.day:02d}.{d.month}.{d.year}",
    ):
        old = [write(d) for d in days]
        new = [private_data._date(t, b"key") for t in old]
        assert len(set(new)) == len(set(old)) and sum(a == b for a, b in zip(old, new)) < 40
        assert all([len(p) for p in re.split(r"\D", a)] == [len(p) for p in re.split(r"\D", b)] for a, b in zip(old, new))
        assert all(1900 <= int(re.search(r"\d{4}", t)[0]) <= 2099 for t in new)
    assert private_data._date("1999-02-28", b"key").split("-") == private_data._date("28/02/1999", b"key").split("/")[::-1]


@pytest.mark.parametrize("form", [(2, 2, False), (1, 2, False), (1, 1, False), (2, 2, True)])
def test_moved_dates_cover_their_domain(form):
    domain = [(y, m, d) for y in (*range(1, 9), *range(1896, 1905), *range(2096, 2105), *range(9990, 10_000)) for m, d in private_data._days(calendar.isleap(y), *form)]
    moved = {private_data._moved_date(*t, form, b"key") for t in domain}
    assert len(moved) == len(domain)
    for (y, m, d), new in zip(domain, (private_data._moved_date(*t, form, b"key") for t in domain)):
        datetime.date(*new)
        assert (1900 <= y <= 2099) == (1900 <= new[0] <= 2099) and new[1:] in private_data._days(calendar.isleap(new[0]), *form)


def plain_pseudonyms(text, key):
    """Each found value replaced on its own, by its kind."""
    out, at = "", 0
    for m in private_data._FIND.finditer(text):
        group = next(k for k in (*private_data.KINDS, "access") if m[k] is not None)
        new = private_data._WORK[group](m[group], key)
        out += text[at : m.start(group)] + (m[group] if new is None else new)
        at = m.end(group)
    return out + text[at:]


def test_query_equals_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    texts = Counter((r.doc_id, None if r.text is None else plain_pseudonyms(r.text, Q.PSEUDONYM_KEY)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = Q.op3_pseudonyms(spark, sf).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == texts and sum(r.n_values for r in rows) > 20


def test_every_position_of_a_secret_changes():
    for n in (8, 63, 600, 4096):
        old = "".join("0123456789abcdef"[(k * 7 + k // 5) % 16] for k in range(n))
        seen = [private_data._secret(old, b"%d" % k) for k in range(12)]
        assert all(any(new[at] != old[at] for new in seen) for at in range(n)) and all(len(new) == n for new in seen)


def test_wide_values_are_permuted_whole():
    for bits in (1000, 1400, 2400):
        for v in (0, 1, (1 << bits) - 1, 3**600 % (1 << bits)):
            new = private_data.permute(v, 1 << bits, b"k", b"t")
            assert private_data.permute(new, 1 << bits, b"k", b"t", back=True) == v
            assert bits * 0.35 < (new ^ v).bit_count() < bits * 0.65 and (new ^ v) >> (bits - 100)


LONGEST = [
    ("sk-", "proj-AbCdEfGhIjKlMnOpQrSt_UvWxYz0123456789abcd"), ("github_pat_", "11ABCDEFG0abcdefghij_KLMNOPqrstuvwxyz0123456789ABCD"), ("ghs_", "a1B2" * 20), ("", "name" * 40 + "@example.com"),
    ("", "müllersmann.johannes@example.com"), ("token    = ", "Abc123Def456Ghi789"), ("Bearer eyJ", "hbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVP_mB92K27uhbUJU1p1r"), ("", "x." * 3000 + "y@example.com"),
]


def test_no_found_value_keeps_a_run_of_its_letters():
    from planline.llm.private_data import pseudonymise

    for start, value in LONGEST:
        text = f"see {start}{value} now"
        new, counts, _ = pseudonymise(text, b"k")
        assert len(new) == len(text) and sum(counts.values()) == 1 and new.startswith(f"see {start}") and new.endswith(" now")
        kept = value.split("@")[0]
        own = new[len(f"see {start}") :]
        same = [a == b and a.isalnum() and a.isascii() for a, b in zip(kept, own)]
        assert not any(all(same[k : k + 6]) for k in range(len(same) - 6)), new


def test_signs_before_a_mailbox_stay_and_long_runs_take_linear_time():
    from planline.llm.private_data import pseudonymise

    new, counts, spans = pseudonymise("-- ..anna.b@example.org, __", b"k")
    assert new.startswith("-- ..") and counts == {"email": 1} and spans[0][1] == 5
    for text in ("a." * 300_000 + "1", "-" * 500_000 + "1", "é" * 500_000 + "1@", "token" + " " * 300_000 + "1"):
        assert pseudonymise(text, b"k")[0] == text
