"""Cheapest edits against a search over all of them, faults, digests and odd rows."""

import hashlib
import heapq
import random
import zlib

import pytest

from planline.llm import conversation as C

DDL = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """(cost, audit, repaired) by a best-first search over whole audits."""
    heap = [(0, "", 0, 0, ())]
    best = {}
    while heap:
        cost, audit, i, g, out = heapq.heappop(heap)
        if best.setdefault((i, g), (cost, audit)) < (cost, audit):
            continue
        if i == len(rows) and g in (0, 3):
            return cost, audit, list(out)
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, g, out))
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                if (g, role[:1]) in KEEP:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, KEEP[g, role[:1]], (*out, f"{role}:{text}")))
                new = NEXT[g]
                heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, new, (*out, f"{'user' if new == 2 else 'assistant'}:{text}")))
        new = NEXT[g]
        if len(audit) < 3 * len(rows) + 6:
            heapq.heappush(heap, (cost + 3, audit + "I", i, new, (*out, f"{'user' if new == 2 else 'assistant'}:")))


def plain(rows):
    """One conversation's result, row by row."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, marked, n = set(), [], {"b": 0, "d": 0, "t": 0, "-": 0}
    for _, role, text in rows:
        bare = text.rstrip(BLANK)
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
        seen.add((role, text))
        n[fault] += 1
        marked.append((role, text, fault))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, out = cheapest(marked)
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def same(spark, conversations):
    rows = [(c, *r) for c, rs in conversations.items() for r in rs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, DDL).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in C.audit_conversations(df).collect()}
    assert got == {c: plain(rs) for c, rs in conversations.items() if rs}


def some(draw, n):
    texts = ["Yes.", "No?", "Go on", "", "  \n", "Well!  ", "ends ", "été."]
    roles = ["user", "assistant", "system", "tool", "", "User"]
    return [(draw.choice([None, *range(12)]), draw.choices(roles, [6, 6, 2, 1, 1, 1])[0], draw.choice([*texts, f"line {draw.randrange(9)}."])) for _ in range(n)]


def test_same_as_a_search(spark):
    draw = random.Random(11)
    same(spark, {c: some(draw, draw.randrange(1, 9)) for c in range(150)} | {None: some(draw, 4)})


def test_pieces_join_up(spark, monkeypatch):
    draw = random.Random(12)
    monkeypatch.setattr(C, "PIECE", 3)
    same(spark, {c: some(draw, draw.randrange(1, 14)) for c in range(60)})


@pytest.mark.parametrize("roles", ["", "s", "u", "ua", "sua", "au", "uaa", "uua", "suaus", "aau", "ssuua"])
def test_least_audit_of_a_tie(roles):
    top = C.end_node()
    for letter in reversed(roles):
        top = C.node(letter, top)
    cost, want, _ = cheapest([({"s": "system", "u": "user", "a": "assistant"}[r], r, "-") for r in roles])
    assert (top.costs[0], C.read_audit(top, 0)) == (cost, want)


def test_endings_are_shared():
    import pyarrow as pa

    made = []
    keep = C.node
    C.node = lambda letter, child: made.append(letter) or keep(letter, child)
    try:
        pieces = sorted(["ua"[::-1], "sua"[::-1], "uaua"[::-1], "suaua"[::-1], "xua"[::-1]])
        batch = pa.RecordBatch.from_pydict({"behind": [""] * 5, "backwards": pieces})
        list(C.solve_pieces(iter([batch])))
    finally:
        C.node = keep
    # au, aus, aux, auau: seven letters in all, for eighteen of the pieces
    assert len(made) < sum(map(len, pieces)) and len(made) == len({p[: k + 1] for p in pieces for k in range(len(p))})


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three") for c in (1, 2, None) for t in [*range(40), None]]
    got = sorted(map(repr, (tuple(r) for r in C.damaged(spark.createDataFrame(rows, DDL)).collect())))
    want = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if h == 4 else role, "" if h == 1 else text.translate(str.maketrans("", "", ".!?")) if h == 2 else text)
        want += [row] * (0 if h == 0 else 2 if h == 3 else 1)
    assert got == sorted(map(repr, want))


def test_conversations_without_rows_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 1, None, None), (2, None, "user", "Hi.")], DDL)
    every = spark.createDataFrame([(1, 0, "x", "x"), (3, 0, "x", "x")], DDL)
    got = {r.conv_id: tuple(r)[1:] for r in C.audit_conversations(rows, every.unionByName(rows)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[3] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got[1] == (0, 1, 0, 0, 0, 4, "D", nothing)
    assert got[2] == plain([(None, "user", "Hi.")])
    assert C.audit_conversations(spark.createDataFrame([], DDL)).count() == 0


def test_long_texts_hot_rows_and_repaired_rows(spark):
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", f"word {t}. " * (20_000 if t == 3 else 1)) for t in range(500)] + [(5, 500, "user", "again.")] * 300
    df = spark.createDataFrame(rows, DDL).withColumnRenamed("conv_id", "conv_id").selectExpr("*", "'x' AS rank", "1 AS kind")
    got = C.audit_conversations(df).first()
    assert (got.duplicate, got.cost) == (299, 299 * 4 + 3)
    out = C.repaired_conversations(df).orderBy("place").collect()
    assert [r.role[0] for r in out] == ["u", "a"] * (len(out) // 2)
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in out).encode()).hexdigest() == got.repaired_sha256
