"""Conversation repair: cheapest edits by a suffix-shared automaton of role and fault signatures.

Each row of a conversation is a letter (its role's initial, whether it ends, whether it
must go); the letters of a conversation are its signature. What remains to be paid depends
only on the letters still to come and on the grammar's state, so signatures are minimised
from the end: conversations that end alike share the nodes of their common ending, and
each node's cost and best edit for each grammar state are found once for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planline.llm.ranks import ranked
from planline.llm.shared import only, written

#: What does not count as content, and what may end a text.
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
#: Price of each edit, and of a kept row that breaks off.
REROLE, DELETE, INSERT, BROKEN = 3, 4, 3, 3
#: Letters of one piece of a signature: no group gathers more rows than this.
PIECE = 4096

#: Grammar ``(s?(ua)+)?``: 0 nothing yet, 1 after s, 2 after u, 3 after a. The turn that a new or renamed row takes.
NEXT = (2, 2, 3, 2)
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = {2: "user", 3: "assistant"}

SUMMARY = "conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id {key}, place long, role string, text string"


class Node(NamedTuple):
    """A distinct ending: for each grammar state what it still costs and the best next edit."""

    costs: tuple[int, int, int, int]
    edits: tuple[str, str, str, str]
    child: Node | None
    letter: str


def _with_inserts(base: list[tuple[int, str]]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Offer an insertion in every state; the less letter wins a tie (D < I < K < R)."""
    best = list(base)
    best[2] = min(base[2], (base[3][0] + INSERT, "I"))
    best[3] = min(base[3], (base[2][0] + INSERT, "I"))
    for g in (0, 1):
        best[g] = min(base[g], (best[2][0] + INSERT, "I"))
    return tuple(c for c, _ in best), tuple(e for _, e in best)


def end_node() -> Node:
    """Nothing follows: empty and ...ua are done, any other state needs insertions."""
    never = 1 << 40
    costs, edits = _with_inserts([(0, ""), (never, ""), (never, ""), (0, "")])
    return Node(costs, edits, None, "")


def node(letter: str, child: Node) -> Node:
    """The ending that starts with ``letter``: x goes, s u a o are roles, upper case breaks off."""
    base = []
    for g in range(4):
        ways = [(DELETE + child.costs[g], "D")]
        if letter != "x":
            broken = BROKEN if letter.isupper() else 0
            kept = KEEP[g].get(letter.lower())
            if kept is not None:
                ways.append((broken + child.costs[kept], "K"))
            ways.append((broken + REROLE + child.costs[NEXT[g]], "R"))
        base.append(min(ways))
    costs, edits = _with_inserts(base)
    return Node(costs, edits, child, letter)


def step(g: int, edit: str, letter: str) -> int:
    """The grammar's state after an edit."""
    return g if edit == "D" else KEEP[g][letter.lower()] if edit == "K" else NEXT[g]


def read_audit(at: Node, g: int) -> str:
    """Best edits from a node on, to the end of its piece (insertions there only where nothing follows)."""
    out = []
    while at.child is not None or at.edits[g] == "I" and at.letter == "":
        edit = at.edits[g]
        out.append(edit)
        g = step(g, edit, at.letter)
        if edit != "I":
            at = at.child
    return "".join(out)


def _border(costs: str) -> Node:
    """Where a piece ends and another begins: costs are known, edits are the other piece's."""
    if costs == "":
        return end_node()
    return Node(tuple(int(c) for c in costs.split(",")), ("", "", "", ""), None, "|")


def solve_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audits of distinct pieces that come sorted by what follows and by their letters from the end.

    Neighbours share their ending, so the nodes of the longest ending in common with the
    piece before are still on the stack: every node of the automaton is made once, and no
    more nodes are held than one piece has letters.
    """
    stack: list[Node] = []
    behind, last = None, ""
    for batch in batches:
        out: dict[str, list] = {"behind": [], "backwards": [], "ahead": [], "audits": []}
        for after, backwards in zip(batch["behind"].to_pylist(), batch["backwards"].to_pylist(), strict=True):
            if after != behind:
                stack, behind, last = [_border(after)], after, ""
            same = 0
            while same < min(len(last), len(backwards)) and last[same] == backwards[same]:
                same += 1
            del stack[same + 1 :]
            for letter in backwards[same:]:
                stack.append(node(letter, stack[-1]))
            last = backwards
            top = stack[-1]
            least = min(top.costs)
            out["behind"].append(after)
            out["backwards"].append(backwards)
            out["ahead"].append(",".join(str(c - least) for c in top.costs))
            out["audits"].append([read_audit(top, g) for g in range(4)])
        yield pa.RecordBatch.from_pydict(out)


def _solved(pieces: DataFrame) -> DataFrame:
    """behind, backwards, ahead, audits for each distinct pair of what follows and piece."""
    dealt = pieces.select("behind", "backwards").distinct().repartitionByRange("behind", "backwards").sortWithinPartitions("behind", "backwards")
    return dealt.mapInArrow(solve_pieces, "behind string, backwards string, ahead string, audits array<string>")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations as a faulty export would leave them, decided by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its full stops, 3 repeats it, 4 gives it
    the role user. Nulls count as one space, in the key as in role and text.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(blank("text"), STOPS, "")).otherwise(blank("text"))
    role = F.when(fate == 4, "user").otherwise(blank("role"))
    times = F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("time")
    return only(rows, "conv_id", "turn", "role", "text").where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("time")


def _fault(first: Column) -> Column:
    """b, d, t or - for the first fault of a row; ``first`` is the least rank of its role and text in the conversation."""
    return (
        F.when(~F.col("full"), "b").when(F.col("rank") > first, "d").when(F.col("broken"), "t").otherwise("-")
    )


def _pieces(placed: DataFrame) -> DataFrame:
    """conv_id, conv (its first rank), piece (0 the last), rank (of its first row), backwards, faults."""
    ends = placed.groupBy("conv_id").agg(F.min("rank").alias("conv"), F.max("rank").alias("last"))
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = placed.select("conv_id", "role", "digest", "rank", "full", "broken").alias("r")
    rows = rows.join(ends.alias("e"), F.expr("r.conv_id <=> e.conv_id")).select("r.*", "conv", "last").alias("r")
    rows = rows.join(firsts.alias("f"), F.expr("r.conv_id <=> f.conv_id and r.role = f.role and r.digest = f.digest"), "left").select("r.*", "first")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    fault = _fault(F.coalesce("first", "rank"))
    letter = F.when(fault.isin("b", "d"), "x").when(fault == "t", F.upper(letter)).otherwise(letter)
    piece = F.floor((F.col("last") - F.col("rank")) / PIECE).cast("long").alias("piece")
    listed = F.array_sort(F.collect_list(F.struct("rank", letter.alias("letter"), fault.alias("fault"))))
    grouped = rows.groupBy("conv_id", "conv", piece).agg(F.min("rank").alias("rank"), listed.alias("listed"))
    joined = lambda field: F.array_join(F.transform("listed", lambda x: x[field]), "")
    return grouped.select("conv_id", "conv", "piece", "rank", F.reverse(joined("letter")).alias("backwards"), joined("fault").alias("faults"))


def _audited(pieces: DataFrame) -> DataFrame:
    """conv_id, rank, faults, audits (one for each state it may be entered in) of every piece.

    Last pieces are solved first; a round for each further piece that the longest
    conversation has.
    """
    deepest = pieces.agg(F.max("piece")).first()[0]
    if deepest is None:
        return pieces.select("conv_id", "rank", "faults", F.array(F.lit("")).alias("audits"))
    done, ahead = None, None
    for k in range(deepest + 1):
        now = pieces.where(F.col("piece") == k)
        now = now.withColumn("behind", F.lit("")) if k == 0 else now.join(ahead, "conv")
        solved = now.join(_solved(now), ["behind", "backwards"]).select("conv_id", "conv", "rank", "faults", "ahead", "audits")
        solved = written(solved, f"audits-{k}") if deepest else solved
        ahead = solved.select("conv", F.col("ahead").alias("behind"))
        part = solved.select("conv_id", "rank", "faults", "audits")
        done = part if done is None else done.unionByName(part)
    return done


class _Reader:
    """One conversation, row by row: edits applied, faults counted, the repaired text hashed."""

    def __init__(self, conv_id: object):
        self.conv_id, self.g, self.audit, self.at, self.faults, self.row = conv_id, 0, "", 0, "", 0
        self.counts = {"b": 0, "d": 0, "t": 0, "-": 0}
        self.illegal = self.cost = self.distinct = self.place = 0
        self.before: str | None = None
        self.low = self.high = None
        self.audits: list[str] = []
        self.hash = hashlib.sha256()

    def _put(self, role: str, text: str) -> list[tuple]:
        self.hash.update((("\n" if self.place else "") + f"{role}:{text}").encode())
        self.place += 1
        return [(self.conv_id, self.place - 1, role, text)]

    def _inserts(self) -> list[tuple]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.g = NEXT[self.g]
            self.cost += INSERT
            self.at += 1
            out += self._put(ROLES[self.g], "")
        return out

    def piece(self, faults: str, audits: list[str]) -> None:
        self.audit, self.at, self.faults, self.row = audits[self.g], 0, faults, 0
        self.audits.append(self.audit)

    def read(self, turn: int | None, role: str, text: str) -> list[tuple]:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        fault, initial = self.faults[self.row], role[:1]
        self.row += 1
        self.counts[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        out = self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            self.cost += DELETE
        else:
            self.cost += (REROLE if edit == "R" else 0) + (BROKEN if fault == "t" else 0)
            self.g = NEXT[self.g] if edit == "R" else KEEP[self.g][initial]
            out += self._put(ROLES[self.g] if edit == "R" else role, text)
        return out

    def close(self) -> tuple[list[tuple], tuple]:
        out = self._inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        found = (self.counts["b"], self.counts["d"], self.counts["t"], self.illegal)
        return out, (self.conv_id, gaps, *found, self.cost, "".join(self.audits), self.hash.hexdigest())


def _reading(schema: pa.Schema, summary: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out = None, []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        def closed() -> list[tuple]:
            rows, total = reader.close()
            return [total] if summary else rows

        for got in batches:
            columns = [got[c].to_pylist() for c in ("kind", "conv_id", "turn", "role", "text", "faults", "audits")]
            for kind, conv_id, turn, role, text, faults, audits in zip(*columns, strict=True):
                if kind == 0:
                    out += closed() if reader else []
                    reader = _Reader(conv_id)
                elif kind == 1:
                    reader.piece(faults, audits)
                else:
                    rows = reader.read(turn, role, text)
                    out += [] if summary else rows
            yield batch(out)
            out = []
        if reader:
            yield batch(closed())

    return read


def _read(rows: DataFrame, conversations: DataFrame, summary: bool) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    bare = F.rtrim(text, F.lit(BLANKS))
    keyed = only(rows, "conv_id", "turn", "role", "text").select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        text.alias("text"),
        F.md5(text.cast("binary")).alias("digest"),
        (bare != "").alias("full"),
        (~F.substring(bare, -1, 1).isin(*STOPS)).alias("broken"),
    )
    placed = ranked(keyed, ["conv_id", "turn", "role", "digest"], "turns")
    audited = _audited(written(_pieces(placed), "pieces"))
    key = dict(rows.dtypes)["conv_id"]
    none = lambda kind: F.lit(None).cast(kind)
    opened = only(conversations, "conv_id").distinct().select(
        F.lit(0).alias("kind"), "conv_id", none("long").alias("rank"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("string").alias("faults"), none("array<string>").alias("audits")
    )
    pieces = audited.select(F.lit(1).alias("kind"), "conv_id", "rank", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), "faults", "audits")
    turns = placed.select(F.lit(2).alias("kind"), "conv_id", "rank", "turn", "role", "text", none("string").alias("faults"), none("array<string>").alias("audits"))
    dealt = opened.unionByName(pieces).unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "rank", "kind")
    ddl = (SUMMARY if summary else REPAIRED).format(key=key)
    empty = rows.sparkSession.createDataFrame([], ddl).toArrow().schema
    return dealt.mapInArrow(_reading(empty, summary), ddl)


def audit_conversations(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of each conversation.

    ``conversations`` (``rows`` itself if not given) names the conversations to report, so
    those without rows are reported too, with zeros, an empty audit and the hash of nothing.
    Null conv_id is a conversation of its own; null turns come first; null role or text count
    as one space. Rows of equal turn stand by role, then by md5 of the text; equal rows are
    duplicates of one another. Of each row its first fault counts: blank, duplicate (role
    and text seen earlier in the conversation), truncated.

    Rows are dealt by ranges and ranked over the whole table, and signatures are gathered in
    pieces of at most ``PIECE`` letters, so a conversation with a third of all rows is many
    groups. Its repaired text is one chain of bytes for SHA-256, so it is read once by one
    task, row by row, with nothing held but the edits.
    """
    return _read(rows, rows if conversations is None else conversations, True)


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of the repaired rows."""
    return _read(rows, rows, False)
