"""DuckDB SQL for the rows of the queries of sharding, conversation repair and spelling variants."""

from __future__ import annotations

#: The table of CRC-32 from its rule, a list ``t`` of 256 numbers.
_CRC_TABLE = """bits(n, c, k) AS (
  SELECT n, n, 0 FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8)"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text, where crc_table is joined."""
    numbers = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda i: CAST('0x' || i AS BIGINT))"
    return f"xor(list_reduce({numbers}, lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1]), 4294967295), 4294967295)"


OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
jumps(doc_id, n, key, place, nxt) AS (
  SELECT doc_id, n, (CAST(coalesce(doc_id, 0) AS HUGEINT) + 18446744073709551616) % 18446744073709551616, CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  FROM (SELECT DISTINCT doc_id FROM documents) CROSS JOIN (VALUES (24), (25)) v(n)
  UNION ALL
  SELECT doc_id, n, k, nxt, CAST(floor((nxt + 1) * (CAST(2147483648 AS DOUBLE) / CAST(k // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, n, nxt, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM jumps WHERE nxt < n)),
placed AS (
  SELECT doc_id, max(place) FILTER (WHERE n = 24) AS shard, max(place) FILTER (WHERE n = 25) AS grown FROM jumps GROUP BY doc_id),
d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, CAST({_crc32("coalesce(text, '')")} AS BIGINT) AS text_crc32
  FROM documents, crc_table)
SELECT d.doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY d.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CAST(grown AS INTEGER) AS grown_shard
FROM d JOIN placed ON d.doc_id IS NOT DISTINCT FROM placed.doc_id
"""

OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY doc_id, run),
fates AS (
  SELECT run, times, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc_table),
cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, times FROM fates),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
rests AS (
  SELECT word, n, 0 AS j, word AS rest FROM words
  UNION ALL SELECT word, n, j, substr(word, 1, j - 1) || substr(word, j + 1) FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS j FROM words)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM rests a JOIN rests b ON a.rest = b.rest AND a.word <> b.word
  WHERE (a.j = b.j) OR (a.j = 0 AND b.j > 0) OR (a.j > 0 AND b.j = 0)),
best AS (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word, n),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * words.n THEN form END AS form, CASE WHEN form_n >= 2 * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word),
chain(word, root, steps) AS (
  SELECT word, word, 0 FROM words
  UNION ALL SELECT chain.word, formed.form, steps + 1 FROM chain JOIN formed ON chain.root = formed.word WHERE formed.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word)
SELECT formed.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM formed JOIN roots ON formed.word = roots.word
"""


def _way(cost: str, edit: str, rest: str, text: str) -> str:
    """One edit: its cost, its letter and the audit of the rest, and the repaired rows."""
    rows = f"{rest}.r" if text == "" else f"list_prepend({text}, {rest}.r)"
    return f"{{'c': {cost} + {rest}.c, 'a': '{edit}' || {rest}.a, 'r': {rows}}}"


def _base(state: int) -> str:
    """The cheapest of keep, rename and delete in a state of the grammar."""
    renamed, new = ("assistant", 3) if state == 2 else ("user", 2)
    kept = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[state]
    broken = "CASE WHEN fault = 't' THEN 3 ELSE 0 END"
    ways = [f"CASE WHEN fault IN ('t', '-') AND left(role, 1) = '{i}' THEN {_way(broken, 'K', f's{g}', 'role || chr(58) || text')} END" for i, g in kept]
    ways.append(f"CASE WHEN fault IN ('t', '-') THEN {_way(f'3 + {broken}', 'R', f's{new}', f"'{renamed}:' || text")} END")
    ways.append(_way("4", "D", f"s{state}", ""))
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw CROSS JOIN (VALUES (0), (1)) v(again) WHERE fate <> 0 AND (again = 0 OR fate = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k, count(*) OVER (PARTITION BY conv_id) AS size FROM damaged),
faulty AS (
  SELECT conv_id, turn, role, text, k, size,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '-' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS step
  FROM numbered),
found AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE step NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
paid(conv_id, k, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, size + 1, {{'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])}}, {{'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}},
         {{'c': 3, 'a': 'I', 'r': ['assistant:']}}, {{'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])}} FROM numbered
  UNION ALL
  SELECT conv_id, k, list_min([b0, {_way("3", "I", "g2", "'user:'")}]), list_min([b1, {_way("3", "I", "g2", "'user:'")}]), g2, g3 FROM (
    SELECT conv_id, k, b0, b1, list_min([b2, {_way("3", "I", "b3", "'assistant:'")}]) AS g2, list_min([b3, {_way("3", "I", "b2", "'user:'")}]) AS g3 FROM (
      SELECT p.conv_id, f.k, {_base(0)} AS b0, {_base(1)} AS b1, {_base(2)} AS b2, {_base(3)} AS b3
      FROM paid p JOIN faulty f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.k = p.k - 1)))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit,
       sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN found ON c.conv_id IS NOT DISTINCT FROM found.conv_id
LEFT JOIN (SELECT * FROM paid WHERE k = 1) p ON c.conv_id IS NOT DISTINCT FROM p.conv_id
"""
