"""The conversation repair's query as DuckDB SQL: whole audits and lines carried from row to row, as the definition has it."""

from __future__ import annotations


def _crc_table() -> list[int]:
    """The bytes' remainders of CRC-32 (the reflected polynomial EDB88320)."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


ROLE = {"u": "user", "a": "assistant"}
#: After nothing, system, user, assistant: the role that an insert or another role takes, the state after it, and what a kept initial leads to.
NEXT = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def _inserted(state: int, n: int) -> tuple[int, list[str]]:
    lines = []
    for _ in range(n):
        role, state = NEXT[state]
        lines.append(f"'{ROLE[role]}:'")
    return state, lines


def _struct(begin: int, cost: str, audit: str, lines: list[str], when: str) -> str:
    made = f"list_concat(s{begin}.l, [{', '.join(lines)}])" if lines else f"s{begin}.l"
    return f"CASE WHEN s{begin} IS NOT NULL{when} THEN {{'c': s{begin}.c + {cost}, 'a': s{begin}.a || '{audit}', 'l': {made}}} END"


def _step(end: int) -> str:
    """The least way to a state: from each state, with up to two inserts, then the row's edit."""
    ways = []
    for begin in range(4):
        for n in range(3):
            state, lines = _inserted(begin, n)
            if state == end:
                ways.append(_struct(begin, f"{2 * n + 3}", "I" * n + "D", lines, ""))
            role, after = NEXT[state]
            if after == end:
                ways.append(_struct(begin, f"{2 * n + 2} + cut", "I" * n + "R", [*lines, f"'{ROLE[role]}:' || text"], " AND stays"))
            for initial, kept in KEEP[state].items():
                if kept == end:
                    ways.append(_struct(begin, f"{2 * n} + cut", "I" * n + "K", [*lines, "role || ':' || text"], f" AND stays AND ini = '{initial}'"))
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]" if ways else "NULL"


def _finish() -> str:
    ways = [_struct(begin, str(2 * n), "I" * n, _inserted(begin, n)[1], "") for begin, n in enumerate((0, 2, 1, 0))]
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


_KIND = "STRUCT(c BIGINT, a VARCHAR, l VARCHAR[])"
SQL = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, {_crc_table()}[((xor(c, b) & 255) + 1)])), 4294967295) % 20 AS fate FROM o),
d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE fate <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
q AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM p),
f AS (SELECT *, fault IN ('', 'truncated') AS stays, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM q),
w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 'l': []}} AS {_KIND}) AS s0, CAST(NULL AS {_KIND}) AS s1, CAST(NULL AS {_KIND}) AS s2, CAST(NULL AS {_KIND}) AS s3 FROM conversations
 UNION ALL SELECT conv_id, i, {", ".join(_step(end) for end in range(4))} FROM (SELECT w.conv_id, f.i, s0, s1, s2, s3, role, text, ini, stays, cut FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
l AS (SELECT conv_id, {_finish()} AS best FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(array_to_string(best.l, chr(10))) AS repaired_sha256 FROM l LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM l.conv_id
"""
