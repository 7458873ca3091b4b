"""Conversation repair against a search that builds whole audits."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from crossloom.llm import turns
from crossloom.llm.turns_sql import SQL

from ..conftest import SF

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
SPACE = re.compile("[^\x20\x09-\x0d]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        found = SPACE.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) by keeping, for each last initial, the least (cost, whole audit)."""
    best = {"": (0, "", ())}

    def inserts(held):
        for _ in range(3):
            for last, (cost, audit, lines) in list(held.items()):
                role = NEXT[last]
                new = (cost + 2, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[role]))
                if role not in held or new < held[role]:
                    held[role] = new
        return held

    for (role, text), fault in zip(rows, faults(rows), strict=True):
        held = {}
        more = fault == "truncated"
        for last, (cost, audit, lines) in inserts(dict(best)).items():
            ways = [(last, (cost + 3, audit + "D", lines))]
            if fault in ("", "truncated"):
                to = NEXT[last]
                ways.append((to, (cost + 2 + more, audit + "R", (*lines, {"u": "user:", "a": "assistant:"}[to] + text))))
                if role[:1] == to or (role[:1] == "s" and last == ""):
                    ways.append((role[:1], (cost + more, audit + "K", (*lines, role + ":" + text))))
            for state, new in ways:
                if state not in held or new < held[state]:
                    held[state] = new
        best = held
    held = inserts(best)
    return min(held[x] for x in ("", "a") if x in held)


def expected(rows):
    out = []
    after = damaged(rows)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=key)
        pairs = [(r[2], r[3]) for r in own]
        cost, audit, lines = cheapest(pairs)
        found, numbers = faults(pairs), {r[1] for r in own} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        out.append((conv, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed, conversations, most):
    pick = random.Random(seed)
    roles, texts = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", None, "übel"], ["Yes.", "No!", "What?", "cut off", " \t", "", None, "é.", "a. ", "x\x0b", "日本"]
    return [(pick.choice([c, c, c, None]), pick.choice([t, t, t + 1, t * 3, None]), pick.choice(roles), pick.choice(texts) if pick.random() < 0.6 else f"Number {t}.") for c in range(conversations) for t in range(pick.randint(0, most))]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(2))
def test_equals_search(spark, seed):
    rows = made(seed, 150, 9)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "2 AS kind", "3 AS edit", "4 AS cost").repartition(3)
    assert found(turns.repaired(df)) == expected(rows)


def test_long_conversations_in_stretches(spark, monkeypatch):
    """Stretches of two turns, small batches: conversations are joined from many matrices."""
    monkeypatch.setattr(turns, "STRETCH", 1)
    monkeypatch.setattr(turns, "AT_ONCE", 5)
    rows = [(3, t, r, x) for t, (_, _, r, x) in enumerate(made(7, 20, 20))] + made(8, 20, 12)
    assert found(turns.repaired(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_empty_long_and_dropped(spark):
    assert turns.repaired(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (-1, 5, "user", "long " * 200_000 + "."), (-1, 6, "assistant", "long " * 200_000)]
    assert found(turns.repaired(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_turns_are_legal_and_steps_cover_the_rows(spark):
    rows = made(3, 60, 9)
    repair = turns.Repair(spark.createDataFrame(rows, SCHEMA))
    steps = repair.steps().orderBy("conv_id", "pos", "step").collect()
    assert sum(s.edit != "I" for s in steps) == len(rows)
    kept = {}
    for s in steps:
        if s.edit != "D":
            kept[s.conv_id] = kept.get(s.conv_id, "") + s.role[:1]
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in kept.values())


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{SF}/conversations.parquet'")
    assert found(turns.op11_conversation_repair(spark, SF)) == sorted(con.sql(SQL).fetchall(), key=repr)
    rows = made(5, 60, 8)
    con.sql("CREATE TABLE awkward (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO awkward VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.sql(SQL.replace("FROM conversations", "FROM awkward")).fetchall(), key=repr) == expected(rows)
