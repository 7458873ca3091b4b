"""The divergence audit against a plain recount, and against SQL."""

import re
from collections import Counter

import duckdb
import pytest

from crossloom.llm import divergence

from ..conftest import SF

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def recount(rows, least, top):
    """rows: (text, lang, source); term by term, pair by pair."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(TERM.findall(t.translate(LOWER)), s) for t, x, s in rows if x == lang]
        seen = Counter(t for terms, _ in own for t in set(terms))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = {s: Counter(t for terms, x in own if x == s for t in terms if seen[t] >= least) for s in {s for _, s in own}}
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s, c in counts.items():
            pairs = [(-sum(f(p(c, t), p(d, t)) for t in kept), x) for x, d in counts.items() if x != s]
            out += [(lang, s, "pair", x, -v, i + 1) for i, (v, x) in enumerate(sorted(pairs, key=lambda y: (y[0], y[1].encode())))]
            terms = [(-f(p(c, t), p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            out += [(lang, s, "term", x, -v, i + 1) for i, (v, x) in enumerate(sorted(terms, key=lambda y: (y[0], y[1].encode()))[:top])]
    return sorted(out)


ROWS = [
    ("The cat and the dog", "en", "a"), ("the CAT the cat", "en", "b"), ("dog dog mouse", "en", "b"), ("the mouse 12 x", "en", "c"), ("the mouse 12 x", "en", "c"), (None, "en", None), ("cat", "en", None),
    ("Ärger ärger größe", "de", "a"), ("Ärger x", "de", "b"), ("İ K 日本語 🙂cat", "de", "b"), (None, None, None), ("", "fr", "a"), ("12 !? \x00", "fr", "b"), ("alone", "es", "a"), ("word " * 40_000 + "cat", "en", "d"),
]


def found(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least", [1, 2])
def test_equals_recount(spark, least):
    df = spark.createDataFrame(ROWS, "text string, lang string, source string").repartition(3)
    extra = df.selectExpr("*", "7 AS term", "8 AS value", "9 AS rank", "'x' AS a", "1 AS doc_id")
    assert found(divergence.audit(extra, 2, least)) == recount(ROWS, least, 2)


def test_small_parts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "AT_ONCE", 1)
    df = spark.createDataFrame(ROWS, "text string, lang string, source string").coalesce(1)
    assert found(divergence.audit(df, 3, 1)) == recount(ROWS, 1, 3)


def test_index_pairs():
    for n in range(8):
        for most in (1, 3, 100):
            got = [(int(a), int(b)) for i, j in divergence._index_pairs(n, most) for a, b in zip(i, j, strict=True)]
            assert got == [(i, j) for i in range(n) for j in range(i + 1, n)]


def test_empty_table(empty):
    assert divergence.audit(empty).collect() == []


def test_large_counts_do_not_overflow(spark):
    from pyspark.sql import functions as F

    n, total = 3 * 10**12, 10**13
    df = spark.range(1).select(divergence.probability(F.lit(n), F.lit(total), F.lit(10**6)).alias("p"))
    assert df.first().p == 1 + 10**9 * (n + 2) // (total + 2 * 10**6)


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = con.sql(divergence.SQL)
    assert want.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert found(divergence.op13_source_divergence(spark, SF)) == sorted(want.fetchall())
