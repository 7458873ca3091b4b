"""Every query of the library that has SQL gives DuckDB's rows on the same tables."""

import math

import pytest

from crossloom.plans import books, desk, evidence, facts, factors, fundamentals, governance, histories, lanes, masters, notices, patterns, readmodels, research, stores, themes

from .conftest import SF

MODULES = (factors, facts, books, research, patterns, fundamentals, desk, masters, notices, histories, stores, lanes, themes, evidence, governance, readmodels)
QUERIES = {n: (q, m.oracle_sql()[n]) for m in MODULES for n, q in m.queries().items() if n in m.oracle_sql()}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", QUERIES)
def test_rows_equal_sql(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, SF)
    names = sorted(df.columns)
    found = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    expected = duck.sql(sql)
    at = [expected.columns.index(c) for c in names]
    assert len(expected.columns) == len(names)
    assert found == sorted(repr([plain(r[i]) for i in at]) for r in expected.fetchall())


def test_every_query_has_sql():
    for m in MODULES:
        assert set(m.queries()) == set(m.oracle_sql())
