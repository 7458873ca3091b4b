"""Folds with carried state, notices and disclosure scores, against plain Python."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossloom.operators import cross_section as xs
from crossloom.operators import disclosures as ds
from crossloom.operators import histories as hs
from crossloom.operators import masters as ms

DAY = dt.date(2024, 1, 1)


def targets_by_hand(rows, k, dropout, most_new, held):
    """rows: {date: [(score, name)]} of one strategy."""
    out = []
    for day in sorted(rows):
        ranked = [n for _, n in sorted(rows[day], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))]
        if not held or (dropout is None and most_new is None):
            chosen = ranked[:k]
        else:
            keep = [n for i, n in enumerate(ranked) if n in held and dropout is not None and i < dropout][:k]
            picked, new = list(keep), 0
            for n in ranked:
                if n in picked or (n not in held and most_new is not None and new >= most_new):
                    continue
                picked.append(n)
                new += n not in held
                if len(picked) >= k:
                    break
            chosen = [n for n in ranked if n in picked][:k]
        out += [(day, n, i + 1) for i, n in enumerate(chosen)]
        held = set(chosen)
    return out


@pytest.mark.parametrize(("dropout", "most_new"), [(6, 1), (None, 1), (6, None), (None, None), (2, 0)])
def test_historical_targets(spark, dropout, most_new):
    pick = random.Random(5)
    data = {s: {DAY + dt.timedelta(d): [(pick.choice([None, *map(float, range(8))]), f"n{i}") for i in pick.sample(range(25), 18)] for d in range(12)} for s in "ab"}
    rows = [(s, d, n, v) for s, by in data.items() for d, names in by.items() for v, n in names]
    held = [("b", "n3"), ("b", "n4"), ("b", "n5"), ("b", "n6"), ("b", "n7"), ("b", "n99")]
    df = spark.createDataFrame(rows, "strategy string, date date, instrument string, ensemble_score double").repartition(3)
    got = hs.historical_targets(df, 4, dropout, most_new, initial=spark.createDataFrame(held, "strategy string, instrument string")).collect()
    want = [(s, *r) for s in "ab" for r in targets_by_hand(data[s], 4, dropout, most_new, {n for x, n in held if x == s})]
    assert sorted((r["strategy"], r["date"], r["instrument"], r["rank"]) for r in got) == sorted(want)
    assert {r["target_weight"] for r in got} == {0.08}


def test_historical_targets_of_nothing(spark):
    df = spark.createDataFrame([], "strategy string, date date, instrument string, ensemble_score double")
    assert hs.historical_targets(df, 3).collect() == []


def clusters_by_hand(items, threshold):
    sets, out = [], []
    for name, tokens in items:
        likes = [1.0 if not tokens and not s else len(tokens & s) / len(tokens | s) for s in sets]
        best = max(range(len(sets)), key=lambda i: (likes[i], -i), default=None)
        if best is None or likes[best] < threshold or likes[best] == 0:
            sets.append(set(tokens))
            best = len(sets) - 1
        else:
            sets[best] |= tokens
        out.append((name, best + 1))
    return out


def test_growing_clusters(spark):
    pick = random.Random(2)
    rows = [(f, f"c{i:02}", float(pick.randint(0, 5)), [f"t{x}" for x in pick.sample(range(9), pick.randint(0, 5))]) for f in ("x", "y", None) for i in range(30)]
    got = hs.growing_clusters(spark.createDataFrame(rows, "family string, name string, score double, tokens array<string>"), "family", "name", "tokens", "score", 0.4).collect()
    for f in ("x", "y", None):
        items = [(r[1], set(r[3])) for r in sorted(rows, key=lambda r: (-r[2], r[1])) if r[0] == f]
        assert sorted((r["name"], r["cluster"]) for r in got if r["family"] == f) == sorted(clusters_by_hand(items, 0.4))


def test_clusters_of_long_rows(spark):
    """Many sizes, near ties and clusters that grow past what any row can join."""
    pick = random.Random(5)
    rows = [("x", f"c{i:03}", float(pick.randint(0, 9)), [f"t{int(x)}" for x in {min(pick.expovariate(0.08), 60) // 1 for _ in range(pick.randint(1, 16))}]) for i in range(400)]
    for threshold in (0.25, 0.48, 0.5):
        got = hs.growing_clusters(spark.createDataFrame(rows, "family string, name string, score double, tokens array<string>"), "family", "name", "tokens", "score", threshold).collect()
        items = [(r[1], set(r[3])) for r in sorted(rows, key=lambda r: (-r[2], r[1]))]
        assert sorted((r["name"], r["cluster"]) for r in got) == sorted(clusters_by_hand(items, threshold))


def test_a_token_in_every_cluster_costs_no_comparison(spark):
    """20,000 clusters that share one token: compared with one another they take minutes."""
    tokens = F.concat(F.array(F.lit("all")), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat_ws("_", F.col("id"), i)))
    began = time.time()
    got = hs.growing_clusters(spark.range(20_000).select(F.lit("x").alias("family"), F.col("id").cast("string").alias("name"), F.lit(1.0).alias("score"), tokens.alias("tokens")), "family", "name", "tokens", "score")
    assert got.agg(F.max("cluster")).first()[0] == 20_000
    assert time.time() - began < 25


def test_expression_tokens(spark):
    df = spark.createDataFrame([("mom_v2", "trend", "Corr(Mean($close, 10), $vwap2, 20) / Ref($close, 5)"), (None, None, None)], "n string, f string, x string")
    got = [set(r[0]) for r in df.select(hs.expression_tokens(F.col("n"), F.col("f"), F.col("x"))).collect()]
    assert got == [{"mom", "trend", "vwap", "10", "20", "vwap2", "close", "corr", "mean", "ref", "w10", "w20", "w5"}, set()]


def test_dependent_exposures_change_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(d, float(rng.normal()), float(x := rng.normal()), float(3 * x), float(rng.normal()), 1.0, g) for d in range(3) for g in "aab" for _ in range(5)]
    df = spark.createDataFrame(rows, "datetime int, s double, x double, x3 double, y double, one double, g string")
    out = xs.neutralize(df, "s", ["x", "x3", "y", "one"], "g", "n").collect()
    for d in range(3):
        part = [r for r in out if r["datetime"] == d]
        a = np.array([[1, r["x"], r["y"], r["g"] == "b"] for r in part], float)
        s = np.array([r["s"] for r in part])
        assert np.allclose([r["n"] for r in part], s - a @ np.linalg.lstsq(a, s, rcond=None)[0])


def scores_by_hand(events, name, day):
    p = n = 0.0
    for i, at, kind, severity, k in events:
        if i != name or not 0 <= (day - at).days <= 90:
            continue
        way = 1 if kind in ds.POSITIVE else -1 if kind in ds.NEGATIVE or severity in ("risk", "block") else 0
        part = (1 - (day - at).days / 90) * {"info": 0.5, "watch": 0.7, "risk": 1.0, "block": 1.5}.get(severity, 0.5) * k
        p, n = p + part * (way > 0), n + part * (way < 0)
    return p, n


def test_disclosure_fields(spark):
    pick = random.Random(8)
    events = [(pick.choice("ab"), DAY + dt.timedelta(pick.randint(0, 200)), pick.choice(["buyback", "lawsuit", "other", ds.REPORT]), pick.choice(["info", "risk", "odd", None]), 1.0) for _ in range(80)]
    df = spark.createDataFrame(events, "instrument string, event_date date, event_type string, severity string, k double")
    rows = [(n, DAY + dt.timedelta(d)) for n in "abc" for d in (0, 60, 60, 150, 250, 400)] + [("a", None), (None, DAY)]
    got = ds.disclosure_fields(spark.createDataFrame(rows, "instrument string, available_at date"), df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["available_at"] is None:
            assert r["financial_disclosure_positive_score_90d"] is None
            continue
        if r["instrument"] is None:
            continue
        p, n = scores_by_hand(events, r["instrument"], r["available_at"])
        assert r["financial_disclosure_positive_score_90d"] == pytest.approx(p, abs=1e-9)
        assert r["financial_disclosure_net_intensity_score_90d"] == pytest.approx(p - n, abs=1e-9)
        last = max((at for i, at, kind, _, _ in events if i == r["instrument"] and kind == ds.REPORT and at <= r["available_at"]), default=None)
        assert r["financial_disclosure_days_since"] == (None if last is None else (r["available_at"] - last).days)


def test_a_name_with_many_events_costs_its_days(spark):
    """Events meet no rows: the plan has no join of the two, and the sums of one day are partial."""
    events = spark.range(50_000).selectExpr("'a' AS instrument", "date_add(DATE '2024-01-01', int(id % 30)) AS event_date", "'buyback' AS event_type", "'info' AS severity")
    rows = spark.range(40).selectExpr("'a' AS instrument", "date_add(DATE '2024-01-10', int(id)) AS date")
    e = events.select("instrument", "event_date", F.lit(1.0).alias("w"))
    out = ds.decaying_sums(rows, e, ["w"], 90, "date")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 40


NOTICES = [("关于回购股份的公告", "", "buyback"), ("预亏损收窄", "", "performance_warning_repair"), ("解除质押", "", "pledge_release"), ("*ST某", "", "st_status"), ("退市风险警示", "", "delisting_risk"), ("股票停牌", "减持", "trading_suspension"), (None, "异常波动", "abnormal_volatility"), ("a", None, "announcement"), ("减持", "处罚", "disciplinary_action")]


def test_notices_take_the_first_rule(spark):
    df = spark.createDataFrame([(t, c, DAY) for t, c, _ in NOTICES], "title string, category string, event_date date")
    assert [r["event_type"] for r in ds.classify_notices(df).collect()] == [k for _, _, k in NOTICES]
    for words, kind, severity in ds.NOTICES:
        one = spark.createDataFrame([(w, "x") for w in words], "title string, category string")
        got = {(r["event_type"], r["severity"]) for r in ds.classify_notices(one, date=None).collect()}
        assert got == {(kind, severity)} or (kind == "st_status" and got == {(kind, severity), ("delisting_risk", "block")})


def test_symbols_boards_and_marks(spark):
    codes = {"600000": ("SH600000", "main"), "920001": ("SH920001", "BSE"), "5": ("SZ000005", "main"), "sz300750": ("SZ300750", "ChiNext"), "830799": ("SZ830799", "BSE"), "688001.SH": ("SH688001", "STAR"), "430047": ("SZ430047", "BSE")}
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = {r[0]: (r[1], r[2]) for r in df.select("c", ms.listed_symbol(F.col("c")), ms.board(F.col("c"))).collect()}
    assert got == codes
    with pytest.raises(Exception, match="no code of six digits"):
        spark.createDataFrame([("1234567",)], "c string").select(ms.listed_symbol(F.col("c"))).collect()
    names = spark.createDataFrame([("*ST a",), ("Best",), ("a退",), ("plain",), (None,)], "n string")
    assert [r[0] for r in names.select(ms.special_treatment(F.col("n"))).collect()] == [True, True, True, False, False]
