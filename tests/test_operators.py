"""Small tables with results worked out by hand or by plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossloom.functions import clip, corr, div, min_max, true_if, true_unless, z_population, z_population_strict, z_sample
from crossloom.functions.series import calls, depth, factor, fields
from crossloom.operators import cross_section as xs
from crossloom.operators import domains, joins, trades, upserts
from crossloom.operators import evaluation as ev
from crossloom.operators import signals as sg
from crossloom.sources import tables


def days(n):
    return [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(n)]


def values(df, c, *order):
    return [r[0] for r in df.orderBy(*order).select(c).collect()]


def test_formula_reads_fields_windows_and_rejects_the_rest(spark):
    text = "Mean($close / Ref($close, 1) - 1, 20) + 1e-12"
    assert fields(text) == ["close"] and depth(text) == 2
    assert sorted(calls(text)) == [("Mean", [20]), ("Ref", [1])]
    for bad in ("__import__('os')", "Mean($close)", "Ref($close, 0)", "$close ** 2", "Nope($close, 3)", "$close if 1 else 2"):
        with pytest.raises((ValueError, TypeError)):
            factor(bad)


def test_formula_values(spark):
    df = spark.createDataFrame([("a", i, float(i), None if i == 2 else 1.0) for i in range(5)], "instrument string, datetime int, x double, y double")
    out = df.select("datetime", factor("Ref($x, 2)").alias("ref"), factor("Mean($x, 3)").alias("mean"), factor("Greater($x, $y)").alias("big"), factor("If(Gt($x, $y), 1, 0)").alias("over"), factor("-$x / 0").alias("none"))
    rows = out.orderBy("datetime").collect()
    assert [r["ref"] for r in rows] == [None, None, 0.0, 1.0, 2.0]
    assert [r["mean"] for r in rows] == [0.0, 0.5, 1.0, 2.0, 3.0]
    assert [r["big"] for r in rows] == [1.0, 1.0, None, 3.0, 4.0]
    assert [r["over"] for r in rows] == [0.0, 0.0, 0.0, 1.0, 1.0]
    assert {r["none"] for r in rows} == {None}


def test_zscores_differ_on_constants_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0), ("b", None)], "g string, x double")
    rows = df.select("g", "x", z_population(F.col("x"), "g").alias("p"), z_population_strict(F.col("x"), "g").alias("s"), z_sample(F.col("x"), "g").alias("d")).collect()
    by = {(r["g"], r["x"]): (r["p"], r["s"], r["d"]) for r in rows}
    assert by[("a", 1.0)] == (0.0, None, 0.0)
    assert by[("b", None)] == (None, None, 0.0)
    assert by[("b", 3.0)] == (1.0, 1.0, pytest.approx(1 / np.sqrt(2)))


def test_flags_and_guards(spark):
    df = spark.createDataFrame([(v,) for v in ("", "0", "No", "nan", "yes", "x", None)], "v string")
    assert values(df.select("v", true_unless(F.col("v")).alias("t")), "t", F.col("v").asc_nulls_last()) == [False, False, False, False, True, True, False]
    assert sum(values(df.select(true_if(F.col("v"), "x").alias("t")), "t", "t")) == 2
    one = spark.createDataFrame([(1.0, 0.0)], "a double, b double").select(div(F.col("a"), F.col("b")).alias("d"), clip(F.col("a"), -0.5, 0.5).alias("c"), min_max(F.col("a"), F.lit(1)).alias("m")).first()
    assert tuple(one) == (None, 0.5, 1.0)
    assert spark.range(3).agg(corr(F.col("id").cast("double"), F.lit(2.0)).alias("c")).first()[0] is None


def test_neutralize_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    rows = [(d, f"i{k}", float(rng.normal()), float(rng.normal()), float(rng.normal()), "ab"[int(rng.integers(2))]) for d in range(3) for k in range(12)]
    df = spark.createDataFrame(rows, "datetime int, instrument string, s double, x double, y double, g string")
    for exposures, group in ((["x"], None), (["x"], "g"), ([], "g"), (["x", "y"], "g")):
        got = {(r["datetime"], r["instrument"]): r["n"] for r in xs.neutralize(df, "s", exposures, group, "n").collect()}
        for d in range(3):
            part = [r for r in rows if r[0] == d]
            design = [np.ones(len(part))] + [np.array([r[{"x": 3, "y": 4}[e]] for r in part]) for e in exposures] + ([np.array([float(r[5] == "b") for r in part])] if group else [])
            a, s = np.stack(design, 1), np.array([r[2] for r in part])
            rest = s - a @ np.linalg.lstsq(a, s, rcond=None)[0]
            assert np.allclose([got[(d, r[1])] for r in part], rest)


def test_purify_steps(spark):
    df = spark.createDataFrame([(1, f"i{k}", float(v)) for k, v in enumerate([1, 2, 3, 4, 100])], "datetime int, instrument string, f double")
    out = values(xs.purify(df, "f", ("MAD ", "rank"), "p"), "p", "f")
    assert out == pytest.approx([-0.4, -0.2, 0.0, 0.2, 0.4])
    with pytest.raises(ValueError):
        xs.purify(df, "f", ("other",))
    with pytest.raises(ValueError):
        xs.mad_winsorize(df, "f", n=0)


def test_quantile_buckets(spark):
    df = spark.createDataFrame([(1, f"i{k}", float(k)) for k in range(7)], "datetime int, instrument string, s double")
    assert values(df.withColumn("q", ev.quantile_bucket("s", 5)), "q", "s") == [1, 1, 2, 3, 4, 5, 5]
    assert set(values(df.where("s < 3").withColumn("q", ev.quantile_bucket("s", 5)), "q", "s")) == {None}


def test_evaluation_of_an_empty_panel(spark):
    df = spark.createDataFrame([], "datetime date, instrument string, close double, s double")
    rows = ev.evaluate(df, "s", [1, 5]).collect()
    assert [(r["observations"], r["ic_mean"]) for r in rows] == [(0, None), (0, None)]


def greedy_by_hand(rows):
    kept, end = [], -1
    for s, e in sorted(rows):
        if s > end:
            kept.append(s)
            end = e
    return kept


def test_greedy_scan(spark):
    random.seed(3)
    rows = [(k, s, s + random.randint(1, 6)) for k in range(6) for s in random.sample(range(60), 25)]
    kept = trades.greedy(spark.createDataFrame(rows, "k int, bar long, exit_bar long"), ["k"]).collect()
    for k in range(6):
        assert sorted(r["bar"] for r in kept if r["k"] == k) == greedy_by_hand([(s, e) for q, s, e in rows if q == k])


def test_labels_cut_percentages():
    assert trades.bucket_label(0.29, 0.57) == "p28_p56"


def test_as_of_takes_the_last_known_value(spark):
    d = days(10)
    panel = spark.createDataFrame([("a", d[i]) for i in (0, 2, 5, 9)] + [("b", d[3])], "i string, t date")
    facts = spark.createDataFrame([("a", d[2], 1.0, 1), ("a", d[4], None, 2), ("a", d[9], 3.0, 3)], "i string, k date, v double, n int")
    assert values(joins.as_of(panel, facts, "i", "t", "k", ["v"]), "v", "i", "t") == [None, 1.0, 1.0, 3.0, None]
    assert values(joins.as_of(panel, facts, "i", "t", "k", ["v", "n"], whole_row=True), "v", "i", "t") == [None, 1.0, None, 3.0, None]


def test_versions_collapse_and_apply(spark):
    d = days(9)
    snaps = spark.createDataFrame([("a", d[0], "x"), ("a", d[2], "x"), ("a", d[4], "y"), ("a", d[6], None)], "i string, t date, v string")
    v = upserts.collapse_versions(snaps, ["i"], "t", ["v"]).orderBy("valid_from").collect()
    assert [(r["v"], r["valid_from"], r["valid_to"]) for r in v] == [("x", d[0], d[3]), ("y", d[4], d[5]), (None, d[6], None)]
    rows = spark.createDataFrame([("a", d[3]), ("b", d[3])], "i string, t date")
    got = joins.in_force(rows, upserts.collapse_versions(snaps, ["i"], "t", ["v"]), ["i", "t"], "i", "t", ["v"]).orderBy("i").collect()
    assert [(r["v"], r["missing"]) for r in got] == [("x", False), (None, True)]


def select_by_hand(ranking, held, k, dropout, most_new):
    chosen = [n for i, n in enumerate(ranking, 1) if n in held and i <= dropout]
    new = 0
    for n in ranking:
        if n in chosen:
            continue
        if n not in held:
            if new >= most_new:
                continue
            new += 1
        chosen.append(n)
        if len(chosen) >= k:
            break
    return set(sorted(chosen, key=ranking.index)[:k])


def test_selection_with_holdings(spark):
    random.seed(7)
    rows, expected = [], {}
    for d in range(40):
        names = [f"n{i}" for i in range(12)]
        random.shuffle(names)
        held = set(random.sample(names, random.randint(0, 7)))
        rows += [(d, n, float(-i), n in held) for i, n in enumerate(names)]
        expected[d] = select_by_hand(names, held, 5, 8, 2)
    out = sg.select_top(spark.createDataFrame(rows, "date int, instrument string, s double, held boolean"), "s", 5, 8, 2).collect()
    for d in range(40):
        assert {r["instrument"] for r in out if r["date"] == d} == expected[d]


def test_portfolio_gate_on_a_missing_column_is_closed(spark):
    df = spark.createDataFrame([("d", "a", 1.0, True)], "date string, instrument string, ensemble_score double, eligible boolean")
    assert sg.target_portfolio(df, least_scores={"nope": 0.0}).count() == 0
    assert sg.target_portfolio(df).first()["target_weight"] == 0.08


def test_signal_of_missing_factor_counts_nothing(spark):
    df = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 3.0)], "date string, instrument string, f double")
    out = sg.build_signal(df, [sg.Factor("f", 1, "x"), sg.Factor("gone", 1, "y")], sg.SignalRules(family_cap=None)).orderBy("instrument").collect()
    assert [round(r["ensemble_score"], 6) for r in out] == [-0.707107, 0.707107]
    assert {r["gone_contribution"] for r in out} == {0.0} and {r["top_factor_2"] for r in out} == {""}


def test_fills_reject_in_order(spark):
    o = spark.createDataFrame([("a", "BUY", 10.0, 100.0, 1000.0, 1e4, True, True), ("b", "SELL", 10.0, 100.0, 1000.0, 1e4, True, False)], "instrument string, side string, price double, order_shares double, order_value double, total_equity double, limit_up boolean, suspended boolean")
    rows = sg.fills(o).orderBy("instrument").collect()
    assert [r["reject_reason"] for r in rows] == ["suspended", ""]
    assert rows[1]["status"] == "filled" and rows[1]["net_cash_effect"] == pytest.approx(1000 * 0.9995 * (1 - 12 / 10000))
    assert {r["status"] for r in sg.fills(o, 0).collect()} == {"rejected"}


def test_reconcile_says_when_all_match(spark):
    p = spark.createDataFrame([("a", 0.5)], "instrument string, current_weight double")
    assert sg.reconcile(p, p).first()["check"] == "positions_match"


def test_event_expiry_and_text_rules(spark):
    e = spark.createDataFrame([("m", "s1", "purchase", "watch", days(1)[0])], "instrument string, event_id string, event_type string, severity string, event_date date")
    rows = spark.createDataFrame([("m", dt.date(2024, 2, 15)), ("m", dt.date(2024, 2, 16))], "instrument string, date date")
    got = domains.event_snapshot(rows, e).orderBy("date").collect()
    assert [r["event_count"] for r in got] == [1, 0]
    t = spark.createDataFrame([("up 12% and 2.5 %",), ("none",), (None,)], "t string").select(domains.percent_intensity(F.col("t")).alias("p"))
    assert values(t, "p", F.desc("p")) == [3.0, 1.0, 1.0]


def test_chunks_keep_every_character(spark):
    text = "a  b\n" + "xyz" * 500
    c = domains.chunks(spark.createDataFrame([(1, text), (2, "  "), (3, None)], "id int, text string"), size=100)
    assert "".join(values(c, "chunk_text", "chunk_id")) == "a b " + "xyz" * 500


def test_readers_and_upsert(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    assert tables.read_csv(spark, path, "a int, b string").count() == 0
    spark.createDataFrame([("1", "x"), ("bad", "y")], "a string, c string").coalesce(1).write.csv(path, header=True)
    assert [tuple(r) for r in tables.read_csv(spark, path, "a int, b string").orderBy("a").collect()] == [(None, None), (1, None)]
    out = str(tmp_path / "t.parquet")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    tables.upsert_to(spark, rows, out, ["k"])
    tables.upsert_to(spark, spark.createDataFrame([(2, "c")], "k int, v string"), out, ["k"])
    assert [tuple(r) for r in spark.read.parquet(out).orderBy("k").collect()] == [(1, "a"), (2, "c")]


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from crossloom.streaming import counted_windows, upsert_stream

    rows = [(1, "a", "2024-01-01 00:05:00"), (1, "a", "2024-01-01 00:05:00"), (2, "b", "2024-01-01 00:50:00"), (3, "a", "2024-01-01 01:10:00")]
    df = spark.createDataFrame(rows, "event_id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    wanted = {("2024-01-01 00:00:00", "a", 1), ("2024-01-01 00:00:00", "b", 1), ("2024-01-01 01:00:00", "a", 1)}
    assert {(str(r["start"]), r["event_type"], r["n"]) for r in counted_windows(df, "1 hour", "1 day").collect()} == wanted
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = counted_windows(stream, "1 hour", "1 day").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(str(r["start"]), r["event_type"], r["n"]) for r in spark.table("counted").collect()} == wanted
    for _ in range(2):
        upsert_stream(stream, str(tmp_path / "out"), ["event_type"], str(tmp_path / f"c{_}")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_industry_of_first_row_and_unpaid_losses(spark):
    from crossloom.operators import cross_section, trades

    groups = spark.createDataFrame([("a", "x", 2), ("a", "z", 1), ("b", "y", 1)], "instrument string, industry string, n int")
    panel = spark.createDataFrame([("a",), ("b",), ("c",)], "instrument string")
    assert {r["instrument"]: r["industry"] for r in cross_section.attach_group(panel, groups, order="n").collect()} == {"a": "z", "b": "y", "c": None}
    made = spark.createDataFrame([("w", 0.5, 0.1, -0.1), ("z", 0.0, 0.1, -0.1), ("l", -0.5, 0.1, -0.1), ("l", 0.25, 0.1, -0.1)], "k string, return double, mfe double, mae double")
    got = {r["k"]: r["payoff"] for r in trades.summarize(made, ["k"]).collect()}
    assert got == {"w": float("inf"), "z": 0.0, "l": 0.5}
    assert {r["k"]: r["payoff"] for r in trades.summarize(made, ["k"], True).collect()}["z"] == float("inf")
