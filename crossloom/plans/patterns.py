"""Breakout queries over the suppliers' bars, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as pt
from ..operators import trades
from ..sources.tables import supplier_bars
from .facts import shared
from .factors import KEYS, W, roll, rounded

#: Monthly bars move more than daily ones: looser limits than the defaults.
RULES = pt.Breakout(golden_ages=(1, 12), pressure_lookback=24, pressure_exclusion=2, least_pressure_bars=6, warm_up=24, return_range=(0.0, 0.6), most_extended=0.6, least_volume_ratio=0.8, close_tolerance=0.05)
BARS = """bars AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(date_trunc('month', l_shipdate) AS DATE) AS datetime, round(avg(l_extendedprice / l_quantity), 8) AS open, round(max(l_extendedprice / l_quantity), 8) AS high,
 round(min(l_extendedprice / l_quantity), 8) AS low, round(sum(l_extendedprice) / sum(l_quantity), 8) AS close, round(sum(l_quantity), 2) AS volume FROM lineitem GROUP BY 1, 2)"""


def pattern_confirmation(spark, sf_dir):
    df = pt.confirmation(supplier_bars(spark, sf_dir), 3, 2, 6, 1.2)
    return rounded(df.where("confirm_bar is not null").select(*KEYS, "confirm_bar", "breakout_level", "confirm_volume_ratio"), KEYS)


CONFIRMATION = f"""WITH {BARS}, b AS (SELECT *, row_number() OVER {W} AS i, max(high) OVER {roll(2)} AS level, volume / nullif(avg(volume) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) AS ratio FROM bars)
SELECT a.instrument, a.datetime, min(n.i - a.i) AS confirm_bar, round(a.level, 6) AS breakout_level, round(arg_min(n.ratio, n.i), 6) AS confirm_volume_ratio FROM b a JOIN b n ON n.instrument = a.instrument AND n.i BETWEEN a.i + 1 AND a.i + 3 AND n.close > a.level AND n.ratio >= 1.2 GROUP BY a.instrument, a.datetime, a.level"""


def pattern_evidence(spark, sf_dir):
    df = pt.evidence(supplier_bars(spark, sf_dir), RULES)
    return rounded(df.select(*KEYS, "weekly_trend", "golden", "golden_date", "pressure_high", "pressure_date", "attack_reason", "confirm_reason", "pre_return"), [*KEYS, "golden_date", "pressure_date"])


def pattern_events(spark, sf_dir):
    """Every supplier's bars with the signal and why there is none; bars of the warm-up say so."""
    return rounded(pt.breakout_events(supplier_bars(spark, sf_dir), RULES).select(*KEYS, "signal", "watch", "failure_reason"), KEYS)


def pattern_explained(spark, sf_dir):
    """Samples: the first supplier's bars of 1997 and a date without one."""
    bars = supplier_bars(spark, sf_dir)
    samples = bars.where("instrument = '1' and year(datetime) = 1997").select(*KEYS, F.lit("case").alias("label"))
    samples = samples.union(spark.createDataFrame([("1", "2030-01-01")], "i string, d string").select("i", F.col("d").cast("date"), F.lit("none")))
    return rounded(pt.explanations(pt.breakout_events(bars, RULES), samples).select(*KEYS, "label", "found", "failure_reason", "ret", "body"), KEYS)


def trades_focus(spark, sf_dir):
    """The focus row of the bucket evaluation, among horizons without the preferred one."""
    return rounded(pt.focus_row(trades.bucket_evaluation(shared(spark, sf_dir), "signal", [3, 5])).select("horizon", "bucket", "trades", "mean_return", "win_rate"), [])


def _full(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {roll(n)} = {n} THEN avg({c}) OVER {roll(n)} END"


def _rows(a: int, b: int) -> str:
    return f"(PARTITION BY instrument ORDER BY datetime ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"


def _ladder(checks: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN NOT coalesce({ok}, false) THEN '{text}'" for ok, text in checks) + " ELSE '' END"


OLD, AGES = _rows(RULES.pressure_exclusion + RULES.pressure_lookback - 1, RULES.pressure_exclusion), _rows(RULES.golden_ages[1], RULES.golden_ages[0])
EVIDENCE = f"""{BARS},
e0 AS (SELECT *, row_number() OVER {W} - 1 AS bar, {_full("close", 5)} AS ma5, {_full("close", 13)} AS ma13, {_full("close", 21)} AS ma21, lag(close) OVER {W} AS pc, CASE WHEN count(low) OVER {_rows(20, 1)} >= 10 THEN min(low) OVER {_rows(20, 1)} END AS low20,
 CASE WHEN count(high) OVER {OLD} >= {RULES.least_pressure_bars} THEN max(high) OVER {OLD} END AS pressure_high, CASE WHEN count(high) OVER {OLD} >= {RULES.least_pressure_bars} THEN min({{'h': -high, 'd': datetime}}) OVER {OLD} END.d AS pressure_date,
 volume / nullif(avg(volume) OVER {_rows(10, 1)}, 0) AS volume_ratio, lag(close) OVER {W} / lag(close, {RULES.extended_lookback}) OVER {W} - 1 AS pre_return, close / lag(close) OVER {W} - 1 AS ret, close / open - 1 AS body, (close - low) / (high - low + 0.000001) AS close_position FROM bars),
e1 AS (SELECT *, coalesce(close > ma21 AND ma21 > lag(ma21, 5) OVER {W} AND ma5 > ma13, false) AS weekly_trend, coalesce(close > pressure_high AND pc <= pressure_high, false) AS first_breakout,
 coalesce(close > ma5 AND close > ma13 AND close > ma21 AND ma5 > ma13 AND ma5 > ma21 AND ma21 > lag(ma21, 3) OVER {W} AND close / (low20 + 0.000001) - 1 >= {RULES.golden_rise}, false) AS golden FROM e0),
e2 AS (SELECT *, max(CASE WHEN golden THEN datetime END) OVER {AGES} AS golden_date, {_ladder([("first_breakout", "attack_not_first_close_breakout"), (f"(pre_return IS NULL OR pre_return <= {RULES.most_extended})", "attack_prior_four_weeks_already_extended"), ("close > pressure_high", "attack_close_below_pressure"), ("ret >= 0", "attack_return_too_weak"), (f"ret <= {RULES.return_range[1]}", "attack_return_too_hot"), ("body >= 0", "attack_body_too_weak"), ("close > ma5", "attack_below_ma5"), ("close > ma13", "attack_below_ma13"), ("close_position >= 0.45", "attack_close_not_near_high"), (f"volume_ratio >= {RULES.least_volume_ratio}", "attack_volume_too_low")])} AS attack_reason FROM e1),
e3 AS (SELECT *, lag(first_breakout) OVER {W} AS b_first, lag(attack_reason) OVER {W} AS b_attack, lag(pressure_high) OVER {W} AS b_pressure, lag(volume) OVER {W} AS b_volume FROM e2),
e AS (SELECT *, {_ladder([("close > open", "confirmation_not_bullish_candle"), ("volume < b_volume", "confirmation_volume_not_shrinking"), (f"close >= b_pressure * (1 - {RULES.close_tolerance})", "confirmation_lost_pressure"), ("close >= pc", "confirmation_close_below_breakout_close"), ("close > ma5", "confirmation_below_ma5"), ("close > ma13", "confirmation_below_ma13")])} AS confirm_reason FROM e3)"""
EVENTS = f"""WITH RECURSIVE {EVIDENCE},
r AS (SELECT *, CASE WHEN bar < {max(RULES.warm_up, RULES.pressure_exclusion + RULES.least_pressure_bars)} THEN 'insufficient_history' WHEN NOT weekly_trend THEN 'weekly_trend_not_ready' WHEN golden_date IS NULL THEN 'missing_prior_golden_buy' WHEN NOT coalesce(b_first, false) THEN 'missing_previous_day_close_breakout'
 WHEN NOT coalesce(b_pressure > 0, false) THEN 'invalid_pressure_high' WHEN b_attack <> '' THEN b_attack WHEN confirm_reason <> '' THEN confirm_reason ELSE 'matched' END AS reason FROM e),
m AS (SELECT a.instrument, a.bar, coalesce(min(n.bar), 2000000000) AS until FROM r a LEFT JOIN r n ON n.instrument = a.instrument AND n.bar > a.bar AND (n.close < a.b_pressure * {RULES.break_share} OR coalesce(n.close < n.ma21 * {RULES.month_cost_share}, false)) WHERE a.reason = 'matched' GROUP BY 1, 2),
t(instrument, bar, until) AS (SELECT * FROM m WHERE bar = (SELECT min(bar) FROM m z WHERE z.instrument = m.instrument)
 UNION ALL SELECT m.instrument, m.bar, m.until FROM m JOIN t ON t.instrument = m.instrument AND m.bar >= t.until WHERE m.bar = (SELECT min(bar) FROM m z WHERE z.instrument = t.instrument AND z.bar >= t.until)),
f AS (SELECT r.*, CASE WHEN reason <> 'insufficient_history' AND EXISTS (SELECT 1 FROM t WHERE t.instrument = r.instrument AND r.bar > t.bar AND r.bar < t.until) THEN 'diamond_structure_already_active' ELSE reason END AS failure_reason FROM r)"""


def queries() -> dict:
    return {"pattern_confirmation": pattern_confirmation, "pattern_evidence": pattern_evidence, "pattern_events": pattern_events, "pattern_explained": pattern_explained, "trades_focus": trades_focus}


def oracle_sql() -> dict[str, str]:
    from .facts import oracle_sql as facts_sql

    ready = "failure_reason NOT IN ('insufficient_history', 'diamond_structure_already_active', 'weekly_trend_not_ready', 'missing_prior_golden_buy')"
    return {
        "pattern_confirmation": CONFIRMATION,
        "pattern_evidence": f"WITH {EVIDENCE} SELECT instrument, datetime, weekly_trend, golden, golden_date, round(pressure_high, 6) AS pressure_high, pressure_date, attack_reason, confirm_reason, round(pre_return, 6) AS pre_return FROM e",
        "pattern_events": f"{EVENTS} SELECT instrument, datetime, CASE WHEN failure_reason = 'matched' THEN 1e0 ELSE 0e0 END AS signal, CASE WHEN {ready} AND attack_reason = '' AND pressure_high > 0 THEN 1e0 ELSE 0e0 END AS watch, failure_reason FROM f",
        "pattern_explained": f"{EVENTS}, s AS (SELECT instrument, datetime, 'case' AS label FROM bars WHERE instrument = '1' AND year(datetime) = 1997 UNION ALL SELECT '1', DATE '2030-01-01', 'none') SELECT instrument, datetime, label, failure_reason IS NOT NULL AS found, failure_reason, round(ret, 6) AS ret, round(body, 6) AS body FROM s LEFT JOIN f USING (instrument, datetime)",
        "trades_focus": f"SELECT horizon, bucket, trades, mean_return, win_rate FROM ({facts_sql()['trades_evaluation']}) WHERE horizon = 5 AND bucket = 'p95_p100'",
    }
