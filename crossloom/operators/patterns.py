"""Breakouts: confirmation of a signal, and a detector of first closes above an old high that hold the next day.

All evidence is window columns over a series. Only which of an instrument's
matches count depends on earlier ones (a structure blocks new matches until it breaks);
that is a fold over the few bars that match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div
from ..functions.series import series
from .trades import greedy


@dataclass(frozen=True)
class Breakout:
    """Default values are fixed values of the detector."""

    golden_ages: tuple[int, int] = (5, 60)
    golden_rise: float = 0.08
    pressure_lookback: int = 180
    pressure_exclusion: int = 21
    least_pressure_bars: int = 40
    warm_up: int = 60
    break_share: float = 0.94
    month_cost_share: float = 0.97
    close_tolerance: float = 0.005
    return_range: tuple[float, float] = (0.0, 0.05)
    least_body: float = 0.0
    least_close_position: float = 0.45
    least_volume_ratio: float = 1.10
    extended_lookback: int = 20
    most_extended: float = 0.20


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def first_failure(checks: list[tuple[Column, str]]) -> Column:
    """The reason of the first check that does not hold (null: does not), or an empty text."""
    reason = F.lit("")
    for ok, text in reversed(checks):
        reason = F.when(~yes(ok), text).otherwise(reason)
    return reason


def confirmation(df: DataFrame, within: int, lookback: int, volume_lookback: int, ratio: float) -> DataFrame:
    """df with the first of the next `within` bars that closes above the high of the last `lookback` bars on enough volume.

    confirm_bar (bars ahead, null if none), breakout_level and confirm_volume_ratio. within 0: the bar itself,
    without the two others. The bars looked at are `within` at most.
    """
    if within <= 0:
        return df.withColumns({"confirm_bar": F.lit(0), "breakout_level": F.lit(None).cast("double"), "confirm_volume_ratio": F.lit(None).cast("double")})
    w = series()
    base = F.avg("volume").over(w.rowsBetween(-volume_lookback, -1))
    df = df.withColumns({"_ratio": div(F.col("volume"), base), "breakout_level": F.max("high").over(w.rowsBetween(1 - lookback, 0))})
    ahead = F.collect_list(F.struct("close", F.coalesce("_ratio", F.lit(-1.0)).alias("ratio"))).over(w.rowsBetween(1, within))
    tagged = F.transform("_ahead", lambda x, i: F.struct((i + 1).alias("bar"), x["close"].alias("close"), x["ratio"].alias("ratio")))
    hit = F.get(F.filter(tagged, lambda x: (x["close"] > F.col("breakout_level")) & (x["ratio"] >= ratio)), F.lit(0))
    df = df.withColumn("_ahead", ahead).withColumn("_hit", hit)
    return df.withColumns({"confirm_bar": F.col("_hit.bar"), "confirm_volume_ratio": F.col("_hit.ratio"), "breakout_level": F.when(F.col("_hit").isNotNull(), F.col("breakout_level"))}).drop("_ratio", "_ahead", "_hit")


def full_mean(c: str, n: int) -> Column:
    """Mean of n bars; null before there are n."""
    w = series().rowsBetween(1 - n, 0)
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w))


def evidence(bars: DataFrame, rules: Breakout = Breakout()) -> DataFrame:
    """bars (open, high, low, close, volume by instrument and datetime) with the stateless evidence of every bar.

    bar counts from 0. attack_reason and confirm_reason name the first check that fails.
    """
    w = series()
    df = bars.withColumn("bar", F.row_number().over(w) - 1)
    df = df.withColumns({f"ma{n}": full_mean("close", n) for n in (5, 13, 21)})
    df = df.withColumns({"_ma21_3": F.lag("ma21", 3).over(w), "_ma21_5": F.lag("ma21", 5).over(w), "_pc": F.lag("close").over(w)})
    past = w.rowsBetween(-20, -1)
    low20 = F.when(F.count("low").over(past) >= 10, F.min("low").over(past))
    c, m5, m13, m21 = (F.col(x) for x in ("close", "ma5", "ma13", "ma21"))
    golden = (c > m5) & (c > m13) & (c > m21) & (m5 > m13) & (m5 > m21) & (m21 > F.col("_ma21_3")) & (div(c, low20 + 0.000001) - 1 >= rules.golden_rise)
    old = w.rowsBetween(1 - rules.pressure_exclusion - rules.pressure_lookback, -rules.pressure_exclusion)
    pressure = F.when(F.count("high").over(old) >= rules.least_pressure_bars, F.max("high").over(old))
    youngest, oldest = rules.golden_ages
    df = df.withColumns({
        "weekly_trend": yes((c > m21) & (m21 > F.col("_ma21_5")) & (m5 > m13)),
        "golden": yes(golden),
        "pressure_high": pressure,
        "pressure_date": F.when(pressure.isNotNull(), F.min_by("datetime", F.struct(-F.col("high"), F.col("datetime"))).over(old)),
        "volume_ratio": div(F.col("volume"), F.avg("volume").over(w.rowsBetween(-10, -1))),
        "pre_return": div(F.col("_pc"), F.lag("close", rules.extended_lookback).over(w)) - 1,
        "ret": div(c, F.col("_pc")) - 1,
        "body": div(c, F.col("open")) - 1,
        "close_position": div(c - F.col("low"), F.col("high") - F.col("low") + 0.000001),
    })
    p = F.col("pressure_high")
    df = df.withColumn("first_breakout", yes((c > p) & (F.col("_pc") <= p)))
    df = df.withColumn("golden_date", F.max(F.when(F.col("golden"), F.col("datetime"))).over(w.rowsBetween(-oldest, -youngest)))
    attack = [
        (F.col("first_breakout"), "attack_not_first_close_breakout"),
        (F.col("pre_return").isNull() | (F.col("pre_return") <= rules.most_extended), "attack_prior_four_weeks_already_extended"),
        (c > p, "attack_close_below_pressure"),
        (F.col("ret") >= rules.return_range[0], "attack_return_too_weak"),
        (F.col("ret") <= rules.return_range[1], "attack_return_too_hot"),
        (F.col("body") >= rules.least_body, "attack_body_too_weak"),
        (c > m5, "attack_below_ma5"),
        (c > m13, "attack_below_ma13"),
        (F.col("close_position") >= rules.least_close_position, "attack_close_not_near_high"),
        (F.col("volume_ratio") >= rules.least_volume_ratio, "attack_volume_too_low"),
    ]
    df = df.withColumn("attack_reason", first_failure(attack))
    before = {f"_b_{x}": F.lag(x).over(w) for x in ("first_breakout", "attack_reason", "pressure_high", "pressure_date", "close", "volume", "datetime")}
    df = df.withColumns(before)
    confirm = [
        (c > F.col("open"), "confirmation_not_bullish_candle"),
        (F.col("volume") < F.col("_b_volume"), "confirmation_volume_not_shrinking"),
        (c >= F.col("_b_pressure_high") * (1 - rules.close_tolerance), "confirmation_lost_pressure"),
        (c >= F.col("_b_close"), "confirmation_close_below_breakout_close"),
        (c > m5, "confirmation_below_ma5"),
        (c > m13, "confirmation_below_ma13"),
    ]
    return df.withColumn("confirm_reason", first_failure(confirm))


def breakout_events(bars: DataFrame, rules: Breakout = Breakout()) -> DataFrame:
    """Every bar with signal (0 or 1), watch (an attack today), the evidence, and the reason why it is no signal ("matched" if it is).

    After a match the structure is active until a close below break_share of its
    pressure or below month_cost_share of the 21-bar mean; until then no bar
    matches, and the bar that breaks it may match again.
    """
    df = evidence(bars, rules)
    early = F.col("bar") < max(rules.warm_up, rules.pressure_exclusion + rules.least_pressure_bars)
    reason = (
        F.when(~F.col("weekly_trend"), "weekly_trend_not_ready")
        .when(F.col("golden_date").isNull(), "missing_prior_golden_buy")
        .when(~yes(F.col("_b_first_breakout")), "missing_previous_day_close_breakout")
        .when(~yes(F.col("_b_pressure_high") > 0), "invalid_pressure_high")
        .when(F.col("_b_attack_reason") != "", F.col("_b_attack_reason"))
        .when(F.col("confirm_reason") != "", F.col("confirm_reason"))
        .otherwise("matched")
    )
    df = df.withColumn("_reason", F.when(early, "insufficient_history").otherwise(reason))
    match = df.where("_reason = 'matched'").select("instrument", "bar", F.col("_b_pressure_high").alias("support"))
    later = df.select(F.col("instrument").alias("_i"), F.col("bar").alias("_bar"), F.col("close").alias("_close"), F.col("ma21").alias("_ma21"))
    broken = (F.col("_close") < F.col("support") * rules.break_share) | yes(F.col("_close") < F.col("_ma21") * rules.month_cost_share)
    # matches are rare; each meets the bars of its own instrument
    ends = match.join(later, (F.col("instrument") == F.col("_i")) & (F.col("_bar") > F.col("bar")) & broken).groupBy("instrument", "bar").agg(F.min("_bar").alias("_end"))
    match = match.join(ends, ["instrument", "bar"], "left").withColumn("exit_bar", F.coalesce(F.col("_end") - 1, F.lit(2_000_000_000)))
    taken = greedy(match, ["instrument"]).select("instrument", "bar", F.col("exit_bar").alias("_until"))
    df = df.join(taken, ["instrument", "bar"], "left")
    earlier = series(at="bar").rowsBetween(Window.unboundedPreceding, -1)
    active = yes(F.last("_until", ignorenulls=True).over(earlier) >= F.col("bar")) & (F.col("_reason") != "insufficient_history")
    df = df.withColumn("failure_reason", F.when(active, "diamond_structure_already_active").otherwise(F.col("_reason")))
    ready = ~F.col("failure_reason").isin("insufficient_history", "diamond_structure_already_active", "weekly_trend_not_ready", "missing_prior_golden_buy")
    return df.select(
        "instrument", "datetime", F.when(F.col("failure_reason") == "matched", 1.0).otherwise(0.0).alias("signal"), F.when(ready & (F.col("attack_reason") == "") & (F.col("pressure_high") > 0), 1.0).otherwise(0.0).alias("watch"),
        "failure_reason", "weekly_trend", "golden", "golden_date", "pressure_high", "pressure_date", "attack_reason", "confirm_reason", "pre_return", "ret", "body", "close_position", "volume_ratio",
    )


def explanations(events: DataFrame, samples: DataFrame) -> DataFrame:
    """The evidence rows of labelled samples (instrument, datetime, label); a sample without a bar keeps nulls and says so."""
    found = samples.join(events, ["instrument", "datetime"], "left")
    return found.withColumn("found", F.col("failure_reason").isNotNull())


def focus_row(summary: DataFrame, bucket: str = "p95_p100", horizon: int = 20) -> DataFrame:
    """One row: of the best bucket (of all rows if it has none) the one at `horizon`, else at the largest horizon."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("bucket") != bucket, F.col("horizon") != horizon, F.desc("horizon"), "bucket")
    return summary.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
