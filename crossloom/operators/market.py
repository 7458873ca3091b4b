"""Daily trading state of instruments: calendars, liquidity, breadth and emotion scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import average_rank, clip, div

LIMIT = 0.098


def with_previous(bars: DataFrame, at: str = "datetime") -> DataFrame:
    return bars.withColumn("prev_close", F.lag("close").over(Window.partitionBy("instrument").orderBy(at)))


def _blocked(df: DataFrame, pct: Column, up: float, down: float) -> DataFrame:
    yes = lambda c: F.coalesce(c, F.lit(False))
    df = df.withColumn("limit_up", ~F.col("suspended") & yes(pct >= up)).withColumn("limit_down", ~F.col("suspended") & yes(pct <= down))
    return df.withColumns({"tradable": ~F.col("suspended"), "buy_blocked": F.col("suspended") | F.col("limit_up"), "sell_blocked": F.col("suspended") | F.col("limit_down")})


def execution_calendar(df: DataFrame, up: float = LIMIT, down: float = -LIMIT) -> DataFrame:
    """suspended (close, amount or volume missing or not positive), limits against the previous close, blocked sides."""
    suspended = F.lit(False)
    for c in ("close", "amount", "volume"):
        suspended = suspended | F.col(c).isNull() | (F.col(c) <= 0)
    return _blocked(df.withColumn("suspended", suspended), div(F.col("close"), F.col("prev_close")) - 1, up, down)


def liquidity(df: DataFrame, up: float = LIMIT, down: float = -LIMIT) -> DataFrame:
    """As execution_calendar, but a missing amount or volume does not suspend; with change, range, gap and limit pressure in [-1, 1]."""
    low = lambda c: F.coalesce(F.col(c) <= 0, F.lit(False))
    df = df.withColumn("suspended", F.col("close").isNull() | low("close") | low("amount") | low("volume"))
    base = F.when(F.col("prev_close") > 0, F.col("prev_close"))
    df = df.withColumns({"pct_change": div(F.col("close"), base) - 1, "intraday_range": div(F.col("high") - F.col("low"), base), "gap_pct": div(F.col("open"), base) - 1})
    pct = F.col("pct_change")
    pressure = F.when(pct >= 0, pct / abs(up)).when(pct < 0, pct / abs(down))
    return _blocked(df, pct, up, down).withColumn("limit_pressure", clip(pressure, -1.0, 1.0))


def breadth(df: DataFrame, date: str = "datetime") -> DataFrame:
    """One row per date over the tradable instruments; expects liquidity columns and turnover_20d. Suspended ones are only counted."""
    df = df.withColumn("_p", F.coalesce("pct_change", F.lit(0.0)))
    # the hot-turnover threshold: 1.5 times the median of the tradable
    hot = df.where("not suspended").groupBy(date).agg(F.median("turnover_20d").alias("_median"))
    rows = df.join(hot, date, "left")
    t = ~F.col("suspended")
    share = lambda c: F.coalesce(F.avg(F.when(t, c.cast("double"))), F.lit(0.0))
    threshold = 1.5 * F.col("_median")
    return rows.groupBy(date).agg(
        F.count(F.when(t, 1)).alias("tradable_count"),
        share(F.col("_p") > 0).alias("up_ratio"),
        share(F.col("_p") < 0).alias("down_ratio"),
        F.count(F.when(t & F.col("limit_up"), 1)).alias("limit_up_count"),
        F.count(F.when(t & F.col("limit_down"), 1)).alias("limit_down_count"),
        F.coalesce(F.avg(F.when(t, F.col("_p"))), F.lit(0.0)).alias("avg_pct_change"),
        F.coalesce(F.median(F.when(t, F.col("_p"))), F.lit(0.0)).alias("median_pct_change"),
        F.coalesce(F.avg(F.when(t & F.col("turnover_20d").isNotNull(), ((F.col("turnover_20d") >= threshold) & (threshold > 0)).cast("double"))), F.lit(0.0)).alias("hot_turnover_ratio"),
        share(F.col("_p") <= -0.05).alias("panic_down_ratio"),
        F.count(F.when(~t, 1)).alias("suspended_count"),
    )


def emotion_score(b: DataFrame) -> DataFrame:
    """emotion_score 0 to 100 of a breadth row; weights and bounds are fixed values; no tradable row: 50."""
    per = F.when(F.col("tradable_count") > 0, F.col("tradable_count"))
    unit = lambda c: clip(c, 0.0, 1.0)
    score = (
        40.0 * unit(F.col("up_ratio"))
        + 20.0 * unit(div(F.col("limit_up_count"), per) * 5.0)
        + 15.0 * unit(F.col("hot_turnover_ratio"))
        + 15.0 * unit((clip(F.col("avg_pct_change"), -0.05, 0.05) + 0.05) / 0.10)
        + 10.0 * (1.0 - unit(F.col("panic_down_ratio")))
        - 10.0 * unit(div(F.col("limit_down_count"), per) * 5.0)
    )
    return b.withColumn("emotion_score", F.bround(clip(F.coalesce(score, F.lit(50.0)), 0.0, 100.0), 4))


def instrument_emotion(df: DataFrame, date: str = "datetime") -> DataFrame:
    """Scores of an instrument within its date, from average percentile ranks of change and turnover, bonuses and penalties."""
    w = Window.partitionBy(date)

    def share(c: Column) -> Column:
        n = F.count(c).over(w)
        return F.coalesce(F.when(n > 1, average_rank(c, date) / n), F.lit(0.5))

    df = df.withColumns({"_p": F.coalesce("pct_change", F.lit(0.0)), "_t": F.coalesce("turnover_20d", "amount_20d")})
    flag = lambda c: F.col(c).cast("double")
    raw = 100.0 * (0.55 * share(F.col("_p")) + 0.25 * share(F.col("_t")) + 0.20 * flag("limit_up")) - 35.0 * flag("limit_down") - 50.0 * flag("suspended")
    df = df.withColumn("instrument_emotion_score", F.bround(clip(raw, 0.0, 100.0), 4)).drop("_p", "_t")
    return df.withColumn("crowding_cooling_score", F.bround(clip(100.0 - F.col("instrument_emotion_score"), 0.0, 100.0), 4))
