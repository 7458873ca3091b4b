"""How well a signal orders future returns: IC, turnover, quantiles, regimes, rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import average_rank, corr, div, first_rank, group_count
from ..functions.series import series


def forward_return(df: DataFrame, horizon: int, close: str = "close", out: str | None = None) -> DataFrame:
    """close `horizon` bars later over close, less 1; bars are the rows there are."""
    return df.withColumn(out or f"fwd_{horizon}", div(F.lead(close, horizon).over(series()), F.col(close)) - 1)


def long_horizons(df: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """One row per horizon: horizon, future; rows whose return lies beyond the data are gone."""
    for h in horizons:
        df = forward_return(df, h)
    stacked = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("future")) for h in horizons]))
    return df.withColumn("_h", stacked).select("*", "_h.horizon", "_h.future").drop("_h", *[f"fwd_{h}" for h in horizons]).where("future is not null")


def daily_ic(df: DataFrame, signal: str, by: Sequence[str] = ("horizon",), date: str = "datetime") -> DataFrame:
    """ic and rank_ic (on average ranks) of each date; n rows."""
    df = df.where(F.col(signal).isNotNull())
    df = df.withColumn("_rs", average_rank(F.col(signal), *by, date)).withColumn("_rf", average_rank(F.col("future"), *by, date))
    return df.groupBy(*by, date).agg(corr(F.col(signal), F.col("future")).alias("ic"), corr(F.col("_rs"), F.col("_rf")).alias("rank_ic"), F.count(F.lit(1)).alias("n"))


def _ic_columns() -> list[Column]:
    made = []
    for c in ("ic", "rank_ic"):
        sd = F.stddev_samp(c)
        made += [F.avg(c).alias(f"{c}_mean"), sd.alias(f"{c}_std"), F.when(sd > 0, div(F.avg(c), sd)).alias(f"{c}ir")]
    return made


def ic_summary(daily: DataFrame, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Mean, deviation over days (divisor n - 1) and their ratio, for both ICs."""
    return daily.groupBy(*by).agg(*_ic_columns(), F.sum("n").alias("observations"))


def top_members(df: DataFrame, signal: str, quantiles: int, by: Sequence[str] = (), date: str = "datetime") -> DataFrame:
    """Rows whose rank share is at least 1 - 1/quantiles (the same double comparison for every count)."""
    c = F.col(signal)
    share = first_rank(c, "instrument", *by, date) / group_count(c, *by, date)
    return df.where(c.isNotNull()).withColumn("_share", share).where(F.col("_share") >= 1 - 1 / quantiles).drop("_share")


def top_turnover(df: DataFrame, signal: str, quantiles: int, by: Sequence[str] = (), date: str = "datetime") -> DataFrame:
    """Mean over consecutive dates of the share of top members that leave; one date only: null.

    A member's next date at the top is a window over its own rows; how many go from which date to which is a small table, in which dates find the one after.
    """
    keys = [*by]
    ahead = F.lead(date).over(Window.partitionBy(*keys, "instrument").orderBy(date))
    moves = top_members(df, signal, quantiles, by, date).withColumn("_next", ahead).groupBy(*keys, date, "_next").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.unix_seconds(F.col(date).cast("timestamp")))
    moves = moves.withColumn("_after", F.min(date).over(order.rangeBetween(1, Window.unboundedFollowing)))
    days = moves.where("_after is not null").groupBy(*keys, date, "_after").agg(F.sum("_n").alias("_all"), F.sum(F.when(F.col("_next") == F.col("_after"), F.col("_n")).otherwise(0)).alias("_stay"))
    return days.groupBy(*keys).agg(F.avg(1 - div(F.col("_stay"), F.col("_all"))).alias("turnover"))


def quantile_bucket(signal: str, quantiles: int, by: Sequence[str] = (), date: str = "datetime") -> Column:
    """1..quantiles: the quantile interval of the first rank r among n, by interpolated edges; null where n < quantiles."""
    c = F.col(signal)
    r, n = first_rank(c, "instrument", *by, date), group_count(c, *by, date)
    return F.when(n >= quantiles, F.greatest(F.lit(1), F.ceil((r - 1) * quantiles / F.greatest(n - 1, F.lit(1)))).cast("int"))


def quantile_returns(df: DataFrame, signal: str, quantiles: int = 5, by: Sequence[str] = ("horizon",), date: str = "datetime") -> DataFrame:
    """q1..qN: the pooled mean future return of each bucket; long_short: the last less the first."""
    bucketed = df.withColumn("_q", quantile_bucket(signal, quantiles, by, date)).where("_q is not null")
    means = [F.avg(F.when(F.col("_q") == k, F.col("future"))).alias(f"q{k}") for k in range(1, quantiles + 1)]
    return bucketed.groupBy(*by).agg(*means).withColumn("long_short", F.col(f"q{quantiles}") - F.col("q1"))


def evaluate(df: DataFrame, signal: str, horizons: Sequence[int], quantiles: int = 5, direction: int = 1) -> DataFrame:
    """One row per horizon: IC statistics, turnover, observations, quantile returns. A horizon without rows has 0 observations.

    Expects instrument, datetime, close and the signal. All horizons go through one plan.
    """
    panel = df.where(F.col(signal).isNotNull() & F.col("close").isNotNull()).withColumn("_s", F.col(signal) * direction)
    rows = long_horizons(panel.select("instrument", "datetime", "close", "_s"), horizons)
    rows = rows.withColumns({"_rs": average_rank(F.col("_s"), "horizon", "datetime"), "_rf": average_rank(F.col("future"), "horizon", "datetime"), "_q": quantile_bucket("_s", quantiles, ["horizon"])})
    each = range(1, quantiles + 1)
    sums = [F.sum(F.when(F.col("_q") == k, F.col("future"))).alias(f"_s{k}") for k in each] + [F.count(F.when(F.col("_q") == k, 1)).alias(f"_n{k}") for k in each]
    daily = rows.groupBy("horizon", "datetime").agg(corr(F.col("_s"), F.col("future")).alias("ic"), corr(F.col("_rs"), F.col("_rf")).alias("rank_ic"), F.count(F.lit(1)).alias("n"), *sums)
    stats = daily.groupBy("horizon").agg(*_ic_columns(), F.sum("n").alias("observations"), *[div(F.sum(f"_s{k}"), F.sum(f"_n{k}")).alias(f"q{k}") for k in each])
    stats = stats.withColumn("long_short", F.col(f"q{quantiles}") - F.col("q1"))
    wanted = df.sparkSession.createDataFrame([(h,) for h in horizons], "horizon int")
    out = wanted.join(stats, "horizon", "left").withColumn("observations", F.coalesce("observations", F.lit(0)))
    return out.crossJoin(top_turnover(panel, "_s", quantiles))  # turnover is one row


def market_regime(df: DataFrame, fast: int = 20, slow: int = 60, trend: int = 20, threshold: float = 0.02) -> DataFrame:
    """Per date: the equal-weight return and its index, moving means, trend, and regime (up, down, sideways).

    After the mean per date, the rest works on one row per date.
    """
    ret = div(F.col("close"), F.lag("close").over(series())) - 1
    daily = df.withColumn("_r", ret).groupBy("datetime").agg(F.coalesce(F.avg("_r"), F.lit(0.0)).alias("market_return"))
    w = Window.partitionBy(F.lit(1)).orderBy("datetime")
    daily = daily.withColumn("proxy", F.product(1 + F.col("market_return")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    daily = daily.withColumn("fast_mean", F.avg("proxy").over(w.rowsBetween(1 - fast, 0))).withColumn("slow_mean", F.avg("proxy").over(w.rowsBetween(1 - slow, 0)))
    daily = daily.withColumn("trend_return", F.coalesce(div(F.col("proxy"), F.lag("proxy", trend).over(w)) - 1, F.lit(0.0)))
    up = (F.col("proxy") >= F.col("slow_mean")) & (F.col("fast_mean") >= F.col("slow_mean")) & (F.col("trend_return") > threshold)
    down = (F.col("proxy") <= F.col("slow_mean")) & (F.col("fast_mean") <= F.col("slow_mean")) & (F.col("trend_return") < -threshold)
    return daily.withColumn("regime", F.when(up, "up").when(down, "down").otherwise("sideways"))


def segmented_ic(daily: DataFrame, regime: DataFrame, least: int = 10) -> DataFrame:
    """rank IC by overall, month of year and regime in one pass of grouping sets: days, mean, share of positive days."""
    rows = daily.where(F.col("n") >= least).join(regime.select("datetime", "regime"), "datetime", "left")
    rows = rows.select(F.year("datetime").alias("year"), F.coalesce("regime", F.lit("unknown")).alias("regime"), "rank_ic")
    sets = rows.groupingSets([[], ["year"], ["regime"]], "year", "regime")
    stats = sets.agg(F.grouping("year").alias("gy"), F.grouping("regime").alias("gr"), F.count("rank_ic").alias("days"), F.avg("rank_ic").alias("rank_ic_mean"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_rate"))
    kind = F.when(F.col("gy") == 0, "year").when(F.col("gr") == 0, "regime").otherwise("overall")
    return stats.select(kind.alias("segment"), F.coalesce(F.col("year").cast("string"), F.col("regime"), F.lit("all")).alias("value"), "days", "rank_ic_mean", "positive_rate")


def role(ic: Column, icir: Column, long_short: Column, retention: Column) -> Column:
    """The role that neutral results suggest; the thresholds are fixed values."""
    core = (ic >= 0.035) & (icir >= 0.25) & (long_short > 0) & (retention >= 0.55)
    candidate = (ic >= 0.025) & (long_short > 0)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(core), "core_candidate").when(yes(candidate), "candidate_review").when(yes(ic >= 0.025), "shadow_review").otherwise("reject_review")


def rank_factors(results: DataFrame, metric: str = "rank_ic_mean", least: int = 0) -> DataFrame:
    """Results with enough observations, the largest absolute metric (to nine digits) first."""
    if metric not in results.columns:
        raise ValueError(f"no column {metric}")
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(F.round(F.abs(F.col(metric)), 9)), "factor")
    return results.where(F.col("observations") >= least).withColumn("position", F.row_number().over(order))


def evaluate_many(df: DataFrame, factors: Mapping[str, tuple[str, int]], horizons: Sequence[int], quantiles: int = 5, turnover: bool = True, long_short: bool = False) -> DataFrame:
    """A row per factor (name: column, direction) and horizon: IC and rank IC means, observations, and if asked for turnover of the top quantile and the long-short return.

    Returns look ahead over all rows with a close; then factors and horizons are stacked, so that the panel is read once. A factor whose column df
    doesn't have, and a horizon beyond the data, have 0 observations and no metrics.
    """
    have = {n: c for n, (c, _) in factors.items() if c in df.columns}
    grid = df.sparkSession.createDataFrame([(n, way, h) for n, (_, way) in factors.items() for h in horizons], "factor string, direction int, horizon int")
    metrics = ["ic_mean", "rank_ic_mean", *(["long_short"] if long_short else []), *(["turnover"] if turnover else [])]
    if not have:
        return grid.select("*", *[F.lit(None).cast("double").alias(m) for m in metrics], F.lit(0).cast("long").alias("observations"))
    base = df.where(F.col("close").isNotNull()).withColumns({f"_f{h}": div(F.lead("close", h).over(series()), F.col("close")) - 1 for h in horizons})
    cells = [F.struct(F.lit(n).alias("factor"), F.lit(h).alias("horizon"), (F.col(c).cast("double") * factors[n][1]).alias("signal"), F.col(f"_f{h}").alias("future")) for n, c in have.items() for h in horizons]
    rows = base.select("instrument", "datetime", F.inline(F.filter(F.array(*cells), lambda x: x["signal"].isNotNull() & x["future"].isNotNull())))
    by = ["factor", "horizon"]
    rows = rows.withColumns({"_rs": average_rank(F.col("signal"), *by, "datetime"), "_rf": average_rank(F.col("future"), *by, "datetime")} | ({"_q": quantile_bucket("signal", quantiles, by)} if long_short else {}))
    ends = [F.sum(F.when(F.col("_q") == k, F.col("future"))).alias(f"_s{k}") for k in (1, quantiles)] + [F.count(F.when(F.col("_q") == k, 1)).alias(f"_n{k}") for k in (1, quantiles)] if long_short else []
    daily = rows.groupBy(*by, "datetime").agg(corr(F.col("signal"), F.col("future")).alias("ic"), corr(F.col("_rs"), F.col("_rf")).alias("rank_ic"), F.count(F.lit(1)).alias("n"), *ends)
    mean = lambda k: div(F.sum(f"_s{k}"), F.sum(f"_n{k}"))
    stats = daily.groupBy(*by).agg(F.avg("ic").alias("ic_mean"), F.avg("rank_ic").alias("rank_ic_mean"), F.sum("n").alias("observations"), *([(mean(quantiles) - mean(1)).alias("long_short")] if long_short else []))
    out = grid.join(stats, by, "left")
    out = out.join(top_turnover(rows, "signal", quantiles, by), by, "left") if turnover else out
    return out.select("factor", "direction", "horizon", *metrics, F.coalesce("observations", F.lit(0)).alias("observations"))


def member_diagnostics(df: DataFrame, members: Sequence[Mapping[str, object]], horizons: Sequence[int] = (20,), quantiles: int = 5) -> DataFrame:
    """A row per active member of a combination that df has: rank IC, long-short return and observations at each horizon, beside its family, role and concerns.

    members: name, and if not as usual family (its name), source, direction (1), weight (1) and active (True).
    """
    used = [m for m in members if m.get("active", True) and m["name"] in df.columns]
    names = [(str(m["name"]), str(m.get("family") or m["name"]), "combo_recent_formal", f"recent_formal_raw_ic_ls; source={m.get('source', 'market')}; direction={m.get('direction', 1)}; weight={float(m.get('weight', 1)):g}") for m in used]
    shown = df.sparkSession.createDataFrame(names, "factor string, family string, suggested_role string, concerns string")
    stats = evaluate_many(df, {str(m["name"]): (str(m["name"]), int(m.get("direction", 1))) for m in used}, horizons, quantiles, turnover=False, long_short=True)
    wide = [F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{to}_h{h}") for h in horizons for c, to in (("rank_ic_mean", "neutral_rank_ic"), ("long_short", "neutral_long_short"), ("observations", "observations"))]
    return shown.join(stats.groupBy("factor").agg(*wide), "factor")
