"""Event trades: forward paths, independent and greedy non-overlapping trades, summaries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div, first_rank, group_count
from ..functions.series import series

BUCKETS = ((0.70, 0.85), (0.85, 0.95), (0.70, 0.95), (0.95, 1.0))


def bucket_label(low: float, high: float) -> str:
    """p70_p85 and the like; percentages are cut, not rounded."""
    return f"p{int(low * 100):02d}_p{int(high * 100):02d}"


def in_bucket(share: Column, low: float, high: float) -> Column:
    """[low, high), and [low, high] for a bucket that ends at 1."""
    return (share >= low) & ((share <= high) if high >= 1 else (share < high))


def score_share(df: DataFrame, signal: str, direction: int = 1, date: str = "datetime", by: Sequence[str] = ()) -> DataFrame:
    """rank_signal, its percentile in the date (ties by instrument), and each row's number in its series; apart for each value of `by`."""
    df = df.where(F.col(signal).isNotNull() & F.col("close").isNotNull()).withColumn("rank_signal", F.col(signal) * direction)
    df = df.withColumn("score_pct", first_rank(F.col("rank_signal"), "instrument", *by, date) / group_count(F.col("rank_signal"), *by, date))
    return df.withColumn("bar", F.row_number().over(_series(by, date)))


def _series(by: Sequence[str], date: str):
    return Window.partitionBy(*by, "instrument").orderBy(date) if by else series(at=date)


def forward_paths(df: DataFrame, horizons: Sequence[int], entry: str | None = "open", delay: int = 0, date: str = "datetime", by: Sequence[str] = (), only: Column | None = None) -> DataFrame:
    """A row per row of df (where `only`) and horizon: entry at the bar after `delay` more, exit at the close `horizon` bars after the delay, best and worst price between. Paths beyond the data are left out.

    entry None: entered at the row's own close. All horizons share one window over the series; the rows are stacked after it.
    """
    w, names = _series(by, date), df.columns
    if entry is None:
        at = {"entry_date": F.col(date), "entry_price": F.col("close")}
    else:
        at = {"entry_date": F.lead(date, delay + 1).over(w), "entry_price": F.lead(entry, delay + 1).over(w)}
    ends = {}
    for h in horizons:
        ahead = w.rowsBetween(delay + 1, delay + h)
        ends |= {f"_d{h}": F.lead(date, delay + h).over(w), f"_c{h}": F.lead("close", delay + h).over(w), f"_h{h}": F.max("high").over(ahead), f"_l{h}": F.min("low").over(ahead)}
    df = df.withColumns(at | ends)
    df = df.where(only) if only is not None else df
    paths = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_d{h}").alias("exit_date"), F.col(f"_c{h}").alias("exit_price"), F.col(f"_h{h}").alias("_hi"), F.col(f"_l{h}").alias("_lo")) for h in horizons])
    rows = df.select(*[F.col(f"`{c}`") for c in names if c not in at], *at, F.inline(F.filter(paths, lambda p: p["exit_date"].isNotNull())))
    rows = rows.withColumns({"return": div(F.col("exit_price"), F.col("entry_price")) - 1, "mfe": div(F.col("_hi"), F.col("entry_price")) - 1, "mae": div(F.col("_lo"), F.col("entry_price")) - 1})
    return rows.drop("_hi", "_lo")


def independent_trades(df: DataFrame, horizons: Sequence[int], threshold: float = 0.5, date: str = "datetime", by: Sequence[str] = ()) -> DataFrame:
    """Every row with a signal over the threshold is a trade; trades may overlap. Rows whose exit lies beyond the data are none."""
    return forward_paths(df, horizons, date=date, by=by, only=F.col("rank_signal") > threshold)


def greedy(df: DataFrame, keys: Sequence[str], bar: str = "bar", until: str = "exit_bar") -> DataFrame:
    """Rows kept by a scan of each group in the order of `bar`: a row is kept if it starts after the last kept one's end.

    Rows are placed and sorted by group, and stream through; a task holds one end, whatever the length of a group.
    """
    where = [df.columns.index(c) for c in (*keys, bar, until)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, end = None, -1
        for batch in batches:
            keep = []
            for *key, begin, last in zip(*(batch.column(i).to_pylist() for i in where), strict=True):
                if key != group:
                    group, end = key, -1
                kept = begin > end
                end = last if kept else end
                keep.append(kept)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.repartition(*keys).sortWithinPartitions(*keys, bar, until).mapInArrow(run, df.schema)


def with_buckets(df: DataFrame, pairs: Sequence[tuple[float, float]]) -> DataFrame:
    """A row for each bucket that the row's score_pct is in, with the bucket's name."""
    known = F.array(*[F.when(in_bucket(F.col("score_pct"), a, b), bucket_label(a, b)) for a, b in pairs])
    return df.withColumn("bucket", F.explode(F.array_compact(known)))


def bucket_trades(df: DataFrame, horizons: Sequence[int], pairs: Sequence[tuple[float, float]] = BUCKETS, date: str = "datetime", by: Sequence[str] = ()) -> DataFrame:
    """Per horizon, bucket and instrument: non-overlapping trades of the rows in the bucket; expects score_share columns."""
    any_ = F.lit(False)
    for a, b in pairs:
        any_ = any_ | in_bucket(F.col("score_pct"), a, b)
    rows = forward_paths(df, horizons, date=date, by=by, only=any_).withColumn("exit_bar", F.col("bar") + F.col("horizon"))
    return greedy(with_buckets(rows, pairs), [*by, "horizon", "bucket", "instrument"])


def two_stage_trades(df: DataFrame, setup: tuple[float, float], horizons: Sequence[int], delay: int = 3, min_share: float | None = None, min_score: float | None = None, date: str = "datetime") -> DataFrame:
    """A bucket hit of `score_pct` that `confirm` (share confirm_pct) backs `delay` bars later; entry the bar after; exit delay + h bars after the setup."""
    w = series(at=date)
    df = df.withColumns({"_cp": F.lead("confirm_pct", delay).over(w), "_cs": F.lead("confirm", delay).over(w)})
    ok = in_bucket(F.col("score_pct"), *setup)
    if min_share is not None:
        ok = ok & (F.col("_cp") >= min_share)
    if min_score is not None:
        ok = ok & (F.col("_cs") >= min_score)
    rows = forward_paths(df, horizons, delay=delay, date=date, only=ok).drop("_cp", "_cs").withColumns({"exit_bar": F.col("bar") + delay + F.col("horizon"), "bucket": F.lit(bucket_label(*setup))})
    return greedy(rows, ["horizon", "bucket", "instrument"])


def stacked(df: DataFrame, factors: Mapping[str, tuple[int, str] | int], columns: Sequence[str] = ("open", "high", "low", "close", "volume"), date: str = "datetime") -> DataFrame:
    """A row per bar and factor that has a value: factor, trade_side, score and rank_signal (the score by the factor's direction). The bars are read once for all factors."""
    specs = {n: (s if isinstance(s, tuple) else (s, "independent")) for n, s in factors.items()}
    rows = F.array(*[F.struct(F.lit(n).alias("factor"), F.lit(side).alias("trade_side"), F.col(n).cast("double").alias("score"), (F.col(n) * way).cast("double").alias("rank_signal")) for n, (way, side) in specs.items()])
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.where(whole).select(date, "instrument", *columns, F.inline(F.filter(rows, lambda r: r["score"].isNotNull())))


def event_lane(df: DataFrame, factors: Mapping[str, tuple[int, str] | int], horizons: Sequence[int] = (5, 20), pairs: Sequence[tuple[float, float]] = ((0.85, 0.95), (0.95, 1.0)), date: str = "datetime") -> DataFrame:
    """Bucket trades of every factor by its own percentiles and over its own bars, in one pass."""
    rows = score_share(stacked(df, factors, date=date), "rank_signal", 1, date, ["factor"])
    return bucket_trades(rows, horizons, pairs, date, ["factor"])


def lane_report(summary: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """One row: the lane's status and its metrics at the focus horizon (20, or the longest): means over the factors' highest buckets if any has trades, else over all buckets; the count is cut to a whole number."""
    focus = 20 if 20 in horizons else max(horizons)
    at = summary.where(F.col("horizon") == focus)
    high = F.col("bucket") == "p95_p100"
    mean = lambda c: F.coalesce(F.avg(F.when(high, F.col(c))), F.avg(F.when(F.col("_none"), F.col(c))))
    at = at.crossJoin(at.agg((F.count_if(high) == 0).alias("_none")))  # one row
    one = at.agg(mean("mean_return").alias("primary_metric"), F.coalesce(F.floor(mean("trades")), F.lit(0)).cast("long").alias("trade_count"))
    return one.select(F.lit(focus).alias("horizon"), F.when(F.col("trade_count") > 0, "review").otherwise("discard_candidate").alias("status"), F.when(F.col("trade_count") > 0, "").otherwise("no event trades").alias("decision_reason"), "primary_metric", "trade_count")


def independent_by_universe(df: DataFrame, factors: Mapping[str, tuple[int, str] | int], members: DataFrame, horizons: Sequence[int], threshold: float = 0.5, start: Column | None = None, end: Column | None = None, date: str = "datetime") -> DataFrame:
    """Independent trades of every factor in every universe, in one pass over the members' bars: a trade is found once and stacked for the universes that its instrument is in.

    members has universe and instrument. Signals before `start` or after `end` are left out; paths may run beyond.
    """
    sets = members.groupBy("instrument").agg(F.sort_array(F.collect_set("universe")).alias("_universes"))
    rows = stacked(df, factors, date=date).join(sets, "instrument")
    ok = F.col("rank_signal") > threshold
    ok = ok if start is None else ok & (F.col(date) >= start)
    ok = ok if end is None else ok & (F.col(date) <= end)
    found = forward_paths(rows, horizons, date=date, by=["factor"], only=ok)
    return found.select(F.explode("_universes").alias("universe"), "factor", "trade_side", "horizon", "instrument", F.col(date).alias("signal_date"), "entry_date", "exit_date", "score", "rank_signal", F.col("entry_price").alias("entry_open"), F.col("exit_price").alias("exit_close"), "return", "mfe", "mae")


def summarize(trades: DataFrame, by: Sequence[str], no_loss_infinite: bool = False) -> DataFrame:
    """Counts, return statistics, win rate, mean win and loss (0 if none), payoff, excursions.

    payoff without losses: infinite if there is a win, else 0; with no_loss_infinite always infinite.
    """
    r = F.col("return")
    win, loss = F.avg(F.when(r > 0, r)), F.avg(F.when(r <= 0, r))
    out = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(r).alias("mean_return"), F.median(r).alias("median_return"), F.avg((r > 0).cast("double")).alias("win_rate"),
        F.coalesce(win, F.lit(0.0)).alias("avg_win"), F.coalesce(loss, F.lit(0.0)).alias("avg_loss"), F.avg("mfe").alias("mfe_mean"), F.median("mfe").alias("mfe_median"), F.avg("mae").alias("mae_mean"), F.median("mae").alias("mae_median"),
    )
    payoff = F.when(F.col("avg_loss") != 0, div(F.col("avg_win"), F.abs("avg_loss"))).when(F.lit(no_loss_infinite) | (F.col("avg_win") > 0), float("inf")).otherwise(0.0)
    expectancy = F.col("win_rate") * F.col("avg_win") + (1 - F.col("win_rate")) * F.col("avg_loss")
    return out.withColumn("payoff", payoff).withColumn("expectancy", expectancy)


def bucket_evaluation(df: DataFrame, signal: str, horizons: Sequence[int], pairs: Sequence[tuple[float, float]] = BUCKETS, date: str = "datetime") -> DataFrame:
    """Undirected buckets without cooldown, returns from the signal's close; a row for every horizon and bucket."""
    rows = forward_paths(score_share(df, signal, 1, date), horizons, entry=None, date=date).where("return is not null")
    found = summarize(with_buckets(rows, pairs), ["horizon", "bucket"], no_loss_infinite=True)
    grid = df.sparkSession.createDataFrame([(h, bucket_label(*p)) for h in horizons for p in pairs], "horizon int, bucket string")
    return grid.join(found, ["horizon", "bucket"], "left").withColumn("trades", F.coalesce("trades", F.lit(0)))


def annotate_regime(trades: DataFrame, regime: DataFrame, date: str = "signal_date") -> DataFrame:
    r = regime.select(F.col("datetime").alias(date), F.col("regime").alias("market_regime"))
    return trades.join(r, date, "left").withColumn("market_regime", F.coalesce("market_regime", F.lit("unknown")))
