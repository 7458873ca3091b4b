"""What the desk looks at: layers of a portfolio, health of data domains, strategy ideas, returns of what was priced twice, the liquidity panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import div, true_if
from ..functions.series import with_factors

#: The liquidity panel's columns, and how far a strategy transfers.
LIQUIDITY = {
    "close": "$close", "prev_close": "Ref($close, 1)", "open": "$open", "high": "$high", "low": "$low", "amount": "$amount", "volume": "$volume", "turnover": "$turnover", "amount_20d": "Mean($amount, 20)", "turnover_20d": "Mean($turnover, 20)",
}
TRANSFER = {"low": 1, "medium": 2, "mid": 2, "high": 3}


def liquidity_scan(bars: DataFrame, start: Column, end: Column, date: str = "datetime") -> DataFrame:
    """The ten liquidity columns of each bar of a span; windows reach back before it. Bars need turnover beside their prices, amount and volume."""
    names = {f"_{c}": text for c, text in LIQUIDITY.items()}
    panel = with_factors(bars, names).where((F.col(date) >= start) & (F.col(date) <= end))
    return panel.select(date, "instrument", *[F.col(f"_{c}").alias(c) for c in LIQUIDITY])


def common_return(now: DataFrame, following: DataFrame, price: str = "close") -> DataFrame:
    """One row: instruments priced on both dates and their mean return, 0 without any."""
    both = now.select("instrument", F.col(price).alias("_a")).join(following.select("instrument", F.col(price).alias("_b")), "instrument")
    return both.agg(F.count(F.lit(1)).alias("instruments"), F.coalesce(F.avg(div(F.col("_b"), F.col("_a")) - 1), F.lit(0.0)).alias("market_return"))


def layers(research: DataFrame, execution: DataFrame) -> DataFrame:
    """Each name of either layer with its ranks and weights, the difference, and whether execution removed, added, scaled or kept it; the execution's score and flags."""

    def side(df: DataFrame, layer: str) -> DataFrame:
        pick = lambda c, kind: (F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind))
        return df.select("instrument", pick("rank", "long").alias(f"{layer}_rank"), pick("target_weight", "double").alias(f"{layer}_weight"), pick("ensemble_score", "double").alias(f"_{layer}_score"), pick("risk_flags", "string").alias(f"_{layer}_flags"))

    both = side(research, "research").join(side(execution, "execution"), "instrument", "full")
    both = both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("research_weight", "execution_weight")}).withColumn("weight_delta", F.col("execution_weight") - F.col("research_weight"))
    a, b = F.col("research_weight") > 0, F.col("execution_weight") > 0
    action = F.when(a & ~b, "removed").when(~a & b, "added").when(F.abs("weight_delta") > 1e-9, "scaled").otherwise("unchanged")
    score = F.col("_execution_score") if "ensemble_score" in execution.columns else F.col("_research_score")
    return both.select("instrument", "research_rank", "execution_rank", "research_weight", "execution_weight", "weight_delta", action.alias("action"), score.alias("ensemble_score"), F.coalesce("_execution_flags", F.lit("")).alias("risk_flags"))


def layer_cards(detail: DataFrame) -> DataFrame:
    """One row: positions and gross weights of both layers, and how many names were removed and scaled. A name without weight and rank in a layer isn't in it."""
    held = lambda layer: F.count_if((F.col(f"{layer}_weight") != 0) | F.col(f"{layer}_rank").isNotNull())
    gross = lambda layer: F.coalesce(F.sum(f"{layer}_weight"), F.lit(0.0))
    one = detail.agg(held("research").alias("research_positions"), held("execution").alias("execution_positions"), gross("research").alias("research_gross_weight"), gross("execution").alias("execution_gross_weight"), F.count_if(F.col("action") == "removed").alias("removed_positions"), F.count_if(F.col("action") == "scaled").alias("scaled_positions"))
    return one.withColumn("weight_delta", F.col("execution_gross_weight") - F.col("research_gross_weight"))


def transfer_rank(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TRANSFER.items() for x in kv]), F.lower(c)), F.lit(0))


def strategy_entries(entries: DataFrame, lane: str | None = None, family: str | None = None, least: str | None = None) -> DataFrame:
    """Entries of a lane and a family that transfer at least so far; a filter that isn't given passes all."""
    for c, value in (("candidate_lane", lane), ("strategy_family", family)):
        entries = entries.where(F.col(c) == value) if value else entries
    return entries.where(transfer_rank(F.col("transferability")) >= TRANSFER.get(least.lower(), 0)) if least else entries


def strategy_ideas(entries: DataFrame, members: DataFrame, limit: int = 10, lane: str | None = None) -> DataFrame:
    """The first ideas: of families that the combination (members: strategy_family, a row a member) has least of, then those that transfer furthest, then by id; with the reason."""
    counts = members.groupBy("strategy_family").agg(F.count(F.lit(1)).alias("present"))
    df = strategy_entries(entries, lane).join(counts, "strategy_family", "left").withColumn("present", F.coalesce("present", F.lit(0)))
    reason = F.when(F.col("present") == 0, F.concat(F.lit("missing family: "), "strategy_family")).otherwise(F.concat(F.lit("family already present "), F.col("present").cast("string"), F.lit(" time(s); use as variant or benchmark")))
    return df.withColumn("reason", reason).orderBy("present", F.desc(transfer_rank(F.col("transferability"))), "strategy_id").limit(limit).drop("present")


def domain_health(report: DataFrame, dated: DataFrame) -> DataFrame:
    """The governance report's rows with shares in per cent and each domain's latest date. dated: domain, latest_date."""
    percent = lambda c: F.round(F.col(c) * 100, 3)
    rows = report.join(dated.select("domain", "latest_date"), "domain", "left")
    return rows.select("domain", "activation_lane", "status", "activation_status", percent("coverage_ratio").alias("coverage_pct"), percent("pit_field_completeness").alias("pit_pct"), "freshness_status", "rows", "latest_date", "detail")


def health_cards(rows: DataFrame, liquidity: DataFrame, emotion: DataFrame) -> DataFrame:
    """One row: domains by state, the liquidity table's blocked and suspended rows and median amount, and the emotion table's means on its last date."""
    own = rows.agg(F.count(F.lit(1)).alias("domains"), F.count_if(F.col("activation_status") == "active").alias("active"), F.count_if(F.col("activation_status") == "shadow").alias("shadow"), F.count_if(F.col("status") == "fail").alias("failed"))
    liquid = liquidity.agg(F.count(F.lit(1)).alias("liquidity_rows"), F.count_if(true_if(F.col("buy_blocked"), "blocked")).alias("buy_blocked"), F.count_if(true_if(F.col("suspended"), "blocked")).alias("suspended"), F.median("amount_20d").alias("median_amount_20d"))
    by_day = emotion.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.avg("emotion_score").alias("s"), F.max("limit_up_count").alias("l"), F.avg("up_ratio").alias("u"))
    last = F.struct("trade_date", "s", "l", "u")
    felt = by_day.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("emotion_rows"), F.max(last).alias("_m")).select("emotion_rows", F.col("_m.s").alias("mean_emotion_score"), F.coalesce(F.col("_m.l"), F.lit(0)).alias("latest_limit_up_count"), F.col("_m.u").alias("latest_up_ratio"))
    return own.crossJoin(liquid).crossJoin(felt)  # one row each
