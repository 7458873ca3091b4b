"""Themes: their members against the daily signal, filled up from other providers, scored, tiered and ranked."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import div, true_if
from ..sources.shared import scratch

# The columns of each component, its weight in the total, statuses, tiers and their words.
COMPONENTS: dict[str, tuple[str, ...]] = {
    "quality_score": (
        "family_quality_score", "logic_fundamental_quality_score", "family_cashflow_quality_score", "fundamental_roe_contribution", "fundamental_roic_contribution", "fundamental_cfo_to_ni_contribution",
        "fundamental_low_debt_contribution", "cashflow_quality_contribution",
    ),
    "growth_score": (
        "family_growth_improvement_score", "logic_fundamental_growth_score", "fundamental_revenue_growth_change_contribution", "fundamental_profit_growth_change_contribution", "fundamental_margin_change_contribution",
        "growth_improvement_contribution",
    ),
    "momentum_score": ("logic_reversal_repair_score", "family_quiet_breakout_score", "quiet_breakout_20_contribution", "ensemble_score"),
    "event_score": ("family_event_catalyst_score", "logic_financial_disclosure_score", "financial_disclosure_event_score_90d_contribution", "financial_disclosure_net_intensity_score_90d_contribution"),
}
WEIGHTS = {"theme_score": 0.30, "quality_score": 0.20, "growth_score": 0.20, "momentum_score": 0.15, "event_score": 0.10, "risk_penalty": -0.15}
STATUSES = ("research_candidate", "watch_only", "risk_review")
TIERS = ("A重点研究", "B观察跟踪", "C风险复核")
ADVICE = ("主题相关性和当前信号同时靠前", "进入观察池，等待信号或证据增强", "事件/交易风险需先核查")
DRIVERS, ROLE, TYPE = "驱动: ", "AI产业链", "research_candidate_not_advice"
SHOWN = (
    "date", "instrument", "name", "supply_chain_role", "sub_chain", "theme_id", "theme_display_name", "theme_as_of_date", "theme_exposure", "confidence", "ensemble_score", "theme_signal_score", "theme_exposure_score",
    "theme_research_score", "theme_score", "quality_score", "growth_score", "momentum_score", "event_score", "risk_penalty", "total_score", "tier", "reason", "research_status", "recommendation_type", "risk_flags",
    "event_blocked", "amount_20d", "industry", "notes",
)


def _false(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("0", "false", "no", "n"), F.lit(False))


def _text(df: DataFrame, c: str) -> Column:
    return F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in df.columns else F.lit("")


def research_status(df: DataFrame) -> Column:
    """risk_review for blocked or not tradable names, watch_only without a score, else research_candidate."""
    blocked = F.lit(False)
    for c in ("event_blocked", "buy_blocked"):
        blocked = blocked | true_if(F.col(c), "blocked") if c in df.columns else blocked
    blocked = blocked | _false(F.col("tradable")) if "tradable" in df.columns else blocked
    return F.when(blocked, STATUSES[2]).when(F.col("ensemble_score").isNull(), STATUSES[1]).otherwise(STATUSES[0])


def risk_penalty(df: DataFrame) -> Column:
    """Parts for the status, risk flags, risk events and their worst severity added up, 1 at most."""
    status, severity = F.col("research_status"), _text(df, "max_event_severity")
    parts = (
        F.when(status == STATUSES[2], 1.0).when(status == STATUSES[1], 0.35).otherwise(0.0), F.when(_text(df, "risk_flags").rlike("risk|blocked"), 0.35).otherwise(0.0),
        F.when((_text(df, "risk_event_summary") != "") | (_text(df, "risk_event_types") != ""), 0.25).otherwise(0.0), F.when(severity.isin("block", "blocked", "high"), 0.5).when(severity.isin("risk", "watch"), 0.2).otherwise(0.0),
    )
    total = F.lit(0.0)
    for p in parts:
        total = total + p
    return F.least(F.lit(1.0), total)


def theme_table(signal: DataFrame, members: DataFrame, top_k: int = 30, theme: Mapping[str, str] | None = None, signal_weight: float = 0.7, theme_weight: float = 0.3) -> DataFrame:
    """The best members of a theme: scores, status, penalty, tier and reason. members has instrument and, if known, theme_exposure (1 where missing) and roles.

    Scores are scaled by the least and greatest value over the members, which one aggregate row brings to all; a component is the mean of its columns that the
    signal has (0 without any). Best: by tier, then total, research score and exposure, then instrument. Columns that neither side has are left out.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    own = members.withColumn("instrument", F.trim("instrument"))
    own = own.withColumn("theme_exposure", F.coalesce(F.col("theme_exposure").cast("string").try_cast("double"), F.lit(1.0)) if "theme_exposure" in own.columns else F.lit(1.0))
    extra = [F.col(c) for c in signal.columns if c not in own.columns]
    df = own.join(signal.select(F.trim("instrument").alias("instrument"), *extra), "instrument", "left")
    df = df.withColumn("ensemble_score", F.col("ensemble_score").cast("string").try_cast("double") if "ensemble_score" in df.columns else F.lit(None).cast("double"))
    used = {k: [c for c in v if c in df.columns] for k, v in COMPONENTS.items()}
    scaled = list(dict.fromkeys(["ensemble_score", "theme_exposure", *(c for v in used.values() for c in v)]))
    df = df.withColumns({f"_v_{c}": F.col(c).cast("double") for c in scaled})
    ends = df.agg(*[f(f"_v_{c}").alias(f"_{n}_{c}") for c in scaled for n, f in (("a", F.min), ("z", F.max))])
    df = df.crossJoin(F.broadcast(ends))  # one row

    def score(c: str) -> Column:
        v, a, z = (F.col(f"_{n}_{c}") for n in "vaz")
        return F.when(v.isNull(), 0.0).when(z == a, 1.0).otherwise(div(v - a, z - a))

    def mean(columns: Sequence[str]) -> Column:
        total = F.lit(0.0)
        for c in columns:
            total = total + score(c)
        return total / len(columns) if columns else total

    df = df.withColumns({"theme_signal_score": score("ensemble_score"), "theme_exposure_score": score("theme_exposure")} | {k: mean(v) for k, v in used.items()})
    df = df.withColumns({"theme_score": F.col("theme_exposure_score"), "research_status": research_status(df)})
    review = F.col("research_status") == STATUSES[2]
    df = df.withColumn("theme_research_score", (signal_weight * F.col("theme_signal_score") + theme_weight * F.col("theme_exposure_score")) * F.when(review, 0.25).otherwise(1.0))
    df = df.withColumn("risk_penalty", risk_penalty(df))
    total = F.lit(0.0)
    for c, w in WEIGHTS.items():
        total = total + w * F.col(c)
    df = df.withColumn("total_score", F.greatest(F.lit(0.0), total))
    tier = F.when(review | (F.col("risk_penalty") >= 0.8), 2).when((F.col("total_score") >= 0.58) & (F.col("research_status") == STATUSES[0]), 0).otherwise(1)
    pick = lambda words: F.get(F.array(*[F.lit(w) for w in words]), F.col("_tier"))
    filled = lambda *names: F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in names if c in df.columns], F.lit(ROLE))
    factors = F.array_compact(F.array(*[F.when(~F.lower(F.trim(F.col(c))).isin("", "nan"), F.trim(F.col(c))) for c in ("top_factor_1", "top_factor_2") if c in df.columns])) if "top_factor_1" in df.columns else F.array().cast("array<string>")
    driven = F.when(F.size(factors) > 0, F.concat(F.lit(DRIVERS), F.array_join(factors, " / ")))
    df = df.withColumn("_tier", tier).withColumns({"tier": pick(TIERS), "recommendation_type": F.lit(TYPE), **{f"theme_{k}": F.lit(v) for k, v in (theme or {}).items()}})
    df = df.withColumn("reason", F.concat_ws("；", filled("supply_chain_role", "sub_chain"), driven, pick(ADVICE)))
    best = df.orderBy("_tier", F.desc("total_score"), F.desc("theme_research_score"), F.desc("theme_exposure"), "instrument").limit(top_k)
    return best.select(*[c for c in SHOWN if c in df.columns])


def back_fill(signal: DataFrame, members: DataFrame, providers: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """signal and rows for the members that it lacks, from the first provider that has them.

    A provider gets the names still missing as a table and gives signal rows; it should semi-join its source with the
    names, so that only theirs are computed. Each provider's rows, members' at most, are written to the shared folder, and nothing is asked for once all are found.
    """
    name = F.trim("instrument").alias("instrument")
    missing = members.select(name).where("instrument <> ''").distinct().join(signal.select(name).distinct(), "instrument", "left_anti")
    spark = signal.sparkSession
    for provider in providers:
        if missing.isEmpty():
            break
        path = scratch(spark, "filled")
        found = provider(missing)
        found.withColumn("instrument", F.trim("instrument")).join(missing, "instrument", "left_semi").write.parquet(path)
        filled = spark.read.schema(found.schema).parquet(path)
        signal = signal.unionByName(filled, allowMissingColumns=True)
        missing = missing.join(filled.select("instrument").distinct(), "instrument", "left_anti")
    return signal
