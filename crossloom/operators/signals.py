"""From exposures to an explainable signal, a target portfolio, orders, fills and their books."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, div, true_if, true_unless, z_sample


@dataclass(frozen=True)
class Factor:
    name: str
    direction: int = 1
    family: str = ""
    logic: str = ""
    status: str = "core"
    regime_profile: str = "all_weather"


@dataclass(frozen=True)
class SignalRules:
    """Default weights are fixed values."""

    regime: str = "sideways"
    status_weight: dict[str, float] = field(default_factory=lambda: {"core": 1.0, "challenger": 0.5, "data_gated": 1.0, "guardrail": 1.0, "reserve": 0.0, "shadow": 0.0, "watch": 0.0, "regime_only": 0.25})
    regime_weight: dict[str, dict[str, float]] = field(default_factory=lambda: {"down_sideways": {"down": 1.0, "sideways": 1.0, "up": 0.0}, "all_weather": {"down": 1.0, "sideways": 1.0, "up": 1.0}})
    family_weight: dict[str, float] = field(default_factory=dict)
    family_cap: float | None = 0.35
    factor_cap: float | None = 3.0
    family_first: bool = True
    rule_weight: float = 1.0
    model_weight: float = 0.0

    def weight(self, f: Factor) -> float:
        return self.status_weight.get(f.status, 0.0) * self.regime_weight.get(f.regime_profile, {}).get(self.regime, 1.0)


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def build_signal(df: DataFrame, factors: Sequence[Factor], rules: SignalRules, date: str = "date") -> DataFrame:
    """Contributions (z-score in the date x direction x weight, capped), family and logic scores, rule and ensemble score, the two largest contributions, risk flags.

    A factor whose column is missing contributes 0 and is not active.
    """
    cap = rules.factor_cap
    families: dict[str, list[str]] = {}
    logics: dict[str, list[str]] = {}
    df = df.withColumn("tradable", true_unless(F.col("tradable")) if "tradable" in df.columns else F.lit(True))
    df = df.withColumn("model_score", F.col("model_score").cast("double") if "model_score" in df.columns else F.lit(0.0))
    names = []
    for f in factors:
        name = f"{f.name}_contribution"
        names.append(name)
        if f.name not in df.columns:
            df = df.withColumn(name, F.lit(0.0))
            continue
        weight = rules.weight(f)
        if weight:
            families.setdefault(f.family or f.name, []).append(name)
            logics.setdefault(f.logic or logic_bucket(f.family or f.name), []).append(name)
        made = z_sample(F.col(f.name).cast("double") * f.direction, date) * weight
        df = df.withColumn(name, clip(made, -abs(cap), abs(cap)) if cap is not None else made)
    scores = []
    if rules.family_first:
        for family, members in families.items():
            score = total([F.col(m) for m in members]) / len(members) * rules.family_weight.get(family, 1.0)
            scores.append(f"family_{slug(family)}_score")
            df = df.withColumn(scores[-1], clip(score, -abs(rules.family_cap), abs(rules.family_cap)) if rules.family_cap is not None else score)
        for logic, members in logics.items():
            df = df.withColumn(f"logic_{slug(logic)}_score", total([F.col(m) for m in members]) / len(members))
        rule = total([F.col(s) for s in scores])
    else:
        rule = total([F.col(n) for n in names])
    df = df.withColumn("rule_score", rule).withColumn("ensemble_score", F.col("rule_score") * rules.rule_weight + F.col("model_score") * rules.model_weight)
    parts = F.array(*[F.struct((-F.abs(F.col(n))).alias("by"), F.lit(n.removesuffix("_contribution")).alias("factor"), F.col(n).alias("value")) for n in names])
    top = F.array_sort(F.filter(parts, lambda x: x["by"] < 0))
    for k in (1, 2):
        df = df.withColumn(f"top_factor_{k}", F.coalesce(F.get(top, F.lit(k - 1))["factor"], F.lit(""))).withColumn(f"top_factor_{k}_contribution", F.coalesce(F.get(top, F.lit(k - 1))["value"], F.lit(0.0)))
    gated = F.lit(None) if families else F.lit("regime_gated")
    return df.withColumn("risk_flags", F.concat_ws(";", F.when(~F.col("tradable"), "not_tradable"), gated.cast("string")))


def slug(text: str) -> str:
    """Lower case, everything but letters and digits an underscore, none at the ends."""
    return "".join(ch if ch.isalnum() else "_" for ch in text).strip("_").lower() or "unknown"


#: A family belongs to the first bucket one of whose words it contains.
LOGIC = (
    ("reversal_repair", ("reversal", "repair", "washout", "discount", "divergence", "convergence")),
    ("liquidity_quality", ("liquidity", "turnover", "volume_dry", "amount_shock")),
    ("risk_structure", ("volatility", "excursion", "drawdown", "downside", "gap")),
    ("trend_following", ("momentum", "trend", "relative_strength")),
    ("emotion_atmosphere", ("emotion", "crowding", "breadth", "limit_pressure", "heat", "panic", "mood")),
    ("fundamental_quality", ("value", "quality", "growth", "earnings", "roe", "profit")),
    ("shareholder_capital", ("holder", "buyback", "pledge", "unlock", "capital", "shareholder")),
)


def logic_bucket(family: str) -> str:
    low = family.strip().lower()
    return next((name for name, words in LOGIC if any(w in low for w in words)), slug(low or "unknown"))


def override_from_calendar(df: DataFrame, calendar: DataFrame, flags: Sequence[str], keys: Sequence[str] = ("date", "instrument")) -> DataFrame:
    """Where the calendar has a value for the row, it wins."""
    c = calendar.select(*keys, *[F.col(f).alias(f"_{f}") for f in flags])
    df = df.join(c, [*keys], "left")
    return df.withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) if f in df.columns else F.col(f"_{f}") for f in flags}).drop(*[f"_{f}" for f in flags])


def tradability(df: DataFrame, least_amount: float | None = None, blocking: Sequence[str] = ("not_tradable", "regime_gated")) -> DataFrame:
    """eligible, and reject_reasons: distinct, in order, joined by ';'."""
    flags = F.filter(F.split(F.coalesce("risk_flags", F.lit("")), ";"), lambda x: x.isin(*blocking))
    reasons = F.array(F.when(~F.col("tradable"), "not_tradable"))
    reasons = F.concat(reasons, F.transform(flags, lambda x: F.concat(F.lit("risk_flag:"), x)))
    if least_amount is not None:
        amount = F.col("amount_20d") if "amount_20d" in df.columns else F.lit(None).cast("double")
        reasons = F.concat(reasons, F.array(F.when(amount.isNull(), "missing_liquidity").when(amount < least_amount, "low_liquidity")))
    found = F.array_distinct(F.array_compact(reasons))
    return df.withColumn("eligible", F.size(found) == 0).withColumn("reject_reasons", F.concat_ws(";", found))


def select_top(df: DataFrame, score: str, k: int, dropout_rank: int | None = None, max_new: int | None = None, date: str = "date") -> DataFrame:
    """k rows per date. With `held` (boolean): holdings ranked within dropout_rank stay, then the ranking fills up, with at most max_new that are new.

    When the holdings already fill k, one more name is still taken before the final cut, so it may displace a holding.
    """
    w = Window.partitionBy(date).orderBy(F.desc(score), "instrument")
    df = df.withColumn("rank", F.row_number().over(w))
    if "held" not in df.columns or dropout_rank is None:
        return df.where(F.col("rank") <= k)
    per = Window.partitionBy(date)
    df = df.withColumn("_keep", F.col("held") & (F.col("rank") <= dropout_rank)).withColumn("_kept", F.sum(F.col("_keep").cast("int")).over(per))
    order = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_new", F.sum((~F.col("held")).cast("int")).over(order))
    may = ~F.col("_keep") & (F.col("held") | (F.col("_new") <= (max_new if max_new is not None else k)))
    df = df.withColumn("_may", may).withColumn("_place", F.sum(F.col("_may").cast("int")).over(order))
    chosen = df.where(F.col("_keep") | (F.col("_may") & (F.col("_place") <= F.greatest(F.lit(k) - F.col("_kept"), F.lit(1)))))
    return chosen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_keep", "_kept", "_new", "_may", "_place")


#: Families that count as defensive, and the columns that a signal hands through if it has them.
DEFENSIVE = ("fundamental_quality", "dividend", "low_vol", "low_volatility")
PASSED = ("amount_20d", "last_price", "amount", "volume_20d", "volume", "suspended", "limit_up", "limit_down", "buy_blocked", "sell_blocked")


def passthrough(df: DataFrame) -> list[str]:
    """Which of the columns that are handed through df has, in their order."""
    return [c for c in PASSED if c in df.columns]


def offensive(df: DataFrame, confirm: Sequence[str], most_defensive: float | None = None) -> DataFrame:
    """Rows that one of the columns `confirm` backs with a positive score, and whose positive family scores are not more than `most_defensive` defensive ones. Without any of the columns nothing passes."""
    present = [c for c in confirm if c in df.columns]
    if not present:
        return df.where("false")
    positive = lambda c: F.coalesce(F.greatest(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    df = df.where(total([positive(c) for c in present]) > 0)
    families = [c for c in df.columns if c.startswith("family_") and c.endswith("_score")]
    guarded = [c for c in families if c.removeprefix("family_").removesuffix("_score") in DEFENSIVE]
    if most_defensive is None or not guarded:
        return df
    whole = total([positive(c) for c in families])
    return df.where((whole <= 0) | (div(total([positive(c) for c in guarded]), whole) <= most_defensive))


def target_portfolio(df: DataFrame, score: str = "ensemble_score", k: int = 20, cash: float = 0.05, most: float = 0.08, least_scores: dict[str, float] | None = None, confirm: Sequence[str] = (), confirm_least: float = 0.05, profile: str = "balanced", profile_confirm: Sequence[str] = (), constraints: dict[str, dict[str, float]] | None = None, date: str = "date", **selection) -> DataFrame:
    """Eligible rows past the gates, the best k, equal weights up to `most`. A gate on a missing column lets nothing pass.

    The profile `offensive` filters by offensive(); constraints give, by profile, max_defensive_family_weight and max_single_weight.
    """
    own = (constraints or {}).get(profile, {})
    most = min(most, float(own["max_single_weight"])) if own.get("max_single_weight") is not None else most
    df = df.where("eligible")
    df = offensive(df, profile_confirm, own.get("max_defensive_family_weight")) if profile == "offensive" else df
    for c, least in (least_scores or {}).items():
        df = df.where(F.col(c) >= least) if c in df.columns else df.where(F.lit(False))
    if confirm:
        present = [c for c in confirm if c in df.columns]
        df = df.where(total([F.greatest(F.col(c), F.lit(0.0)) for c in present]) >= confirm_least)
    df = select_top(df, score, k, date=date, **selection)
    n = F.count(F.lit(1)).over(Window.partitionBy(date))
    return df.withColumn("target_weight", F.least((1 - cash) / n, F.lit(most)))


def weight_changes(target: DataFrame, current: DataFrame, left: str = "target_weight", right: str = "current_weight") -> DataFrame:
    """Both sides' weights by instrument (0 where missing) and how they differ: added, removed, scaled, unchanged."""
    both = target.select("instrument", left).join(current.select("instrument", right), "instrument", "full")
    both = both.withColumns({left: F.coalesce(left, F.lit(0.0)), right: F.coalesce(right, F.lit(0.0))}).withColumn("delta_weight", F.col(left) - F.col(right))
    change = F.when((F.col(right) == 0) & (F.col(left) != 0), "added").when((F.col(left) == 0) & (F.col(right) != 0), "removed").when(F.abs("delta_weight") > 1e-9, "scaled").otherwise("unchanged")
    return both.withColumn("change", change)


def orders(target: DataFrame, current: DataFrame, equity: float = 1e6, lot: int = 100, tolerance: float = 1e-6, least_value: float = 0.0) -> DataFrame:
    """Order suggestions: a side per changed weight, value cut to whole lots where there is a price.

    A buy takes the target's price, else the holding's; a sale the other way round.
    """
    price = lambda df, side: df.select("instrument", F.col("price").alias(side)) if "price" in df.columns else df.select("instrument", F.lit(None).cast("double").alias(side))
    df = weight_changes(target, current).join(price(target, "_tp"), "instrument", "left").join(price(current, "_cp"), "instrument", "left")
    df = df.where(F.abs("delta_weight") > tolerance).withColumnRenamed("delta_weight", "requested_delta_weight")
    buy = F.col("requested_delta_weight") > 0
    df = df.withColumn("side", F.when(buy, "BUY").otherwise("SELL")).withColumn("price", F.when(buy, F.coalesce("_tp", "_cp")).otherwise(F.coalesce("_cp", "_tp")))
    df = df.withColumn("requested_order_value", F.abs("requested_delta_weight") * equity)
    priced = F.col("price") > 0
    df = df.withColumn("order_shares", F.when(priced, F.floor(F.col("requested_order_value") / F.col("price") / lot) * lot).cast("double"))
    df = df.withColumn("order_value", F.when(priced, F.col("order_shares") * F.col("price")).otherwise(F.col("requested_order_value")))
    df = df.where(F.col("order_value") >= least_value).withColumn("delta_weight", F.when(F.col("side") == "BUY", 1).otherwise(-1) * F.col("order_value") / equity)
    return df.withColumn("total_equity", F.lit(equity)).withColumn("status", F.lit("suggested")).drop("_tp", "_cp", "change")


def fills(df: DataFrame, ratio: float = 1.0, slippage_bps: float = 5.0, commission_bps: float = 2.0, stamp_bps: float = 10.0, least_value: float = 0.0) -> DataFrame:
    """Simulated fills of orders: slippage against the side, costs, the first reject reason that applies. Missing state columns do not block."""
    ratio = max(0.0, min(1.0, ratio))
    buy = F.col("side") == "BUY"
    has = lambda c, otherwise: true_if(F.col(c)) if c in df.columns else F.lit(otherwise)
    execution = F.col("price") * (1 + F.when(buy, 1).otherwise(-1) * slippage_bps / 10_000)
    df = df.withColumns({"execution_price": execution, "_shares": F.col("order_shares") * ratio})
    df = df.withColumn("_value", F.coalesce(F.col("_shares") * F.col("execution_price"), F.col("order_value") * ratio))
    df = df.withColumn("_cost", F.col("_value") * (commission_bps + F.when(buy, 0.0).otherwise(stamp_bps)) / 10_000)
    ladder = [
        (F.lit(least_value > 0) & (F.col("_value") < least_value), "below_min_trade_value"),
        (~has("tradable", True), "not_tradable"),
        (has("suspended", False), "suspended"),
        (buy & (has("limit_up", False) | has("buy_blocked", False)), "limit_up_buy_blocked"),
        (~buy & (has("limit_down", False) | has("sell_blocked", False)), "limit_down_sell_blocked"),
    ]
    reason = first_failure(ladder)
    ok = reason == ""
    df = df.withColumn("reject_reason", reason if ratio > 0 else F.when(ok, "zero_fill_ratio").otherwise(reason))
    df = df.withColumn("status", F.when(~ok | F.lit(ratio <= 0), "rejected").when(F.lit(ratio >= 1), "filled").otherwise("partial"))
    df = df.withColumns({"fill_value": F.when(ok, F.col("_value")).otherwise(0.0), "fill_shares": F.when(ok, F.col("_shares")).otherwise(0.0), "transaction_cost": F.when(ok, F.col("_cost")).otherwise(0.0)})
    sign = F.when(buy, 1).otherwise(-1)
    df = df.withColumn("fill_delta_weight", sign * div(F.col("fill_value"), F.col("total_equity"))).withColumn("net_cash_effect", -sign * F.col("fill_value") - F.col("transaction_cost"))
    return df.withColumn("fill_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("instrument"))).drop("_shares", "_value", "_cost")


def first_failure(ladder: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first condition that holds, else ''."""
    out = F.lit("")
    for condition, reason in reversed(ladder):
        out = F.when(F.coalesce(condition, F.lit(False)), reason).otherwise(out)
    return out


def apply_fills(positions: DataFrame, filled: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Weights after filled and partial deltas; those within tolerance of 0 are gone."""
    delta = filled.where(F.col("status").isin("filled", "partial")).select("instrument", F.col("fill_delta_weight").alias("current_weight"))
    new = positions.select("instrument", "current_weight").unionByName(delta).groupBy("instrument").agg(F.sum("current_weight").alias("current_weight"))
    return new.where(F.abs("current_weight") > tolerance)


def reconcile(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Differences of two sets of weights; one row `positions_match` if there are none."""
    both = expected.select("instrument", F.col("current_weight").alias("expected")).join(actual.select("instrument", F.col("current_weight").alias("actual")), "instrument", "full")
    check = F.when(F.col("actual").isNull(), "missing_position").when(F.col("expected").isNull(), "unexpected_position").when(F.abs(F.col("expected") - F.col("actual")) > tolerance, "weight_mismatch")
    bad = both.withColumn("check", check).where("check is not null").select("check", "instrument", "expected", "actual")
    none = bad.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("positions_match").alias("check"), F.lit("").alias("instrument"), F.lit(None).cast("double").alias("expected"), F.lit(None).cast("double").alias("actual"))
    return bad.unionByName(none)


def turnover(target: DataFrame, current: DataFrame) -> DataFrame:
    """The sum of absolute weight changes over the union of names."""
    return weight_changes(target, current).agg(F.coalesce(F.sum(F.abs("delta_weight")), F.lit(0.0)).alias("turnover"))


def risk_checks(portfolio: DataFrame, most: float = 0.08, positions: int = 10, industry: str | None = None, most_industry: float = 0.35) -> DataFrame:
    """Rows (check, status, value, threshold) of a portfolio's limits; an empty portfolio fails."""
    one = portfolio.agg(F.coalesce(F.max("target_weight"), F.lit(0.0)).alias("w"), F.count(F.lit(1)).cast("double").alias("n"), F.sum((F.col("target_weight") < 0).cast("double")).alias("neg"))
    row = lambda name, ok, value, limit: F.struct(F.lit(name).alias("check"), F.when(ok, "pass").otherwise("fail").alias("status"), value.cast("double").alias("value"), F.lit(float(limit)).alias("threshold"))
    checks = one.select(F.inline(F.array(
        row("non_empty", F.col("n") > 0, F.col("n"), 1), row("max_single_weight", F.col("w") <= most + 1e-12, F.col("w"), most),
        row("min_positions", F.col("n") >= positions, F.col("n"), positions), row("negative_weights", F.coalesce("neg", F.lit(0.0)) == 0, F.coalesce("neg", F.lit(0.0)), 0),
    )))
    if industry:
        by = portfolio.groupBy(industry).agg(F.sum("target_weight").alias("s")).agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("m"))
        checks = checks.unionByName(by.select(F.inline(F.array(row("max_industry_weight", F.col("m") <= most_industry, F.col("m"), most_industry)))))
    return checks


def replay(targets: DataFrame, closes: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """Per run date: return to the next close date, equal-weight benchmark, excess, and cumulated values. targets: date, instrument, target_weight; closes: date, instrument, close."""
    w = Window.partitionBy("instrument").orderBy("date")
    returns = closes.withColumn("ret", div(F.lead("close").over(w), F.col("close")) - 1)
    bench = returns.groupBy("date").agg(F.avg("ret").alias("benchmark_return"))
    daily = targets.join(returns, ["date", "instrument"], "left").groupBy("date").agg(F.sum(F.col("target_weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.sum("target_weight").alias("invested"))
    daily = daily.join(bench, "date", "left").withColumn("portfolio_return", F.col("gross") - F.col("invested") * cost_bps / 10_000)
    daily = daily.withColumn("benchmark_return", F.coalesce("benchmark_return", F.lit(0.0))).withColumn("excess_return", F.col("portfolio_return") - F.col("benchmark_return"))
    run = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row per date
    return daily.withColumn("nav", F.product(1 + F.col("portfolio_return")).over(run)).withColumn("benchmark_nav", F.product(1 + F.col("benchmark_return")).over(run))


def replay_summary(daily: DataFrame, per_year: int = 252) -> DataFrame:
    """total and annualised return, volatility (divisor n), largest drawdown, win rate."""
    run = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    peak = daily.withColumn("_dd", div(F.col("nav"), F.greatest(F.lit(1.0), F.max("nav").over(run))) - 1)
    out = peak.agg(F.count(F.lit(1)).alias("periods"), (F.product(1 + F.col("portfolio_return")) - 1).alias("total_return"), (F.stddev_pop("portfolio_return") * F.sqrt(F.lit(float(per_year)))).alias("volatility"), F.min("_dd").alias("max_drawdown"), F.avg((F.col("portfolio_return") > 0).cast("double")).alias("win_rate"))
    return out.withColumn("annualised_return", F.pow(1 + F.col("total_return"), F.lit(float(per_year)) / F.col("periods")) - 1)


def monthly(daily: DataFrame, c: str = "portfolio_return", date: str = "date") -> DataFrame:
    return daily.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg((F.product(1 + F.col(c)) - 1).alias("return"), F.count(F.lit(1)).alias("periods"))


def exposure(portfolio: DataFrame, prefix: str = "family_", weight: str = "target_weight") -> DataFrame:
    """Weighted exposure per score column of that prefix: sum, absolute sum, share of the absolute total."""
    names = [c for c in portfolio.columns if c.startswith(prefix) and c.endswith("_score")]
    long = portfolio.select(F.col(weight).alias("_w"), F.inline(F.array(*[F.struct(F.lit(n.removeprefix(prefix).removesuffix("_score")).alias("name"), F.col(n).alias("score")) for n in names])))
    sums = long.groupBy("name").agg(F.sum(F.col("_w") * F.col("score")).alias("exposure"), F.sum(F.abs(F.col("_w") * F.col("score"))).alias("gross"))
    return sums.withColumn("share", F.coalesce(div(F.col("gross"), F.sum("gross").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)))


def style_exposure(portfolio: DataFrame, columns: Sequence[str], weight: str = "target_weight") -> DataFrame:
    """Weighted mean of each column over the rows that have it, per absolute weight, and the absolute weight that has it (without any: of all rows)."""
    long = portfolio.select(F.col(weight).alias("_w"), F.inline(F.array(*[F.struct(F.lit(c).alias("style"), F.col(c).cast("double").alias("v")) for c in columns])))
    has = F.col("v").isNotNull()
    covered = F.coalesce(F.sum(F.when(has & F.col("_w").isNotNull(), F.abs("_w"))), F.lit(0.0))
    base = F.when(covered != 0, covered).otherwise(F.sum(F.abs("_w")))
    return long.groupBy("style").agg(div(F.coalesce(F.sum(F.when(has, F.col("_w") * F.col("v"))), F.lit(0.0)), base).alias("exposure"), covered.alias("covered_weight"))


def theme_candidates(members: DataFrame, signal: DataFrame, components: Sequence[str], k: int = 10, penalty: float = 0.2) -> DataFrame:
    """Theme members with the signal's scores: min-max of each component, their mean, a penalty for risk flags, the best k."""
    df = members.join(signal, "instrument", "left")
    ends = df.agg(*[f(F.col(c)).alias(f"_{n}_{c}") for c in components for n, f in (("a", F.min), ("z", F.max))])
    df = df.crossJoin(F.broadcast(ends))  # one row

    def scaled(c: str) -> Column:
        v, a, z = F.col(c), F.col(f"_a_{c}"), F.col(f"_z_{c}")
        return F.when(v.isNull(), 0.0).when(z == a, 1.0).otherwise(div(v - a, z - a))

    df = df.withColumns({f"{c}_scaled": scaled(c) for c in components}).drop(*[f"_{n}_{c}" for c in components for n in "az"])
    df = df.withColumn("component_score", total([F.col(f"{c}_scaled") for c in components]) / len(components))
    risk = F.least(F.lit(1.0), penalty * F.size(F.filter(F.split(F.coalesce("risk_flags", F.lit("")), ";"), lambda x: x != "")))
    df = df.withColumn("risk_penalty", risk).withColumn("total_score", F.col("component_score") - F.col("risk_penalty")).withColumn("in_signal", F.col(components[0]).isNotNull())
    best = df.orderBy(F.desc("total_score"), "instrument").limit(k)
    return best.withColumn("theme_rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("total_score"), "instrument")))  # k rows
