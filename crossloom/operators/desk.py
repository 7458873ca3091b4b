"""Around a portfolio: risk report, gates, reviews, tickets, quotes and intraday results, and trading over many days."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div, true_if
from .signals import exposure, first_failure, turnover

#: Failed checks that only call for caution, flags that forbid trading.
CAUTION_CHECKS = ("max_industry_weight", "min_factor_family_count", "max_factor_family_concentration", "min_factor_logic_count", "max_factor_logic_concentration", "tushare_dividend_coverage", "tushare_disclosure_evidence_coverage")
HARD_FLAGS = ("not_tradable", "limit_locked", "st_or_delisting")
REVIEW_FLAG = "expert_review_caution"


def flag(df: DataFrame, c: str) -> Column:
    return true_if(F.col(c)) if c in df.columns else F.lit(False)


def named(condition: Column, text: Column) -> Column:
    """The texts of the rows where the condition holds, in order, joined by '; '."""
    return F.array_join(F.sort_array(F.collect_list(F.when(F.coalesce(condition, F.lit(False)), text))), "; ")


def check_rows(df: DataFrame, rows: Sequence[tuple[str, Column, Column, float, Column]]) -> DataFrame:
    """One aggregate of df, as rows (check, status, value, threshold, detail)."""
    made = [F.struct(F.lit(n).alias("check"), ok.alias("ok"), v.cast("double").alias("value"), F.lit(float(t)).alias("threshold"), d.alias("detail")) for n, ok, v, t, d in rows]
    return df.agg(F.array(*made).alias("r")).select(F.inline("r")).select("check", F.when(F.coalesce("ok", F.lit(False)), "pass").otherwise("fail").alias("status"), "value", "threshold", "detail")


@dataclass(frozen=True)
class RiskRules:
    most_weight: float = 0.08
    least_positions: int = 10
    least_coverage: float = 0.5
    most_turnover: float = 0.5
    least_amount: float = 1e6
    value: float = 1e7
    most_amount_share: float = 0.05
    most_cost: float = 10_000.0
    cost_bps: float = 15.0
    most_industry: float = 0.35
    least_count: int = 2
    most_concentration: float = 0.7


def risk_report(portfolio: DataFrame, signal: DataFrame, current: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """Every limit of a portfolio as (check, status, value, threshold, detail): weights, coverage, turnover, events, capacity, cost, and exposure by industry, family and logic.

    A limit on a column that the portfolio lacks fails.
    """
    w, none = F.col("target_weight"), F.lit("")
    count, blocked = F.count(F.lit(1)), flag(portfolio, "event_blocked")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    missing = lambda c: (F.lit(False), F.lit(None), F.lit(f"missing required column: {c}"))
    if "amount_20d" in portfolio.columns:
        share = div(F.abs(w) * rules.value, F.col("amount_20d"))
        amount = (F.bool_and(F.coalesce(F.col("amount_20d") >= rules.least_amount, F.lit(False))), zero(F.min("amount_20d")), named(F.col("amount_20d") < rules.least_amount, F.col("instrument")))
        held = (F.bool_and(F.coalesce(share <= rules.most_amount_share, F.lit(False))), zero(F.max(share)), named(share > rules.most_amount_share, F.col("instrument")))
    else:
        amount = held = missing("amount_20d")
    cost = zero(F.sum(F.abs(w))) * rules.value * rules.cost_bps / 10_000
    rows = check_rows(portfolio, [
        ("max_single_weight", zero(F.max(w)) <= rules.most_weight + 1e-12, zero(F.max(w)), rules.most_weight, none),
        ("min_positions", count >= rules.least_positions, count, rules.least_positions, none),
        ("no_negative_weights", F.count_if(w < 0) == 0, F.count_if(w < 0), 0, none),
        ("event_blocked_positions", F.count_if(blocked) == 0, F.count_if(blocked), 0, named(blocked, F.col("instrument"))),
        ("min_amount_20d", amount[0], amount[1], rules.least_amount, amount[2]),
        ("max_position_amount_share", held[0], held[1], rules.most_amount_share, held[2]),
        ("max_estimated_cost", cost <= rules.most_cost, cost, rules.most_cost, F.lit(f"total_bps={rules.cost_bps:g}")),
    ])
    covered = zero(F.avg(F.col("eligible").cast("double")))
    rows = rows.unionByName(check_rows(signal, [("min_signal_coverage", covered >= rules.least_coverage, covered, rules.least_coverage, none)]))
    moved = F.max("turnover")
    rows = rows.unionByName(check_rows(turnover(portfolio, current), [("max_turnover", moved <= rules.most_turnover, moved, rules.most_turnover, none)]))
    top = zero(F.max("weight"))
    rows = rows.unionByName(check_rows(industry_exposure(portfolio), [("max_industry_weight", top <= rules.most_industry, top, rules.most_industry, F.coalesce(F.max_by("industry", F.struct("weight", "industry")), none))]))
    for prefix, name in (("family_", "factor_family"), ("logic_", "factor_logic")):
        parts = exposure(portfolio, prefix)
        n, share = F.count_if(F.col("gross") > 0), zero(F.max("share"))
        rows = rows.unionByName(check_rows(parts, [(f"min_{name}_count", n >= rules.least_count, n, rules.least_count, none), (f"max_{name}_concentration", share <= rules.most_concentration, share, rules.most_concentration, F.coalesce(F.max_by("name", F.struct("gross", "name")), none))]))
    return rows


def industry_exposure(portfolio: DataFrame, columns: Sequence[str] = ("industry_sw", "industry", "industry_csrc")) -> DataFrame:
    """industry, weight, positions by the first column that the portfolio has; a blank industry is `unknown`."""
    known = [c for c in columns if c in portfolio.columns]
    label = F.coalesce(F.when(F.trim(known[0]) != "", F.trim(known[0])), F.lit("unknown")) if known else F.lit("unknown")
    return portfolio.groupBy(label.alias("industry")).agg(F.sum("target_weight").alias("weight"), F.count(F.lit(1)).alias("positions"))


def classify_gate(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """decision per group: pass, caution (a caution, or only failures that call for it) or reject; without checks pass."""
    failed = F.col("status") == "fail"
    hard = F.count_if(failed & ~F.col("check").isin(*CAUTION_CHECKS))
    soft = F.count_if(failed | (F.col("status") == "caution"))
    return checks.groupBy(*by).agg(F.when(hard > 0, "reject").when(soft > 0, "caution").otherwise("pass").alias("decision"), F.count_if(failed).alias("failed"))


def pretrade_review(portfolio: DataFrame, least_amount: float = 1e8) -> DataFrame:
    """Five reviews as (check, status, count, detail): low liquidity, limits and suspensions, blocking events, announcements, hard flags; no hit: pass."""
    flags = F.split(F.coalesce("risk_flags", F.lit("")), ";") if "risk_flags" in portfolio.columns else F.array().cast("array<string>")
    locked = F.lit(False)
    for c in ("limit_up", "limit_down", "suspended", "buy_blocked"):
        locked = locked | flag(portfolio, c)
    watch = flag(portfolio, "announcement_flag")
    if "event_count" in portfolio.columns:
        watch = watch | (F.coalesce("event_count", F.lit(0)) > 0)
    amount = F.coalesce(F.col("amount_20d") < least_amount, F.lit(False)) if "amount_20d" in portfolio.columns else F.lit(False)
    checks = [("liquidity_floor", "caution", amount), ("limit_or_suspended", "reject", locked), ("event_blocked", "reject", flag(portfolio, "event_blocked")), ("announcement_watch", "caution", watch), ("hard_risk_flags", "reject", F.arrays_overlap(flags, F.array(*[F.lit(x) for x in HARD_FLAGS])))]
    rows = [F.struct(F.lit(n).alias("check"), F.when(F.count_if(hit) > 0, status).otherwise("pass").alias("status"), F.count_if(hit).alias("count"), named(hit, F.col("instrument")).alias("detail")) for n, status, hit in checks]
    return portfolio.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def tickets(orders: DataFrame, fills: DataFrame | None = None, banned: Sequence[str] = (), cash: float | None = None, most_value: float | None = None, allow_sells: bool = True) -> DataFrame:
    """Orders as tickets for a person: BUY or SELL, or REVIEW with the reasons (rules before the trade, then a rejected fill)."""
    df = orders.drop("status")
    if fills is not None:
        df = df.join(fills.select("instrument", F.col("status").alias("fill_status"), "reject_reason"), "instrument", "left")
    else:
        df = df.withColumns({"fill_status": F.lit(None).cast("string"), "reject_reason": F.lit(None).cast("string")})
    buy, value = F.col("side") == "BUY", F.coalesce("order_value", F.lit(0.0))
    reasons = [F.when(F.col("instrument").isin(*banned), "banned_instrument")]
    reasons += [F.when(buy & (value > cash), "insufficient_cash")] if cash is not None else []
    reasons += [F.when(value > most_value, "above_max_order_value")] if most_value is not None else []
    reasons += [] if allow_sells else [F.when(~buy, "sell_not_allowed")]
    df = df.withColumn("pretrade_reason", F.concat_ws(";", *reasons))
    rejected = F.coalesce(F.col("fill_status") == "rejected", F.lit(False))
    df = df.withColumn("review_reason", F.concat_ws(";", F.when(F.col("pretrade_reason") != "", F.col("pretrade_reason")), F.when(rejected & (F.coalesce("reject_reason", F.lit("")) != ""), F.col("reject_reason"))))
    review = rejected | (F.col("pretrade_reason") != "")
    return df.withColumns({"pretrade_status": F.when(F.col("pretrade_reason") != "", "review").otherwise("pass"), "action": F.when(review, "REVIEW").otherwise(F.col("side")), "fill_status": F.coalesce("fill_status", F.lit(""))}).drop("reject_reason")


def review_gate(portfolio: DataFrame, decision: str, status: str = "completed", required: bool = False, multiplier: float = 0.5) -> DataFrame:
    """The portfolio after an expert's decision: nothing if it is rejected or a required review is missing; scaled and flagged on caution."""
    if (required and (status != "completed" or decision == "unknown")) or decision == "reject":
        return portfolio.where("false")
    if decision != "caution":
        return portfolio
    old = F.coalesce("risk_flags", F.lit("")) if "risk_flags" in portfolio.columns else F.lit("")
    return portfolio.withColumns({"target_weight": F.col("target_weight") * multiplier, "risk_flags": F.concat_ws(";", F.when(old != "", old), F.lit(REVIEW_FLAG))})


def symbol(text: Column) -> Column:
    """A code with its exchange before it: SH for 6 and 9, SZ for 0, 2 and 3, BJ for 4 and 8; from the last six digits. Anything else stays, in capitals."""
    plain = F.upper(F.trim(F.coalesce(text.cast("string"), F.lit(""))))
    digits = F.regexp_replace(plain, "[^0-9]", "")
    code = F.right(digits, F.lit(6))
    first = F.substring(code, 1, 1)
    exchange = F.when(first.isin("6", "9"), "SH").when(first.isin("0", "2", "3"), "SZ").when(first.isin("4", "8"), "BJ")
    return F.when(plain.rlike("^(SH|SZ|BJ)") | (F.length(digits) < 6) | exchange.isNull(), plain).otherwise(F.concat(exchange, code))


def quotes(raw: DataFrame, order: str) -> DataFrame:
    """instrument, prev_close, current, pct_today: of aliased columns the first with a number, the last row of each instrument by `order`."""
    pick = lambda *names: F.coalesce(*[F.col(n).cast("string").try_cast("double") for n in names if n in raw.columns], F.lit(None).cast("double"))
    df = raw.select(symbol(F.col("instrument" if "instrument" in raw.columns else "code")).alias("instrument"), pick("prev_close", "pre_close").alias("prev_close"), pick("current", "price", "last").alias("current"), pick("pct_today", "pct_chg").alias("pct_today"), F.col(order).alias("_o"))
    w = Window.partitionBy("instrument").orderBy(F.desc("_o"), "current", "prev_close")
    return df.where("instrument <> ''").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_o")


def event_bucket(df: DataFrame) -> Column:
    """event_block, event_watch, announcement_watch or no_event, whichever holds first."""
    said = F.lit(False)
    for c in ("event_risk_summary", "active_event_types"):
        if c in df.columns:
            said = said | (F.trim(F.coalesce(c, F.lit(""))) != "")
    if "event_count" in df.columns:
        said = said | (F.coalesce("event_count", F.lit(0)) > 0)
    return F.when(flag(df, "event_blocked"), "event_block").when(said, "event_watch").when(flag(df, "announcement_flag"), "announcement_watch").otherwise("no_event")


def intraday(portfolio: DataFrame, quoted: DataFrame) -> DataFrame:
    """Positions with today's change (0 if unknown), its weighted return in per cent, direction and event bucket."""
    df = portfolio.join(quoted, "instrument", "left")
    change = F.coalesce("pct_today", (div(F.col("current"), F.col("prev_close")) - 1) * 100, F.lit(0.0))
    df = df.withColumn("pct_today", change).withColumn("weighted_return_pct", F.coalesce("target_weight", F.lit(0.0)) * F.col("pct_today"))
    return df.withColumns({"direction": F.when(F.col("pct_today") > 0, "up").when(F.col("pct_today") < 0, "down").otherwise("flat"), "event_bucket": event_bucket(df)})


def group_results(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(kind, value, positions, weight, mean change, weighted return) by each of the columns, in one pass of grouping sets."""
    rows = df.select(*[F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))), F.lit("unknown")).alias(c) for c in columns], "target_weight", "pct_today", "weighted_return_pct")
    sets = rows.groupingSets([[c] for c in columns], *columns)
    out = sets.agg(*[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(columns)], F.count(F.lit(1)).alias("positions"), F.sum("target_weight").alias("target_weight"), F.avg("pct_today").alias("pct_today"), F.sum("weighted_return_pct").alias("weighted_return_pct"))
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        kind, value = F.when(F.col(f"_g{i}") == 0, c).otherwise(kind), F.when(F.col(f"_g{i}") == 0, F.col(c)).otherwise(value)
    return out.select(kind.alias("kind"), value.alias("value"), "positions", "target_weight", "pct_today", "weighted_return_pct")


def paper_batch(targets: DataFrame, states: DataFrame, initial: DataFrame | None = None, equity: float = 1e7, lot: int = 100, ratio: float = 1.0, slippage_bps: float = 5.0, commission_bps: float = 2.0, stamp_bps: float = 10.0, tolerance: float = 1e-6, least_value: float = 1000.0) -> DataFrame:
    """Trading towards each day's targets from the initial positions: what was ordered and filled, and the weight after it, for every instrument and day.

    targets: date, instrument, target_weight. states: date, instrument, price and blocked (a reject reason or ''). initial: instrument,
    current_weight. A day without a target for a name asks for none of it. An order worth less than least_value after rounding to
    lots is no order. The days of one instrument are one fold, in which
    only its own weight is carried: no loop over days, and instruments run apart.
    """
    days = targets.agg(F.sort_array(F.collect_set("date")).alias("days"))  # one row
    own = targets.groupBy("instrument").agg(F.map_from_entries(F.collect_list(F.struct("date", "target_weight"))).alias("wanted"))
    held = initial.groupBy("instrument").agg(F.sum("current_weight").alias("held")) if initial is not None else own.select("instrument", F.lit(0.0).alias("held")).where("false")
    own = own.join(held, "instrument", "full").withColumn("held", F.coalesce("held", F.lit(0.0)))
    grid = own.crossJoin(days).select("instrument", "held", F.explode("days").alias("date"), "wanted").withColumn("target", F.coalesce(F.try_element_at("wanted", F.col("date")), F.lit(0.0))).drop("wanted")
    rows = grid.join(states, ["date", "instrument"], "left")
    item = F.struct("date", "target", "price", F.coalesce("blocked", F.lit("")).alias("blocked"))
    series = rows.groupBy("instrument").agg(F.sort_array(F.collect_list(item)).alias("items"), F.first("held").alias("held"))
    out = "array<struct<date:date,target_weight:double,before:double,side:string,delta_weight:double,fill_delta_weight:double,transaction_cost:double,status:string,reject_reason:string,after:double>>"

    def step(acc, x):
        asked = x["target"] - acc["w"]
        buy = asked > 0
        priced = F.coalesce(x["price"] > 0, F.lit(False))
        shares = F.floor(F.round(F.abs(asked) * equity / x["price"] / lot, 6)) * lot  # rounded, so that sums that differ in the last digit give equal lots
        value = F.when(priced, shares * x["price"]).otherwise(F.abs(asked) * equity)
        any_ = (F.abs(asked) > tolerance) & (value >= least_value)
        sign = F.when(buy, 1.0).otherwise(-1.0)
        ok = any_ & (x["blocked"] == "")
        filled = F.when(ok, value * ratio * F.when(priced, 1 + sign * slippage_bps / 10_000).otherwise(1.0)).otherwise(0.0)
        cost = filled * (commission_bps + F.when(buy, 0.0).otherwise(stamp_bps)) / 10_000
        after = acc["w"] + sign * filled / equity
        after = F.when(F.abs(after) > 1e-8, after).otherwise(0.0)
        status = F.when(~any_, "none").when(~ok, "rejected").otherwise("filled" if ratio >= 1 else "partial")
        row = F.struct(x["date"].alias("date"), x["target"].alias("target_weight"), acc["w"].alias("before"), F.when(any_, F.when(buy, "BUY").otherwise("SELL")).alias("side"), F.when(any_, sign * value / equity).otherwise(0.0).alias("delta_weight"), (sign * filled / equity).alias("fill_delta_weight"), cost.alias("transaction_cost"), status.alias("status"), F.when(any_, x["blocked"]).otherwise("").alias("reject_reason"), after.alias("after"))
        return F.struct(after.alias("w"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.col("held").alias("w"), F.array().cast(out).alias("rows"))
    return series.select("instrument", F.inline(F.aggregate("items", start, step)["rows"]))


def batch_metrics(batch: DataFrame, reported: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Per day: orders, fills, rejects with their most common reason, turnover asked for and filled, costs, positions, exposure, the distance from the targets, and whether the positions are those reported.

    reported: date, instrument, current_weight, as another account has them; without it the positions are taken as they are.
    """
    s = F.col("status")
    days = batch.groupBy("date").agg(
        F.count_if(s != "none").alias("order_count"), F.count_if(s.isin("filled", "partial")).alias("fill_count"), F.count_if(s == "rejected").alias("rejected_count"), F.sum(F.abs("delta_weight")).alias("turnover"), F.sum(F.abs("fill_delta_weight")).alias("filled_turnover"),
        F.sum("transaction_cost").alias("transaction_cost"), F.count_if(F.col("after") != 0).alias("position_count"), F.sum("after").alias("gross_exposure"), F.sum(F.abs(F.col("target_weight") - F.col("after"))).alias("target_drift"),
    )
    reasons = batch.where("status = 'rejected'").groupBy("date", "reject_reason").agg(F.count(F.lit(1)).alias("n"))
    most = reasons.groupBy("date").agg(F.min_by("reject_reason", F.struct(-F.col("n"), F.col("reject_reason"))).alias("top_reject_reason"))
    days = days.join(most, "date", "left").withColumn("top_reject_reason", F.coalesce("top_reject_reason", F.lit("")))
    if reported is None:
        return days.withColumn("reconciliation_passed", F.lit(True))
    both = batch.where("after <> 0").select("date", "instrument", "after").join(reported.where("current_weight <> 0").select("date", "instrument", "current_weight"), ["date", "instrument"], "full")
    off = both.where(F.col("after").isNull() | F.col("current_weight").isNull() | (F.abs(F.col("after") - F.col("current_weight")) > tolerance)).select("date", F.lit(True).alias("_off")).distinct()
    return days.join(off, "date", "left").withColumn("reconciliation_passed", F.col("_off").isNull()).drop("_off")


def batch_summary(batch: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """One row: days, turnover, largest drift, days that don't reconcile, costs, rejected orders with their most common reason (ties: the first in order), final positions."""
    daily = batch_metrics(batch, reported)
    whole = daily.agg(F.count(F.lit(1)).alias("days"), F.sum("turnover").alias("total_turnover"), F.avg("turnover").alias("average_turnover"), F.max("target_drift").alias("max_target_drift"), F.count_if(~F.col("reconciliation_passed")).alias("reconciliation_failures"), F.sum("transaction_cost").alias("total_transaction_cost"), F.sum("rejected_count").alias("execution_failure_count"), F.max_by("position_count", "date").alias("final_positions"))
    reasons = batch.where("status = 'rejected'").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
    most = reasons.agg(F.coalesce(F.min_by("reject_reason", F.struct(-F.col("n"), F.col("reject_reason"))), F.lit("")).alias("top_execution_failure_reason"))
    return whole.crossJoin(most)  # one row each


def theme_gate(candidates: DataFrame, least_candidates: int = 3, least_coverage: float = 0.6, least_amount: float = 1e8) -> DataFrame:
    """Checks of a theme's candidates (check, status, value, threshold): candidates, coverage and liquidity call for caution, blocked names fail; an empty set fails."""
    n = F.count(F.lit(1))
    research, watch = F.count_if(F.col("research_status") == "research_candidate"), F.count_if(F.col("research_status") == "watch_only")
    covered = F.avg(F.col("in_signal").cast("double"))
    blocked, locked = F.count_if(flag(candidates, "event_blocked")), F.count_if(flag(candidates, "buy_blocked") | ~F.coalesce(F.col("tradable"), F.lit(True)))
    low = F.count_if(F.coalesce(F.col("amount_20d") < least_amount, F.lit(False)))
    row = lambda name, ok, otherwise, value, limit: F.struct(F.lit(name).alias("check"), F.when(ok, "pass").otherwise(otherwise).alias("status"), value.cast("double").alias("value"), F.lit(float(limit)).alias("threshold"))
    rows = F.array(
        row("min_research_candidates", research >= least_candidates, "caution", research, least_candidates), row("min_signal_coverage", covered >= least_coverage, "caution", covered, least_coverage), row("watch_only_positions", watch == 0, "caution", watch, 0),
        row("event_blocked_positions", blocked == 0, "fail", blocked, 0), row("tradability_blocked_positions", locked == 0, "fail", locked, 0), row("min_amount_20d", low == 0, "caution", low, least_amount),
    )
    empty = F.array(row("min_research_candidates", F.lit(False), "fail", F.lit(0), least_candidates))
    return candidates.agg(F.when(n == 0, empty).otherwise(rows).alias("r")).select(F.inline("r"))


def signal_universe(signal: DataFrame, eligible_only: bool = False) -> DataFrame:
    return (signal.where("eligible") if eligible_only else signal).select("instrument").distinct()


def missing_members(members: DataFrame, signal: DataFrame) -> DataFrame:
    """Members that the signal does not have."""
    return members.join(signal_universe(signal), "instrument", "left_anti")


def merge_scores(exposures: DataFrame, scores: DataFrame) -> DataFrame:
    """exposures with model_score, by date and instrument where both have a date, else by instrument; null where there is none."""
    keys = ["date", "instrument"] if "date" in exposures.columns and "date" in scores.columns else ["instrument"]
    return exposures.drop("model_score").join(scores.select(*keys, "model_score"), keys, "left")
