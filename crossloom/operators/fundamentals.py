"""Point-in-time fundamentals: reading vendor text, valuation and dividend fields, statements, combinations of fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, div, z_population_strict, z_sample
from ..sources.tables import announced_by
from .joins import as_of, latest_per_key
from .signals import Factor, SignalRules

#: Formats in which vendors write a date. Fixed values.
DATES = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd")
MISSING = ("", "-", "--", "nan", "none", "null")


def number(text: Column) -> Column:
    """A number written with thousands' commas or a percent sign; blanks, dashes and anything else give null."""
    plain = F.regexp_replace(F.trim(text.cast("string")), "[,%]", "")
    return F.when(F.lower(plain).isin(*MISSING), None).otherwise(plain.try_cast("double"))


def day(text: Column) -> Column:
    """A date in one of DATES, else null."""
    plain = F.trim(text.cast("string"))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(plain, F.lit(f))) for f in DATES])


def first_of(df: DataFrame, names: Sequence[str], read) -> Column:
    """The first readable value among the columns of these names that df has."""
    known = [read(F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*known) if known else read(F.lit(None).cast("string"))


def normalize(raw: DataFrame, fields: Mapping[str, Sequence[str]], source: str) -> DataFrame:
    """instrument, report_period, announce_date, available_at, the fields and source; one row per instrument and period.

    `fields` gives each field's column names in order of preference. Without an announcement the
    latest legal day counts, so that nothing is known too early. Rows without instrument or period go;
    of several rows the one available last stays.
    """
    instrument = F.upper(F.trim(first_of(raw, ["instrument", "code"], lambda c: c.cast("string"))))
    df = raw.withColumns({"_i": instrument, "_p": first_of(raw, ["report_period", "end_date"], day)}).where("_i is not null and _i <> '' and _p is not null")
    df = df.withColumn("_a", F.coalesce(first_of(raw, ["announce_date", "ann_date"], day), announced_by(F.col("_p"))))
    df = df.withColumn("_v", F.coalesce(first_of(raw, ["available_at", "as_of_date"], day), F.col("_a")))
    out = df.select(F.col("_i").alias("instrument"), F.col("_p").alias("report_period"), F.col("_a").alias("announce_date"), F.col("_v").alias("available_at"), *[first_of(raw, names, number).alias(f) for f, names in fields.items()], F.lit(source).alias("source"))
    return latest_per_key(out, ["instrument", "report_period"], "available_at", tie=[*fields])


def dividends(raw: DataFrame, source: str) -> DataFrame:
    """instrument, announce_date, available_at, dividend_cash_per_10, source; rows without a date or an amount go."""
    announced = first_of(raw, ["announce_date", "ann_date"], day)
    known = F.coalesce(first_of(raw, ["available_at", "ex_date", "record_date", "pay_date"], day), announced)
    out = raw.select("instrument", announced.alias("announce_date"), known.alias("available_at"), first_of(raw, ["dividend_cash_per_10", "cash"], number).alias("dividend_cash_per_10"), F.lit(source).alias("source"))
    return out.where("available_at is not null and dividend_cash_per_10 is not null")


def valuation(fundamentals: DataFrame, prices: DataFrame, paid: DataFrame) -> DataFrame:
    """fundamentals with ep, cfp and dividend_yield (per cent of the close known at available_at) where they were missing; valuation_source lists what was filled.

    fundamentals has eps, operating_cashflow_per_share, ep, cfp, dividend_yield and valuation_source; prices instrument, trade_date, close.
    """
    df = as_of(fundamentals, prices, "instrument", "available_at", "trade_date", ["close"], whole_row=True)
    df = as_of(df, paid, "instrument", "available_at", "available_at", ["dividend_cash_per_10"], whole_row=True, tie="dividend_cash_per_10")
    made = {"ep": div(F.col("eps"), F.col("close")) * 100, "cfp": div(F.col("operating_cashflow_per_share"), F.col("close")) * 100, "dividend_yield": div(F.col("dividend_cash_per_10") / 10, F.col("close")) * 100}
    tags = [F.when(F.col(c).isNull() & v.isNotNull(), f"{c}_derived") for c, v in made.items()]
    source = F.concat_ws(";", F.when(F.trim("valuation_source") != "", F.col("valuation_source")), *tags)
    return df.withColumns({"valuation_source": source} | {c: F.coalesce(c, v) for c, v in made.items()}).drop("close", "dividend_cash_per_10")


def dividend_quality(df: DataFrame, paid: DataFrame) -> DataFrame:
    """dividend_stability (the last two dividends known at available_at: 1 less their relative change, cut to [0, 1]) and dividend_cashflow_coverage, where they were missing."""
    w = Window.partitionBy("instrument").orderBy("available_at", "dividend_cash_per_10")
    history = paid.select("instrument", "available_at", F.col("dividend_cash_per_10").alias("_last"), F.lag("dividend_cash_per_10").over(w).alias("_before"))
    df = as_of(df, history, "instrument", "available_at", "available_at", ["_last", "_before"], whole_row=True, tie="_last")
    stability = clip(1 - div(F.abs(F.col("_last") - F.col("_before")), F.abs(F.col("_before"))), 0.0, 1.0)
    coverage = div(F.col("operating_cashflow_per_share"), F.col("_last") / 10)
    return df.withColumns({"dividend_stability": F.coalesce("dividend_stability", stability), "dividend_cashflow_coverage": F.coalesce("dividend_cashflow_coverage", coverage)}).drop("_last", "_before")


def statement_metrics(income: DataFrame, balance: DataFrame, cashflow: DataFrame, source: str) -> DataFrame:
    """accrual_ratio and operating_cashflow_to_net_profit (per cent) of each instrument and period that all three statements have.

    income has net_income, balance total_assets, cashflow operating_cashflow; rows with a missing number or without assets go.
    """
    keys = ["instrument", "report_period"]
    df = income.select(*keys, "net_income").join(balance.select(*keys, "total_assets"), keys).join(cashflow.select(*keys, "operating_cashflow"), keys)
    n, a, o = F.col("net_income"), F.col("total_assets"), F.col("operating_cashflow")
    df = df.where(n.isNotNull() & o.isNotNull() & (a != 0))
    df = df.select(*keys, (div(n - o, a) * 100).alias("accrual_ratio"), (div(o, n) * 100).alias("operating_cashflow_to_net_profit"), F.lit(source).alias("source"))
    return latest_per_key(df, keys, "accrual_ratio", tie=["operating_cashflow_to_net_profit"])


def backfill(df: DataFrame, metrics: DataFrame, fields: Sequence[str] = ("accrual_ratio", "operating_cashflow_to_net_profit"), tag: str = "statement_accrual") -> DataFrame:
    """df with missing fields taken from metrics; `source` names it where that happened."""
    keys = ["instrument", "report_period"]
    named = metrics.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields])
    df = df.join(named, keys, "left")
    filled = F.lit(False)
    for c in fields:
        filled = filled | (F.col(c).isNull() & F.col(f"_{c}").isNotNull())
    df = df.withColumn("source", F.when(filled, F.concat_ws(";", F.when(F.trim("source") != "", F.col("source")), F.lit(tag))).otherwise(F.col("source")))
    return df.withColumns({c: F.coalesce(c, f"_{c}") for c in fields}).drop(*[f"_{c}" for c in fields])


def disclosure_events(raw: DataFrame, source: str) -> DataFrame:
    """A calendar of disclosures (instrument, report_period, planned, actual) as event rows; a row without a date is none."""
    on = F.coalesce(first_of(raw, ["actual"], day), first_of(raw, ["planned"], day))
    period = first_of(raw, ["report_period"], day)
    df = raw.select("instrument", on.alias("event_date"), period.alias("report_period"), F.lit("disclosure_date").alias("event_type"), F.lit("info").alias("severity"), F.lit(source).alias("source")).where("event_date is not null")
    return df.withColumn("event_id", F.concat_ws("_", F.lit("disclosure"), "instrument", F.date_format("report_period", "yyyyMMdd"), F.date_format("event_date", "yyyyMMdd")))


@dataclass(frozen=True)
class Component:
    field: str
    direction: int = 1
    weight: float = 1.0


@dataclass(frozen=True)
class Member:
    name: str
    source: str = "approved_factor"
    active: bool = True
    weight: float = 1.0
    direction: int = 1
    family: str = ""
    logic: str = ""
    status: str = "core"
    components: tuple[Component, ...] = ()


def combo_rules(members: Sequence[Member], rules: SignalRules = SignalRules()) -> tuple[list[Factor], SignalRules]:
    """The active members as signal factors, and rules that put families first; the last member of a family sets its weight."""
    active = [m for m in members if m.active]
    factors = [Factor(m.name, m.direction, m.family or m.name, m.logic, m.status) for m in active]
    return factors, replace(rules, family_first=True, family_weight={**rules.family_weight, **{m.family or m.name: m.weight for m in active}})


def combo_frame(panel: DataFrame, facts: DataFrame, components: Sequence[Component], name: str = "combo", at: str = "datetime") -> DataFrame:
    """panel rows that know every component's field, with the weighted sum of the fields' z-scores.

    One as-of join carries all fields. A field's z-score is taken per date over the rows that know it (divisor n; a date
    without spread: null, which adds nothing).
    """
    fields = [c.field for c in components]
    df = as_of(panel, facts, "instrument", at, "available_at", fields, tie="report_period")
    for i, c in enumerate(components):
        df = df.withColumn(f"_z{i}", z_population_strict(F.col(c.field) * c.direction, at))
    total = sum((F.coalesce(f"_z{i}", F.lit(0.0)) * c.weight for i, c in enumerate(components)), F.lit(0.0))
    return df.where(F.expr(" and ".join(f"`{f}` is not null" for f in fields))).withColumn(name, total).drop(*[f"_z{i}" for i in range(len(components))])


def combo_exposures(base: DataFrame, facts: DataFrame, member: Member, until: Column) -> DataFrame:
    """base with the member's score: z-scores (divisor n - 1) per date of its fields, from the last facts known at `until`."""
    latest = latest_per_key(facts, ["instrument"], "available_at", until, ["report_period"])
    df = base.join(latest.select("instrument", *[F.col(c.field).alias(f"_{c.field}") for c in member.components]), "instrument", "left")
    total = sum((z_sample(F.col(f"_{c.field}") * c.direction, "date") * c.weight for c in member.components), F.lit(0.0))
    return df.withColumn(member.name, total).drop(*[f"_{c.field}" for c in member.components])


def industry_map(master: DataFrame, order: str, columns: Sequence[str] = ("industry_sw", "industry", "industry_csrc")) -> DataFrame:
    """instrument and industry from the first of the columns that has any non-blank value; the last row by `order` of each instrument.

    Which column counts is one aggregate of a row.
    """
    known = [c for c in columns if c in master.columns]
    seen = master.agg(*[F.count(F.when(F.trim(c) != "", 1)).alias(c) for c in known]).first() if known else {}
    chosen = next((c for c in known if seen[c]), None)
    if chosen is None:
        return master.select("instrument", F.lit(None).cast("string").alias("industry")).where("false")
    return latest_per_key(master, ["instrument"], order).select("instrument", F.trim(chosen).alias("industry"))
