"""Security masters, price histories, universes, announcements and the read models over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, div
from .joins import latest_per_key

#: Units of money in announcements (the reference's, and with English ones), and words that tell a source's tier.
UNITS = {"亿元": 1e8, "亿": 1e8, "万元": 1e4, "万": 1e4}
ALL_UNITS = UNITS | {"million": 1e6, "billion": 1e9}
OFFICIAL, AGGREGATOR = ("cninfo.com.cn", "sse.com.cn", "szse.cn", "bse.cn", "official_exchange"), ("akshare", "eastmoney", "10jqka", "ifind", "choice", "wind")


def listed_symbol(code: Column) -> Column:
    """SH before codes that begin with 5, 6 or 9, SZ before all others, by the code's digits filled up to six; other lengths raise an error. The rule of masters and histories."""
    digits = F.regexp_replace(F.coalesce(code.cast("string"), F.lit("")), "[^0-9]", "")
    pure = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    text = F.concat(F.when(F.substring(pure, 1, 1).isin("5", "6", "9"), "SH").otherwise("SZ"), pure)
    return F.when(F.length(pure) == 6, text).otherwise(F.raise_error(F.concat(F.lit("no code of six digits: "), F.coalesce(code.cast("string"), F.lit("null")))))


def board(code: Column) -> Column:
    """The board by the first digits of a code filled up to six."""
    digits = F.regexp_replace(F.coalesce(code.cast("string"), F.lit("")), "[^0-9]", "")
    pure = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    return F.when(pure.rlike("^68[89]"), "STAR").when(pure.rlike("^30[01]"), "ChiNext").when(pure.rlike("^(8|4|920)"), "BSE").otherwise("main")


def special_treatment(name: Column) -> Column:
    """Whether a name carries ST anywhere, in any case, or the sign of delisting."""
    upper = F.upper(F.coalesce(name, F.lit("")))
    return F.contains(upper, F.lit("ST")) | F.contains(upper, F.lit("退"))


def blank(c: Column | str) -> Column:
    """Null for a text of white space only."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(c != "", c)


def price_history(daily: DataFrame, factors: DataFrame | None = None, basics: DataFrame | None = None, extra: Sequence[str] = (), volume_unit: float = 100.0, amount_unit: float = 1000.0) -> DataFrame:
    """Bars in shares and currency with vwap (the close where there is no volume), adjustment factor (1 if unknown) and the basics' columns; one bar per code and date.

    daily has code, date, order, open, high, low, close, volume and amount; rows without a close or a date go; of several
    rows the last by `order` stays. factors has adj_factor, basics the `extra` columns, both by code and date.
    """
    keys = ["code", "date"]
    df = latest_per_key(daily.where("date is not null and close is not null"), keys, "order").drop("order")
    df = df.withColumns({"volume": F.col("volume") * volume_unit, "amount": F.col("amount") * amount_unit})
    df = df.withColumn("vwap", F.coalesce(div(F.col("amount"), F.col("volume")), F.col("close")))
    df = df.join(factors.select(*keys, "adj_factor"), keys, "left") if factors is not None else df.withColumn("adj_factor", F.lit(None).cast("double"))
    df = df.withColumn("factor", F.coalesce("adj_factor", F.lit(1.0))).drop("adj_factor")
    if basics is not None:
        df = df.join(basics.select(*keys, *extra), keys, "left")
    return df.withColumn("instrument", listed_symbol(F.col("code")))


def snapshot(raw: DataFrame, order: str, as_of: Column) -> DataFrame:
    """instrument, name, exchange, board, is_st, industry and valid_from of each security; the last row of an instrument by `order`. Rows with a blank code are left out."""
    df = raw.where(blank(F.col("code").cast("string")).isNotNull()).withColumn("instrument", listed_symbol(F.col("code")))
    df = latest_per_key(df, ["instrument"], order)
    exchange = F.when(F.startswith("instrument", F.lit("SH")), "SSE").otherwise("SZSE")
    name = F.coalesce(blank("name"), F.lit(""))
    return df.select("instrument", name.alias("name"), exchange.alias("exchange"), board(F.col("code")).alias("board"), special_treatment(name).alias("is_st"), blank("industry").alias("industry"), as_of.alias("as_of"))


def enrich_industries(master: DataFrame, other: DataFrame) -> DataFrame:
    """master with blank industries taken from the other table, and where each came from."""
    df = master.join(other.select("instrument", blank("industry").alias("_other")), "instrument", "left")
    source = F.when(blank("industry").isNotNull(), "master").when(F.col("_other").isNotNull(), "other").otherwise("")
    return df.withColumns({"industry_source": source, "industry": F.coalesce(blank("industry"), "_other", F.lit(""))}).drop("_other")


def preferred_industry(raw: DataFrame, standards: Sequence[str]) -> DataFrame:
    """instrument and industry by the first standard of the list that has one, its latest row; other standards come last."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in standards]), F.col("standard")), F.lit(0))
    order = Window.partitionBy("instrument").orderBy(F.when(place > 0, place).otherwise(len(standards) + 1), F.desc("date"), "industry")
    return raw.where(blank("industry").isNotNull()).withColumn("_k", F.row_number().over(order)).where("_k = 1").select("instrument", "industry", "standard")


def in_universes(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows whose instrument is in a universe, with all its universes in order, joined by commas. members: universe, instrument."""
    named = members.groupBy("instrument").agg(F.array_join(F.sort_array(F.collect_set("universe")), ",").alias("universes"))
    return df.join(named, "instrument")


def history(master: DataFrame, prices: DataFrame, outside: DataFrame) -> DataFrame:
    """Versions of each security: those of `outside` (instrument, name, valid_from, valid_to) where it has any, else one open version from listing or the first trade."""
    first = prices.groupBy("instrument").agg(F.min("date").alias("_first"))
    own = master.join(outside.select("instrument").distinct(), "instrument", "left_anti").join(first, "instrument", "left")
    own = own.select("instrument", "name", F.coalesce("listed", "_first").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit("snapshot").alias("origin"))
    return outside.select("instrument", "name", "valid_from", "valid_to", F.lit("history").alias("origin")).unionByName(own)


def name_history(master: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per interval of a name with its ST mark; a security without changes has its current name from listing on."""
    df = master.join(changes.select("instrument", F.col("name").alias("_name"), "start", "end"), "instrument", "left")
    name = F.coalesce("_name", "name")
    return df.select("instrument", name.alias("name"), F.coalesce("start", "listed").alias("valid_from"), F.col("end").alias("valid_to"), special_treatment(F.replace(name, F.lit(" "))).alias("is_st"))


def capital_events(events: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Rows of shareholders' and capital events: announce date (or the event's), availability (or that), source."""
    announced = F.coalesce("announce_date", "event_date")
    return events.where(F.col("event_type").isin(*kinds)).select("instrument", "event_id", "event_type", announced.alias("announce_date"), F.coalesce("available_at", announced).alias("available_at"), F.coalesce(blank("source"), F.lit("company_events")).alias("source"))


def source_tier(source: Column, url: Column) -> Column:
    text = F.lower(F.concat_ws(" ", source, url))
    has = lambda words: text.rlike("|".join(w.replace(".", r"\.") for w in words))
    return F.when(has(OFFICIAL), "official").when(has(AGGREGATOR), "aggregator").otherwise("unknown")


def money_intensity(text: Column, units: Mapping[str, float] = UNITS) -> Column:
    """1 + log10(largest amount / ten million), in [1, 3]; no amount in one of the units: 1."""
    money = rf"([0-9]+(?:\.[0-9]+)?)\s*({'|'.join(sorted(units, key=len, reverse=True))})"
    pick = lambda group: F.regexp_extract_all(text, F.lit(money), F.lit(group))
    unit = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    amounts = F.transform(F.arrays_zip(pick(1).alias("v"), pick(2).alias("u")), lambda x: x["v"].cast("double") * unit[x["u"]])
    most = F.array_max(amounts)
    return F.coalesce(F.when(most > 0, clip(1 + F.log10(most / 1e7), 1.0, 3.0)), F.lit(1.0))


def classify(events: DataFrame, taxonomy: Mapping[str, tuple[str, str, str]], default: tuple[str, str, str] = ("other", "watch", "watch_risk")) -> DataFrame:
    """events with event_class, severity and action by type. The taxonomy is plan-time data of a few rows."""
    kinds = F.create_map(*[F.lit(x) for k, v in taxonomy.items() for x in (k, F.array(*[F.lit(y) for y in v]))] or [F.lit(""), F.array(*[F.lit(y) for y in default])])
    found = F.coalesce(F.try_element_at(kinds, F.lower(F.trim("event_type"))), F.array(*[F.lit(y) for y in default]))
    return events.withColumns({name: found[i] for i, name in enumerate(("event_class", "severity", "action"))})


def evidence_search(df: DataFrame, keyword: str | None = None, instruments: Sequence[str] = (), types: Sequence[str] = (), as_of: Column | None = None, lookback: int | None = None, limit: int = 200) -> DataFrame:
    """The first `limit` chunks that pass every filter given: newest event first, then by instrument (descending) and chunk; ties by the event's id, shorter ones first, so that numbers stand in their order."""
    for c, values in (("instrument", instruments), ("event_type", types)):
        df = df.where(F.col(c).isin(*values)) if values else df
    if as_of is not None:
        df = df.where(F.col("event_date") <= as_of)
        df = df.where(F.col("event_date") >= F.date_sub(as_of, lookback)) if lookback is not None else df
    if keyword:
        df = df.where(F.contains(F.lower("chunk_text"), F.lit(keyword.lower())))
    return df.orderBy(F.desc("event_date"), F.desc("instrument"), "chunk_id", F.length("event_id"), "event_id").limit(limit)


def evidence_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("event_id").alias("events"), F.count_distinct("instrument").alias("instruments"), F.count_distinct("source_url").alias("urls"))


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """How often each value of a ';'-joined column occurs; blanks don't count."""
    values = df.select(*by, F.explode(F.split(F.coalesce(column, F.lit("")), ";")).alias("value")).withColumn("value", F.trim("value")).where("value <> ''")
    return values.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))


def event_library(events: DataFrame) -> DataFrame:
    """Events by type and severity, and the totals, in one pass of grouping sets."""
    sets = events.groupingSets([["event_type"], ["severity"], []], "event_type", "severity")
    out = sets.agg(F.grouping("event_type").alias("_t"), F.grouping("severity").alias("_s"), F.count(F.lit(1)).alias("events"), F.count_distinct("instrument").alias("instruments"), F.max("event_date").alias("latest"))
    kind = F.when(F.col("_t") == 0, "event_type").when(F.col("_s") == 0, "severity").otherwise("total")
    return out.select(kind.alias("kind"), F.coalesce("event_type", "severity", F.lit("all")).alias("value"), "events", "instruments", "latest")


def context_health(master: DataFrame, events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: securities, the share with a value in each column, and the share with an event."""
    known = master.join(events.select("instrument", F.lit(1).alias("_e")).distinct(), "instrument", "left")
    return known.agg(F.count(F.lit(1)).alias("securities"), *[F.avg(blank(F.col(c).cast("string")).isNotNull().cast("double")).alias(f"{c}_coverage") for c in columns], F.avg(F.col("_e").isNotNull().cast("double")).alias("event_coverage"))


def rolling_evidence(events: DataFrame, names: DataFrame, as_of: Column, days: int, limit: int = 5) -> DataFrame:
    """Per name: events of the last `days`, counts by severity as a map, and the newest `limit` as an array of structs.

    The newest are ranked before they are gathered, so a name with very many events costs no more than `limit` in a row.
    """
    recent = events.where((F.col("event_date") <= as_of) & (F.col("event_date") >= F.date_sub(as_of, days)))
    w = Window.partitionBy("instrument").orderBy(F.desc("event_date"), "event_id")
    top = recent.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit)
    items = top.groupBy("instrument").agg(F.sort_array(F.collect_list(F.struct("_k", "event_id", "event_type", "severity", "event_date"))).alias("items"))
    kinds = recent.groupBy("instrument", "severity").agg(F.count(F.lit(1)).alias("n"))
    counts = kinds.groupBy("instrument").agg(F.sum("n").alias("event_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("severity_counts"))
    out = names.join(counts, "instrument", "left").join(items, "instrument", "left")
    return out.withColumn("event_count", F.coalesce("event_count", F.lit(0)))


def cards(portfolio: DataFrame, evidence: DataFrame, decision: str) -> DataFrame:
    """A nested card per position: identity, position, signal, evidence and the gate's decision."""
    return portfolio.join(evidence, "instrument", "left").select(
        "instrument", F.struct("industry").alias("identity"), F.struct("target_weight", "rank").alias("position"), F.struct("ensemble_score", "top_factor_1", "top_factor_2", F.split("risk_flags", ";").alias("risk_flags")).alias("signal"),
        F.struct("event_count", "severity_counts", "items").alias("evidence"), F.struct(F.lit(decision).alias("decision")).alias("gate"),
    )


def card_items(made: DataFrame) -> DataFrame:
    """The cards' evidence items as flat rows."""
    return made.select("instrument", "gate.decision", F.inline("evidence.items")).withColumnRenamed("_k", "place")


def queue(ledger: DataFrame) -> DataFrame:
    """A ledger of text columns, metrics as numbers, newest first (blank times last), with the size of each status.

    Runs are numbered inside their day, after those of later days: a task holds a day, not the ledger.
    """
    number = lambda c: F.col(c).try_cast("double").alias(c)
    df = ledger.select("run", "lane", "status", "reason", "time", number("primary_metric")).withColumn("_t", F.try_to_timestamp("time"))
    df = df.withColumn("_day", F.coalesce(F.to_date("_t"), F.lit("0001-01-01").cast("date")))
    later = Window.partitionBy(F.lit(1)).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = df.groupBy("_day").agg(F.count(F.lit(1)).alias("_n")).select("_day", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_before"))  # a row a day
    inside = Window.partitionBy("_day").orderBy(F.desc_nulls_last("_t"), "run")
    df = df.join(days, "_day").withColumn("place", F.col("_before") + F.row_number().over(inside))
    sizes = df.groupBy("status").agg(F.count(F.lit(1)).alias("status_size"))
    return df.join(sizes.withColumnRenamed("status", "_status"), F.expr("status <=> _status")).drop("_t", "_day", "_before", "_status")


def lanes(ledger: DataFrame) -> DataFrame:
    """Per lane: runs, crashes, the best run by metric and its health."""
    m = F.col("primary_metric").try_cast("double")
    out = ledger.groupBy("lane").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "crash").alias("crashes"), F.max_by("run", F.when(m.isNotNull(), F.struct(m, F.col("run")))).alias("best_run"), F.max(m).alias("best_metric"))
    share = div(F.col("crashes"), F.col("runs"))
    return out.withColumn("health", F.when(share >= 0.5, "failing").when(F.col("best_metric").isNull(), "silent").when(share > 0, "degraded").otherwise("healthy"))


def last_date(calendar: DataFrame, until: Column, otherwise: Column) -> DataFrame:
    """One row, run_date: the last calendar date not after `until`, or `otherwise` in an empty calendar."""
    return calendar.agg(F.coalesce(F.max(F.when(F.col("date") <= until, F.col("date"))), otherwise).alias("run_date"))
