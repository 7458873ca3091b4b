"""Research domains: facts and their derivations, disclosures, risk events, evidence texts, quality and governance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, div
from .joins import active_events

SEVERITIES = ("info", "watch", "risk", "block")
#: Weight and days until expiry of each severity.
SEVERITY_WEIGHT = {"info": 0.5, "watch": 0.7, "risk": 1.0, "block": 1.5}
EXPIRY_DAYS = {"block": 90, "risk": 60, "watch": 45, "info": 30}


def lookup(c: Column, values: dict, otherwise=None) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def severity_rank(c: Column) -> Column:
    return lookup(c, {s: i for i, s in enumerate(SEVERITIES)}, -1)


def active_until(date: Column, severity: Column) -> Column:
    return F.date_add(date, lookup(severity, EXPIRY_DAYS, 30))


def year_change(df: DataFrame, c: str, out: str, by: str = "instrument", period: str = "report_period") -> DataFrame:
    """c less its value at the previous report; an existing value of `out` stays."""
    made = F.col(c) - F.lag(c).over(Window.partitionBy(by).orderBy(period))
    return df.withColumn(out, F.coalesce(F.col(out), made) if out in df.columns else made)


def event_snapshot(rows: DataFrame, events: DataFrame, date: str = "date") -> DataFrame:
    """Per row (instrument, date): active events, blocks, worst severity, distinct types, and the first three summaries in date order.

    An event is active from event_date to active_until. Counts and lists come from one aggregate over the matches.
    """
    e = events.withColumn("active_until", F.coalesce(F.col("active_until"), active_until(F.col("event_date"), F.col("severity"))) if "active_until" in events.columns else active_until(F.col("event_date"), F.col("severity")))
    hits = active_events(rows.select("instrument", date), e.select("instrument", "event_id", "event_type", "severity", "event_date", "active_until"), "instrument", date, "event_date", "active_until")
    text = F.concat_ws(":", F.col("event_date").cast("string"), "event_type")
    hits = hits.withColumn("_k", F.row_number().over(Window.partitionBy("instrument", date).orderBy("event_date", "event_id")))
    found = hits.groupBy("instrument", date).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum((F.col("severity") == "block").cast("int")).alias("block_count"),
        F.max_by("severity", severity_rank(F.col("severity"))).alias("max_severity"),
        F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("event_types"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_k") <= 3, F.struct("_k", text.alias("t"))))), lambda x: x["t"]), ";").alias("summaries"),
    )
    out = rows.join(found, ["instrument", date], "left")
    return out.withColumns({"event_count": F.coalesce("event_count", F.lit(0)), "block_count": F.coalesce("block_count", F.lit(0)), "max_severity": F.coalesce("max_severity", F.lit("none")), "event_types": F.coalesce("event_types", F.lit("")), "summaries": F.coalesce("summaries", F.lit("")), "event_blocked": F.coalesce(F.col("block_count") > 0, F.lit(False))})


def disclosure_scores(rows: DataFrame, events: DataFrame, positive: Sequence[str], negative: Sequence[str], days: int = 90, date: str = "date") -> DataFrame:
    """Per row: positive, negative and net event scores of the last `days`: severity weight x linear recency; days since the last event."""
    weight = lookup(F.col("severity"), SEVERITY_WEIGHT, 0.5)
    part = lambda kinds: F.sum(F.when(F.col("event_type").isin(*kinds), weight).otherwise(0.0))
    # added up by day first: a name with very many events meets each of its dates with `days` rows at most
    e = events.groupBy(F.col("instrument").alias("_i"), "event_date").agg(part(positive).alias("_p"), part(negative).alias("_n"))
    hit = (F.col("instrument") == F.col("_i")) & (F.col("event_date") <= F.col(date)) & (F.col("event_date") >= F.date_sub(F.col(date), days))
    age = F.datediff(F.col(date), F.col("event_date"))
    matched = rows.select("instrument", date).distinct().join(e, hit).withColumn("_age", age)
    side = lambda c: F.coalesce(F.sum(F.col(c) * (1 - F.col("_age") / float(days))), F.lit(0.0))
    found = matched.groupBy("instrument", date).agg(side("_p").alias("positive_score"), side("_n").alias("negative_score"), F.min("_age").alias("days_since"))
    out = rows.join(found, ["instrument", date], "left")
    out = out.withColumns({"positive_score": F.coalesce("positive_score", F.lit(0.0)), "negative_score": F.coalesce("negative_score", F.lit(0.0))})
    return out.withColumn("net_score", F.col("positive_score") - F.col("negative_score"))


def pieces(text: Column, size: int) -> Column:
    """The text cut into slices of `size` characters, in one pass; null and empty texts give none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def chunks(df: DataFrame, text: str = "text", size: int = 500) -> DataFrame:
    """White space collapsed, then fixed-width slices: chunk_id (from 0), chunk_text; an empty text gives none.

    The slices are cut before they become rows, so no row carries its whole text.
    """
    plain = F.trim(F.regexp_replace(F.col(text), r"[ \t\n\r\f\x0B]+", " "))
    return df.drop("chunk_id", "chunk_text").select("*", F.posexplode(pieces(plain, size)).alias("chunk_id", "chunk_text"))


def search(df: DataFrame, words: Sequence[str], text: str = "chunk_text", limit: int = 200, order: Sequence[Column] = ()) -> DataFrame:
    """Rows whose text contains one of the words, whatever the case; the first `limit` in that order."""
    low = F.lower(F.col(text))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w.lower()))
    return df.where(hit).orderBy(*order).limit(limit)


def percent_intensity(text: Column) -> Column:
    """1 + the largest percentage / 3, in [1, 3]; no percentage: 1."""
    values = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*%"), 1), lambda x: x.try_cast("double"))
    return F.coalesce(clip(1 + F.array_max(values) / 3, 1.0, 3.0), F.lit(1.0))


def classify(text: Column, rules: Sequence[tuple[Sequence[str], str, str]], otherwise: tuple[str, str] = ("other", "info")) -> tuple[Column, Column]:
    """(type, severity) of the first rule one of whose words the text contains."""
    kind, severity = F.lit(otherwise[0]), F.lit(otherwise[1])
    for words, k, s in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        kind, severity = F.when(hit, k).otherwise(kind), F.when(hit, s).otherwise(severity)
    return kind, severity


def event_id(*parts: Column) -> Column:
    """The first 16 hex digits of the parts' SHA-1, joined by '|'."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def signal_quality(df: DataFrame, factors: Sequence[str], least_coverage: float = 0.8, date: str = "date") -> DataFrame:
    """Rows (check, status, value): non-empty, one date, unique instruments, and per factor its finite coverage and that it varies."""
    good = lambda c: F.count(F.when(~F.isnan(c) & c.isNotNull() & (F.abs(c) < float("inf")), 1))
    n = F.count(F.lit(1)).cast("double")
    aggregates = [n.alias("n"), F.count_distinct(date).cast("double").alias("dates"), F.count_distinct("instrument").cast("double").alias("names")]
    for c in factors:
        value = F.col(c).cast("double")
        aggregates += [good(value).cast("double").alias(f"g_{c}"), F.count_distinct(value).cast("double").alias(f"d_{c}")]
    one = df.agg(*aggregates)
    row = lambda name, ok, value: F.struct(F.lit(name).alias("check"), F.when(ok, "pass").otherwise("fail").alias("status"), value.alias("value"))
    rows = [row("non_empty", F.col("n") > 0, F.col("n")), row("single_date", F.col("dates") == 1, F.col("dates")), row("unique_instruments", F.col("names") == F.col("n"), F.col("n") - F.col("names"))]
    for c in factors:
        share = F.coalesce(div(F.col(f"g_{c}"), F.col("n")), F.lit(0.0))
        rows += [row(f"coverage:{c}", share >= least_coverage, share), row(f"varies:{c}", F.col(f"d_{c}") > 1, F.col(f"d_{c}"))]
    return one.select(F.inline(F.array(*rows)))


def field_coverage(df: DataFrame, fields: Sequence[str], ready: float = 0.8, caution: float = 0.5) -> DataFrame:
    """Share of non-null values of each field and its status; one aggregate, unpivoted."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in fields])
    long = one.select("_n", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in fields])))
    share = F.coalesce(div(F.col("present"), F.col("_n")), F.lit(0.0))
    return long.select("field", "present", share.alias("coverage"), F.when(share >= ready, "ready").when(share >= caution, "caution").otherwise("blocked").alias("status"))


def domain_freshness(df: DataFrame, domain: str, date: str, as_of: Column, most_days: int, least_instruments: int) -> DataFrame:
    """One row of governance: instruments, latest date, age in days, status."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("instrument").alias("instruments"), F.max(date).alias("latest"))
    age = F.datediff(as_of, F.col("latest"))
    ok = (F.col("instruments") >= least_instruments) & (age <= most_days)
    return one.select(F.lit(domain).alias("domain"), "rows", "instruments", "latest", age.alias("age_days"), F.when(F.col("rows") == 0, "blocked").when(ok, "active").otherwise("caution").alias("status"))


def quarters(spark, start: str, end: str) -> DataFrame:
    """Quarter ends from the quarter of start up to and including end."""
    first = F.trunc(F.lit(start).cast("date"), "quarter")
    ends = F.explode(F.sequence(first, F.trunc(F.lit(end).cast("date"), "quarter"), F.expr("interval 3 months")))
    ends = spark.range(1).select(ends.alias("q")).select(F.last_day(F.add_months("q", 2)).alias("report_period"))
    return ends.where(F.col("report_period") <= F.lit(end).cast("date"))


def pad_calendar(df: DataFrame, calendar: DataFrame, date: str = "datetime") -> DataFrame:
    """A row for each calendar date between an instrument's first and last; gaps are null. The calendar is one row of its dates, of which each instrument takes its slice."""
    span = df.groupBy("instrument").agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = calendar.agg(F.array_sort(F.collect_set(date)).alias("_days"))
    own = F.filter("_days", lambda d: (d >= F.col("_a")) & (d <= F.col("_b")))
    grid = span.crossJoin(F.broadcast(days)).select("instrument", F.explode(own).alias(date))  # one row, a day each
    return grid.join(df, ["instrument", date], "left")
