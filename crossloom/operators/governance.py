"""Whether data may be used: domains against their rules, a provider's calendar against the day, vendor coverage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masters import blank


@dataclass(frozen=True)
class Domain:
    """A data domain's rules. A domain without a table is missing."""

    name: str
    required: Sequence[str] = ()
    pit: Sequence[str] = ()
    date: str | None = None
    most_days: int | None = None
    least_coverage: float = 0.0
    source: str | None = None
    trusted: Sequence[str] = ()
    least_trusted: float = 0.0
    lane: str = ""
    if_missing: str = "shadow"
    if_failed: str = "shadow"


def _day(c: str) -> Column:
    return F.col(c).cast("string").try_cast("date")


def domain_report(df: DataFrame | None, domain: Domain, expected: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """One row: status, activation, coverage of the expected instruments, completeness of the point-in-time fields, freshness, share of trusted sources, rows and what failed.

    Everything but the coverage is one aggregate over the table; the coverage counts distinct instruments that both sides have.
    """
    lane = domain.lane or domain.name
    columns = ("domain", "activation_lane", "status", "activation_status", "coverage_ratio", "pit_field_completeness", "freshness_status", "trusted_source_ratio", "rows", "detail")
    if df is None:
        spark = expected.sparkSession if expected is not None else None
        if spark is None:
            raise ValueError("a missing domain needs the expected instruments' session")
        return spark.range(1).select(*[F.lit(v).alias(c) for c, v in zip(columns, (domain.name, lane, "missing", domain.if_missing, 0.0, 0.0, "missing", 0.0), strict=False)], F.lit(0).cast("long").alias("rows"), F.lit("file missing").alias("detail"))
    n, have = F.count(F.lit(1)), set(df.columns)
    parts = [F.coalesce(F.avg(blank(F.col(c).cast("string")).isNotNull().cast("double")), F.lit(0.0)) if c in have else F.lit(0.0) for c in domain.pit]
    trusted = sorted({t.strip().lower() for t in domain.trusted if t.strip()})
    watched = bool(domain.source and domain.trusted)
    own = F.lower(F.trim(F.coalesce(F.col(domain.source).cast("string"), F.lit("")))) if domain.source in have else None
    share = F.lit(1.0) if not watched or (own is not None and not trusted) else F.lit(0.0) if own is None else F.coalesce(F.avg(own.isin(*trusted).cast("double")), F.lit(0.0))
    dated = domain.date is not None and domain.most_days is not None and as_of is not None
    latest = F.max(_day(domain.date)) if dated and domain.date in have else F.lit(None).cast("date")
    one = df.agg(n.alias("rows"), (reduce(lambda a, b: a + b, parts) / len(parts) if parts else F.lit(1.0)).alias("pit_field_completeness"), share.alias("trusted_source_ratio"), latest.alias("_latest"))
    if "instrument" in have and expected is not None:
        names = expected.select(F.col("instrument").cast("string").alias("instrument")).where("instrument is not null").distinct()
        hit = df.select(F.col("instrument").cast("string").alias("instrument")).distinct().withColumn("_h", F.lit(1))
        covered = names.join(hit, "instrument", "left").agg(F.count(F.lit(1)).alias("_all"), F.count("_h").alias("_hit"))
        one = one.crossJoin(covered)  # one row each
        coverage = F.when(F.col("rows") == 0, 0.0).when(F.col("_all") == 0, 1.0).otherwise(F.try_divide(F.col("_hit").cast("double"), F.col("_all")))
    else:
        coverage = F.when(F.col("rows") == 0, 0.0).otherwise(1.0)
    fresh = F.lit("not_checked") if not dated else F.when(F.col("_latest").isNull(), "missing").when(F.datediff(as_of, "_latest") <= domain.most_days, "pass").otherwise("stale")
    one = one.withColumns({"coverage_ratio": coverage, "freshness_status": fresh})
    lacking = [c for c in domain.required if c not in have]
    failures = F.concat_ws(
        "; ", F.when(F.col("rows") == 0, "empty"), F.lit(f"missing_required={lacking}" if lacking else None).cast("string"), F.when(F.col("coverage_ratio") < domain.least_coverage, f"coverage_below_{domain.least_coverage:g}"),
        F.when(F.lit(bool(domain.pit)) & (F.col("pit_field_completeness") < 1), "pit_incomplete"), F.when(F.col("freshness_status") == "missing", "freshness_missing"), F.when(F.col("freshness_status") == "stale", "stale"),
        F.when(F.col("trusted_source_ratio") < domain.least_trusted, f"trusted_source_below_{domain.least_trusted:g}"),
    )
    one = one.withColumn("detail", failures).withColumn("status", F.when(F.col("detail") == "", "pass").otherwise("fail"))
    return one.withColumns({"domain": F.lit(domain.name), "activation_lane": F.lit(lane), "activation_status": F.when(F.col("status") == "pass", "active").otherwise(domain.if_failed)}).select(*columns)


def governance_report(tables: Sequence[tuple[DataFrame | None, Domain]], expected: DataFrame, as_of: Column) -> DataFrame:
    """A row per domain. The report passes where every row does or is a shadow."""
    return reduce(DataFrame.unionByName, [domain_report(df, d, expected, as_of) for df, d in tables])


def provider_freshness(calendar: DataFrame, today: Column, ends: Column, most_days: int = 3, available: Column | None = None, date: str = "date") -> DataFrame:
    """One row: whether a provider's calendar and declared end date are as fresh as the day, or as the data known to be available, demands. Dates that are null are missing."""
    one = calendar.agg(F.max(date).cast("date").alias("latest_calendar_date"))
    known = F.lit(None).cast("date") if available is None else available.cast("date")
    one = one.withColumns({"provider_end_time": ends.cast("date"), "latest_available_data_date": known, "age_days": F.datediff(today, "latest_calendar_date")})
    last, end, have, age = (F.col(c) for c in ("latest_calendar_date", "provider_end_time", "latest_available_data_date", "age_days"))
    text = lambda c: c.cast("string")
    detail = F.concat_ws(
        "; ", F.when(last.isNull(), "missing_calendar"), F.when(age < 0, "calendar_after_current_date"), F.when(last < have, F.concat(F.lit("calendar_behind_available_data:"), text(last), F.lit("!="), text(have))),
        F.when(last > have, F.concat(F.lit("calendar_after_available_data:"), text(last), F.lit("!="), text(have))), F.when(have.isNull() & (age > most_days), F.concat(F.lit("stale_calendar_age_"), text(age), F.lit(f"d_gt_{most_days}d"))),
        F.when(end.isNull(), "missing_provider_end_time").when(end != last, F.concat(F.lit("provider_end_time_mismatch_calendar:"), text(end), F.lit("!="), text(last))),
    )
    return one.withColumns({"detail": detail, "passed": detail == "", "freshness_basis": F.when(have.isNull(), "calendar_age_days").otherwise("latest_available_data_date")})


def vendor_coverage(df: DataFrame, domain: str, source: str, dates: Sequence[str], kind: str | None = None) -> DataFrame:
    """One row: rows and instruments of a vendor's source (and kind of event) in a table, the latest of its dates, and a note."""
    have = set(df.columns)
    ok = F.coalesce(F.col("source").cast("string") == source, F.lit(False)) if "source" in have else F.lit(False)
    if kind is not None:
        ok = ok & (F.coalesce(F.col("event_type") == kind, F.lit(False)) if "event_type" in have else F.lit(False))
    days = [_day(c) for c in dates if c in have]
    latest = F.greatest(*days) if len(days) > 1 else days[0] if days else F.lit(None).cast("date")
    names = F.count_distinct("instrument") if "instrument" in have else F.lit(0).cast("long")
    one = df.where(ok).agg(F.count(F.lit(1)).alias("rows"), names.alias("instruments"), F.max(latest).alias("latest_date"))
    note = F.when(F.col("rows") > 0, F.format_string("%d instruments / %d rows", "instruments", "rows")).otherwise("no vendor rows")
    return one.select(F.lit(domain).alias("domain"), F.lit(source).alias("source"), F.when(F.col("rows") > 0, "active").otherwise("missing").alias("status"), "rows", "instruments", "latest_date", note.alias("coverage_note"))


def vendor_gate(coverage: DataFrame, checks: Sequence[tuple[str, str, bool]], least: int = 1) -> DataFrame:
    """(check, status, value, threshold, detail) for each (domain, check, mandatory): a domain that is active with enough instruments passes; else mandatory ones fail and others call for caution."""
    specs = F.inline(F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(c).alias("check"), F.lit("mandatory" if m else "optional").alias("level")) for d, c, m in checks]))
    rows = coverage.sparkSession.range(1).select(specs).join(coverage, "domain", "left")  # a handful of rows
    value, status = F.coalesce("instruments", F.lit(0)), F.coalesce("status", F.lit("missing"))
    ok = (status == "active") & (value >= least)
    detail = F.concat(F.col("level"), F.lit("; domain="), "domain", F.lit("; source="), F.coalesce("source", F.lit("")), F.lit("; status="), status)
    return rows.select("check", F.when(ok, "pass").when(F.col("level") == "mandatory", "fail").otherwise("caution").alias("status"), value.cast("long").alias("value"), F.lit(least).cast("long").alias("threshold"), detail.alias("detail"))
