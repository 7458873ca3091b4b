"""Governance of domains, provider freshness and vendor gates, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import governance as gv
from ..sources.tables import company_events, nation_facts, table
from .facts import EVENTS, FACTS
from .factors import rounded

AS_OF = "2002-03-01"


def governed(spark, sf_dir):
    """Facts by nation under several rules, an old part of them, an empty one, and a domain that isn't there."""
    n = F.col("orders")
    facts = nation_facts(spark, sf_dir).withColumns({"source": F.when(n % 3 == 0, " Vendor ").when(n % 3 == 1, "scrape"), "note": F.when(n % 4 != 0, "x").otherwise(" ")})
    expected = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("instrument")).unionByName(spark.range(1).select(F.lit("99").alias("instrument")))
    pit = ("report_period", "available_at")
    rules = [
        (facts, gv.Domain("facts", ("instrument", "revenue"), pit, "available_at", 400, 0.9, "source", ("vendor",), 0.2)),
        (facts.where("orders % 3 = 1"), gv.Domain("strict", ("instrument", "gone"), (*pit, "note", "lost"), "report_period", 10, 1.0, "source", ("vendor", "broker"), 0.9, "lane", "off", "caution")),
        (facts.where("false"), gv.Domain("none", ("instrument",), pit, "available_at", 400, 0.5)),
        (facts.drop("instrument"), gv.Domain("nameless", date="odd", most_days=3, least_coverage=0.9)),
        (None, gv.Domain("absent", if_missing="blocked")),
    ]
    return rounded(gv.governance_report(rules, expected, F.lit(AS_OF).cast("date")), [])


GOVERNED = f"""WITH {FACTS}, f AS (SELECT *, CASE orders % 3 WHEN 0 THEN 'vendor' WHEN 1 THEN 'scrape' ELSE '' END AS source, CASE WHEN orders % 4 <> 0 THEN 'x' END AS note FROM pit), x AS (SELECT CAST(n_nationkey AS VARCHAR) AS instrument FROM nation UNION ALL SELECT '99'),
a AS (SELECT count(*) AS rows, (SELECT avg(CASE WHEN x.instrument IN (SELECT instrument FROM f) THEN 1e0 ELSE 0 END) FROM x) AS cov, max(available_at) AS m, avg(CASE WHEN source = 'vendor' THEN 1e0 ELSE 0 END) AS t FROM f),
b AS (SELECT count(*) AS rows, (SELECT avg(CASE WHEN x.instrument IN (SELECT instrument FROM f WHERE orders % 3 = 1) THEN 1e0 ELSE 0 END) FROM x) AS cov, (2 + avg(CASE WHEN note IS NULL THEN 0e0 ELSE 1 END)) / 4 AS p FROM f WHERE orders % 3 = 1)
SELECT 'facts' AS domain, 'facts' AS activation_lane, CASE WHEN d = '' THEN 'pass' ELSE 'fail' END AS status, CASE WHEN d = '' THEN 'active' ELSE 'shadow' END AS activation_status, round(cov, 6) AS coverage_ratio, 1e0 AS pit_field_completeness, CASE WHEN DATE '{AS_OF}' - m <= 400 THEN 'pass' ELSE 'stale' END AS freshness_status, round(t, 6) AS trusted_source_ratio, rows, d AS detail
 FROM (SELECT *, concat_ws('; ', CASE WHEN cov < 0.9 THEN 'coverage_below_0.9' END, CASE WHEN DATE '{AS_OF}' - m > 400 THEN 'stale' END, CASE WHEN t < 0.2 THEN 'trusted_source_below_0.2' END) AS d FROM a)
UNION ALL SELECT 'strict', 'lane', 'fail', 'caution', round(cov, 6), round(p, 6), 'stale', 0, rows, 'missing_required=[''gone'']; coverage_below_1; pit_incomplete; stale; trusted_source_below_0.9' FROM b
UNION ALL SELECT 'none', 'none', 'fail', 'shadow', 0, 0, 'missing', 1, 0, 'empty; coverage_below_0.5; pit_incomplete; freshness_missing'
UNION ALL SELECT 'nameless', 'nameless', 'fail', 'shadow', 1, 1, 'missing', 1, rows, 'freshness_missing' FROM a UNION ALL SELECT 'absent', 'absent', 'missing', 'blocked', 0, 0, 'missing', 0, 0, 'file missing'"""


def provider_state(spark, sf_dir):
    """The orders' calendar seen from several days, with and without known data, and an empty calendar."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    last = days.agg(F.max("date").alias("m"))
    day = lambda t: F.lit(t).try_cast("date")
    parts = [
        gv.provider_freshness(days, day("2001-12-31"), day("2001-12-30")).withColumn("kind", F.lit("end")), gv.provider_freshness(days, day("1990-01-01"), day("odd")).withColumn("kind", F.lit("early")),
        gv.provider_freshness(days, day("2030-01-01"), day("2001-01-01"), 5).withColumn("kind", F.lit("late")), gv.provider_freshness(days, day("2030-01-01"), day("2001-01-01"), available=day("2025-01-01")).withColumn("kind", F.lit("behind")),
        gv.provider_freshness(days.where("false"), day("2030-01-01"), day("2001-01-01")).withColumn("kind", F.lit("none")),
    ]
    return rounded(reduce(DataFrame.unionByName, parts).crossJoin(last.select(F.year("m").alias("year"))), ["latest_calendar_date", "provider_end_time", "latest_available_data_date"])


def _state(kind: str, today: str, end: str, most: int, known: str, rows: str = "TRUE") -> str:
    e, k = (f"DATE '{end}'" if end else "CAST(NULL AS DATE)"), (f"DATE '{known}'" if known else "CAST(NULL AS DATE)")
    return f"""SELECT '{kind}' AS kind, l AS latest_calendar_date, e AS provider_end_time, k AS latest_available_data_date, CAST(a AS BIGINT) AS age_days, d AS detail, d = '' AS passed, CASE WHEN k IS NULL THEN 'calendar_age_days' ELSE 'latest_available_data_date' END AS freshness_basis, year FROM (
 SELECT *, concat_ws('; ', CASE WHEN l IS NULL THEN 'missing_calendar' END, CASE WHEN a < 0 THEN 'calendar_after_current_date' END, CASE WHEN l < k THEN 'calendar_behind_available_data:' || l || '!=' || k END, CASE WHEN l > k THEN 'calendar_after_available_data:' || l || '!=' || k END, CASE WHEN k IS NULL AND a > {most} THEN 'stale_calendar_age_' || a || 'd_gt_{most}d' END, CASE WHEN e IS NULL THEN 'missing_provider_end_time' WHEN e <> l THEN 'provider_end_time_mismatch_calendar:' || e || '!=' || l END) AS d FROM (
  SELECT max(CASE WHEN {rows} THEN CAST(o_orderdate AS DATE) END) AS l, {e} AS e, {k} AS k, DATE '{today}' - max(CASE WHEN {rows} THEN CAST(o_orderdate AS DATE) END) AS a, year(max(o_orderdate)) AS year FROM orders))"""


STATE = " UNION ALL ".join([_state("end", "2001-12-31", "2001-12-30", 3, ""), _state("early", "1990-01-01", "", 3, ""), _state("late", "2030-01-01", "2001-01-01", 5, ""), _state("behind", "2030-01-01", "2001-01-01", 3, "2025-01-01"), _state("none", "2030-01-01", "2001-01-01", 3, "", "FALSE")])

CHECKS = (("trades", "trade_coverage", True), ("faults", "fault_coverage", True), ("signups", "signup_coverage", False), ("gone", "gone_coverage", True))


def vendor_checks(spark, sf_dir):
    e = company_events(spark, sf_dir).withColumns({"source": F.when(F.col("event_id").cast("long") % 2 == 0, "v").otherwise("w"), "ann_date": F.date_add("event_date", 2)})
    rows = [gv.vendor_coverage(e, "trades", "v", ["event_date", "ann_date", "no"], "purchase"), gv.vendor_coverage(e, "faults", "u", ["event_date"], "error"), gv.vendor_coverage(e.where("instrument = '3'"), "signups", "w", ["event_date"], "signup")]
    cover = reduce(DataFrame.unionByName, rows)
    gate = gv.vendor_gate(cover, CHECKS, 2)
    both = gate.join(cover.select("domain", "rows", "latest_date", "coverage_note"), F.expr("detail like concat('%domain=', domain, ';%')"), "left").drop("domain")
    return rounded(both, ["latest_date"])


VENDOR = f"""WITH {EVENTS}, v AS (SELECT *, CASE WHEN CAST(event_id AS BIGINT) % 2 = 0 THEN 'v' ELSE 'w' END AS source FROM ev),
c AS (SELECT 'trades' AS domain, 'v' AS source, count(*) AS rows, count(DISTINCT instrument) AS n, CAST(max(event_date) + 2 AS DATE) AS d FROM v WHERE source = 'v' AND event_type = 'purchase' UNION ALL SELECT 'faults', 'u', 0, 0, NULL UNION ALL SELECT 'signups', 'w', count(*), count(DISTINCT instrument), max(event_date) FROM v WHERE source = 'w' AND event_type = 'signup' AND instrument = '3'),
s AS (SELECT * FROM (VALUES ('trades', 'trade_coverage', 'mandatory'), ('faults', 'fault_coverage', 'mandatory'), ('signups', 'signup_coverage', 'optional'), ('gone', 'gone_coverage', 'mandatory')) t(domain, chk, level))
SELECT chk AS "check", CASE WHEN coalesce(rows > 0 AND n >= 2, false) THEN 'pass' WHEN level = 'mandatory' THEN 'fail' ELSE 'caution' END AS status, coalesce(n, 0) AS value, CAST(2 AS BIGINT) AS threshold, level || '; domain=' || domain || '; source=' || coalesce(source, '') || '; status=' || CASE WHEN coalesce(rows, 0) > 0 THEN 'active' ELSE 'missing' END AS detail,
 rows, d AS latest_date, CASE WHEN rows > 0 THEN n || ' instruments / ' || rows || ' rows' WHEN rows IS NOT NULL THEN 'no vendor rows' END AS coverage_note FROM s LEFT JOIN c USING (domain)"""


def queries() -> dict:
    return {"governed": governed, "provider_state": provider_state, "vendor_checks": vendor_checks}


def oracle_sql() -> dict[str, str]:
    return {"governed": GOVERNED, "provider_state": STATE, "vendor_checks": VENDOR}
