"""Notices and disclosure scores over events and orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import disclosures as ds
from ..sources.tables import company_events, table
from .facts import DATES, EVENTS, event_dates
from .factors import rounded

KINDS = ("buyback", "lawsuit", ds.REPORT, "announcement", " Guarantee ", "dividend_plan", "st_status")
UNITS = ("万元", "亿", "亿元", "km")


def disclosed(spark, sf_dir) -> DataFrame:
    """Events as disclosures with titles and evidence; every ninth has neither."""
    e, k = company_events(spark, sf_dir), F.col("event_id").cast("long")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    title = F.concat(F.lit("about "), (k % 9770).cast("string"), F.lit(" "), pick(UNITS, k), F.lit(" of 12.5万"))
    return e.withColumns({"event_type": pick(KINDS, k), "title": F.when(k % 9 != 0, title), "evidence": F.when(k % 3 == 0, F.concat((k % 17).cast("string"), F.lit(".5 %")))})


def disclosure_intensity(spark, sf_dir):
    """What each user had disclosed by three days and by an unknown one; some scores are there already."""
    rows = event_dates(spark, sf_dir).withColumnRenamed("date", "available_at")
    n = F.col("instrument").cast("long")
    rows = rows.withColumn("available_at", F.when((n % 5 == 0) & (F.month("available_at") == 2), None).otherwise(F.col("available_at"))).withColumn("financial_disclosure_event_score_90d", F.when(n % 4 == 0, "7.25").when(n % 4 == 1, "none"))
    rows = rows.unionByName(rows.select(F.concat(F.lit("new"), "instrument").alias("instrument"), "available_at", "financial_disclosure_event_score_90d").where("instrument like 'new1%'"))
    return rounded(ds.disclosure_fields(rows, disclosed(spark, sf_dir)), ["available_at"])


_PLAIN = "CASE WHEN lower(trim(event_type)) IN ({}) THEN 1 ELSE 0 END"
_LIST = ", ".join(f"'{x}'" for x in ds.POSITIVE), ", ".join(f"'{x}'" for x in ds.NEGATIVE)
INTENSITY = f"""WITH {EVENTS}, {DATES},
dis AS (SELECT * REPLACE ([{", ".join(f"'{x}'" for x in KINDS)}][CAST(event_id AS BIGINT) % 7 + 1] AS event_type), CAST(event_id AS BIGINT) AS k FROM ev),
way AS (SELECT *, CASE WHEN lower(trim(event_type)) IN ({_LIST[0]}) THEN 1 WHEN lower(trim(event_type)) IN ({_LIST[1]}) THEN -1 WHEN severity IN ('risk', 'block') THEN -1 ELSE 0 END AS way, CASE severity WHEN 'info' THEN 0.5 WHEN 'watch' THEN 0.7 WHEN 'risk' THEN 1e0 ELSE 1.5 END AS w,
  greatest(1e0, CASE WHEN k % 9 <> 0 THEN least(3e0, 1 + log10(greatest(125000e0, k % 9770 * [1e4, 1e8, 1e8, 0e0][k % 4 + 1]) / 1e7)) ELSE 1 END, CASE WHEN k % 3 = 0 THEN least(3e0, 1 + (k % 17 + 0.5) / 3) ELSE 1 END) AS m FROM dis),
q0 AS (SELECT instrument, CASE WHEN CAST(instrument AS BIGINT) % 5 = 0 AND month(date) = 2 THEN NULL ELSE date END AS available_at, CASE WHEN CAST(instrument AS BIGINT) % 4 = 0 THEN 7.25 END AS own FROM dates),
q AS (SELECT * FROM q0 UNION ALL SELECT 'new' || instrument, available_at, own FROM q0 WHERE 'new' || instrument LIKE 'new1%'),
g AS (SELECT q.instrument, q.available_at, coalesce(sum(CASE WHEN way = 1 THEN w * r ELSE 0 END), 0) AS p, coalesce(sum(CASE WHEN way = -1 THEN w * r ELSE 0 END), 0) AS n, coalesce(sum(CASE WHEN way = 1 THEN w * r * m ELSE 0 END), 0) AS pi, coalesce(sum(CASE WHEN way = -1 THEN w * r * m ELSE 0 END), 0) AS ni
  FROM (SELECT DISTINCT instrument, available_at FROM q WHERE available_at IS NOT NULL) q LEFT JOIN (SELECT way.*, unnest(range(0, 91)) AS age FROM way) e ON e.instrument = q.instrument AND e.event_date + CAST(e.age AS INT) = q.available_at LEFT JOIN (SELECT unnest(range(0, 91)) AS a, 1 - unnest(range(0, 91)) / 90e0 AS r) x ON x.a = e.age GROUP BY 1, 2),
l AS (SELECT q.instrument, q.available_at, CAST(q.available_at - max(e.event_date) AS DOUBLE) AS d FROM (SELECT DISTINCT instrument, available_at FROM q) q JOIN dis e ON e.instrument = q.instrument AND e.event_type = '{ds.REPORT}' AND e.event_date <= q.available_at GROUP BY 1, 2)
SELECT q.instrument, q.available_at, round(d, 6) AS financial_disclosure_days_since, round(CASE WHEN d IS NOT NULL THEN greatest(0, least(1, 1 - d / 30)) END, 6) AS financial_disclosure_recency_30d, round(p, 6) AS financial_disclosure_positive_score_90d, round(n, 6) AS financial_disclosure_negative_score_90d, round(coalesce(own, p - n), 6) AS financial_disclosure_event_score_90d,
 round(pi, 6) AS financial_disclosure_positive_intensity_score_90d, round(ni, 6) AS financial_disclosure_negative_intensity_score_90d, round(pi - ni, 6) AS financial_disclosure_net_intensity_score_90d FROM q LEFT JOIN g USING (instrument, available_at) LEFT JOIN l USING (instrument, available_at)"""

#: All words of the rules, one after another.
WORDS = tuple(w for words, *_ in ds.NOTICES for w in words)


def notices(spark, sf_dir) -> DataFrame:
    """An order's notice: two of the rules' words in a title, a third in some categories, and overlapping ones."""
    k = F.col("o_orderkey")
    words = F.array(*[F.lit(w) for w in WORDS])
    word = lambda n: F.element_at(words, (n % len(WORDS) + 1).cast("int"))
    title = F.when(k % 11 == 0, F.col("o_orderpriority")).when(k % 13 == 0, "预亏损收窄").otherwise(F.concat(word(k), F.lit("关于"), word(F.floor(k / 7)), "o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", title.alias("title"), F.when(k % 5 == 0, word(F.floor(k / 3))).alias("category"), F.when(k % 17 != 0, F.to_date("o_orderdate")).alias("event_date"))


def notice_rules(spark, sf_dir):
    """Kind, severity and end of every order's notice."""
    return rounded(ds.classify_notices(notices(spark, sf_dir)).select("o_orderkey", "event_type", "severity", "active_until"), ["active_until"])


_SAYS = ["(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")" for words, *_ in ds.NOTICES]
_CASE = lambda i: "CASE " + " ".join(f"WHEN {says} THEN '{rule[i]}'" for says, rule in zip(_SAYS, ds.NOTICES, strict=True)) + f" ELSE '{ds.NOTICE[i - 1]}' END"
_WORD = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
RULES = f"""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority WHEN o_orderkey % 13 = 0 THEN '预亏损收窄' ELSE {_WORD}[o_orderkey % {len(WORDS)} + 1] || '关于' || {_WORD}[(o_orderkey // 7) % {len(WORDS)} + 1] || o_orderpriority END || ' ' || CASE WHEN o_orderkey % 5 = 0 THEN {_WORD}[(o_orderkey // 3) % {len(WORDS)} + 1] ELSE '' END AS t, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders),
c AS (SELECT o_orderkey, d, {_CASE(1)} AS event_type, {_CASE(2)} AS severity FROM n)
SELECT o_orderkey, event_type, severity, CAST(d + CASE WHEN severity = 'block' OR event_type IN ('disciplinary_action', 'delisting_risk', 'trading_suspension', 'st_status') THEN 90 WHEN severity = 'risk' THEN 60 WHEN severity = 'watch' THEN 45 ELSE 30 END AS DATE) AS active_until FROM c"""


def queries() -> dict:
    return {"disclosure_intensity": disclosure_intensity, "notice_rules": notice_rules}


def oracle_sql() -> dict[str, str]:
    return {"disclosure_intensity": INTENSITY, "notice_rules": RULES}
