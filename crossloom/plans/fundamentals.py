"""Queries over the nations' quarterly facts as vendor tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cross_section as xs
from ..operators import evaluation as ev
from ..operators import fundamentals as fd
from ..operators import signals as sg
from ..sources.tables import nation_facts, table
from .facts import FACTS
from .factors import W, rounded

FIELDS = {"roe": ["roe", "roe_waa"], "gross_margin": ["gross_margin"], "debt_ratio": ["debt_ratio", "debt"]}
QUARTER = ["instrument", "report_period", "announce_date", "available_at"]


def raw_facts(spark, sf_dir) -> DataFrame:
    """The facts as a vendor writes them: text, percent signs, dashes, two date formats, some announcements missing; every row twice."""
    n = F.col("orders")
    df = nation_facts(spark, sf_dir).select(
        F.when(n % 19 == 0, " ").otherwise(F.concat(F.lit(" n"), "instrument")).alias("code"),
        F.when(n % 2 == 0, F.date_format("report_period", "yyyyMMdd")).otherwise(F.date_format("report_period", "yyyy-MM-dd")).alias("end_date"),
        F.when(n % 3 == 0, "").otherwise(F.date_format(F.date_add("report_period", (n % 50).cast("int")), "yyyy-MM-dd")).alias("ann_date"),
        F.when(n % 5 == 0, "--").otherwise(F.concat((n % 30).cast("string"), F.lit(".5%"))).alias("roe"),
        F.concat((n % 17).cast("string"), F.lit("%")).alias("roe_waa"), F.concat(F.lit("1,"), F.lpad((n % 100).cast("string"), 3, "0")).alias("gross_margin"), F.lit("x").alias("debt"),
    )
    return df.union(df.withColumn("roe", F.lit("1")))


def fund_normalized(spark, sf_dir):
    return rounded(fd.normalize(raw_facts(spark, sf_dir), FIELDS, "vendor"), QUARTER)


NORMALIZED = f"""WITH {FACTS}, r AS (SELECT upper('n' || instrument) AS instrument, report_period, CASE WHEN orders % 3 = 0 THEN available_at ELSE CAST(report_period + CAST(orders % 50 AS INT) AS DATE) END AS announce_date, orders AS n FROM pit WHERE orders % 19 <> 0),
b AS (SELECT *, CASE WHEN n % 5 = 0 THEN n % 17 ELSE n % 30 + 0.5 END AS roe FROM r)
SELECT instrument, report_period, announce_date, announce_date AS available_at, CAST(greatest(roe, 1) AS DOUBLE) AS roe, CAST(1000 + n % 100 AS DOUBLE) AS gross_margin, CAST(NULL AS DOUBLE) AS debt_ratio, 'vendor' AS source FROM b"""


def raw_dividends(spark, sf_dir) -> DataFrame:
    n = F.col("orders")
    return nation_facts(spark, sf_dir).where(n % 4 != 0).select(
        "instrument", F.date_format("available_at", "yyyy/MM/dd").alias("ann_date"), F.when(n % 6 == 1, F.date_format(F.date_add("available_at", 20), "yyyyMMdd")).alias("ex_date"),
        F.when(n % 10 == 0, "-").otherwise((n % 7).cast("string")).alias("cash"),
    )


def fund_dividends(spark, sf_dir):
    return rounded(fd.dividends(raw_dividends(spark, sf_dir), "payer"), ["instrument", "announce_date", "available_at"])


PAID = "paid AS (SELECT instrument, available_at AS announce_date, CASE WHEN orders % 6 = 1 THEN CAST(available_at + 20 AS DATE) ELSE available_at END AS available_at, CAST(orders % 7 AS DOUBLE) AS dividend_cash_per_10, 'payer' AS source FROM pit WHERE orders % 4 <> 0 AND orders % 10 <> 0)"


def closes(spark, sf_dir) -> DataFrame:
    """Monthly mean order values of each nation, as prices."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").cast("string").alias("instrument"), F.trunc(F.to_date("o_orderdate"), "month").alias("datetime")).agg(F.round(F.avg("o_totalprice"), 8).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


CLOSES = "px AS (SELECT CAST(c_nationkey AS VARCHAR) AS instrument, CAST(date_trunc('month', o_orderdate) AS DATE) AS datetime, round(avg(o_totalprice), 8) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def fund_valuation(spark, sf_dir):
    """Valuation fields where the facts lack them, and dividend quality, as known on the day."""
    n = F.col("orders")
    facts = nation_facts(spark, sf_dir).select("instrument", "report_period", "available_at", (n * 10.0).alias("eps"), F.when(n % 3 != 0, n * 7.0).alias("operating_cashflow_per_share"), F.when(n % 4 == 0, 1.0).alias("ep"), F.lit(None).cast("double").alias("cfp"), F.when(n % 5 == 0, 2.0).alias("dividend_yield"), F.when(n % 2 == 0, "old").otherwise("").alias("valuation_source"), F.lit(None).cast("double").alias("dividend_stability"), F.lit(None).cast("double").alias("dividend_cashflow_coverage"))
    paid = fd.dividends(raw_dividends(spark, sf_dir), "payer")
    made = fd.valuation(facts, closes(spark, sf_dir).select("instrument", F.col("datetime").alias("trade_date"), "close"), paid)
    return rounded(fd.dividend_quality(made, paid), QUARTER)


VALUATION = f"""WITH {FACTS}, {PAID}, {CLOSES},
one AS (SELECT *, lag(dividend_cash_per_10) OVER (PARTITION BY instrument ORDER BY available_at, dividend_cash_per_10) AS before FROM paid),
h AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY instrument, available_at ORDER BY dividend_cash_per_10 DESC, before DESC NULLS LAST) = 1),
v AS (SELECT p.instrument, p.report_period, p.available_at, p.orders AS n, close, dividend_cash_per_10 AS d, before FROM pit p ASOF LEFT JOIN px ON p.instrument = px.instrument AND p.available_at >= px.datetime ASOF LEFT JOIN h ON p.instrument = h.instrument AND p.available_at >= h.available_at),
x AS (SELECT *, n * 10.0 AS eps, CASE WHEN n % 3 <> 0 THEN n * 7.0 END AS ops, CASE WHEN n % 4 = 0 THEN 1.0 END AS ep0, CASE WHEN n % 5 = 0 THEN 2.0 END AS dy0 FROM v)
SELECT instrument, report_period, available_at, CAST(eps AS DOUBLE) AS eps, CAST(ops AS DOUBLE) AS operating_cashflow_per_share, round(coalesce(ep0, CAST(eps AS DOUBLE) / close * 100), 6) AS ep, round(CAST(ops AS DOUBLE) / close * 100, 6) AS cfp, round(coalesce(dy0, d / 10 / close * 100), 6) AS dividend_yield,
 concat_ws(';', CASE WHEN n % 2 = 0 THEN 'old' END, CASE WHEN ep0 IS NULL AND close IS NOT NULL THEN 'ep_derived' END, CASE WHEN ops IS NOT NULL AND close IS NOT NULL THEN 'cfp_derived' END, CASE WHEN dy0 IS NULL AND d IS NOT NULL AND close IS NOT NULL THEN 'dividend_yield_derived' END) AS valuation_source,
 round(CASE WHEN before <> 0 THEN greatest(0, least(1, 1 - abs(d - before) / abs(before))) END, 6) AS dividend_stability, round(CASE WHEN d <> 0 THEN CAST(ops AS DOUBLE) / (d / 10) END, 6) AS dividend_cashflow_coverage FROM x"""


def fund_statements(spark, sf_dir):
    """Three statements (one with gaps) joined, and used where the facts lack the ratios."""
    keys, n = ["instrument", "report_period"], F.col("orders")
    facts = nation_facts(spark, sf_dir)
    income, balance, cash = facts.select(*keys, ((n % 11) - 5).cast("double").alias("net_income")), facts.where(n % 7 != 0).select(*keys, (n % 13).cast("double").alias("total_assets")), facts.select(*keys, (n % 9).cast("double").alias("operating_cashflow"))
    metrics = fd.statement_metrics(income, balance, cash, "statement_accrual")
    base = facts.select(*keys, F.when(n % 2 == 0, 3.0).alias("accrual_ratio"), F.lit(None).cast("double").alias("operating_cashflow_to_net_profit"), F.when(n % 3 == 0, "").otherwise("vendor").alias("source"))
    return rounded(fd.backfill(base, metrics), keys)


STATEMENTS = f"""WITH {FACTS}, m AS (SELECT instrument, report_period, orders AS n, ((n % 11) - 5 - n % 9) / CAST(n % 13 AS DOUBLE) * 100 AS a, CASE WHEN n % 11 <> 5 THEN n % 9 / CAST((n % 11) - 5 AS DOUBLE) * 100 END AS o FROM pit WHERE orders % 7 <> 0 AND orders % 13 <> 0)
SELECT p.instrument, p.report_period, round(CASE WHEN orders % 2 = 0 THEN 3.0 ELSE a END, 6) AS accrual_ratio, round(o, 6) AS operating_cashflow_to_net_profit,
 CASE WHEN (orders % 2 <> 0 AND a IS NOT NULL) OR o IS NOT NULL THEN concat_ws(';', CASE WHEN orders % 3 <> 0 THEN 'vendor' END, 'statement_accrual') WHEN orders % 3 = 0 THEN '' ELSE 'vendor' END AS source FROM pit p LEFT JOIN m USING (instrument, report_period)"""


def fund_disclosures(spark, sf_dir):
    n = F.col("orders")
    raw = nation_facts(spark, sf_dir).select("instrument", F.date_format("report_period", "yyyyMMdd").alias("report_period"), F.when(n % 4 != 0, F.date_format("available_at", "yyyyMMdd")).alias("planned"), F.when(n % 3 == 0, F.date_format(F.date_add("available_at", -3), "yyyy-MM-dd")).alias("actual"))
    return rounded(fd.disclosure_events(raw, "calendar"), ["event_date", "report_period"])


DISCLOSURES = f"""WITH {FACTS}, d AS (SELECT instrument, report_period, CASE WHEN orders % 3 = 0 THEN CAST(available_at - 3 AS DATE) WHEN orders % 4 <> 0 THEN available_at END AS event_date FROM pit)
SELECT instrument, event_date, report_period, 'disclosure_date' AS event_type, 'info' AS severity, 'calendar' AS source, 'disclosure_' || instrument || '_' || strftime(report_period, '%Y%m%d') || '_' || strftime(event_date, '%Y%m%d') AS event_id FROM d WHERE event_date IS NOT NULL"""

COMPONENTS = (fd.Component("revenue", 1, 0.7), fd.Component("orders", -1, 0.5))
MEMBERS = (fd.Member("mom", family="trend", weight=0.6), fd.Member("size", family="trend", weight=0.9, direction=-1, status="challenger"), fd.Member("quality", "fundamental", family="quality", weight=0.5, components=COMPONENTS), fd.Member("off", active=False))


def combo(spark, sf_dir) -> DataFrame:
    facts = nation_facts(spark, sf_dir).withColumn("revenue", F.when(F.col("orders") % 9 != 0, F.col("revenue")))
    return fd.combo_frame(closes(spark, sf_dir), facts, COMPONENTS)


def combo_frame(spark, sf_dir):
    return rounded(combo(spark, sf_dir).select("instrument", "datetime", "combo"), ["instrument", "datetime"])


COMBO = f"""{FACTS}, {CLOSES}, fa AS (SELECT * FROM pit QUALIFY row_number() OVER (PARTITION BY instrument, available_at ORDER BY report_period DESC) = 1),
fr AS (SELECT * FROM pit WHERE orders % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY instrument, available_at ORDER BY report_period DESC) = 1),
k AS (SELECT px.*, r.revenue, o.orders FROM px ASOF LEFT JOIN fr r ON px.instrument = r.instrument AND px.datetime >= r.available_at ASOF LEFT JOIN fa o ON px.instrument = o.instrument AND px.datetime >= o.available_at),
z AS (SELECT *, CASE WHEN stddev_pop(revenue) OVER (PARTITION BY datetime) > 1e-12 THEN (revenue - avg(revenue) OVER (PARTITION BY datetime)) / stddev_pop(revenue) OVER (PARTITION BY datetime) END AS z1, CASE WHEN stddev_pop(orders) OVER (PARTITION BY datetime) > 1e-12 THEN (avg(orders) OVER (PARTITION BY datetime) - orders) / stddev_pop(orders) OVER (PARTITION BY datetime) END AS z2 FROM k),
cb AS (SELECT instrument, datetime, close, volume, coalesce(z1, 0) * 0.7 + coalesce(z2, 0) * 0.5 AS combo FROM z WHERE revenue IS NOT NULL AND orders IS NOT NULL)"""


def combo_evaluation(spark, sf_dir):
    """The combination, neutral to size, against the next months' returns."""
    df = xs.neutralize(xs.size_proxy(combo(spark, sf_dir)), "combo", ["size_proxy"], None, "signal")
    rows = ev.long_horizons(df.select("instrument", "datetime", "close", "signal"), [1, 3])
    return rounded(ev.ic_summary(ev.daily_ic(rows, "signal")), ["horizon"], 5)


COMBO_EVALUATION = f"""WITH {COMBO}, s AS (SELECT *, ln(1 + abs(close) * abs(volume)) AS size FROM cb), y AS (SELECT *, combo - avg(combo) OVER (PARTITION BY datetime) AS y, size - avg(size) OVER (PARTITION BY datetime) AS x, count(*) OVER (PARTITION BY datetime) AS n FROM s),
g AS (SELECT instrument, datetime, close, CASE WHEN n >= 2 THEN y - CASE WHEN sum(x * x) OVER (PARTITION BY datetime) > 1e-12 THEN sum(x * y) OVER (PARTITION BY datetime) / sum(x * x) OVER (PARTITION BY datetime) ELSE 0 END * x END AS signal FROM y),
l AS (SELECT *, 1 AS horizon, lead(close) OVER {W} / close - 1 AS future FROM g UNION ALL SELECT *, 3, lead(close, 3) OVER {W} / close - 1 FROM g),
r AS (SELECT *, rank() OVER (PARTITION BY horizon, datetime ORDER BY signal) + (count(*) OVER (PARTITION BY horizon, datetime, signal) - 1) / 2 AS rs, rank() OVER (PARTITION BY horizon, datetime ORDER BY future) + (count(*) OVER (PARTITION BY horizon, datetime, future) - 1) / 2 AS rf FROM l WHERE future IS NOT NULL AND signal IS NOT NULL),
d AS (SELECT horizon, datetime, CASE WHEN stddev_pop(signal) * stddev_pop(future) > 1e-12 THEN covar_pop(signal, future) / (stddev_pop(signal) * stddev_pop(future)) END AS ic, CASE WHEN stddev_pop(rs) * stddev_pop(rf) > 1e-12 THEN covar_pop(rs, rf) / (stddev_pop(rs) * stddev_pop(rf)) END AS rank_ic, count(*) AS n FROM r GROUP BY 1, 2)
SELECT CAST(horizon AS BIGINT) AS horizon, round(avg(ic), 5) AS ic_mean, round(stddev_samp(ic), 5) AS ic_std, round(avg(ic) / stddev_samp(ic), 5) AS icir, round(avg(rank_ic), 5) AS rank_ic_mean, round(stddev_samp(rank_ic), 5) AS rank_ic_std, round(avg(rank_ic) / stddev_samp(rank_ic), 5) AS rank_icir, CAST(sum(n) AS BIGINT) AS observations FROM d GROUP BY 1"""


def combo_signal(spark, sf_dir):
    """Members of a combination as factors of the signal; one comes from the facts known at the run date."""
    factors, rules = fd.combo_rules(MEMBERS, sg.SignalRules(family_cap=None))
    base = closes(spark, sf_dir).where("datetime = '1997-06-01'").select(F.col("datetime").alias("date"), "instrument", (F.col("close") / 1000).alias("mom"), F.col("volume").alias("size"), F.lit(True).alias("tradable"))
    df = fd.combo_exposures(base, nation_facts(spark, sf_dir), MEMBERS[2], F.lit("1997-06-01").cast("date"))
    return rounded(sg.build_signal(df, factors, rules).select("date", "instrument", "quality", "ensemble_score"), ["date"])


def _z(c: str) -> str:
    return f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0)"


COMBO_SIGNAL = f"""WITH {FACTS}, {CLOSES}, f AS (SELECT * FROM pit WHERE available_at <= DATE '1997-06-01' QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY available_at DESC, report_period DESC) = 1),
b AS (SELECT px.datetime AS date, px.instrument, close / 1000 AS mom, -volume AS size, revenue, -orders AS orders FROM px LEFT JOIN f USING (instrument) WHERE px.datetime = DATE '1997-06-01'),
q AS (SELECT *, {_z("revenue")} * 0.7 + {_z("orders")} * 0.5 AS quality FROM b)
SELECT date, instrument, round(quality, 6) AS quality, round((greatest(-3, least(3, {_z("mom")})) + greatest(-3, least(3, 0.5 * {_z("size")}))) / 2 * 0.9 + greatest(-3, least(3, {_z("quality")})) * 0.5, 6) AS ensemble_score FROM q"""


def fund_industries(spark, sf_dir):
    """The preferred column is blank everywhere, so the second one counts; the last row of an instrument wins."""
    master = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("instrument"), F.lit(" ").alias("industry_sw"), F.concat(F.lit(" g"), (F.col("s_suppkey") % 7).cast("string")).alias("industry"), F.lit("z").alias("industry_csrc"), "s_suppkey")
    return fd.industry_map(master, "s_suppkey")


def queries() -> dict:
    return {"fund_normalized": fund_normalized, "fund_dividends": fund_dividends, "fund_valuation": fund_valuation, "fund_statements": fund_statements, "fund_disclosures": fund_disclosures, "combo_frame": combo_frame, "combo_evaluation": combo_evaluation, "combo_signal": combo_signal, "fund_industries": fund_industries}


def oracle_sql() -> dict[str, str]:
    return {
        "fund_normalized": NORMALIZED, "fund_dividends": f"WITH {FACTS}, {PAID} SELECT * FROM paid", "fund_valuation": VALUATION, "fund_statements": STATEMENTS, "fund_disclosures": DISCLOSURES,
        "combo_frame": f"WITH {COMBO} SELECT instrument, datetime, round(combo, 6) AS combo FROM cb", "combo_evaluation": COMBO_EVALUATION, "combo_signal": COMBO_SIGNAL,
        "fund_industries": "SELECT CAST(s_nationkey AS VARCHAR) AS instrument, 'g' || (arg_max(s_suppkey, s_suppkey) % 7) AS industry FROM supplier GROUP BY 1",
    }
