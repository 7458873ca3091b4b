"""Queries around the brands' portfolios: risk, gates, tickets, intraday, trading over all months, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import desk as dk
from ..sources.tables import brand_bars, table
from .books import FILLS, NEXT, PORTFOLIO, SIGNALS, TWO, brand_groups, checked, current, made_fills, made_orders, portfolio, signal, target_on
from .factors import rounded

RULES = dk.RiskRules(most_weight=0.1, least_positions=5, most_turnover=0.4, least_amount=2e6, most_amount_share=0.3, most_cost=15_000)


def marked(df: DataFrame) -> DataFrame:
    """Positions with flags: some blocked by an event, some announced, some locked."""
    n = F.length("instrument")
    return df.withColumns({"event_blocked": F.when(F.endswith("instrument", F.lit("3")), "yes").otherwise("no"), "announcement_flag": (n == 8).cast("string"), "limit_up": F.when(F.endswith("instrument", F.lit("1")), 1).otherwise(0), "event_count": F.when(F.endswith("instrument", F.lit("2")), 2)})


MARKED = "mk AS (SELECT *, instrument LIKE '%3' AS eb, length(instrument) = 8 AS af, instrument LIKE '%1' AS lu, CASE WHEN instrument LIKE '%2' THEN 2 ELSE 0 END AS ec FROM tn)"


def report(spark, sf_dir) -> DataFrame:
    return dk.risk_report(marked(target_on(spark, sf_dir, NEXT)), checked(spark, sf_dir).where(F.col("date") == NEXT), current(spark, sf_dir), RULES)


def desk_risk(spark, sf_dir):
    return rounded(report(spark, sf_dir), [])


def desk_gate(spark, sf_dir):
    """The decision on the whole report, and on the checks of exposure only."""
    rows = report(spark, sf_dir)
    parts = rows.withColumn("scope", F.lit("all")).unionByName(rows.where("check like '%factor%' or check like '%industry%'").withColumn("scope", F.lit("exposure")))
    return dk.classify_gate(parts, ["scope"])


REPORT = f"""WITH {TWO}, {MARKED}, sg AS (SELECT * FROM e WHERE date = DATE '{NEXT}'),
ch AS (SELECT coalesce(sum(abs(coalesce(tn.target_weight, 0) - coalesce(tc.target_weight, 0))), 0) AS t FROM tn FULL JOIN tc USING (instrument)),
ind AS (SELECT industry, sum(target_weight) AS w FROM tn GROUP BY 1),
fx AS (SELECT 'family' AS k, 'momentum' AS n, sum(abs(target_weight * family_momentum_score)) AS g FROM tn UNION ALL SELECT 'family', 'volatility', sum(abs(target_weight * family_volatility_score)) FROM tn UNION ALL SELECT 'logic', 'trend_following', sum(abs(target_weight * logic_trend_following_score)) FROM tn UNION ALL SELECT 'logic', 'risk_structure', sum(abs(target_weight * logic_risk_structure_score)) FROM tn),
fc AS (SELECT k, count(*) FILTER (g > 0) AS n, max(g) / nullif(sum(g), 0) AS c, arg_max(n, g) AS top FROM fx GROUP BY 1),
rows AS (
 SELECT 'max_single_weight' AS "check", coalesce(max(target_weight), 0) <= 0.1 + 1e-12 AS ok, coalesce(max(target_weight), 0) AS value, 0.1 AS threshold, '' AS detail FROM mk
 UNION ALL SELECT 'min_positions', count(*) >= 5, count(*), 5, '' FROM mk
 UNION ALL SELECT 'no_negative_weights', count(*) FILTER (target_weight < 0) = 0, count(*) FILTER (target_weight < 0), 0, '' FROM mk
 UNION ALL SELECT 'event_blocked_positions', count(*) FILTER (eb) = 0, count(*) FILTER (eb), 0, coalesce(string_agg(CASE WHEN eb THEN instrument END, '; ' ORDER BY instrument), '') FROM mk
 UNION ALL SELECT 'min_amount_20d', bool_and(amount_20d >= 2e6), min(amount_20d), 2e6, coalesce(string_agg(CASE WHEN amount_20d < 2e6 THEN instrument END, '; ' ORDER BY instrument), '') FROM mk
 UNION ALL SELECT 'max_position_amount_share', bool_and(abs(target_weight) * 1e7 / amount_20d <= 0.3), max(abs(target_weight) * 1e7 / amount_20d), 0.3, coalesce(string_agg(CASE WHEN abs(target_weight) * 1e7 / amount_20d > 0.3 THEN instrument END, '; ' ORDER BY instrument), '') FROM mk
 UNION ALL SELECT 'max_estimated_cost', sum(abs(target_weight)) * 1e7 * 15 / 10000 <= 15000, sum(abs(target_weight)) * 1e7 * 15 / 10000, 15000, 'total_bps=15' FROM mk
 UNION ALL SELECT 'min_signal_coverage', avg(CASE WHEN reject_reasons = '' THEN 1e0 ELSE 0e0 END) >= 0.5, avg(CASE WHEN reject_reasons = '' THEN 1e0 ELSE 0e0 END), 0.5, '' FROM sg
 UNION ALL SELECT 'max_turnover', t <= 0.4, t, 0.4, '' FROM ch
 UNION ALL SELECT 'max_industry_weight', max(w) <= 0.35, max(w), 0.35, arg_max(industry, (w, industry)) FROM ind
 UNION ALL SELECT 'min_factor_' || k || '_count', n >= 2, n, 2, '' FROM fc
 UNION ALL SELECT 'max_factor_' || k || '_concentration', c <= 0.7, c, 0.7, top FROM fc),
report AS (SELECT "check", CASE WHEN coalesce(ok, false) THEN 'pass' ELSE 'fail' END AS status, round(CAST(value AS DOUBLE), 6) AS value, CAST(threshold AS DOUBLE) AS threshold, detail FROM rows)"""
GATE = f"""{REPORT}, sc AS (SELECT 'all' AS scope, * FROM report UNION ALL SELECT 'exposure', * FROM report WHERE "check" LIKE '%factor%' OR "check" LIKE '%industry%')
SELECT scope, CASE WHEN count(*) FILTER (status = 'fail' AND "check" NOT IN ('max_industry_weight', 'min_factor_family_count', 'max_factor_family_concentration', 'min_factor_logic_count', 'max_factor_logic_concentration')) > 0 THEN 'reject' WHEN count(*) FILTER (status = 'fail') > 0 THEN 'caution' ELSE 'pass' END AS decision, count(*) FILTER (status = 'fail') AS failed FROM sc GROUP BY 1"""


def desk_trend(spark, sf_dir):
    """Per run date: the share of eligible names, positions, the heaviest industry."""
    cover = checked(spark, sf_dir).groupBy("date").agg(F.avg(F.col("eligible").cast("double")).alias("coverage"))
    weights = portfolio(spark, sf_dir).groupBy("date", "industry").agg(F.sum("target_weight").alias("w"), F.count(F.lit(1)).alias("n"))
    top = weights.groupBy("date").agg(F.max("w").alias("top_industry_weight"), F.sum("n").alias("positions"))
    return rounded(cover.join(top, "date", "left"), ["date"])


TREND = f"""WITH {PORTFOLIO}, cv AS (SELECT date, avg(CASE WHEN reject_reasons = '' THEN 1e0 ELSE 0e0 END) AS coverage FROM e GROUP BY 1), w AS (SELECT date, industry, sum(target_weight) AS w, count(*) AS n FROM pf GROUP BY 1, 2), t AS (SELECT date, max(w) AS w, CAST(sum(n) AS BIGINT) AS positions FROM w GROUP BY 1)
SELECT date, round(coverage, 6) AS coverage, round(w, 6) AS top_industry_weight, positions FROM cv LEFT JOIN t USING (date)"""


def desk_review(spark, sf_dir):
    return rounded(dk.pretrade_review(marked(target_on(spark, sf_dir, NEXT)), 2e6), [])


REVIEW = f"""WITH {TWO}, {MARKED}, h AS (SELECT instrument, unnest([{{'c': 'liquidity_floor', 's': 'caution', 'hit': amount_20d < 2e6}}, {{'c': 'limit_or_suspended', 's': 'reject', 'hit': lu}}, {{'c': 'event_blocked', 's': 'reject', 'hit': eb}}, {{'c': 'announcement_watch', 's': 'caution', 'hit': af OR ec > 0}}, {{'c': 'hard_risk_flags', 's': 'reject', 'hit': risk_flags = 'not_tradable'}}]) AS x FROM mk)
SELECT x.c AS "check", CASE WHEN count(*) FILTER (x.hit) > 0 THEN x.s ELSE 'pass' END AS status, count(*) FILTER (x.hit) AS count, coalesce(string_agg(CASE WHEN x.hit THEN instrument END, '; ' ORDER BY instrument), '') AS detail FROM h GROUP BY x.c, x.s"""


def desk_tickets(spark, sf_dir):
    made = dk.tickets(made_orders(spark, sf_dir), made_fills(spark, sf_dir), ["Brand#13"], cash=500_000, most_value=800_000, allow_sells=False)
    return made.select("instrument", "side", "action", "fill_status", "pretrade_status", "pretrade_reason", "review_reason")


TICKETS = f"""WITH {FILLS}, t AS (SELECT o.instrument, o.side, f.status AS fill_status, f.reject_reason, concat_ws(';', CASE WHEN o.instrument = 'Brand#13' THEN 'banned_instrument' END, CASE WHEN o.side = 'BUY' AND o.order_value > 500000 THEN 'insufficient_cash' END, CASE WHEN o.order_value > 800000 THEN 'above_max_order_value' END, CASE WHEN o.side = 'SELL' THEN 'sell_not_allowed' END) AS pretrade_reason FROM od o LEFT JOIN fills f USING (instrument))
SELECT instrument, side, CASE WHEN pretrade_reason <> '' OR fill_status = 'rejected' THEN 'REVIEW' ELSE side END AS action, fill_status, CASE WHEN pretrade_reason <> '' THEN 'review' ELSE 'pass' END AS pretrade_status, pretrade_reason, concat_ws(';', CASE WHEN pretrade_reason <> '' THEN pretrade_reason END, CASE WHEN fill_status = 'rejected' AND reject_reason <> '' THEN reject_reason END) AS review_reason FROM t"""


def desk_expert(spark, sf_dir):
    """The portfolio after each kind of decision; a rejected one and a missing review leave nothing."""
    p = target_on(spark, sf_dir, NEXT).select("instrument", "target_weight", "risk_flags")
    kinds = {"pass": dk.review_gate(p, "pass"), "caution": dk.review_gate(p, "caution"), "reject": dk.review_gate(p, "reject"), "missing": dk.review_gate(p, "unknown", required=True)}
    out = None
    for k, df in kinds.items():
        df = df.withColumn("decision", F.lit(k))
        out = df if out is None else out.unionByName(df)
    return rounded(out, [])


EXPERT = f"WITH {TWO} SELECT 'pass' AS decision, instrument, round(target_weight, 6) AS target_weight, risk_flags FROM tn UNION ALL SELECT 'caution', instrument, round(target_weight * 0.5, 6), CASE WHEN risk_flags <> '' THEN risk_flags || ';' ELSE '' END || 'expert_review_caution' FROM tn"


def desk_symbols(spark, sf_dir):
    """Quotes of codes in several spellings, the last of each instrument."""
    k = F.col("o_orderkey")
    code = F.element_at(F.array(F.lit("600"), F.lit("000"), F.lit("830"), F.lit("500"), F.lit("sh600")), (k % 5 + 1).cast("int"))
    raw = table(spark, sf_dir, "orders").select(F.concat(F.lit(" "), code, F.lpad((k % 23).cast("string"), 3, "0"), F.when(k % 2 == 0, ".XX").otherwise("")).alias("code"), F.col("o_totalprice").alias("pre_close"), F.when(k % 7 != 0, F.col("o_totalprice") * 1.01).alias("price"), "o_orderkey")
    return rounded(dk.quotes(raw, "o_orderkey"), [])


SYMBOLS = """WITH r AS (SELECT o_orderkey AS k, ['600', '000', '830', '500', 'sh600'][o_orderkey % 5 + 1] || lpad(CAST(o_orderkey % 23 AS VARCHAR), 3, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '.XX' ELSE '' END AS code, o_totalprice AS p FROM orders),
s AS (SELECT *, upper(code) AS u, regexp_replace(code, '[^0-9]', '', 'g') AS d FROM r),
t AS (SELECT *, CASE WHEN u LIKE 'SH%' THEN u WHEN d[1] = '6' THEN 'SH' || d WHEN d[1] = '0' THEN 'SZ' || d WHEN d[1] = '8' THEN 'BJ' || d ELSE u END AS instrument, CASE WHEN k % 7 <> 0 THEN p * 1.01 END AS c FROM s)
SELECT instrument, round(p, 6) AS prev_close, round(c, 6) AS current, CAST(NULL AS DOUBLE) AS pct_today FROM t QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY k DESC, c NULLS FIRST, p) = 1"""


def today(spark, sf_dir) -> DataFrame:
    w = brand_bars(spark, sf_dir).where(F.col("datetime") == NEXT).where("instrument not like '%4'")
    quoted = w.select("instrument", F.col("open").alias("prev_close"), F.col("close").alias("current"), F.when(F.endswith("instrument", F.lit("1")), 2.5).alias("pct_today"))
    return dk.intraday(marked(target_on(spark, sf_dir, NEXT)), quoted)


def desk_intraday(spark, sf_dir):
    return rounded(today(spark, sf_dir).select("instrument", "pct_today", "weighted_return_pct", "direction", "event_bucket"), [])


def desk_attribution(spark, sf_dir):
    return rounded(dk.group_results(today(spark, sf_dir), ["industry", "top_factor_1", "event_bucket"]).where("kind <> 'top_factor_1'"), [])


INTRADAY = f"""WITH {TWO}, {MARKED}, q AS (SELECT instrument, open, close AS c, CASE WHEN instrument LIKE '%1' THEN 2.5 END AS pct FROM bars WHERE datetime = DATE '{NEXT}' AND instrument NOT LIKE '%4'),
i AS (SELECT mk.*, coalesce(pct, (c / nullif(open, 0) - 1) * 100, 0) AS pct_today, CASE WHEN eb THEN 'event_block' WHEN ec > 0 THEN 'event_watch' WHEN af THEN 'announcement_watch' ELSE 'no_event' END AS event_bucket FROM mk LEFT JOIN q USING (instrument))"""


def batch(spark, sf_dir) -> DataFrame:
    """All months of the portfolio traded one after another, from holdings in some names."""
    targets = portfolio(spark, sf_dir).select("date", "instrument", "target_weight")
    blocked = F.when(F.endswith("instrument", F.lit("5")), "suspended").when(F.month("date") % 4 == 0, "not_tradable").otherwise("")
    states = brand_bars(spark, sf_dir).select(F.col("datetime").alias("date"), "instrument", F.col("close").alias("price")).withColumn("blocked", blocked)
    return dk.paper_batch(targets, states, initial(spark, sf_dir), least_value=LEAST_ORDER)


LEAST_ORDER = 300_000.0


def initial(spark, sf_dir) -> DataFrame:
    return brand_groups(spark, sf_dir).where("instrument like '%3' or instrument like '%5'").select("instrument", F.lit(0.04).alias("current_weight"))


def reported(spark, sf_dir) -> DataFrame:
    """Positions as another account has them: one name is missing in the first months of a year."""
    df = batch(spark, sf_dir).select("date", "instrument", F.col("after").alias("current_weight"))
    return df.where("not (instrument = 'Brand#13' and month(date) = 1)")


def batch_days(spark, sf_dir):
    return rounded(dk.batch_metrics(batch(spark, sf_dir), reported(spark, sf_dir)), ["date"], 5)


def batch_summary(spark, sf_dir):
    return rounded(dk.batch_summary(batch(spark, sf_dir), reported(spark, sf_dir)), [], 5)


BATCH = f"""WITH RECURSIVE {PORTFOLIO}, dd AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM pf)),
gr AS (SELECT n.instrument, dd.date, dd.i, coalesce(pf.target_weight, 0) AS t, b.close AS p, CASE WHEN n.instrument LIKE '%5' THEN 'suspended' WHEN month(dd.date) % 4 = 0 THEN 'not_tradable' ELSE '' END AS bl FROM (SELECT instrument FROM pf UNION SELECT instrument FROM g WHERE instrument LIKE '%3' OR instrument LIKE '%5') n CROSS JOIN dd LEFT JOIN pf ON pf.date = dd.date AND pf.instrument = n.instrument LEFT JOIN bars b ON b.datetime = dd.date AND b.instrument = n.instrument),
rc(instrument, i, date, t, w, ov, fv, bl, after) AS (
 SELECT instrument, CAST(0 AS BIGINT), CAST(NULL AS DATE), 0e0, 0e0, 0e0, 0e0, '', CASE WHEN instrument LIKE '%3' OR instrument LIKE '%5' THEN 0.04e0 ELSE 0e0 END FROM (SELECT DISTINCT instrument FROM gr)
 UNION ALL
 SELECT instrument, i, date, t, w, ov, fv, bl, CASE WHEN abs(w + sign(t - w) * fv / 1e7) > 1e-8 THEN w + sign(t - w) * fv / 1e7 ELSE 0 END FROM (
  SELECT * REPLACE (CASE WHEN ov >= {LEAST_ORDER} THEN ov ELSE 0 END AS ov), CASE WHEN ov >= {LEAST_ORDER} AND bl = '' THEN ov * CASE WHEN pr THEN 1 + sign(t - w) * 5 / 10000 ELSE 1 END ELSE 0 END AS fv FROM (
   SELECT g.instrument, g.i, g.date, g.t, rc.after AS w, g.bl, CASE WHEN abs(g.t - rc.after) > 1e-6 THEN CASE WHEN g.p > 0 THEN floor(round(abs(g.t - rc.after) * 1e7 / g.p / 100, 6)) * 100 * g.p ELSE abs(g.t - rc.after) * 1e7 END ELSE 0 END AS ov, coalesce(g.p > 0, false) AS pr FROM rc JOIN gr g ON g.instrument = rc.instrument AND g.i = rc.i + 1))),
bt AS (SELECT *, ov > 0 AS has, fv * (2 + CASE WHEN t > w THEN 0 ELSE 10 END) / 10000 AS cost FROM rc WHERE i > 0),
bm AS (SELECT date, count(*) FILTER (has) AS order_count, count(*) FILTER (has AND bl = '') AS fill_count, count(*) FILTER (has AND bl <> '') AS rejected_count, sum(ov) / 1e7 AS turnover, sum(fv) / 1e7 AS filled_turnover, sum(cost) AS transaction_cost, count(*) FILTER (after <> 0) AS position_count, sum(after) AS gross_exposure, sum(abs(t - after)) AS target_drift, count(*) FILTER (instrument = 'Brand#13' AND month(date) = 1 AND after <> 0) = 0 AS reconciliation_passed FROM bt GROUP BY 1)"""


def theme_set(spark, sf_dir) -> DataFrame:
    members = brand_groups(spark, sf_dir).select("instrument").unionByName(spark.range(1).select(F.lit("Unlisted").alias("instrument")))
    s = signal(spark, sf_dir).where(F.col("date") == NEXT).where("instrument not like '%2'").select("instrument", "tradable", "amount_20d")
    df = members.join(s, "instrument", "left").withColumn("in_signal", F.col("amount_20d").isNotNull())
    return df.withColumns({"research_status": F.when(F.col("in_signal"), "research_candidate").otherwise("watch_only"), "event_blocked": F.lit("no")})


def theme_checks(spark, sf_dir):
    rows = dk.theme_gate(theme_set(spark, sf_dir), 30, 0.9, 2e6).withColumn("scope", F.lit("theme"))
    return rounded(rows.unionByName(dk.theme_gate(theme_set(spark, sf_dir).where("false")).withColumn("scope", F.lit("empty"))), [])


def theme_gap(spark, sf_dir):
    s = signal(spark, sf_dir).where(F.col("date") == NEXT).where("instrument not like '%2'")
    return dk.missing_members(theme_set(spark, sf_dir).select("instrument"), s)


THEME = f"""WITH {SIGNALS}, mb AS (SELECT instrument FROM g UNION ALL SELECT 'Unlisted'), th AS (SELECT mb.instrument, z.tradable, z.amount_20d, z.amount_20d IS NOT NULL AS ins FROM mb LEFT JOIN (SELECT * FROM s WHERE date = DATE '{NEXT}' AND instrument NOT LIKE '%2') z USING (instrument)),
a AS (SELECT count(*) FILTER (ins) AS r, count(*) FILTER (NOT ins) AS w, avg(CASE WHEN ins THEN 1e0 ELSE 0e0 END) AS c, count(*) FILTER (NOT coalesce(tradable, true)) AS l, count(*) FILTER (amount_20d < 2e6) AS low FROM th)"""


def desk_scores(spark, sf_dir):
    """Scores by month and by instrument only."""
    s = signal(spark, sf_dir).select("date", "instrument")
    by_name = brand_groups(spark, sf_dir).where("instrument not like '%1'").select("instrument", F.length("industry").cast("double").alias("model_score"))
    by_day = s.where("month(date) = 3").withColumn("model_score", F.year("date").cast("double"))
    return rounded(dk.merge_scores(s, by_name).withColumnRenamed("model_score", "by_name").join(dk.merge_scores(s, by_day), ["date", "instrument"]), ["date"])


def queries() -> dict:
    return {"desk_risk": desk_risk, "desk_gate": desk_gate, "desk_trend": desk_trend, "desk_review": desk_review, "desk_tickets": desk_tickets, "desk_expert": desk_expert, "desk_symbols": desk_symbols, "desk_intraday": desk_intraday, "desk_attribution": desk_attribution, "batch_days": batch_days, "batch_summary": batch_summary, "theme_checks": theme_checks, "theme_gap": theme_gap, "desk_scores": desk_scores}


def oracle_sql() -> dict[str, str]:
    group = lambda c: f"SELECT '{c}' AS kind, {c} AS value, count(*) AS positions, round(sum(target_weight), 6) AS target_weight, round(avg(pct_today), 6) AS pct_today, round(sum(target_weight * pct_today), 6) AS weighted_return_pct FROM i GROUP BY {c}"
    columns = ("turnover", "filled_turnover", "transaction_cost", "gross_exposure", "target_drift")
    return {
        "desk_risk": f"{REPORT} SELECT * FROM report", "desk_gate": GATE, "desk_trend": TREND, "desk_review": REVIEW, "desk_tickets": TICKETS, "desk_expert": EXPERT, "desk_symbols": SYMBOLS,
        "desk_intraday": f"{INTRADAY} SELECT instrument, round(pct_today, 6) AS pct_today, round(target_weight * pct_today, 6) AS weighted_return_pct, CASE WHEN pct_today > 0 THEN 'up' WHEN pct_today < 0 THEN 'down' ELSE 'flat' END AS direction, event_bucket FROM i",
        "desk_attribution": f"{INTRADAY} {group('industry')} UNION ALL {group('event_bucket')}",
        "batch_days": f"{BATCH} SELECT date, order_count, fill_count, rejected_count, position_count, reconciliation_passed, coalesce((SELECT bl FROM bt WHERE bt.date = bm.date AND has AND bl <> '' GROUP BY bl ORDER BY count(*) DESC, bl LIMIT 1), '') AS top_reject_reason, {', '.join(f'round({c}, 5) AS {c}' for c in columns)} FROM bm",
        "batch_summary": f"{BATCH} SELECT count(*) AS days, round(sum(turnover), 5) AS total_turnover, round(avg(turnover), 5) AS average_turnover, round(max(target_drift), 5) AS max_target_drift, count(*) FILTER (NOT reconciliation_passed) AS reconciliation_failures, round(sum(transaction_cost), 5) AS total_transaction_cost, CAST(sum(rejected_count) AS BIGINT) AS execution_failure_count, arg_max(position_count, date) AS final_positions, (SELECT bl FROM bt WHERE has AND bl <> '' GROUP BY bl ORDER BY count(*) DESC, bl LIMIT 1) AS top_execution_failure_reason FROM bm",
        "theme_checks": f"""{THEME} SELECT 'theme' AS scope, 'min_research_candidates' AS "check", CASE WHEN r >= 30 THEN 'pass' ELSE 'caution' END AS status, CAST(r AS DOUBLE) AS value, 30e0 AS threshold FROM a UNION ALL SELECT 'theme', 'min_signal_coverage', CASE WHEN c >= 0.9 THEN 'pass' ELSE 'caution' END, round(c, 6), 0.9 FROM a UNION ALL SELECT 'theme', 'watch_only_positions', CASE WHEN w = 0 THEN 'pass' ELSE 'caution' END, w, 0 FROM a
 UNION ALL SELECT 'theme', 'event_blocked_positions', 'pass', 0, 0 FROM a UNION ALL SELECT 'theme', 'tradability_blocked_positions', CASE WHEN l = 0 THEN 'pass' ELSE 'fail' END, l, 0 FROM a UNION ALL SELECT 'theme', 'min_amount_20d', CASE WHEN low = 0 THEN 'pass' ELSE 'caution' END, low, 2e6 FROM a UNION ALL SELECT 'empty', 'min_research_candidates', 'fail', 0, 3""",
        "theme_gap": f"{THEME} SELECT instrument FROM th WHERE NOT ins",
        "desk_scores": f"WITH {SIGNALS} SELECT s.date, s.instrument, CASE WHEN s.instrument NOT LIKE '%1' THEN CAST(length(g.industry) AS DOUBLE) END AS by_name, CASE WHEN month(s.date) = 3 THEN CAST(year(s.date) AS DOUBLE) END AS model_score FROM s JOIN g USING (instrument)",
    }
