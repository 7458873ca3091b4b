"""Signal, portfolio, execution, attribution and quality queries over the months of the brand bars, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import with_factors
from ..operators import domains
from ..operators import signals as sg
from ..sources.tables import brand_bars, table
from .factors import BARS, W, brand_groups, roll, rounded

FACTORS = (
    sg.Factor("mom", 1, "momentum"),
    sg.Factor("calm", -1, "volatility", status="challenger"),
    sg.Factor("swing", 1, "momentum", regime_profile="down_sideways"),
    sg.Factor("idle", 1, "emotion", status="shadow"),
)
FORMULAS = {"mom": "$close / Ref($close, 5) - 1", "calm": "Std($close / Ref($close, 1) - 1, 10)", "swing": "$close / Mean($close, 10) - 1", "idle": "$volume / Mean($volume, 5)"}
RULES = sg.SignalRules(family_weight={"momentum": 0.8}, family_cap=1.5)
GROUPS = "g AS (SELECT p_brand AS instrument, max(p_type) || CASE WHEN length(p_brand) > 7 THEN '_b' ELSE '_a' END AS industry FROM part GROUP BY p_brand)"


def exposures(spark, sf_dir) -> DataFrame:
    df = with_factors(brand_bars(spark, sf_dir), FORMULAS)
    df = df.withColumn("amount_20d", F.avg("amount").over(Window.partitionBy("instrument").orderBy("datetime").rowsBetween(-19, 0)))
    df = df.withColumn("tradable", (F.month("datetime") + F.length("instrument")) % 5 != 0)
    return df.where("mom is not null").withColumnRenamed("datetime", "date").join(brand_groups(spark, sf_dir).select("instrument", "industry"), "instrument")


def signal(spark, sf_dir) -> DataFrame:
    return sg.build_signal(exposures(spark, sf_dir), FACTORS, RULES)


EXPOSURES = f"""{BARS}, {GROUPS}, r AS (SELECT *, close / lag(close) OVER {W} - 1 AS r FROM bars),
x0 AS (SELECT instrument, datetime AS date, close, amount, close / lag(close, 5) OVER {W} - 1 AS mom, stddev_samp(r) OVER {roll(10)} AS calm, close / avg(close) OVER {roll(10)} - 1 AS swing, volume / avg(volume) OVER {roll(5)} AS idle, avg(amount) OVER {roll(20)} AS amount_20d, (month(datetime) + length(instrument)) % 5 <> 0 AS tradable FROM r),
x AS (SELECT x0.*, industry FROM x0 JOIN g USING (instrument) WHERE mom IS NOT NULL)"""


def _z(c: str, sign: str, weight: float) -> str:
    p = "(PARTITION BY date)"
    z = f"coalesce(CASE WHEN stddev_samp({sign}{c}) OVER {p} > 1e-12 THEN ({sign}{c} - avg({sign}{c}) OVER {p}) / stddev_samp({sign}{c}) OVER {p} END, 0) * {weight}"
    return f"greatest(-3, least(3, {z}))"


SIGNALS = f"""{EXPOSURES},
c AS (SELECT *, {_z("mom", "", 1.0)} AS mom_contribution, {_z("calm", "-", 0.5)} AS calm_contribution, {_z("swing", "", 1.0)} AS swing_contribution, {_z("idle", "", 0.0)} AS idle_contribution FROM x),
f AS (SELECT *, greatest(-1.5, least(1.5, (mom_contribution + swing_contribution) / 2 * 0.8)) AS family_momentum_score, greatest(-1.5, least(1.5, calm_contribution)) AS family_volatility_score, (mom_contribution + swing_contribution) / 2 AS logic_trend_following_score, calm_contribution AS logic_risk_structure_score FROM c),
s AS (SELECT *, family_momentum_score + family_volatility_score AS ensemble_score, CASE WHEN tradable THEN '' ELSE 'not_tradable' END AS risk_flags FROM f)"""


def signal_daily(spark, sf_dir):
    df = signal(spark, sf_dir)
    return rounded(df.select("date", "instrument", "mom_contribution", "calm_contribution", "swing_contribution", "family_momentum_score", "family_volatility_score", "logic_trend_following_score", "logic_risk_structure_score", "ensemble_score", "risk_flags"), ["date"])


def signal_explain(spark, sf_dir):
    df = signal(spark, sf_dir)
    return rounded(df.select("date", "instrument", "top_factor_1", "top_factor_1_contribution", "top_factor_2", "top_factor_2_contribution"), ["date"])


SIGNAL_EXPLAIN = f"""WITH {SIGNALS}, u AS (SELECT date, instrument, factor, value FROM s, LATERAL (VALUES ('mom', mom_contribution), ('calm', calm_contribution), ('swing', swing_contribution)) v(factor, value) WHERE value <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY date, instrument ORDER BY abs(value) DESC, factor) AS k FROM u)
SELECT s.date, s.instrument, coalesce(a.factor, '') AS top_factor_1, round(coalesce(a.value, 0), 6) AS top_factor_1_contribution, coalesce(b.factor, '') AS top_factor_2, round(coalesce(b.value, 0), 6) AS top_factor_2_contribution
FROM s LEFT JOIN k a ON a.date = s.date AND a.instrument = s.instrument AND a.k = 1 LEFT JOIN k b ON b.date = s.date AND b.instrument = s.instrument AND b.k = 2"""


def signal_calendar(spark, sf_dir):
    """The execution calendar's flag overrides the signal's own where it has one."""
    calendar = exposures(spark, sf_dir).where("month(date) % 2 = 0").select("date", "instrument", (F.col("amount") > 900000).alias("tradable"))
    return sg.override_from_calendar(exposures(spark, sf_dir).select("date", "instrument", "tradable"), calendar, ["tradable"])


LEAST_AMOUNT = 1_000_000.0


def checked(spark, sf_dir) -> DataFrame:
    return sg.tradability(signal(spark, sf_dir), LEAST_AMOUNT)


def signal_tradability(spark, sf_dir):
    return checked(spark, sf_dir).select("date", "instrument", "eligible", "reject_reasons")


TRADABLE = f"""{SIGNALS}, e AS (SELECT *, concat_ws(';', CASE WHEN NOT tradable THEN 'not_tradable' END, CASE WHEN NOT tradable THEN 'risk_flag:not_tradable' END, CASE WHEN amount_20d IS NULL THEN 'missing_liquidity' WHEN amount_20d < {LEAST_AMOUNT} THEN 'low_liquidity' END) AS reject_reasons FROM s)"""


def portfolio(spark, sf_dir) -> DataFrame:
    df = checked(spark, sf_dir).withColumn("ensemble_score", F.round("ensemble_score", 9))
    return sg.target_portfolio(df, k=8, most=0.12)


def portfolio_target(spark, sf_dir):
    return rounded(portfolio(spark, sf_dir).select("date", "instrument", "rank", "target_weight"), ["date"])


PORTFOLIO = f"""{TRADABLE}, pk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(ensemble_score, 9) DESC, instrument) AS rank FROM e WHERE reject_reasons = ''),
pf AS (SELECT *, least(0.95 / count(*) OVER (PARTITION BY date), 0.12) AS target_weight FROM pk WHERE rank <= 8)"""


def portfolio_offensive(spark, sf_dir):
    """The offensive profile: a positive momentum family, at most a third of the positive scores from low volatility, smaller weights; with the columns that are handed through."""
    df = checked(spark, sf_dir).drop("volume").withColumnsRenamed({"family_volatility_score": "family_low_vol_score"}).withColumn("ensemble_score", F.round("ensemble_score", 9))
    limits = {"offensive": {"max_defensive_family_weight": 0.33, "max_single_weight": 0.07}}
    chosen = sg.target_portfolio(df, k=6, most=0.12, profile="offensive", profile_confirm=["family_momentum_score", "family_gone_score"], constraints=limits)
    none = sg.target_portfolio(df, profile="offensive", profile_confirm=["family_gone_score"])
    return rounded(chosen.unionByName(none).select("date", "instrument", "rank", "target_weight", *sg.passthrough(chosen)), ["date"], 4)


OFFENSIVE = f"""{TRADABLE}, o AS (SELECT *, greatest(family_momentum_score, 0) AS a, greatest(family_volatility_score, 0) AS b FROM e WHERE reject_reasons = ''),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(ensemble_score, 9) DESC, instrument) AS rank FROM o WHERE a > 0 AND b / (a + b) <= 0.33)
SELECT date, instrument, rank, round(least(0.95 / count(*) OVER (PARTITION BY date), 0.07), 4) AS target_weight, round(amount_20d, 4) AS amount_20d, round(amount, 4) AS amount FROM k WHERE rank <= 6"""


def held(spark, sf_dir) -> DataFrame:
    """A ranking with holdings: the names that were among the best five a month before."""
    df = checked(spark, sf_dir).withColumn("ensemble_score", F.round("ensemble_score", 9)).where("eligible")
    best = sg.select_top(df, "ensemble_score", 5).select(F.add_months("date", 1).alias("date"), "instrument", F.lit(True).alias("held"))
    return df.join(best, ["date", "instrument"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def portfolio_dropout(spark, sf_dir):
    """Top five with holdings kept to rank 9 and at most two new names."""
    chosen = sg.select_top(held(spark, sf_dir), "ensemble_score", 5, 9, 2)
    return chosen.select("date", "instrument", F.col("rank").cast("long").alias("rank"), "held")


DROPOUT = f"""WITH {PORTFOLIO}, h AS (SELECT pk.date, pk.instrument, round(pk.ensemble_score, 9) AS sc, pk.rank, coalesce(b.k, false) AS held FROM pk LEFT JOIN (SELECT CAST(date + INTERVAL 1 MONTH AS DATE) AS date, instrument, true AS k FROM pk WHERE rank <= 5) b USING (date, instrument)),
a AS (SELECT *, held AND rank <= 9 AS keep, sum(CASE WHEN held AND rank <= 9 THEN 1 ELSE 0 END) OVER (PARTITION BY date) AS kept, sum(CASE WHEN held THEN 0 ELSE 1 END) OVER (PARTITION BY date ORDER BY rank) AS nw FROM h),
b AS (SELECT *, NOT keep AND (held OR nw <= 2) AS may FROM a), c2 AS (SELECT *, sum(CASE WHEN may THEN 1 ELSE 0 END) OVER (PARTITION BY date ORDER BY rank) AS place FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY sc DESC, instrument) AS r FROM c2 WHERE keep OR (may AND place <= greatest(5 - kept, 1)))
SELECT date, instrument, r AS rank, held FROM d WHERE r <= 5"""

DAY, NEXT = "1997-03-01", "1997-04-01"


def target_on(spark, sf_dir, day: str) -> DataFrame:
    return portfolio(spark, sf_dir).where(F.col("date") == day).withColumn("price", F.col("close"))


def current(spark, sf_dir) -> DataFrame:
    return target_on(spark, sf_dir, DAY).select("instrument", F.col("target_weight").alias("current_weight"), F.lit(None).cast("double").alias("price"))


def portfolio_changes(spark, sf_dir):
    return rounded(sg.weight_changes(target_on(spark, sf_dir, NEXT), current(spark, sf_dir)), [])


TWO = f"{PORTFOLIO}, tn AS (SELECT * FROM pf WHERE date = DATE '{NEXT}'), tc AS (SELECT * FROM pf WHERE date = DATE '{DAY}')"
CHANGES = f"""{TWO}, ch AS (SELECT instrument, coalesce(tn.target_weight, 0) AS target_weight, coalesce(tc.target_weight, 0) AS current_weight, coalesce(tn.target_weight, 0) - coalesce(tc.target_weight, 0) AS delta_weight, tn.close AS price FROM tn FULL JOIN tc USING (instrument))"""
EQUITY, LOT = 1e7, 100


def made_orders(spark, sf_dir) -> DataFrame:
    return sg.orders(target_on(spark, sf_dir, NEXT), current(spark, sf_dir), EQUITY, LOT)


def orders_suggested(spark, sf_dir):
    return rounded(made_orders(spark, sf_dir).select("instrument", "side", "requested_delta_weight", "price", "order_shares", "order_value", "delta_weight", "status"), [])


ORDERS = f"""{CHANGES}, o0 AS (SELECT *, CASE WHEN delta_weight > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(delta_weight) * {EQUITY} AS rv FROM ch WHERE abs(delta_weight) > 1e-6),
o AS (SELECT *, CASE WHEN price > 0 THEN CAST(floor(rv / price / {LOT}) * {LOT} AS DOUBLE) END AS order_shares, CASE WHEN price > 0 THEN floor(rv / price / {LOT}) * {LOT} * price ELSE rv END AS order_value FROM o0),
od AS (SELECT *, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * order_value / {EQUITY} AS dw FROM o)"""


def made_fills(spark, sf_dir) -> DataFrame:
    state = F.length("instrument") == 7
    df = made_orders(spark, sf_dir).withColumn("limit_up", state & (F.col("side") == "BUY")).withColumn("suspended", F.endswith("instrument", F.lit("5")))
    return sg.fills(df, 0.5)


def fills_simulated(spark, sf_dir):
    return rounded(made_fills(spark, sf_dir).select("fill_id", "instrument", "side", "fill_value", "fill_shares", "execution_price", "transaction_cost", "fill_delta_weight", "net_cash_effect", "status", "reject_reason"), [])


FILLS = f"""{ORDERS}, fl AS (SELECT *, price * (1 + CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * 5.0 / 10000) AS ep, order_shares * 0.5 AS sh, CASE WHEN instrument LIKE '%5' THEN 'suspended' WHEN side = 'BUY' AND length(instrument) = 7 THEN 'limit_up_buy_blocked' ELSE '' END AS rr FROM od),
f2 AS (SELECT *, coalesce(sh * ep, order_value * 0.5) AS v FROM fl), f3 AS (SELECT *, v * (2.0 + CASE WHEN side = 'BUY' THEN 0 ELSE 10.0 END) / 10000 AS cost FROM f2),
fills AS (SELECT row_number() OVER (ORDER BY instrument) AS fill_id, instrument, side, CASE WHEN rr = '' THEN v ELSE 0 END AS fill_value, CASE WHEN rr = '' THEN sh ELSE 0 END AS fill_shares, ep AS execution_price, CASE WHEN rr = '' THEN cost ELSE 0 END AS transaction_cost, rr AS reject_reason, CASE WHEN rr = '' THEN 'partial' ELSE 'rejected' END AS status FROM f3)"""


def positions_after(spark, sf_dir):
    return rounded(sg.apply_fills(current(spark, sf_dir), made_fills(spark, sf_dir)), [])


AFTER = f"""{FILLS}, af AS (SELECT instrument, sum(w) AS current_weight FROM (SELECT instrument, target_weight AS w FROM tc UNION ALL SELECT instrument, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * fill_value / {EQUITY} FROM fills WHERE status <> 'rejected') GROUP BY 1 HAVING abs(sum(w)) > 1e-8)"""


def positions_reconcile(spark, sf_dir):
    actual = target_on(spark, sf_dir, NEXT).select("instrument", F.col("target_weight").alias("current_weight"))
    return rounded(sg.reconcile(sg.apply_fills(current(spark, sf_dir), made_fills(spark, sf_dir)), actual), [])


def portfolio_turnover(spark, sf_dir):
    return rounded(sg.turnover(target_on(spark, sf_dir, NEXT), current(spark, sf_dir)), [])


def portfolio_risk(spark, sf_dir):
    return rounded(sg.risk_checks(target_on(spark, sf_dir, NEXT), 0.08, 5, "industry"), [])


RISK = f"""WITH {TWO}, a AS (SELECT max(target_weight) AS w, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN target_weight < 0 THEN 1e0 ELSE 0e0 END) AS neg FROM tn), i AS (SELECT max(s) AS m FROM (SELECT sum(target_weight) AS s FROM tn GROUP BY industry))
SELECT 'non_empty' AS "check", CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END AS status, n AS value, 1e0 AS threshold FROM a UNION ALL SELECT 'max_single_weight', CASE WHEN w <= 0.08 + 1e-12 THEN 'pass' ELSE 'fail' END, round(w, 6), 0.08 FROM a
UNION ALL SELECT 'min_positions', CASE WHEN n >= 5 THEN 'pass' ELSE 'fail' END, n, 5 FROM a UNION ALL SELECT 'negative_weights', CASE WHEN neg = 0 THEN 'pass' ELSE 'fail' END, neg, 0 FROM a UNION ALL SELECT 'max_industry_weight', CASE WHEN m <= 0.35 THEN 'pass' ELSE 'fail' END, round(m, 6), 0.35 FROM i"""


def replayed(spark, sf_dir) -> DataFrame:
    closes = brand_bars(spark, sf_dir).select(F.col("datetime").alias("date"), "instrument", "close")
    return sg.replay(portfolio(spark, sf_dir).select("date", "instrument", "target_weight"), closes, 5.0)


def replay_daily(spark, sf_dir):
    return rounded(replayed(spark, sf_dir), ["date"])


REPLAY = f"""{PORTFOLIO}, rt AS (SELECT datetime AS date, instrument, lead(close) OVER {W} / close - 1 AS ret FROM bars), bn AS (SELECT date, avg(ret) AS b FROM rt GROUP BY 1),
dl AS (SELECT date, sum(target_weight * coalesce(ret, 0)) AS gross, sum(target_weight) AS invested FROM pf LEFT JOIN rt USING (date, instrument) GROUP BY 1),
rp AS (SELECT date, gross, invested, gross - invested * 5.0 / 10000 AS portfolio_return, coalesce(b, 0) AS benchmark_return FROM dl LEFT JOIN bn USING (date)),
rn AS (SELECT *, product(1 + portfolio_return) OVER (ORDER BY date) AS nav, product(1 + benchmark_return) OVER (ORDER BY date) AS benchmark_nav FROM rp)"""


def replay_summary(spark, sf_dir):
    return rounded(sg.replay_summary(replayed(spark, sf_dir), 12), [])


def replay_monthly(spark, sf_dir):
    return rounded(sg.monthly(replayed(spark, sf_dir)), [])


def attribution_exposure(spark, sf_dir):
    p = target_on(spark, sf_dir, NEXT)
    return rounded(sg.exposure(p, "family_").withColumn("kind", F.lit("family")).unionByName(sg.exposure(p, "logic_").withColumn("kind", F.lit("logic"))), [])


ATTRIBUTION = f"""WITH {TWO}, u AS (SELECT 'family' AS kind, 'momentum' AS name, target_weight * family_momentum_score AS x FROM tn UNION ALL SELECT 'family', 'volatility', target_weight * family_volatility_score FROM tn UNION ALL SELECT 'logic', 'trend_following', target_weight * logic_trend_following_score FROM tn UNION ALL SELECT 'logic', 'risk_structure', target_weight * logic_risk_structure_score FROM tn),
a AS (SELECT kind, name, sum(x) AS e, sum(abs(x)) AS g FROM u GROUP BY 1, 2) SELECT kind, name, round(e, 6) AS exposure, round(g, 6) AS gross, round(coalesce(g / nullif(sum(g) OVER (PARTITION BY kind), 0), 0), 6) AS share FROM a"""


def attribution_style(spark, sf_dir):
    p = target_on(spark, sf_dir, NEXT).withColumn("patchy", F.when(F.length("instrument") == 8, F.col("mom")))
    return rounded(sg.style_exposure(p, ["mom", "calm", "patchy"]), [])


STYLE = f"""WITH {TWO}, u AS (SELECT 'mom' AS style, target_weight AS w, mom AS v FROM tn UNION ALL SELECT 'calm', target_weight, calm FROM tn UNION ALL SELECT 'patchy', target_weight, CASE WHEN length(instrument) = 8 THEN mom END FROM tn)
SELECT style, round(sum(w * v) / nullif(sum(abs(w)) FILTER (v IS NOT NULL), 0), 6) AS exposure, round(coalesce(sum(abs(w)) FILTER (v IS NOT NULL), 0), 6) AS covered_weight FROM u GROUP BY 1"""


def theme_candidates(spark, sf_dir):
    """Members of a theme, one of them unknown to the signal."""
    s = signal(spark, sf_dir).where(F.col("date") == NEXT).select("instrument", "mom", "swing", "risk_flags")
    members = brand_groups(spark, sf_dir).where("industry like '%b'").select("instrument").unionByName(spark.range(1).select(F.lit("Unlisted").alias("instrument")))
    return rounded(sg.theme_candidates(members, s, ["mom", "swing"], 8).select("instrument", "component_score", "risk_penalty", "total_score", "in_signal", "theme_rank"), [])


THEME = f"""WITH {SIGNALS}, mb AS (SELECT instrument FROM g WHERE industry LIKE '%b' UNION ALL SELECT 'Unlisted'), j AS (SELECT mb.instrument, t.mom, t.swing, t.risk_flags FROM mb LEFT JOIN (SELECT * FROM s WHERE date = DATE '{NEXT}') t USING (instrument)),
q AS (SELECT *, (CASE WHEN mom IS NULL THEN 0 WHEN max(mom) OVER () = min(mom) OVER () THEN 1 ELSE (mom - min(mom) OVER ()) / (max(mom) OVER () - min(mom) OVER ()) END + CASE WHEN swing IS NULL THEN 0 WHEN max(swing) OVER () = min(swing) OVER () THEN 1 ELSE (swing - min(swing) OVER ()) / (max(swing) OVER () - min(swing) OVER ()) END) / 2 AS cs, CASE WHEN coalesce(risk_flags, '') = '' THEN 0e0 ELSE 0.2 END AS rp FROM j),
k AS (SELECT *, cs - rp AS ts, row_number() OVER (ORDER BY cs - rp DESC, instrument) AS r FROM q) SELECT instrument, round(cs, 6) AS component_score, rp AS risk_penalty, round(ts, 6) AS total_score, mom IS NOT NULL AS in_signal, r AS theme_rank FROM k WHERE r <= 8"""


def quality_signal(spark, sf_dir):
    df = exposures(spark, sf_dir).where(F.col("date") == NEXT).withColumn("flat", F.lit(1.0)).withColumn("thin", F.when(F.length("instrument") == 7, F.col("mom")))
    return rounded(domains.signal_quality(df, ["mom", "flat", "thin"]), [])


QUALITY = f"""WITH {EXPOSURES}, q AS (SELECT *, 1.0 AS flat, CASE WHEN length(instrument) = 7 THEN mom END AS thin FROM x WHERE date = DATE '{NEXT}'), a AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT date) AS DOUBLE) AS d, CAST(count(DISTINCT instrument) AS DOUBLE) AS u, count(mom) AS gm, count(thin) AS gt, count(DISTINCT mom) AS dm, count(DISTINCT flat) AS df, count(DISTINCT thin) AS dt FROM q)
SELECT 'non_empty' AS "check", CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END AS status, n AS value FROM a UNION ALL SELECT 'single_date', CASE WHEN d = 1 THEN 'pass' ELSE 'fail' END, d FROM a UNION ALL SELECT 'unique_instruments', CASE WHEN u = n THEN 'pass' ELSE 'fail' END, n - u FROM a
UNION ALL SELECT 'coverage:mom', CASE WHEN gm / n >= 0.8 THEN 'pass' ELSE 'fail' END, round(gm / n, 6) FROM a UNION ALL SELECT 'varies:mom', CASE WHEN dm > 1 THEN 'pass' ELSE 'fail' END, dm FROM a UNION ALL SELECT 'coverage:flat', CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END, 1 FROM a UNION ALL SELECT 'varies:flat', CASE WHEN df > 1 THEN 'pass' ELSE 'fail' END, df FROM a
UNION ALL SELECT 'coverage:thin', CASE WHEN gt / n >= 0.8 THEN 'pass' ELSE 'fail' END, round(gt / n, 6) FROM a UNION ALL SELECT 'varies:thin', CASE WHEN dt > 1 THEN 'pass' ELSE 'fail' END, dt FROM a"""


def quality_coverage(spark, sf_dir):
    df = exposures(spark, sf_dir).withColumn("thin", F.when(F.length("instrument") == 7, F.col("mom"))).withColumn("part", F.when(F.month("date") <= 7, F.col("mom")))
    return rounded(domains.field_coverage(df, ["mom", "thin", "part"]), [])


COVERAGE = f"""WITH {EXPOSURES}, q AS (SELECT *, CASE WHEN length(instrument) = 7 THEN mom END AS thin, CASE WHEN month(date) <= 7 THEN mom END AS part FROM x), u AS (SELECT 'mom' AS field, count(mom) AS present, count(*) AS n FROM q UNION ALL SELECT 'thin', count(thin), count(*) FROM q UNION ALL SELECT 'part', count(part), count(*) FROM q)
SELECT field, present, round(present / CAST(n AS DOUBLE), 6) AS coverage, CASE WHEN present / CAST(n AS DOUBLE) >= 0.8 THEN 'ready' WHEN present / CAST(n AS DOUBLE) >= 0.5 THEN 'caution' ELSE 'blocked' END AS status FROM u"""


def governance(spark, sf_dir):
    e = exposures(spark, sf_dir)
    as_of = F.lit("2001-12-31").cast("date")
    rows = [domains.domain_freshness(e, "signals", "date", as_of, 60, 20), domains.domain_freshness(e.where("date < '1997-01-01'"), "old", "date", as_of, 60, 20), domains.domain_freshness(e.where("false"), "none", "date", as_of, 60, 20)]
    return rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]), [])


GOVERNANCE = f"""WITH {EXPOSURES}, u AS (SELECT 'signals' AS domain, count(*) AS rows, count(DISTINCT instrument) AS instruments, max(date) AS latest FROM x UNION ALL SELECT 'old', count(*), count(DISTINCT instrument), max(date) FROM x WHERE date < DATE '1997-01-01' UNION ALL SELECT 'none', 0, 0, NULL)
SELECT domain, rows, instruments, latest, CAST(DATE '2001-12-31' - latest AS BIGINT) AS age_days, CASE WHEN rows = 0 THEN 'blocked' WHEN instruments >= 20 AND DATE '2001-12-31' - latest <= 60 THEN 'active' ELSE 'caution' END AS status FROM u"""


def read_models(spark, sf_dir):
    """Nested cards: a conversation's turns as an array of structs, its roles as a map, flattened to one line."""
    t = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.length("text"))
    first = t.withColumn("k", F.row_number().over(order)).where("k <= 3")  # a task keeps three rows of a conversation before anything is shuffled
    opening = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "role", F.length("text").alias("size")))).alias("turns"))
    counts = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("role") == "user").cast("long")).alias("from_user"))
    line = F.array_join(F.transform("turns", lambda x: F.concat_ws(":", x["role"], x["size"].cast("string"))), ";")
    return counts.join(opening, "conv_id").select("conv_id", "n", "from_user", line.alias("opening"))


READ_MODELS = """WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) AS k FROM conversations)
SELECT conv_id, count(*) AS n, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS from_user, string_agg(CASE WHEN k <= 3 THEN role || ':' || length(text) END, ';' ORDER BY k) AS opening FROM k GROUP BY conv_id"""


def queries() -> dict:
    return {
        "signal_daily": signal_daily, "signal_explain": signal_explain, "signal_calendar": signal_calendar, "signal_tradability": signal_tradability, "portfolio_target": portfolio_target, "portfolio_dropout": portfolio_dropout, "portfolio_offensive": portfolio_offensive,
        "portfolio_changes": portfolio_changes, "portfolio_turnover": portfolio_turnover, "portfolio_risk": portfolio_risk, "orders_suggested": orders_suggested, "fills_simulated": fills_simulated, "positions_after": positions_after,
        "positions_reconcile": positions_reconcile, "replay_daily": replay_daily, "replay_summary": replay_summary, "replay_monthly": replay_monthly, "attribution_exposure": attribution_exposure, "attribution_style": attribution_style,
        "theme_candidates": theme_candidates, "quality_signal": quality_signal, "quality_coverage": quality_coverage, "governance": governance, "read_models": read_models,
    }


def oracle_sql() -> dict[str, str]:
    r = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
    return {
        "signal_daily": f"WITH {SIGNALS} SELECT date, instrument, {r('mom_contribution', 'calm_contribution', 'swing_contribution', 'family_momentum_score', 'family_volatility_score', 'logic_trend_following_score', 'logic_risk_structure_score', 'ensemble_score')}, risk_flags FROM s",
        "signal_explain": SIGNAL_EXPLAIN,
        "signal_calendar": f"WITH {EXPOSURES} SELECT date, instrument, CASE WHEN month(date) % 2 = 0 THEN amount > 900000 ELSE tradable END AS tradable FROM x",
        "signal_tradability": f"WITH {TRADABLE} SELECT date, instrument, reject_reasons = '' AS eligible, reject_reasons FROM e",
        "portfolio_target": f"WITH {PORTFOLIO} SELECT date, instrument, rank, round(target_weight, 6) AS target_weight FROM pf",
        "portfolio_dropout": DROPOUT, "portfolio_offensive": f"WITH {OFFENSIVE}",
        "portfolio_changes": f"WITH {CHANGES} SELECT instrument, {r('target_weight', 'current_weight', 'delta_weight')}, CASE WHEN current_weight = 0 AND target_weight <> 0 THEN 'added' WHEN target_weight = 0 AND current_weight <> 0 THEN 'removed' WHEN abs(delta_weight) > 1e-9 THEN 'scaled' ELSE 'unchanged' END AS change FROM ch",
        "portfolio_turnover": f"WITH {CHANGES} SELECT round(sum(abs(delta_weight)), 6) AS turnover FROM ch",
        "portfolio_risk": RISK,
        "orders_suggested": f"WITH {ORDERS} SELECT instrument, side, round(delta_weight, 6) AS requested_delta_weight, round(price, 6) AS price, order_shares, round(order_value, 6) AS order_value, round(dw, 6) AS delta_weight, 'suggested' AS status FROM od",
        "fills_simulated": f"WITH {FILLS} SELECT fill_id, instrument, side, {r('fill_value', 'fill_shares', 'execution_price', 'transaction_cost')}, round(CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * fill_value / {EQUITY}, 6) AS fill_delta_weight, round(CASE WHEN side = 'BUY' THEN -1 ELSE 1 END * fill_value - transaction_cost, 6) AS net_cash_effect, status, reject_reason FROM fills",
        "positions_after": f"WITH {AFTER} SELECT instrument, round(current_weight, 6) AS current_weight FROM af",
        "positions_reconcile": f"""WITH {AFTER}, b AS (SELECT instrument, af.current_weight AS expected, tn.target_weight AS actual FROM af FULL JOIN tn USING (instrument)), c3 AS (SELECT CASE WHEN actual IS NULL THEN 'missing_position' WHEN expected IS NULL THEN 'unexpected_position' WHEN abs(expected - actual) > 1e-6 THEN 'weight_mismatch' END AS "check", instrument, {r('expected', 'actual')} FROM b)
 SELECT * FROM c3 WHERE "check" IS NOT NULL UNION ALL SELECT 'positions_match', '', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM c3 WHERE "check" IS NOT NULL)""",
        "replay_daily": f"WITH {REPLAY} SELECT date, {r('gross', 'invested', 'portfolio_return', 'benchmark_return')}, round(portfolio_return - benchmark_return, 6) AS excess_return, {r('nav', 'benchmark_nav')} FROM rn",
        "replay_summary": f"WITH {REPLAY}, dd AS (SELECT *, nav / greatest(1, max(nav) OVER (ORDER BY date)) - 1 AS dd FROM rn), a AS (SELECT count(*) AS periods, product(1 + portfolio_return) - 1 AS total_return, stddev_pop(portfolio_return) * sqrt(12) AS volatility, min(dd) AS max_drawdown, avg(CASE WHEN portfolio_return > 0 THEN 1e0 ELSE 0e0 END) AS win_rate FROM dd) SELECT periods, {r('total_return', 'volatility', 'max_drawdown', 'win_rate')}, round(pow(1 + total_return, 12.0 / periods) - 1, 6) AS annualised_return FROM a",
        "replay_monthly": f"WITH {REPLAY} SELECT strftime(date, '%Y-%m') AS month, round(product(1 + portfolio_return) - 1, 6) AS \"return\", count(*) AS periods FROM rn GROUP BY 1",
        "attribution_exposure": ATTRIBUTION, "attribution_style": STYLE, "theme_candidates": THEME, "quality_signal": QUALITY, "quality_coverage": COVERAGE, "governance": GOVERNANCE, "read_models": READ_MODELS,
    }
