"""A theme's candidates from a signal filled up by providers, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import with_factors
from ..operators import signals as sg
from ..operators import themes as th
from ..sources.tables import brand_bars
from .books import EXPOSURES, FACTORS, FORMULAS, NEXT, RULES, SIGNALS, signal
from .factors import brand_groups, rounded

#: What the signal's scores stand for in the theme.
NAMES = {"family_momentum_score": "quiet_breakout_20_contribution", "family_volatility_score": "family_quality_score", "logic_trend_following_score": "family_growth_improvement_score", "logic_risk_structure_score": "family_event_catalyst_score"}


def provider(spark, sf_dir, without: str):
    """A provider of signals over the brand bars that lacks the names of an ending."""

    def make(names: DataFrame) -> DataFrame:
        bars = brand_bars(spark, sf_dir, names).where(~F.endswith("instrument", F.lit(without)))
        df = with_factors(bars, FORMULAS)
        df = df.withColumn("amount_20d", F.avg("amount").over(Window.partitionBy("instrument").orderBy("datetime").rowsBetween(-19, 0))).withColumn("tradable", (F.month("datetime") + F.length("instrument")) % 5 != 0)
        df = df.where("mom is not null").withColumnRenamed("datetime", "date").join(brand_groups(spark, sf_dir).select("instrument", "industry"), "instrument")
        return sg.build_signal(df, FACTORS, RULES).where(F.col("date") == NEXT)

    return make


def theme_members(spark, sf_dir) -> DataFrame:
    names = brand_groups(spark, sf_dir).select("instrument", F.when(F.length("instrument") == 8, F.concat(F.substring("instrument", 8, 1), F.lit(".5"))).alias("theme_exposure"), F.when(F.endswith("instrument", F.lit("3")), "chips").otherwise(" ").alias("supply_chain_role"))
    return names.unionByName(spark.range(1).select(F.lit(" Unlisted").alias("instrument"), F.lit("bad").alias("theme_exposure"), F.lit("cloud").alias("supply_chain_role")))


def filled(spark, sf_dir) -> DataFrame:
    own = signal(spark, sf_dir).where(F.col("date") == NEXT).where("instrument not like '%2' and instrument not like '%6'")
    return th.back_fill(own, theme_members(spark, sf_dir), [provider(spark, sf_dir, "6"), provider(spark, sf_dir, "x")])


def theme_back_fill(spark, sf_dir):
    """A month's signal with the names that it lacked, from two providers in order."""
    return rounded(filled(spark, sf_dir).select("date", "instrument", "ensemble_score", "family_momentum_score", "family_volatility_score", "risk_flags"), ["date"])


def theme_table(spark, sf_dir):
    """The best twelve members with tiers and reasons."""
    last = F.substring("instrument", -1, 1)
    s = filled(spark, sf_dir).withColumnsRenamed(NAMES).withColumns({"max_event_severity": F.when(last == "1", "risk").when(last == "5", "BLOCK"), "risk_event_types": F.when(last.isin("1", "7"), "lawsuit"), "event_blocked": F.when(last == "9", "yes")})
    return rounded(th.theme_table(s, theme_members(spark, sf_dir), 12, {"id": "t1"}).drop("date"), [])


def _chain(rows: str, n: str) -> str:
    """The signal's steps over other rows, under names of their own."""
    text = SIGNALS[len(EXPOSURES) + 1 :].strip()
    for name in ("c", "f", "s"):
        text = re.sub(rf"(^|\n){name} AS \(", rf"\g<1>{name}{n} AS (", text)
        text = re.sub(rf"FROM {name}\)", f"FROM {name}{n})", text)
    return text.replace("FROM x)", f"FROM {rows})")


FILLED = f"""{SIGNALS}, own AS (SELECT * FROM s WHERE date = DATE '{NEXT}' AND instrument NOT LIKE '%2' AND instrument NOT LIKE '%6'),
x1 AS (SELECT * FROM x WHERE instrument NOT IN (SELECT instrument FROM own) AND instrument NOT LIKE '%6'), {_chain("x1", "1")},
x2 AS (SELECT * FROM x WHERE instrument NOT IN (SELECT instrument FROM own) AND instrument NOT IN (SELECT instrument FROM s1 WHERE date = DATE '{NEXT}')), {_chain("x2", "2")},
fi AS (SELECT date, instrument, ensemble_score, family_momentum_score, family_volatility_score, logic_trend_following_score, logic_risk_structure_score, risk_flags, tradable, amount_20d, industry, mom_contribution, calm_contribution, swing_contribution FROM own
 UNION ALL SELECT date, instrument, ensemble_score, family_momentum_score, family_volatility_score, logic_trend_following_score, logic_risk_structure_score, risk_flags, tradable, amount_20d, industry, mom_contribution, calm_contribution, swing_contribution FROM s1 WHERE date = DATE '{NEXT}'
 UNION ALL SELECT date, instrument, ensemble_score, family_momentum_score, family_volatility_score, logic_trend_following_score, logic_risk_structure_score, risk_flags, tradable, amount_20d, industry, mom_contribution, calm_contribution, swing_contribution FROM s2 WHERE date = DATE '{NEXT}')"""


def _scale(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 0 WHEN max({c}) OVER () = min({c}) OVER () THEN 1 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


TABLE = f"""WITH {FILLED}, mb AS (SELECT instrument, CASE WHEN length(instrument) = 8 THEN CAST(instrument[8] || '.5' AS DOUBLE) ELSE 1 END AS theme_exposure, CASE WHEN instrument LIKE '%3' THEN 'chips' ELSE ' ' END AS supply_chain_role FROM g UNION ALL SELECT 'Unlisted', 1, 'cloud'),
tf AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY abs(v) DESC, fac) AS k FROM (SELECT instrument, fac, v FROM fi, LATERAL (VALUES ('mom', mom_contribution), ('calm', calm_contribution), ('swing', swing_contribution)) t(fac, v) WHERE v <> 0)),
j AS (SELECT mb.*, fi.* EXCLUDE (instrument), CASE instrument[-1] WHEN '1' THEN 'risk' WHEN '5' THEN 'block' ELSE '' END AS sev, fi.date IS NOT NULL AS known, (SELECT fac FROM tf WHERE tf.instrument = mb.instrument AND k = 1) AS t1, (SELECT fac FROM tf WHERE tf.instrument = mb.instrument AND k = 2) AS t2 FROM mb LEFT JOIN fi USING (instrument)),
k AS (SELECT *, {_scale("ensemble_score")} AS ss, {_scale("theme_exposure")} AS es, {_scale("family_volatility_score")} AS qs, {_scale("logic_trend_following_score")} AS gs, ({_scale("family_momentum_score")} + {_scale("ensemble_score")}) / 2 AS ms, {_scale("logic_risk_structure_score")} AS vs, CASE WHEN (known AND instrument LIKE '%9') OR NOT coalesce(tradable, true) THEN 'risk_review' WHEN ensemble_score IS NULL THEN 'watch_only' ELSE 'research_candidate' END AS st FROM j),
m AS (SELECT *, (0.7 * ss + 0.3 * es) * CASE WHEN st = 'risk_review' THEN 0.25 ELSE 1 END AS rs, least(1, CASE st WHEN 'risk_review' THEN 1 WHEN 'watch_only' THEN 0.35 ELSE 0 END + CASE WHEN known AND (instrument LIKE '%1' OR instrument LIKE '%7') THEN 0.25 ELSE 0 END + CASE WHEN NOT known THEN 0 WHEN sev = 'block' THEN 0.5 WHEN sev = 'risk' THEN 0.2 ELSE 0 END) AS rp FROM k),
n AS (SELECT *, greatest(0, 0.3 * es + 0.2 * qs + 0.2 * gs + 0.15 * ms + 0.1 * vs - 0.15 * rp) AS ts FROM m), o AS (SELECT *, CASE WHEN st = 'risk_review' OR rp >= 0.8 THEN 2 WHEN ts >= 0.58 AND st = 'research_candidate' THEN 0 ELSE 1 END AS ti FROM n)
SELECT instrument, supply_chain_role, 't1' AS theme_id, round(theme_exposure, 6) AS theme_exposure, round(ensemble_score, 6) AS ensemble_score, round(ss, 6) AS theme_signal_score, round(es, 6) AS theme_exposure_score, round(rs, 6) AS theme_research_score, round(es, 6) AS theme_score, round(qs, 6) AS quality_score, round(gs, 6) AS growth_score, round(ms, 6) AS momentum_score, round(vs, 6) AS event_score, round(CAST(rp AS DOUBLE), 6) AS risk_penalty, round(CAST(ts AS DOUBLE), 6) AS total_score, ['A重点研究', 'B观察跟踪', 'C风险复核'][ti + 1] AS tier,
 concat_ws('；', coalesce(nullif(trim(supply_chain_role), ''), 'AI产业链'), CASE WHEN t1 IS NOT NULL THEN '驱动: ' || concat_ws(' / ', t1, t2) END, ['主题相关性和当前信号同时靠前', '进入观察池，等待信号或证据增强', '事件/交易风险需先核查'][ti + 1]) AS reason, st AS research_status, 'research_candidate_not_advice' AS recommendation_type, risk_flags, CASE WHEN known AND instrument LIKE '%9' THEN 'yes' END AS event_blocked, round(amount_20d, 6) AS amount_20d, industry
FROM o ORDER BY ti, ts DESC, rs DESC, theme_exposure DESC, instrument LIMIT 12"""


def queries() -> dict:
    return {"theme_back_fill": theme_back_fill, "theme_table": theme_table}


def oracle_sql() -> dict[str, str]:
    return {
        "theme_back_fill": f"WITH {FILLED} SELECT date, instrument, round(ensemble_score, 6) AS ensemble_score, round(family_momentum_score, 6) AS family_momentum_score, round(family_volatility_score, 6) AS family_volatility_score, risk_flags FROM fi",
        "theme_table": TABLE,
    }
