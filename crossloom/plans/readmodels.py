"""Read models over portfolios, domains, strategies and prices, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market
from ..operators import readmodels as rm
from ..sources.tables import brand_bars, table
from .books import NEXT, PORTFOLIO, target_on
from .facts import BREADTH, market_bars
from .factors import BARS, W, roll, rounded
from .governance import GOVERNED, governed


def _executed(spark, sf_dir):
    """The month's targets as executed: some names dropped, some cut, one added."""
    last = F.substring("instrument", -1, 1)
    p = target_on(spark, sf_dir, NEXT).select("instrument", "rank", F.when(last == "1", F.col("target_weight") / 2).otherwise(F.col("target_weight")).alias("target_weight"), "ensemble_score", F.when(last == "2", "cut").alias("risk_flags")).where(last != "3")
    return p.unionByName(spark.range(1).select(F.lit("Extra").alias("instrument"), F.lit(99).alias("rank"), F.lit(0.01).alias("target_weight"), F.lit(None).cast("double").alias("ensemble_score"), F.lit(None).cast("string").alias("risk_flags")))


def layer_detail(spark, sf_dir):
    return rounded(rm.layers(target_on(spark, sf_dir, NEXT).select("instrument", "rank", "target_weight", "ensemble_score"), _executed(spark, sf_dir)), [])


def layer_cards(spark, sf_dir):
    detail = rm.layers(target_on(spark, sf_dir, NEXT).select("instrument", "rank", "target_weight"), _executed(spark, sf_dir))
    return rounded(rm.layer_cards(detail), [])


LAYERS = f"""{PORTFOLIO}, a AS (SELECT instrument, rank, target_weight, round(ensemble_score, 9) AS s FROM pf WHERE date = DATE '{NEXT}'), b AS (SELECT instrument, rank, CASE WHEN instrument LIKE '%1' THEN target_weight / 2 ELSE target_weight END AS target_weight, s, CASE WHEN instrument LIKE '%2' THEN 'cut' END AS rf FROM a WHERE instrument NOT LIKE '%3' UNION ALL SELECT 'Extra', 99, 0.01, NULL, NULL),
la AS (SELECT coalesce(a.instrument, b.instrument) AS instrument, a.rank AS research_rank, b.rank AS execution_rank, coalesce(a.target_weight, 0) AS research_weight, coalesce(b.target_weight, 0) AS execution_weight, coalesce(b.target_weight, 0) - coalesce(a.target_weight, 0) AS weight_delta, CASE WHEN b.instrument IS NULL THEN 'removed' WHEN a.instrument IS NULL THEN 'added' WHEN abs(b.target_weight - a.target_weight) > 1e-9 THEN 'scaled' ELSE 'unchanged' END AS action, b.s AS ensemble_score, coalesce(b.rf, '') AS risk_flags FROM a FULL JOIN b ON a.instrument = b.instrument)"""


def market_common(spark, sf_dir):
    """Names priced in two months, and none priced in a month without bars."""
    bars = brand_bars(spark, sf_dir)
    now = bars.where(F.col("datetime") == NEXT).where("instrument not like '%7'")
    later = bars.where(F.col("datetime") == F.add_months(F.lit(NEXT).cast("date"), 1)).where("instrument not like '%8'")
    pair = rm.common_return(now, later).withColumn("kind", F.lit("two"))
    return rounded(pair.unionByName(rm.common_return(now, later.where("false")).withColumn("kind", F.lit("none"))), [])


#: Already rounded, as the bars are.
PRICES = ("close", "prev_close", "open", "high", "low")


def liquidity_panel(spark, sf_dir):
    bars = brand_bars(spark, sf_dir).withColumn("turnover", F.col("volume") / 7)
    return rounded(rm.liquidity_scan(bars, F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date")), ["datetime", *PRICES])


PANEL = f"WITH {BARS}, t AS (SELECT *, volume / 7 AS turnover, lag(close) OVER {W} AS prev_close, avg(amount) OVER {roll(20)} AS amount_20d, avg(volume / 7) OVER {roll(20)} AS turnover_20d FROM bars) SELECT datetime, instrument, {', '.join(c if c in PRICES else f'round({c}, 6) AS {c}' for c in rm.LIQUIDITY)} FROM t WHERE datetime BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"


def strategy_list(spark, sf_dir):
    """Parts as strategies, brands as families, of which the cheap ones are in the combination already: a top-k report."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    entries = p.select(F.format_string("s%06d", k).alias("strategy_id"), F.col("p_brand").alias("strategy_family"), F.lower("p_type").alias("candidate_lane"), F.element_at(F.array(*[F.lit(x) for x in ("Low", "mid", "HIGH", "none", "medium")]), (k % 5 + 1).cast("int")).alias("transferability"))
    members = p.where("p_partkey % 10 = 0").select(F.col("p_brand").alias("strategy_family")).where("strategy_family not like '%4'")
    return rm.strategy_ideas(rm.strategy_entries(entries, least="medium"), members, 40, "economy")


IDEAS = """WITH e AS (SELECT printf('s%06d', p_partkey) AS strategy_id, p_brand AS strategy_family, lower(p_type) AS candidate_lane, ['Low', 'mid', 'HIGH', 'none', 'medium'][p_partkey % 5 + 1] AS transferability, [1, 2, 3, 0, 2][p_partkey % 5 + 1] AS t FROM part), m AS (SELECT p_brand AS strategy_family, count(*) AS n FROM part WHERE p_partkey % 10 = 0 AND p_brand NOT LIKE '%4' GROUP BY 1)
SELECT strategy_family, strategy_id, candidate_lane, transferability, CASE WHEN n IS NULL THEN 'missing family: ' || strategy_family ELSE 'family already present ' || n || ' time(s); use as variant or benchmark' END AS reason FROM e LEFT JOIN m USING (strategy_family) WHERE t >= 2 AND candidate_lane = 'economy' ORDER BY coalesce(n, 0), t DESC, strategy_id LIMIT 40"""


def health_rows(spark, sf_dir):
    dated = brand_bars(spark, sf_dir).agg(F.max("datetime").alias("latest_date")).select(F.lit("facts").alias("domain"), "latest_date")
    return rounded(rm.domain_health(governed(spark, sf_dir), dated), ["latest_date"], 3)


def health_cards(spark, sf_dir):
    liquid = market.liquidity(market_bars(spark, sf_dir))
    felt = market.emotion_score(market.breadth(liquid)).withColumnRenamed("datetime", "trade_date")
    return rounded(rm.health_cards(governed(spark, sf_dir), liquid, felt), [], 4)


def queries() -> dict:
    return {"layer_detail": layer_detail, "layer_cards": layer_cards, "market_common": market_common, "liquidity_panel": liquidity_panel, "strategy_list": strategy_list, "health_rows": health_rows, "health_cards": health_cards}


def oracle_sql() -> dict[str, str]:
    inner, _, last = BREADTH.rpartition("\nSELECT datetime")
    return {
        "layer_detail": f"WITH {LAYERS} SELECT * REPLACE (round(research_weight, 6) AS research_weight, round(execution_weight, 6) AS execution_weight, round(weight_delta, 6) AS weight_delta, round(ensemble_score, 6) AS ensemble_score) FROM la",
        "layer_cards": f"WITH {LAYERS} SELECT count(research_rank) AS research_positions, count(execution_rank) AS execution_positions, round(sum(research_weight), 6) AS research_gross_weight, round(sum(execution_weight), 6) AS execution_gross_weight, count(*) FILTER (action = 'removed') AS removed_positions, count(*) FILTER (action = 'scaled') AS scaled_positions, round(sum(execution_weight) - sum(research_weight), 6) AS weight_delta FROM la",
        "market_common": f"WITH {BARS} SELECT 'two' AS kind, count(*) AS instruments, round(avg(b.close / a.close - 1), 6) AS market_return FROM bars a JOIN bars b USING (instrument) WHERE a.datetime = DATE '{NEXT}' AND b.datetime = DATE '{NEXT}' + INTERVAL 1 MONTH AND instrument NOT LIKE '%7' AND instrument NOT LIKE '%8' UNION ALL SELECT 'none', 0, 0",
        "liquidity_panel": PANEL, "strategy_list": IDEAS,
        "health_rows": f"WITH {BARS}, gv AS ({GOVERNED}) SELECT domain, activation_lane, status, activation_status, round(coverage_ratio * 100, 3) AS coverage_pct, round(pit_field_completeness * 100, 3) AS pit_pct, freshness_status, rows, CASE WHEN domain = 'facts' THEN (SELECT max(datetime) FROM bars) END AS latest_date, detail FROM gv",
        "health_cards": f"{inner}, em AS (SELECT datetime{last}), gv AS ({GOVERNED}) SELECT * FROM (SELECT count(*) AS domains, count(*) FILTER (activation_status = 'active') AS active, count(*) FILTER (activation_status = 'shadow') AS shadow, count(*) FILTER (status = 'fail') AS failed FROM gv) CROSS JOIN (SELECT count(*) AS liquidity_rows, count(*) FILTER (suspended OR limit_up) AS buy_blocked, count(*) FILTER (suspended) AS suspended, round(median(amount_20d), 4) AS median_amount_20d FROM liq) CROSS JOIN (SELECT count(*) AS emotion_rows, round(arg_max(emotion_score, datetime), 4) AS mean_emotion_score, arg_max(limit_up_count, datetime) AS latest_limit_up_count, round(arg_max(up_ratio, datetime), 4) AS latest_up_ratio FROM em)",
    }
