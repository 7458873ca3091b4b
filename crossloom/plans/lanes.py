"""Many factors over many universes in one pass over the bars, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import with_factors
from ..operators import evaluation as ev
from ..operators import market, trades
from ..sources.tables import brand_bars
from .books import GROUPS
from .facts import EMOTION, STATS, market_bars
from .factors import BARS, W, brand_groups, roll, rounded

FORMULAS = {"mom": "$close / Ref($close, 5) - 1", "busy": "$volume / Mean($volume, 5)", "swing": "$close / Mean($close, 10) - 1"}
FACTORS = {"mom": (1, "independent"), "busy": (-1, "short"), "swing": (1, "long")}
HORIZONS, PAIRS = (5, 20), ((0.85, 0.95), (0.95, 1.0))


def bars(spark, sf_dir) -> DataFrame:
    return with_factors(brand_bars(spark, sf_dir), FORMULAS)


STACK = f"""{BARS}, w AS (SELECT *, close / lag(close, 5) OVER {W} - 1 AS mom, volume / avg(volume) OVER {roll(5)} AS busy, close / avg(close) OVER {roll(10)} - 1 AS swing FROM bars),
st AS (SELECT w.*, factor, side, score, score * way AS rank_signal FROM w, LATERAL (VALUES ('mom', 1, 'independent', mom), ('busy', -1, 'short', busy), ('swing', 1, 'long', swing)) v(factor, way, side, score) WHERE score IS NOT NULL)"""


def _ahead(h: int) -> str:
    s = "(PARTITION BY factor, instrument ORDER BY datetime"
    near = f"{s} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"SELECT *, {h} AS horizon, lead(datetime, 1) OVER {s}) AS entry_date, lead(open, 1) OVER {s}) AS entry_open, lead(datetime, {h}) OVER {s}) AS exit_date, lead(close, {h}) OVER {s}) AS exit_close, lead(close, {h}) OVER {s}) / lead(open, 1) OVER {s}) - 1 AS ret, max(high) OVER {near} / lead(open, 1) OVER {s}) - 1 AS mfe, min(low) OVER {near} / lead(open, 1) OVER {s}) - 1 AS mae FROM sc"


LANE = f"""WITH RECURSIVE {STACK},
sc AS (SELECT *, row_number() OVER (PARTITION BY factor, datetime ORDER BY rank_signal, instrument) / CAST(count(*) OVER (PARTITION BY factor, datetime) AS DOUBLE) AS score_pct, row_number() OVER (PARTITION BY factor, instrument ORDER BY datetime) AS bar FROM st),
pa AS (SELECT * FROM ({" UNION ALL ".join(_ahead(h) for h in HORIZONS)}) WHERE exit_date IS NOT NULL),
c AS (SELECT pa.*, CASE WHEN score_pct >= 0.95 THEN 'p95_p100' ELSE 'p85_p95' END AS bucket FROM pa WHERE score_pct >= 0.85),
gr AS (SELECT factor, bucket, horizon, instrument, min(bar) AS bar FROM c GROUP BY ALL
  UNION ALL SELECT x.factor, x.bucket, x.horizon, x.instrument, (SELECT min(c.bar) FROM c WHERE c.factor = x.factor AND c.bucket = x.bucket AND c.horizon = x.horizon AND c.instrument = x.instrument AND c.bar > x.bar + x.horizon) FROM gr x WHERE x.bar IS NOT NULL),
tr AS (SELECT c.* FROM c JOIN gr USING (factor, bucket, horizon, instrument, bar)),
su AS (SELECT factor, bucket, CAST(horizon AS BIGINT) AS horizon, {STATS} FROM tr GROUP BY 1, 2, 3)"""


def lane_summary(spark, sf_dir):
    """Non-overlapping trades of three factors in two buckets and two horizons, summed up."""
    return rounded(trades.summarize(trades.event_lane(bars(spark, sf_dir), FACTORS, HORIZONS, PAIRS), ["factor", "bucket", "horizon"]), [])


def lane_focus(spark, sf_dir):
    """The lane's one row, and that of a lane without trades."""
    some = trades.summarize(trades.event_lane(bars(spark, sf_dir), FACTORS, HORIZONS, PAIRS), ["factor", "bucket", "horizon"]).withColumn("mean_return", F.round("mean_return", 6))
    none = trades.lane_report(some.where("false"), (3, 7)).withColumn("lane", F.lit("none"))
    return rounded(trades.lane_report(some, HORIZONS).withColumn("lane", F.lit("some")).unionByName(none), [])


def lane_universes(spark, sf_dir):
    """Independent trades of three factors in every industry and in one universe of many names, between two signal dates."""
    groups = brand_groups(spark, sf_dir).select("instrument", F.col("industry").alias("universe"))
    members = groups.unionByName(groups.where("instrument not like '%4'").select("instrument", F.lit("many").alias("universe")))
    found = trades.independent_by_universe(bars(spark, sf_dir), FACTORS, members, (3, 8), 0.01, F.lit("1995-03-01").cast("date"), F.lit("1997-10-01").cast("date"))
    return rounded(found.withColumns({c: F.round(c, 4) for c in ("entry_open", "exit_close")}), ["signal_date", "entry_date", "exit_date"])


UNIVERSES = f"""WITH {STACK}, {GROUPS}, mb AS (SELECT instrument, industry AS universe FROM g UNION ALL SELECT instrument, 'many' FROM g WHERE instrument NOT LIKE '%4'), sc AS (FROM st),
pa AS (SELECT * FROM ({_ahead(3)} UNION ALL {_ahead(8)}) WHERE exit_date IS NOT NULL AND rank_signal > 0.01 AND datetime BETWEEN DATE '1995-03-01' AND DATE '1997-10-01')
SELECT mb.universe, factor, side AS trade_side, CAST(horizon AS BIGINT) AS horizon, instrument, datetime AS signal_date, entry_date, exit_date, round(score, 6) AS score, round(rank_signal, 6) AS rank_signal, round(entry_open, 4) AS entry_open, round(exit_close, 4) AS exit_close, round(ret, 6) AS "return", round(mfe, 6) AS mfe, round(mae, 6) AS mae FROM pa JOIN mb USING (instrument)"""


HEAT = {"hot": ("instrument_emotion_score", 1), "cool": ("crowding_cooling_score", -1), "gone": ("no_such_score", 1)}


def emotion_factors(spark, sf_dir):
    """Emotion scores against the closes that follow, one of them missing, one horizon beyond the data."""
    scores = market.instrument_emotion(market.liquidity(market_bars(spark, sf_dir))).select("instrument", "datetime", "instrument_emotion_score", "crowding_cooling_score")
    close = brand_bars(spark, sf_dir).where("month(datetime) <> 2").select("instrument", "datetime", "close")
    return rounded(ev.evaluate_many(scores.join(close, ["instrument", "datetime"]), HEAT, (5, 20, 500)), [])


MEMBERS = ({"name": "mom", "family": "trend", "weight": 0.5}, {"name": "busy", "direction": -1, "source": "volume"}, {"name": "swing", "active": False}, {"name": "absent"})


def combo_members(spark, sf_dir):
    return rounded(ev.member_diagnostics(bars(spark, sf_dir), MEMBERS, (5, 20)), [])


def _ranked(rows: str, keys: str) -> str:
    """Daily ICs, means and turnover of stacked rows (keys, instrument, datetime, signal, future)."""
    d = f"(PARTITION BY {keys}, datetime"
    tie = lambda c: f"rank() OVER {d} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, datetime, {c}) - 1) / 2"
    return f"""ra AS (SELECT *, {tie("signal")} AS rs, {tie("future")} AS rf, row_number() OVER {d} ORDER BY signal, instrument) AS fr, count(*) OVER {d}) AS n FROM {rows}),
dy AS (SELECT {keys}, datetime, CASE WHEN stddev_pop(signal) * stddev_pop(future) > 1e-12 THEN corr(signal, future) END AS ic, CASE WHEN stddev_pop(rs) * stddev_pop(rf) > 1e-12 THEN corr(rs, rf) END AS ric, count(*) AS c FROM ra GROUP BY ALL),
mn AS (SELECT {keys}, avg(ic) AS ic_mean, avg(ric) AS rank_ic_mean, CAST(sum(c) AS BIGINT) AS observations FROM dy GROUP BY ALL),
tp AS (SELECT {keys}, datetime, instrument, dense_rank() OVER (PARTITION BY {keys} ORDER BY datetime) AS i FROM ra WHERE fr / CAST(n AS DOUBLE) >= 1 - 1 / 5e0),
tv AS (SELECT {keys}, avg(t) AS turnover FROM (SELECT {keys}, i, 1 - avg(CASE WHEN nx THEN 1e0 ELSE 0 END) AS t FROM (SELECT a.*, EXISTS (SELECT 1 FROM tp b WHERE b.i = a.i + 1 AND b.instrument = a.instrument AND {" AND ".join(f"b.{k.strip()} = a.{k.strip()}" for k in keys.split(","))}) AS nx, max(i) OVER (PARTITION BY {keys}) AS z FROM tp a) WHERE i < z GROUP BY ALL) GROUP BY ALL),
qb AS (SELECT {keys}, CASE WHEN n >= 5 THEN greatest(1, ceil((fr - 1) * 5 / CAST(greatest(n - 1, 1) AS DOUBLE))) END AS q, future FROM ra), ls AS (SELECT {keys}, avg(future) FILTER (q = 5) - avg(future) FILTER (q = 1) AS long_short FROM qb GROUP BY ALL)"""


HEATED = f"""{EMOTION.partition("SELECT instrument, datetime, e AS")[0].rstrip()}, b2 AS (SELECT s.instrument, s.datetime, s.e, bars.close FROM s JOIN bars USING (instrument, datetime) WHERE month(datetime) <> 2 AND bars.close IS NOT NULL),
lo AS (SELECT factor, horizon, instrument, datetime, signal, future FROM (SELECT *, lead(close, 5) OVER {W} / close - 1 AS f5, lead(close, 20) OVER {W} / close - 1 AS f20 FROM b2), LATERAL (VALUES ('hot', 5, e, f5), ('hot', 20, e, f20), ('cool', 5, -round(100 - e, 4), f5), ('cool', 20, -round(100 - e, 4), f20)) v(factor, horizon, signal, future) WHERE signal IS NOT NULL AND future IS NOT NULL), {_ranked("lo", "factor, horizon")}
SELECT g.factor, CAST(g.direction AS BIGINT) AS direction, CAST(g.horizon AS BIGINT) AS horizon, round(ic_mean, 6) AS ic_mean, round(rank_ic_mean, 6) AS rank_ic_mean, round(turnover, 6) AS turnover, coalesce(observations, 0) AS observations FROM (SELECT * FROM (VALUES ('hot', 1), ('cool', -1), ('gone', 1)) f(factor, direction) CROSS JOIN (VALUES (5), (20), (500)) h(horizon)) g LEFT JOIN mn USING (factor, horizon) LEFT JOIN tv USING (factor, horizon)"""

COMBO = f"""WITH {STACK}, lo AS (SELECT factor, horizon, instrument, datetime, signal, future FROM (SELECT *, lead(close, 5) OVER {W} / close - 1 AS f5, lead(close, 20) OVER {W} / close - 1 AS f20 FROM w), LATERAL (VALUES ('mom', 5, mom, f5), ('mom', 20, mom, f20), ('busy', 5, -busy, f5), ('busy', 20, -busy, f20)) v(factor, horizon, signal, future) WHERE signal IS NOT NULL AND future IS NOT NULL), {_ranked("lo", "factor, horizon")},
al AS (SELECT * FROM mn JOIN ls USING (factor, horizon))
SELECT factor, CASE factor WHEN 'mom' THEN 'trend' ELSE 'busy' END AS family, 'combo_recent_formal' AS suggested_role, 'recent_formal_raw_ic_ls; source=' || CASE factor WHEN 'mom' THEN 'market; direction=1; weight=0.5' ELSE 'volume; direction=-1; weight=1' END AS concerns, {", ".join(f"round(max(rank_ic_mean) FILTER (horizon = {h}), 6) AS neutral_rank_ic_h{h}, round(max(long_short) FILTER (horizon = {h}), 6) AS neutral_long_short_h{h}, max(observations) FILTER (horizon = {h}) AS observations_h{h}" for h in HORIZONS)} FROM al GROUP BY factor"""


def queries() -> dict:
    return {"lane_summary": lane_summary, "lane_focus": lane_focus, "lane_universes": lane_universes, "emotion_factors": emotion_factors, "combo_members": combo_members}


def oracle_sql() -> dict[str, str]:
    return {
        "lane_summary": f"{LANE} SELECT * FROM su",
        "lane_focus": f"{LANE} SELECT 'some' AS lane, CAST(20 AS BIGINT) AS horizon, 'review' AS status, '' AS decision_reason, round(avg(mean_return), 6) AS primary_metric, CAST(floor(avg(trades)) AS BIGINT) AS trade_count FROM su WHERE horizon = 20 AND bucket = 'p95_p100' UNION ALL SELECT 'none', 7, 'discard_candidate', 'no event trades', NULL, 0",
        "lane_universes": UNIVERSES, "emotion_factors": HEATED, "combo_members": COMBO,
    }
