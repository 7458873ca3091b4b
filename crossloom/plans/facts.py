"""Point-in-time, event, trade and market-state queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import with_factors
from ..operators import domains, joins, market, trades, upserts
from ..operators import evaluation as ev
from ..sources.tables import brand_bars, company_events, nation_facts, table
from .factors import BARS, EXTREMES, KEYS, REGIME, SIG, SIGNAL, W, roll, rounded

FACTS = """
facts AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS instrument, CAST(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS report_period,
         round(sum(o_totalprice), 2) AS revenue, count(*) AS orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
pit AS (SELECT *, CASE strftime(report_period, '%m-%d') WHEN '03-31' THEN make_date(year(report_period), 4, 30) WHEN '06-30' THEN make_date(year(report_period), 8, 31)
         WHEN '09-30' THEN make_date(year(report_period), 10, 31) WHEN '12-31' THEN make_date(year(report_period) + 1, 4, 30) END AS available_at FROM facts)"""
PANEL = "panel AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS instrument, CAST(date_trunc('month', o_orderdate) AS DATE) AS datetime FROM orders JOIN customer ON o_custkey = c_custkey)"


def nation_panel(spark, sf_dir) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("string").alias("instrument"), F.trunc(F.to_date("o_orderdate"), "month").alias("datetime")).distinct()


def pit_facts(spark, sf_dir):
    return rounded(nation_facts(spark, sf_dir), ["instrument"])


def thin_facts(spark, sf_dir) -> DataFrame:
    """Facts with gaps: revenue is missing where the number of orders is a multiple of three."""
    return nation_facts(spark, sf_dir).withColumn("thin", F.when(F.col("orders") % 3 != 0, F.col("revenue")))


def join_as_of(spark, sf_dir):
    """Values pass over null facts; the whole-row variant does not."""
    facts = thin_facts(spark, sf_dir)
    panel = nation_panel(spark, sf_dir)
    by_value = joins.as_of(panel, facts, "instrument", "datetime", "available_at", ["thin", "orders"], tie="report_period")
    by_row = joins.as_of(panel, facts.withColumnRenamed("report_period", "period"), "instrument", "datetime", "available_at", ["period", "thin"], whole_row=True, tie="period")
    return rounded(by_value.join(by_row.withColumnRenamed("thin", "thin_row"), KEYS), KEYS)


JOIN_AS_OF = f"""WITH {FACTS}, {PANEL}, thin AS (SELECT *, CASE WHEN orders % 3 <> 0 THEN revenue END AS thin FROM pit),
last AS (SELECT * FROM thin QUALIFY row_number() OVER (PARTITION BY instrument, available_at ORDER BY report_period DESC) = 1),
full_ AS (SELECT * FROM thin WHERE thin IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instrument, available_at ORDER BY report_period DESC) = 1),
v AS (SELECT p.*, t.thin FROM panel p ASOF LEFT JOIN full_ t ON p.instrument = t.instrument AND p.datetime >= t.available_at),
o AS (SELECT p.*, t.orders, t.report_period AS period, t.thin AS thin_row FROM panel p ASOF LEFT JOIN last t ON p.instrument = t.instrument AND p.datetime >= t.available_at)
SELECT instrument, datetime, v.thin, o.orders, o.period, o.thin_row FROM v JOIN o USING (instrument, datetime)"""


def join_latest(spark, sf_dir):
    facts = nation_facts(spark, sf_dir)
    return rounded(joins.latest_per_key(facts, ["instrument"], "available_at", F.lit("1997-06-30").cast("date"), ["report_period"]), ["instrument"])


JOIN_LATEST = f"WITH {FACTS} SELECT instrument, report_period, revenue, orders, available_at FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY available_at DESC, report_period DESC) AS k FROM pit WHERE available_at <= DATE '1997-06-30') WHERE k = 1"


def year_change(spark, sf_dir):
    df = domains.year_change(nation_facts(spark, sf_dir), "revenue", "revenue_change").select("instrument", "report_period", "revenue_change")
    return rounded(df, ["instrument"], 2)


YEAR_CHANGE = f"WITH {FACTS} SELECT instrument, report_period, round(revenue - lag(revenue) OVER (PARTITION BY instrument ORDER BY report_period), 2) AS revenue_change FROM facts"


def snapshots(spark, sf_dir) -> DataFrame:
    """The busiest order priority of each nation and month."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("string").alias("instrument"), F.trunc(F.to_date("o_orderdate"), "month").alias("month"), F.col("o_orderpriority").alias("board")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("instrument", "month").agg(F.max_by("board", F.struct("n", "board")).alias("board"))


SNAPSHOTS = """snap AS (SELECT instrument, month, board FROM (SELECT *, row_number() OVER (PARTITION BY instrument, month ORDER BY n DESC, board DESC) AS k FROM
  (SELECT CAST(c_nationkey AS VARCHAR) AS instrument, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS board, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)) WHERE k = 1),
chg AS (SELECT *, board IS DISTINCT FROM lag(board) OVER (PARTITION BY instrument ORDER BY month) AS new FROM snap),
scd AS (SELECT instrument, board, month AS valid_from, CAST(lead(month) OVER (PARTITION BY instrument ORDER BY month) - INTERVAL 1 DAY AS DATE) AS valid_to FROM chg WHERE new)"""


def scd_collapse(spark, sf_dir):
    return upserts.collapse_versions(snapshots(spark, sf_dir), ["instrument"], "month", ["board"])


def scd_in_force(spark, sf_dir):
    """The version in force in the middle of each quarter; versions of nation 3 end early, so that some are missing."""
    versions = scd_collapse(spark, sf_dir).where("not (instrument = '3' and valid_to is null)")
    rows = nation_facts(spark, sf_dir).select("instrument", F.date_sub("report_period", 40).alias("datetime"))
    return joins.in_force(rows, versions, KEYS, "instrument", "datetime", ["board"])


SCD_IN_FORCE = f"""WITH {FACTS}, {SNAPSHOTS}, v AS (SELECT * FROM scd WHERE NOT (instrument = '3' AND valid_to IS NULL)), r AS (SELECT instrument, CAST(report_period - INTERVAL 40 DAY AS DATE) AS datetime FROM facts)
SELECT r.instrument, r.datetime, v.board, v.instrument IS NULL AS missing FROM r LEFT JOIN v ON r.instrument = v.instrument AND r.datetime >= v.valid_from AND (v.valid_to IS NULL OR r.datetime <= v.valid_to)"""


def upsert_keep_last(spark, sf_dir):
    """Two overlapping loads of the bars, the second with a changed volume and a new column."""
    bars = brand_bars(spark, sf_dir).select("instrument", "datetime", "close", "volume")
    old, new = bars.where("datetime < '1998-01-01'"), bars.where("datetime >= '1997-07-01'").withColumn("volume", F.col("volume") + 1).withColumn("source", F.lit("new"))
    return rounded(upserts.keep_last(old, new, KEYS), KEYS, 8)


UPSERT = f"WITH {BARS} SELECT instrument, datetime, close, CASE WHEN datetime >= DATE '1997-07-01' THEN round(volume + 1, 6) ELSE volume END AS volume, CASE WHEN datetime >= DATE '1997-07-01' THEN 'new' END AS source FROM bars"


def upsert_events(spark, sf_dir):
    """Event logs merged by id, or by content where the id is blank; counts per type."""
    e = company_events(spark, sf_dir).withColumn("event_id", F.when(F.col("event_id").cast("long") % 4 == 0, "").otherwise(F.col("event_id")))
    merged = upserts.merge_events(e, e.where("event_date >= '2024-01-10'").withColumn("severity", F.lit("risk")), "event_id", ["instrument", "event_date", "event_type"])
    return merged.groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("n"))


UPSERT_EVENTS = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS instrument, CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS event_id, event_type, CASE event_type WHEN 'error' THEN 'block' WHEN 'purchase' THEN 'watch' WHEN 'signup' THEN 'risk' ELSE 'info' END AS severity, CAST(ts AS DATE) AS event_date FROM events),
a AS (SELECT *, 0 AS side FROM e UNION ALL SELECT instrument, event_id, event_type, 'risk', event_date, 1 FROM e WHERE event_date >= DATE '2024-01-10'),
k AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN event_id = '' THEN concat_ws('|', 'content', instrument, event_date, event_type) ELSE 'id|' || event_id END ORDER BY side DESC) AS k FROM a)
SELECT event_type, severity, count(*) AS n FROM k WHERE k = 1 GROUP BY 1, 2"""

EVENTS = """ev AS (SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(event_id AS VARCHAR) AS event_id, event_type, CASE event_type WHEN 'error' THEN 'block' WHEN 'purchase' THEN 'watch' WHEN 'signup' THEN 'risk' ELSE 'info' END AS severity, CAST(ts AS DATE) AS event_date FROM events)"""


def event_dates(spark, sf_dir) -> DataFrame:
    people = company_events(spark, sf_dir).select("instrument").distinct()
    return people.select("instrument", F.explode(F.array(*[F.lit(d).cast("date") for d in ("2024-01-05", "2024-01-20", "2024-02-25")])).alias("date"))


DATES = "dates AS (SELECT DISTINCT instrument, d.date FROM ev, (VALUES (DATE '2024-01-05'), (DATE '2024-01-20'), (DATE '2024-02-25')) d(date))"


def event_snapshot(spark, sf_dir):
    return rounded(domains.event_snapshot(event_dates(spark, sf_dir), company_events(spark, sf_dir)), ["instrument"])


EVENT_SNAPSHOT = f"""WITH {EVENTS}, {DATES},
act AS (SELECT d.instrument, d.date, e.event_id, e.event_type, e.severity, e.event_date, row_number() OVER (PARTITION BY d.instrument, d.date ORDER BY e.event_date, e.event_id) AS k FROM dates d JOIN ev e ON e.instrument = d.instrument AND e.event_date <= d.date
  AND e.event_date + CASE e.severity WHEN 'block' THEN 90 WHEN 'risk' THEN 60 WHEN 'watch' THEN 45 ELSE 30 END >= d.date),
g AS (SELECT instrument, date, count(*) AS event_count, sum(CASE WHEN severity = 'block' THEN 1 ELSE 0 END) AS block_count, max(CASE severity WHEN 'info' THEN 0 WHEN 'watch' THEN 1 WHEN 'risk' THEN 2 ELSE 3 END) AS m,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types, string_agg(CASE WHEN k <= 3 THEN CAST(event_date AS VARCHAR) || ':' || event_type END, ';' ORDER BY k) AS summaries FROM act GROUP BY 1, 2)
SELECT d.instrument, d.date, coalesce(event_count, 0) AS event_count, CAST(coalesce(block_count, 0) AS BIGINT) AS block_count, CASE m WHEN 0 THEN 'info' WHEN 1 THEN 'watch' WHEN 2 THEN 'risk' WHEN 3 THEN 'block' ELSE 'none' END AS max_severity,
  coalesce(event_types, '') AS event_types, coalesce(summaries, '') AS summaries, coalesce(block_count, 0) > 0 AS event_blocked FROM dates d LEFT JOIN g USING (instrument, date)"""


def disclosure_scores(spark, sf_dir):
    return rounded(domains.disclosure_scores(event_dates(spark, sf_dir), company_events(spark, sf_dir), ["purchase", "signup"], ["error"]), ["instrument"])


DISCLOSURE = f"""WITH {EVENTS}, {DATES},
m AS (SELECT d.instrument, d.date, e.event_type, d.date - e.event_date AS age, CASE e.severity WHEN 'info' THEN 0.5 WHEN 'watch' THEN 0.7 WHEN 'risk' THEN 1e0 ELSE 1.5 END * (1 - (d.date - e.event_date) / 90.0) AS s FROM dates d JOIN ev e ON e.instrument = d.instrument AND e.event_date <= d.date AND e.event_date >= d.date - 90),
g AS (SELECT instrument, date, coalesce(sum(s) FILTER (event_type IN ('purchase', 'signup')), 0) AS p, coalesce(sum(s) FILTER (event_type = 'error'), 0) AS n, CAST(min(age) AS BIGINT) AS days_since FROM m GROUP BY 1, 2)
SELECT d.instrument, d.date, round(coalesce(p, 0), 6) AS positive_score, round(coalesce(n, 0), 6) AS negative_score, days_since, round(coalesce(p, 0) - coalesce(n, 0), 6) AS net_score FROM dates d LEFT JOIN g USING (instrument, date)"""


def market_bars(spark, sf_dir) -> DataFrame:
    """Bars with a previous close, means over 20 bars, and some missing or zero amounts."""
    df = market.with_previous(brand_bars(spark, sf_dir))
    gap = F.pmod(F.month("datetime") + F.length("instrument"), F.lit(7))
    df = df.withColumn("amount", F.when(gap == 0, None).when(gap == 1, 0.0).otherwise(F.col("amount")))
    w = Window.partitionBy("instrument").orderBy("datetime").rowsBetween(-19, 0)
    return df.withColumn("turnover_20d", F.avg("volume").over(w)).withColumn("amount_20d", F.avg("amount").over(w))


MARKET = f"""mk AS (SELECT * REPLACE (CASE (month(datetime) + length(instrument)) % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE amount END AS amount), lag(close) OVER {W} AS prev_close FROM bars),
mb AS (SELECT *, avg(volume) OVER {roll(20)} AS turnover_20d, avg(amount) OVER {roll(20)} AS amount_20d FROM mk)"""
LIQ = f"""{MARKET},
l0 AS (SELECT *, close IS NULL OR close <= 0 OR coalesce(amount <= 0, false) OR coalesce(volume <= 0, false) AS suspended, CASE WHEN prev_close > 0 THEN close / prev_close - 1 END AS pct_change, CASE WHEN prev_close > 0 THEN (high - low) / prev_close END AS intraday_range, CASE WHEN prev_close > 0 THEN open / prev_close - 1 END AS gap_pct FROM mb),
liq AS (SELECT *, NOT suspended AND coalesce(pct_change >= 0.098, false) AS limit_up, NOT suspended AND coalesce(pct_change <= -0.098, false) AS limit_down, CASE WHEN pct_change IS NOT NULL THEN greatest(-1, least(1, pct_change / 0.098)) END AS limit_pressure FROM l0)"""
STATE = ["instrument", "datetime", "suspended", "limit_up", "limit_down", "tradable", "buy_blocked", "sell_blocked"]


def market_calendar(spark, sf_dir):
    return market.execution_calendar(market_bars(spark, sf_dir)).select(*STATE)


def market_liquidity(spark, sf_dir):
    df = market.liquidity(market_bars(spark, sf_dir))
    return rounded(df.select(*STATE, "pct_change", "intraday_range", "gap_pct", "limit_pressure"), KEYS)


def market_breadth(spark, sf_dir):
    return rounded(market.emotion_score(market.breadth(market.liquidity(market_bars(spark, sf_dir)))), ["datetime"])


BREADTH = f"""WITH {BARS}, {LIQ}, h AS (SELECT datetime, median(turnover_20d) AS m FROM liq WHERE NOT suspended GROUP BY 1),
b AS (SELECT datetime, count(*) FILTER (NOT suspended) AS tradable_count, coalesce(avg(CASE WHEN p > 0 THEN 1e0 ELSE 0e0 END) FILTER (NOT suspended), 0) AS up_ratio, coalesce(avg(CASE WHEN p < 0 THEN 1e0 ELSE 0e0 END) FILTER (NOT suspended), 0) AS down_ratio,
 count(*) FILTER (NOT suspended AND limit_up) AS limit_up_count, count(*) FILTER (NOT suspended AND limit_down) AS limit_down_count, coalesce(avg(p) FILTER (NOT suspended), 0) AS avg_pct_change, coalesce(median(p) FILTER (NOT suspended), 0) AS median_pct_change,
 coalesce(avg(CASE WHEN turnover_20d >= 1.5 * m AND m > 0 THEN 1e0 ELSE 0e0 END) FILTER (NOT suspended AND turnover_20d IS NOT NULL), 0) AS hot_turnover_ratio, coalesce(avg(CASE WHEN p <= -0.05 THEN 1e0 ELSE 0e0 END) FILTER (NOT suspended), 0) AS panic_down_ratio, count(*) FILTER (suspended) AS suspended_count
 FROM (SELECT liq.*, h.m, coalesce(pct_change, 0) AS p FROM liq LEFT JOIN h USING (datetime)) GROUP BY 1),
s AS (SELECT *, 40 * up_ratio + 20 * least(1, limit_up_count / nullif(tradable_count, 0) * 5) + 15 * hot_turnover_ratio + 15 * (greatest(-0.05, least(0.05, avg_pct_change)) + 0.05) / 0.10 + 10 * (1 - panic_down_ratio) - 10 * least(1, limit_down_count / nullif(tradable_count, 0) * 5) AS x FROM b)
SELECT datetime, tradable_count, round(up_ratio, 6) AS up_ratio, round(down_ratio, 6) AS down_ratio, limit_up_count, limit_down_count, round(avg_pct_change, 6) AS avg_pct_change, round(median_pct_change, 6) AS median_pct_change, round(hot_turnover_ratio, 6) AS hot_turnover_ratio, round(panic_down_ratio, 6) AS panic_down_ratio, suspended_count,
 round(greatest(0, least(100, coalesce(x, 50))), 4) AS emotion_score FROM s"""


def market_emotion(spark, sf_dir):
    df = market.instrument_emotion(market.liquidity(market_bars(spark, sf_dir)))
    return rounded(df.select(*KEYS, "instrument_emotion_score", "crowding_cooling_score"), KEYS)


EMOTION = f"""WITH {BARS}, {LIQ}, p AS (SELECT *, coalesce(pct_change, 0) AS pc, coalesce(turnover_20d, amount_20d) AS t FROM liq),
r AS (SELECT *, rank() OVER (PARTITION BY datetime ORDER BY pc) + (count(*) OVER (PARTITION BY datetime, pc) - 1) / 2 AS rp, rank() OVER (PARTITION BY datetime ORDER BY t) + (count(*) OVER (PARTITION BY datetime, t) - 1) / 2 AS rt, count(*) OVER (PARTITION BY datetime) AS n FROM p),
s AS (SELECT *, round(greatest(0, least(100, 100 * (0.55 * CASE WHEN n > 1 THEN rp / n ELSE 0.5 END + 0.25 * CASE WHEN n > 1 THEN rt / n ELSE 0.5 END + CASE WHEN limit_up THEN 0.2 ELSE 0 END) - CASE WHEN limit_down THEN 35 ELSE 0 END - CASE WHEN suspended THEN 50 ELSE 0 END)), 4) AS e FROM r)
SELECT instrument, datetime, e AS instrument_emotion_score, round(100 - e, 4) AS crowding_cooling_score FROM s"""


def shared(spark, sf_dir) -> DataFrame:
    return trades.score_share(with_factors(brand_bars(spark, sf_dir), {"signal": EXTREMES[SIGNAL]}), "signal")


SHARE = f"""{BARS}, {SIG}, sc AS (SELECT *, signal AS rank_signal, row_number() OVER (PARTITION BY datetime ORDER BY signal, instrument) / CAST(count(*) OVER (PARTITION BY datetime) AS DOUBLE) AS score_pct, row_number() OVER {W} AS bar FROM sig WHERE signal IS NOT NULL)"""


def _path(h: int) -> str:
    ahead = f"(PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"SELECT instrument, datetime, bar, score_pct, rank_signal, {h} AS horizon, lead(datetime, 1) OVER {W} AS entry_date, lead(datetime, {h}) OVER {W} AS exit_date, lead(close, {h}) OVER {W} / lead(open, 1) OVER {W} - 1 AS ret, max(high) OVER {ahead} / lead(open, 1) OVER {W} - 1 AS mfe, min(low) OVER {ahead} / lead(open, 1) OVER {W} - 1 AS mae FROM sc"


THRESHOLD = 0.025
PATHS = f"pa AS (SELECT * FROM ({_path(3)} UNION ALL {_path(5)}) WHERE exit_date IS NOT NULL)"
STATS = """count(*) AS trades, round(avg(ret), 6) AS mean_return, round(median(ret), 6) AS median_return, round(avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate, round(coalesce(avg(ret) FILTER (ret > 0), 0), 6) AS avg_win, round(coalesce(avg(ret) FILTER (ret <= 0), 0), 6) AS avg_loss,
 round(avg(mfe), 6) AS mfe_mean, round(median(mfe), 6) AS mfe_median, round(avg(mae), 6) AS mae_mean, round(median(mae), 6) AS mae_median,
 round(CASE WHEN coalesce(avg(ret) FILTER (ret <= 0), 0) <> 0 THEN coalesce(avg(ret) FILTER (ret > 0), 0) / abs(avg(ret) FILTER (ret <= 0)) WHEN coalesce(avg(ret) FILTER (ret > 0), 0) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END, 6) AS payoff,
 round(avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) * coalesce(avg(ret) FILTER (ret > 0), 0) + (1 - avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END)) * coalesce(avg(ret) FILTER (ret <= 0), 0), 6) AS expectancy"""
TRADE_COLUMNS = ["instrument", "horizon", "datetime", "entry_date", "exit_date", "return", "mfe", "mae"]


def trades_independent(spark, sf_dir):
    return rounded(trades.independent_trades(shared(spark, sf_dir), [3, 5], THRESHOLD).select(*TRADE_COLUMNS), KEYS)


def trades_summary(spark, sf_dir):
    t = trades.independent_trades(shared(spark, sf_dir), [3, 5], THRESHOLD).withColumn("year", F.year("entry_date"))
    return rounded(trades.summarize(t, ["horizon", "year"]), [])


def trades_regime(spark, sf_dir):
    t = trades.independent_trades(shared(spark, sf_dir), [3, 5], THRESHOLD).withColumnRenamed("datetime", "signal_date")
    t = trades.annotate_regime(t, ev.market_regime(brand_bars(spark, sf_dir)))
    return rounded(trades.summarize(t, ["horizon", "market_regime"]), [])


def trades_buckets(spark, sf_dir):
    """Greedy non-overlapping trades of every bucket."""
    return rounded(trades.bucket_trades(shared(spark, sf_dir), [3, 5]).select("bucket", *TRADE_COLUMNS), KEYS)


BUCKET_TABLE = "bk AS (SELECT * FROM (VALUES ('p70_p85', 0.70e0, 0.85e0, false), ('p85_p95', 0.85e0, 0.95e0, false), ('p70_p95', 0.70e0, 0.95e0, false), ('p95_p100', 0.95e0, 1e0, true)) v(bucket, lo, hi, closed))"
IN_BUCKET = "score_pct >= lo AND (score_pct < hi OR (closed AND score_pct <= hi))"
TRADES_BUCKETS = f"""WITH RECURSIVE {SHARE}, {PATHS}, {BUCKET_TABLE},
c AS (SELECT bk.bucket, pa.* FROM pa JOIN bk ON {IN_BUCKET}),
g AS (SELECT bucket, horizon, instrument, min(bar) AS bar FROM c GROUP BY 1, 2, 3
  UNION ALL SELECT g.bucket, g.horizon, g.instrument, (SELECT min(c.bar) FROM c WHERE c.bucket = g.bucket AND c.horizon = g.horizon AND c.instrument = g.instrument AND c.bar > g.bar + g.horizon) FROM g WHERE g.bar IS NOT NULL)
SELECT c.bucket, c.instrument, CAST(c.horizon AS BIGINT) AS horizon, c.datetime, c.entry_date, c.exit_date, round(c.ret, 6) AS "return", round(c.mfe, 6) AS mfe, round(c.mae, 6) AS mae FROM c JOIN g ON c.bucket = g.bucket AND c.horizon = g.horizon AND c.instrument = g.instrument AND c.bar = g.bar"""


def trades_two_stage(spark, sf_dir):
    df = shared(spark, sf_dir)
    confirm = trades.score_share(df.drop("rank_signal", "score_pct", "bar").withColumn("c", F.col("volume")), "c").select(*KEYS, F.col("rank_signal").alias("confirm"), F.col("score_pct").alias("confirm_pct"))
    return rounded(trades.two_stage_trades(df.join(confirm, KEYS), (0.70, 0.95), [3, 5], 3, 0.3).select("bucket", *TRADE_COLUMNS), KEYS)


def _two(h: int) -> str:
    ahead = f"(PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 FOLLOWING AND {3 + h} FOLLOWING)"
    return f"SELECT *, {h} AS horizon, lead(datetime, {3 + h}) OVER {W} AS exit_date, lead(close, {3 + h}) OVER {W} / entry_price - 1 AS ret, max(high) OVER {ahead} / entry_price - 1 AS mfe, min(low) OVER {ahead} / entry_price - 1 AS mae FROM b0"


TRADES_TWO = f"""WITH RECURSIVE {SHARE}, a0 AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY volume, instrument) / CAST(count(*) OVER (PARTITION BY datetime) AS DOUBLE) AS vp FROM sc),
b0 AS (SELECT *, lead(vp, 3) OVER {W} AS cp, lead(datetime, 4) OVER {W} AS entry_date, lead(open, 4) OVER {W} AS entry_price FROM a0),
c AS (SELECT * FROM ({_two(3)} UNION ALL {_two(5)}) WHERE exit_date IS NOT NULL AND score_pct >= 0.7 AND score_pct < 0.95 AND cp >= 0.3),
g AS (SELECT horizon, instrument, min(bar) AS bar FROM c GROUP BY 1, 2
  UNION ALL SELECT g.horizon, g.instrument, (SELECT min(c.bar) FROM c WHERE c.horizon = g.horizon AND c.instrument = g.instrument AND c.bar > g.bar + 3 + g.horizon) FROM g WHERE g.bar IS NOT NULL)
SELECT 'p70_p95' AS bucket, c.instrument, CAST(c.horizon AS BIGINT) AS horizon, c.datetime, c.entry_date, c.exit_date, round(c.ret, 6) AS "return", round(c.mfe, 6) AS mfe, round(c.mae, 6) AS mae FROM c JOIN g ON c.horizon = g.horizon AND c.instrument = g.instrument AND c.bar = g.bar"""


def trades_evaluation(spark, sf_dir):
    df = with_factors(brand_bars(spark, sf_dir), {"signal": EXTREMES[SIGNAL]})
    return rounded(trades.bucket_evaluation(df, "signal", [3, 5, 200]), [])


def _eval(h: int) -> str:
    ahead = f"(PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"SELECT score_pct, {h} AS horizon, lead(close, {h}) OVER {W} / close - 1 AS ret, max(high) OVER {ahead} / close - 1 AS mfe, min(low) OVER {ahead} / close - 1 AS mae FROM sc"


EVAL = f"""WITH {SHARE}, e AS (SELECT * FROM ({_eval(3)} UNION ALL {_eval(5)}) WHERE ret IS NOT NULL), {BUCKET_TABLE},
s AS (SELECT horizon, bucket, {STATS.replace("WHEN coalesce(avg(ret) FILTER (ret > 0), 0) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0", "ELSE CAST('inf' AS DOUBLE)")} FROM e JOIN bk ON {IN_BUCKET} GROUP BY 1, 2)
SELECT CAST(h AS BIGINT) AS horizon, bk.bucket, coalesce(trades, 0) AS trades, mean_return, median_return, win_rate, avg_win, avg_loss, mfe_mean, mfe_median, mae_mean, mae_median, payoff, expectancy FROM (SELECT unnest([3, 5, 200]) AS h) CROSS JOIN bk LEFT JOIN s ON s.horizon = h AND s.bucket = bk.bucket"""


def evidence_chunks(spark, sf_dir):
    """Whole documents in fixed-width slices, with each slice's size and digest."""
    df = domains.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.length("chunk_text").cast("long").alias("size"), F.md5("chunk_text").alias("digest"))


CHUNKS = r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, CAST(ceil(length(t) / 500.0) AS BIGINT))) AS chunk_id FROM t WHERE length(t) > 0)
SELECT doc_id, chunk_id, CAST(length(substring(t, chunk_id * 500 + 1, 500)) AS BIGINT) AS size, md5(substring(t, chunk_id * 500 + 1, 500)) AS digest FROM c"""


def evidence_search(spark, sf_dir):
    """The 200 first slices that contain a word, by document and slice: a top-k report."""
    df = domains.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return domains.search(df, ["license", "rights"], order=[F.col("doc_id"), F.col("chunk_id")]).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"))


SEARCH = CHUNKS.split("SELECT doc_id, chunk_id, CAST")[0] + "SELECT doc_id, chunk_id FROM c WHERE contains(lower(substring(t, chunk_id * 500 + 1, 500)), 'license') OR contains(lower(substring(t, chunk_id * 500 + 1, 500)), 'rights') ORDER BY doc_id, chunk_id LIMIT 200"

NOTICE_RULES = ((("license", "licensed"), "license", "watch"), (("rights reserved",), "rights", "risk"), (("example.com",), "contact", "info"))


def evidence_classes(spark, sf_dir):
    """Type and severity of whole documents by the first matching rule, counted by source."""
    docs = table(spark, sf_dir, "documents")
    kind, severity = domains.classify(F.lower(F.coalesce("text", F.lit(""))), NOTICE_RULES)
    return docs.select("source", kind.alias("kind"), severity.alias("severity")).groupBy("source", "kind", "severity").agg(F.count(F.lit(1)).alias("n"))


CLASSES = """SELECT source, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'rights reserved') THEN 'rights' WHEN contains(lower(text), 'example.com') THEN 'contact' ELSE 'other' END AS kind,
 CASE WHEN contains(lower(text), 'license') THEN 'watch' WHEN contains(lower(text), 'rights reserved') THEN 'risk' ELSE 'info' END AS severity, count(*) AS n FROM documents GROUP BY 1, 2, 3"""


def evidence_ids(spark, sf_dir):
    e = company_events(spark, sf_dir)
    return e.select("event_id", domains.event_id(F.col("instrument"), F.col("event_type"), F.col("event_date").cast("string")).alias("content_id"))


IDS = f"WITH {EVENTS} SELECT event_id, substring(sha1(concat_ws('|', instrument, event_type, CAST(event_date AS VARCHAR))), 1, 16) AS content_id FROM ev"


def calendar_quarters(spark, sf_dir):
    return domains.quarters(spark, "1995-02-10", "1997-09-30")


def calendar_padding(spark, sf_dir):
    bars = brand_bars(spark, sf_dir).where("not (month(datetime) = 3)").select("instrument", "datetime", "close")
    calendar = brand_bars(spark, sf_dir).select("datetime").distinct()
    return rounded(domains.pad_calendar(bars, calendar), KEYS, 8)


PADDING = f"""WITH {BARS}, b AS (SELECT instrument, datetime, close FROM bars WHERE month(datetime) <> 3), s AS (SELECT instrument, min(datetime) AS a, max(datetime) AS z FROM b GROUP BY 1)
SELECT s.instrument, c.datetime, b.close FROM s JOIN (SELECT DISTINCT datetime FROM bars) c ON c.datetime BETWEEN a AND z LEFT JOIN b ON b.instrument = s.instrument AND b.datetime = c.datetime"""


def queries() -> dict:
    return {
        "pit_facts": pit_facts, "join_as_of": join_as_of, "join_latest": join_latest, "year_change": year_change, "scd_collapse": scd_collapse, "scd_in_force": scd_in_force,
        "upsert_keep_last": upsert_keep_last, "upsert_events": upsert_events, "event_snapshot": event_snapshot, "disclosure_scores": disclosure_scores, "market_calendar": market_calendar,
        "market_liquidity": market_liquidity, "market_breadth": market_breadth, "market_emotion": market_emotion, "trades_independent": trades_independent, "trades_summary": trades_summary,
        "trades_regime": trades_regime, "trades_buckets": trades_buckets, "trades_two_stage": trades_two_stage, "trades_evaluation": trades_evaluation, "evidence_chunks": evidence_chunks,
        "evidence_search": evidence_search, "evidence_classes": evidence_classes, "evidence_ids": evidence_ids, "calendar_quarters": calendar_quarters, "calendar_padding": calendar_padding,
    }


def oracle_sql() -> dict[str, str]:
    trade = f'SELECT instrument, CAST(horizon AS BIGINT) AS horizon, datetime, entry_date, exit_date, round(ret, 6) AS "return", round(mfe, 6) AS mfe, round(mae, 6) AS mae FROM pa WHERE rank_signal > {THRESHOLD}'
    flags = "instrument, datetime, suspended, limit_up, limit_down, NOT suspended AS tradable, suspended OR limit_up AS buy_blocked, suspended OR limit_down AS sell_blocked"
    strict = "st AS (SELECT * REPLACE (coalesce(close <= 0, true) OR coalesce(amount <= 0, true) OR coalesce(volume <= 0, true) AS suspended) FROM l0), st2 AS (SELECT *, NOT suspended AND coalesce(pct_change >= 0.098, false) AS limit_up, NOT suspended AND coalesce(pct_change <= -0.098, false) AS limit_down FROM st)"
    return {
        "pit_facts": f"WITH {FACTS} SELECT * FROM pit",
        "join_as_of": JOIN_AS_OF, "join_latest": JOIN_LATEST, "year_change": YEAR_CHANGE, "scd_collapse": f"WITH {SNAPSHOTS} SELECT * FROM scd", "scd_in_force": SCD_IN_FORCE, "upsert_keep_last": UPSERT, "upsert_events": UPSERT_EVENTS,
        "event_snapshot": EVENT_SNAPSHOT, "disclosure_scores": DISCLOSURE,
        "market_calendar": f"WITH {BARS}, {LIQ}, {strict} SELECT {flags} FROM st2",
        "market_liquidity": f"WITH {BARS}, {LIQ} SELECT {flags}, round(pct_change, 6) AS pct_change, round(intraday_range, 6) AS intraday_range, round(gap_pct, 6) AS gap_pct, round(limit_pressure, 6) AS limit_pressure FROM liq",
        "market_breadth": BREADTH, "market_emotion": EMOTION,
        "trades_independent": f"WITH {SHARE}, {PATHS} {trade}",
        "trades_summary": f"WITH {SHARE}, {PATHS} SELECT CAST(horizon AS BIGINT) AS horizon, year(entry_date) AS year, {STATS} FROM pa WHERE rank_signal > {THRESHOLD} GROUP BY 1, 2",
        "trades_regime": f"WITH {SHARE}, {PATHS}, {REGIME.replace(BARS + ',', '')} SELECT CAST(horizon AS BIGINT) AS horizon, coalesce(regime, 'unknown') AS market_regime, {STATS} FROM pa LEFT JOIN reg USING (datetime) WHERE rank_signal > {THRESHOLD} GROUP BY 1, 2",
        "trades_buckets": TRADES_BUCKETS, "trades_two_stage": TRADES_TWO, "trades_evaluation": EVAL,
        "evidence_chunks": CHUNKS, "evidence_search": SEARCH, "evidence_classes": CLASSES, "evidence_ids": IDS,
        "calendar_quarters": "SELECT CAST(last_day(CAST(q AS DATE) + INTERVAL 2 MONTH) AS DATE) AS report_period FROM (SELECT unnest(range(TIMESTAMP '1995-01-01', TIMESTAMP '1997-07-02', INTERVAL 3 MONTH)) AS q)",
        "calendar_padding": PADDING,
    }
