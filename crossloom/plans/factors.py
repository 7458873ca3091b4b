"""Factor, cross-section and evaluation queries over the brand bars, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import with_factors
from ..operators import cross_section as xs
from ..operators import evaluation as ev
from ..sources.tables import brand_bars, supplier_bars, table

BARS = """
bars AS (
  SELECT p_brand AS instrument, CAST(date_trunc('month', l_shipdate) AS DATE) AS datetime,
         round(avg(l_extendedprice / l_quantity), 8) AS open, round(max(l_extendedprice / l_quantity), 8) AS high,
         round(min(l_extendedprice / l_quantity), 8) AS low, round(sum(l_extendedprice) / sum(l_quantity), 8) AS close,
         round(sum(l_quantity), 2) AS volume, round(sum(l_extendedprice), 2) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
W = "(PARTITION BY instrument ORDER BY datetime)"


def roll(n: int) -> str:
    return f"(PARTITION BY instrument ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rounded(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """keys as they are, doubles rounded, whole numbers as longs."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if name not in keys and kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


KEYS = ["instrument", "datetime"]

#: Formulas of the registry's kind; the constants and windows are fixed values.
MOMENTUM = {"ret_5": "$close / Ref($close, 5) - 1", "ret_20": "$close / Ref($close, 20) - 1", "ret_60": "$close / Ref($close, 60) - 1", "reversal_5": "Ref($close, 5) / $close - 1", "mom_skip_20_5": "Ref($close, 5) / Ref($close, 20) - 1", "intraday_reversal": "1 - $close / $open"}
VOLATILITY = {"vol_20": "Std($close / Ref($close, 1) - 1, 20)", "vol_adj_mom_20": "($close / Ref($close, 20) - 1) / Std($close / Ref($close, 1) - 1, 20)", "range_vol_20": "Mean(($high - $low) / $close, 20)", "return_variance_20": "Std($close / Ref($close, 1) - 1, 20) * Std($close / Ref($close, 1) - 1, 20)", "intraday_volatility_skew_20": "Std($high / $open, 20) - Std($open / $low, 20)"}
VOLUME = {"turnover_20": "Mean($volume, 20) / Mean($volume, 60)", "volume_mom_5": "Mean($volume, 5) / Ref(Mean($volume, 5), 5) - 1", "vosc_12_26": "(Mean($volume, 12) - Mean($volume, 26)) / (Mean($volume, 12) + 0.000001)", "amihud_illiq_10": "Mean(Abs($close / Ref($close, 1) - 1) / ($amount + 1), 10)", "price_volume_divergence_10": "($close / Ref($close, 10) - 1) - (Mean($volume, 10) / Ref(Mean($volume, 10), 10) - 1)", "quiet_breakout_20": "($close / Ref($close, 20) - 1) - (Mean($volume, 5) / Mean($volume, 20) - 1)"}
EXTREMES = {"price_position_20": "($close - Min($low, 20)) / (Max($high, 20) - Min($low, 20) + 1e-12)", "max_drawdown_20": "Max($close, 20) / $close - 1", "boll_position_20": "($close - Mean($close, 20)) / (2 * Std($close, 20) + 0.000001)", "gap_risk_20": "Mean(Abs($open / Ref($close, 1) - 1), 20)", "selling_pressure_20_60": "Mean(($open - $close) / $open, 20) + Mean(($open - $close) / $open, 60)"}
CORRELATION = {"price_volume_divergence": "0-Corr($close/Mean($close,20),$volume/Mean($volume,20),20)", "high_amount_divergence": "0-Corr($high/Mean($high,20),$amount/Mean($amount,20),20)", "pv_corr_10": "Corr($close / Ref($close, 1) - 1, $volume / Ref($volume, 1) - 1, 10)", "quiet_range_divergence": "0 - Corr($close / Mean($close, 20), $high / $low - 1, 20)"}
LOGIC = {"arbr_26": "(Sum($high - $open, 26) / (Sum($open - $low, 26) + 0.000001)) - (Sum(Greater($high - Ref($close, 1), 0), 26) / (Sum(Greater(Ref($close, 1) - $low, 0), 26) + 0.000001))", "breadth_proxy_20": "Mean(Greater($close / Ref($close, 1) - 1, 0), 20) - Mean(Less($close / Ref($close, 1) - 1, 0), 20)", "downside_vol_20": "Std(Less($close / Ref($close, 1) - 1, 0) * ($close / Ref($close, 1) - 1), 20)", "up_day": "If(And(Gt($close, Ref($close, 1)), Ge($volume, Mean($volume, 5))), 1, 0)", "quiet_day": "If(And(Lt($close, Mean($close, 5)), Le($volume, Ref($volume, 1))), 1, 0)", "recent_up": "Max(Ref(If(And(Gt($close, Mean($close, 21)), Gt(Mean($close, 5), Mean($close, 13))), 1, 0), 3), 10)"}


#: Factors of a very small scale, rounded to twelve digits.
FINE = ["amihud_illiq_10"]


def _factor_query(formulas: dict[str, str]):
    def query(spark, sf_dir):
        panel = with_factors(brand_bars(spark, sf_dir), formulas)
        fine = [F.round(n, 12).alias(n) if n in FINE else n for n in formulas]
        return rounded(panel.select(*KEYS, *fine), [*KEYS, *FINE])

    return query


def _sql(staged: str, final: dict[str, str], source: str = "s2") -> str:
    return f"WITH {BARS}, {staged} SELECT instrument, datetime, " + ", ".join(f"round({e}, {12 if n in FINE else 6}) AS {n}" for n, e in final.items()) + f" FROM {source}"


RET = f"s1 AS (SELECT *, close / lag(close, 1) OVER {W} - 1 AS r, lag(close, 1) OVER {W} AS pc FROM bars)"

SIGNAL = "price_position_20"


def signal_panel(spark, sf_dir) -> DataFrame:
    return with_factors(brand_bars(spark, sf_dir), {"signal": EXTREMES[SIGNAL]})


SIG = f"sig AS (SELECT *, (close - min(low) OVER {roll(20)}) / (max(high) OVER {roll(20)} - min(low) OVER {roll(20)} + 1e-12) AS signal FROM bars)"


def xs_purify(spark, sf_dir):
    df = signal_panel(spark, sf_dir)
    df = xs.mad_winsorize(df, "signal", "winsorized")
    df = xs.zscore(df, "winsorized", "z")
    df = xs.rank_standardize(df, "signal", "ranked")
    return rounded(df.select(*KEYS, "winsorized", "z", "ranked"), KEYS)


XS_PURIFY = f"""WITH {BARS}, {SIG},
m AS (SELECT *, median(signal) OVER (PARTITION BY datetime) AS m FROM sig),
d AS (SELECT *, median(abs(signal - m)) OVER (PARTITION BY datetime) AS d FROM m),
w AS (SELECT *, CASE WHEN coalesce(d, 0) = 0 THEN signal ELSE greatest(m - 3 * 1.4826 * d, least(m + 3 * 1.4826 * d, signal)) END AS winsorized FROM d)
SELECT instrument, datetime, round(winsorized, 6) AS winsorized,
 round(CASE WHEN winsorized IS NULL THEN NULL WHEN coalesce(stddev_pop(winsorized) OVER (PARTITION BY datetime), 0) > 1e-12
   THEN (winsorized - avg(winsorized) OVER (PARTITION BY datetime)) / stddev_pop(winsorized) OVER (PARTITION BY datetime) ELSE 0 END, 6) AS z,
 round((row_number() OVER (PARTITION BY datetime ORDER BY signal, instrument) - 0.5) / count(signal) OVER (PARTITION BY datetime) - 0.5, 6) AS ranked FROM w"""


def brand_groups(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("instrument")).agg(F.max("p_type").alias("industry"), F.min("p_size").alias("least_size"))
    return parts.withColumn("industry", F.when(F.length("instrument") > 7, F.concat("industry", F.lit("_b"))).otherwise(F.concat("industry", F.lit("_a"))))


def xs_neutralize(spark, sf_dir):
    df = xs.size_proxy(xs.attach_group(signal_panel(spark, sf_dir), brand_groups(spark, sf_dir)))
    df = xs.neutralize(df, "signal", ["size_proxy"], None, "size_neutral")
    df = xs.neutralize(df, "signal", [], "industry", "group_neutral")
    df = xs.neutralize(df, "signal", ["size_proxy"], "industry", "both_neutral")
    return rounded(df.select(*KEYS, "size_proxy", "industry", "size_neutral", "group_neutral", "both_neutral"), KEYS)


XS_NEUTRALIZE = f"""WITH {BARS}, {SIG},
g AS (SELECT p_brand AS instrument, max(p_type) || CASE WHEN length(p_brand) > 7 THEN '_b' ELSE '_a' END AS industry FROM part GROUP BY p_brand),
s AS (SELECT sig.*, g.industry, ln(1 + abs(close) * abs(volume)) AS size_proxy FROM sig LEFT JOIN g USING (instrument)),
a AS (SELECT *, signal - avg(signal) OVER (PARTITION BY datetime) AS y1, size_proxy - avg(size_proxy) OVER (PARTITION BY datetime) AS x1,
      signal - avg(signal) OVER (PARTITION BY datetime, industry) AS y2, size_proxy - avg(size_proxy) OVER (PARTITION BY datetime, industry) AS x2,
      count(*) OVER (PARTITION BY datetime) AS n FROM s),
b AS (SELECT *, sum(x1 * y1) OVER (PARTITION BY datetime) AS xy1, sum(x1 * x1) OVER (PARTITION BY datetime) AS xx1,
      sum(x2 * y2) OVER (PARTITION BY datetime) AS xy2, sum(x2 * x2) OVER (PARTITION BY datetime) AS xx2 FROM a)
SELECT instrument, datetime, round(size_proxy, 6) AS size_proxy, industry,
 round(CASE WHEN n >= 2 THEN y1 - CASE WHEN xx1 > 1e-12 THEN xy1 / xx1 ELSE 0 END * x1 END, 6) AS size_neutral,
 round(CASE WHEN n >= 2 THEN y2 END, 6) AS group_neutral,
 round(CASE WHEN n >= 2 THEN y2 - CASE WHEN xx2 > 1e-12 THEN xy2 / xx2 ELSE 0 END * x2 END, 6) AS both_neutral FROM b"""

HORIZONS = (1, 5)


def xs_neutralize_several(spark, sf_dir):
    """Residuals on size, turnover and amount, the last of which is twice the second, without and with industries."""
    df = xs.size_proxy(xs.attach_group(signal_panel(spark, sf_dir), brand_groups(spark, sf_dir)))
    df = df.withColumns({"turn": F.log1p(F.col("volume")), "double_turn": 2 * F.log1p(F.col("volume"))})
    df = xs.neutralize(df, "signal", ["size_proxy", "turn", "double_turn"], None, "plain_neutral")
    df = xs.neutralize(df, "signal", ["size_proxy", "turn", "double_turn"], "industry", "group_neutral")
    return rounded(df.select(*KEYS, "plain_neutral", "group_neutral"), KEYS)


def _two(cell: str, n: str) -> str:
    p = f"(PARTITION BY {cell})"
    d = "(PARTITION BY datetime)"
    return f"""d{n} AS (SELECT *, CASE WHEN ok THEN signal - avg(CASE WHEN ok THEN signal END) OVER {p} END AS y{n}, CASE WHEN ok THEN size_proxy - avg(CASE WHEN ok THEN size_proxy END) OVER {p} END AS a{n}, CASE WHEN ok THEN turn - avg(CASE WHEN ok THEN turn END) OVER {p} END AS b{n} FROM s),
e{n} AS (SELECT *, sum(a{n} * a{n}) OVER {d} AS aa, sum(a{n} * b{n}) OVER {d} AS ab, sum(b{n} * b{n}) OVER {d} AS bb, sum(a{n} * y{n}) OVER {d} AS ay, sum(b{n} * y{n}) OVER {d} AS byy, count(y{n}) OVER {d} AS n FROM d{n}),
f{n} AS (SELECT instrument, datetime, CASE WHEN n >= 2 THEN y{n} - CASE WHEN aa * bb - ab * ab > 1e-10 * aa * bb THEN (ay * bb - byy * ab) / (aa * bb - ab * ab) * a{n} + (byy * aa - ay * ab) / (aa * bb - ab * ab) * b{n} WHEN aa > 0 THEN ay / aa * a{n} ELSE 0 END END AS r FROM e{n})"""


XS_SEVERAL = f"""WITH {BARS}, {SIG},
g AS (SELECT p_brand AS instrument, max(p_type) || CASE WHEN length(p_brand) > 7 THEN '_b' ELSE '_a' END AS industry FROM part GROUP BY p_brand),
s AS (SELECT sig.*, g.industry, ln(1 + abs(close) * abs(volume)) AS size_proxy, ln(1 + volume) AS turn, signal IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL AS ok FROM sig LEFT JOIN g USING (instrument)),
{_two("datetime", "1")}, {_two("datetime, industry", "2")}
SELECT instrument, datetime, round(f1.r, 6) AS plain_neutral, round(f2.r, 6) AS group_neutral FROM f1 JOIN f2 USING (instrument, datetime)"""


def daily(spark, sf_dir) -> DataFrame:
    rows = ev.long_horizons(signal_panel(spark, sf_dir).where("signal is not null"), HORIZONS)
    return ev.daily_ic(rows, "signal")


def ev_daily_ic(spark, sf_dir):
    return rounded(daily(spark, sf_dir), ["horizon", "datetime"])


def ev_ic_summary(spark, sf_dir):
    return rounded(ev.ic_summary(daily(spark, sf_dir)), ["horizon"])


LONG = f"""{BARS}, {SIG},
f AS (SELECT *, lead(close, 1) OVER {W} / close - 1 AS f1, lead(close, 5) OVER {W} / close - 1 AS f5 FROM sig WHERE signal IS NOT NULL),
l AS (SELECT instrument, datetime, signal, 1 AS horizon, f1 AS future FROM f WHERE f1 IS NOT NULL UNION ALL SELECT instrument, datetime, signal, 5, f5 FROM f WHERE f5 IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY horizon, datetime ORDER BY signal) + (count(*) OVER (PARTITION BY horizon, datetime, signal) - 1) / 2 AS rs,
      rank() OVER (PARTITION BY horizon, datetime ORDER BY future) + (count(*) OVER (PARTITION BY horizon, datetime, future) - 1) / 2 AS rf FROM l),
d AS (SELECT CAST(horizon AS BIGINT) AS horizon, datetime,
      CASE WHEN stddev_pop(signal) * stddev_pop(future) > 1e-12 THEN covar_pop(signal, future) / (stddev_pop(signal) * stddev_pop(future)) END AS ic,
      CASE WHEN stddev_pop(rs) * stddev_pop(rf) > 1e-12 THEN covar_pop(rs, rf) / (stddev_pop(rs) * stddev_pop(rf)) END AS rank_ic, count(*) AS n FROM r GROUP BY 1, 2)"""
SUMMARY = "SELECT horizon, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) END AS icir, avg(rank_ic) AS rank_ic_mean, stddev_samp(rank_ic) AS rank_ic_std, CASE WHEN stddev_samp(rank_ic) > 0 THEN avg(rank_ic) / stddev_samp(rank_ic) END AS rank_icir, CAST(sum(n) AS BIGINT) AS observations FROM d GROUP BY horizon"
QUANTS = """q AS (SELECT *, greatest(1, CAST(ceil((row_number() OVER (PARTITION BY horizon, datetime ORDER BY signal, instrument) - 1) * 5 / greatest(count(*) OVER (PARTITION BY horizon, datetime) - 1, 1)) AS INT)) AS q, count(*) OVER (PARTITION BY horizon, datetime) AS n FROM l),
qs AS (SELECT horizon, avg(future) FILTER (q = 1) AS q1, avg(future) FILTER (q = 2) AS q2, avg(future) FILTER (q = 3) AS q3, avg(future) FILTER (q = 4) AS q4, avg(future) FILTER (q = 5) AS q5 FROM q WHERE n >= 5 GROUP BY horizon)"""
TOP = """p AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY signal, instrument) / CAST(count(*) OVER (PARTITION BY datetime) AS DOUBLE) AS share FROM sig WHERE signal IS NOT NULL),
t AS (SELECT datetime, instrument, dense_rank() OVER (ORDER BY datetime) AS i FROM p WHERE share >= 1 - 1.0 / 5),
tt AS (SELECT avg(x) AS turnover FROM (SELECT a.i, 1 - count(b.instrument) / CAST(count(*) AS DOUBLE) AS x FROM t a LEFT JOIN t b ON b.i = a.i + 1 AND b.instrument = a.instrument WHERE a.i < (SELECT max(i) FROM t) GROUP BY a.i))"""


def ev_quantiles(spark, sf_dir):
    rows = ev.long_horizons(signal_panel(spark, sf_dir).where("signal is not null"), HORIZONS)
    return rounded(ev.quantile_returns(rows, "signal"), ["horizon"])


def ev_turnover(spark, sf_dir):
    return rounded(ev.top_turnover(signal_panel(spark, sf_dir), "signal", 5), [])


def ev_evaluate(spark, sf_dir):
    return rounded(ev.evaluate(signal_panel(spark, sf_dir), "signal", [1, 5, 200]), ["horizon"])


def ev_regime(spark, sf_dir):
    return rounded(ev.market_regime(brand_bars(spark, sf_dir)), ["datetime"])


REGIME = f"""{BARS},
m0 AS (SELECT datetime, close / lag(close) OVER {W} - 1 AS r FROM bars),
m1 AS (SELECT datetime, coalesce(avg(r), 0) AS market_return FROM m0 GROUP BY 1),
m2 AS (SELECT *, product(1 + market_return) OVER (ORDER BY datetime) AS proxy FROM m1),
m3 AS (SELECT *, avg(proxy) OVER (ORDER BY datetime ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS fast_mean, avg(proxy) OVER (ORDER BY datetime ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS slow_mean, coalesce(proxy / lag(proxy, 20) OVER (ORDER BY datetime) - 1, 0) AS trend_return FROM m2),
reg AS (SELECT *, CASE WHEN fast_mean >= slow_mean AND proxy >= slow_mean AND trend_return > 0.02 THEN 'up' WHEN fast_mean <= slow_mean AND proxy <= slow_mean AND trend_return < -0.02 THEN 'down' ELSE 'sideways' END AS regime FROM m3)"""


def ev_segments(spark, sf_dir):
    days = daily(spark, sf_dir).where("horizon = 1").drop("horizon")
    return rounded(ev.segmented_ic(days, ev.market_regime(brand_bars(spark, sf_dir))), [])


def ev_ranking(spark, sf_dir):
    """Several factors through one panel: rank IC of each at one horizon, ranked; role of each against its neutral version."""
    formulas = {n: f for g in (MOMENTUM, EXTREMES) for n, f in g.items() if n in ("ret_5", "reversal_5", "price_position_20", "max_drawdown_20", "gap_risk_20")}
    panel = ev.forward_return(with_factors(brand_bars(spark, sf_dir), formulas), 1)
    long = panel.select(*KEYS, F.col("fwd_1").alias("future"), F.inline(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("signal")) for n in formulas])))
    results = ev.ic_summary(ev.daily_ic(long.where("future is not null"), "signal", ["factor"]), ["factor"])
    ranked = ev.rank_factors(results, "rank_ic_mean", 10)
    made = ranked.withColumn("role", ev.role(F.col("rank_ic_mean"), F.col("rank_icir"), F.col("ic_mean"), F.lit(1.0)))
    return rounded(made.select("factor", "rank_ic_mean", "rank_icir", "observations", "position", "role"), ["factor"])


EV_RANKING = f"""WITH {BARS},
e AS (SELECT *, close / lag(close, 5) OVER {W} - 1 AS ret_5, lag(close, 5) OVER {W} / close - 1 AS reversal_5, (close - min(low) OVER {roll(20)}) / (max(high) OVER {roll(20)} - min(low) OVER {roll(20)} + 1e-12) AS price_position_20,
      max(close) OVER {roll(20)} / close - 1 AS max_drawdown_20, abs(open / lag(close) OVER {W} - 1) AS gap, lead(close) OVER {W} / close - 1 AS future FROM bars),
e2 AS (SELECT *, avg(gap) OVER {roll(20)} AS gap_risk_20 FROM e),
l AS (SELECT datetime, instrument, future, factor, signal FROM (UNPIVOT e2 ON ret_5, reversal_5, price_position_20, max_drawdown_20, gap_risk_20 INTO NAME factor VALUE signal) WHERE future IS NOT NULL AND signal IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY factor, datetime ORDER BY signal) + (count(*) OVER (PARTITION BY factor, datetime, signal) - 1) / 2 AS rs, rank() OVER (PARTITION BY factor, datetime ORDER BY future) + (count(*) OVER (PARTITION BY factor, datetime, future) - 1) / 2 AS rf FROM l),
d AS (SELECT factor, datetime, CASE WHEN stddev_pop(signal) * stddev_pop(future) > 1e-12 THEN covar_pop(signal, future) / (stddev_pop(signal) * stddev_pop(future)) END AS ic, CASE WHEN stddev_pop(rs) * stddev_pop(rf) > 1e-12 THEN covar_pop(rs, rf) / (stddev_pop(rs) * stddev_pop(rf)) END AS rank_ic, count(*) AS n FROM r GROUP BY 1, 2),
s AS (SELECT factor, avg(ic) AS ls, avg(rank_ic) AS m, CASE WHEN stddev_samp(rank_ic) > 0 THEN avg(rank_ic) / stddev_samp(rank_ic) END AS ir, CAST(sum(n) AS BIGINT) AS observations FROM d GROUP BY 1)
SELECT factor, round(m, 6) AS rank_ic_mean, round(ir, 6) AS rank_icir, observations, row_number() OVER (ORDER BY round(abs(m), 9) DESC NULLS LAST, factor) AS position,
 CASE WHEN m >= 0.035 AND ir >= 0.25 AND ls > 0 THEN 'core_candidate' WHEN m >= 0.025 AND ls > 0 THEN 'candidate_review' WHEN m >= 0.025 THEN 'shadow_review' ELSE 'reject_review' END AS role FROM s WHERE observations >= 10"""


def supplier_factors(spark, sf_dir):
    """Many factors over many instruments in one pass: a single exchange and sort serves every window."""
    formulas = MOMENTUM | EXTREMES | {"vol_20": VOLATILITY["vol_20"]}
    panel = with_factors(supplier_bars(spark, sf_dir), formulas)
    return rounded(panel.select(*KEYS, "ret_5", "ret_20", "price_position_20", "max_drawdown_20", "vol_20"), KEYS)


SUPPLIER = f"""WITH bars AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(date_trunc('month', l_shipdate) AS DATE) AS datetime, round(max(l_extendedprice / l_quantity), 8) AS high, round(min(l_extendedprice / l_quantity), 8) AS low, round(sum(l_extendedprice) / sum(l_quantity), 8) AS close FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, close / lag(close) OVER {W} - 1 AS r FROM bars)
SELECT instrument, datetime, round(close / lag(close, 5) OVER {W} - 1, 6) AS ret_5, round(close / lag(close, 20) OVER {W} - 1, 6) AS ret_20, round((close - min(low) OVER {roll(20)}) / (max(high) OVER {roll(20)} - min(low) OVER {roll(20)} + 1e-12), 6) AS price_position_20, round(max(close) OVER {roll(20)} / close - 1, 6) AS max_drawdown_20, round(stddev_samp(r) OVER {roll(20)}, 6) AS vol_20 FROM s"""


def queries() -> dict:
    return {
        "supplier_factors": supplier_factors,
        "factor_momentum": _factor_query(MOMENTUM), "factor_volatility": _factor_query(VOLATILITY), "factor_volume": _factor_query(VOLUME), "factor_extremes": _factor_query(EXTREMES),
        "factor_correlation": _factor_query(CORRELATION), "factor_logic": _factor_query(LOGIC), "xs_purify": xs_purify, "xs_neutralize": xs_neutralize, "xs_neutralize_several": xs_neutralize_several, "ev_daily_ic": ev_daily_ic,
        "ev_ic_summary": ev_ic_summary, "ev_quantiles": ev_quantiles, "ev_turnover": ev_turnover, "ev_evaluate": ev_evaluate, "ev_regime": ev_regime, "ev_segments": ev_segments, "ev_ranking": ev_ranking,
    }


def _corr(x: str, y: str, n: int) -> str:
    both = lambda a: f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {a} END"
    a, b, w = both(x), both(y), roll(n)
    return f"CASE WHEN stddev_pop({a}) OVER {w} * stddev_pop({b}) OVER {w} > 1e-12 THEN covar_pop({a}, {b}) OVER {w} / (stddev_pop({a}) OVER {w} * stddev_pop({b}) OVER {w}) END"


def oracle_sql() -> dict[str, str]:
    lag = lambda c, n: f"lag({c}, {n}) OVER {W}"
    over = lambda f, c, n: f"{f}({c}) OVER {roll(n)}"
    r6 = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
    regime_columns = ("market_return", "proxy", "fast_mean", "slow_mean", "trend_return")
    return {
        "supplier_factors": SUPPLIER,
        "factor_momentum": _sql("s2 AS (SELECT * FROM bars)", {"ret_5": f"close / {lag('close', 5)} - 1", "ret_20": f"close / {lag('close', 20)} - 1", "ret_60": f"close / {lag('close', 60)} - 1", "reversal_5": f"{lag('close', 5)} / close - 1", "mom_skip_20_5": f"{lag('close', 5)} / {lag('close', 20)} - 1", "intraday_reversal": "1 - close / open"}),
        "factor_volatility": _sql(RET, {"vol_20": over("stddev_samp", "r", 20), "vol_adj_mom_20": f"(close / {lag('close', 20)} - 1) / nullif({over('stddev_samp', 'r', 20)}, 0)", "range_vol_20": over("avg", "(high - low) / close", 20), "return_variance_20": f"{over('stddev_samp', 'r', 20)} * {over('stddev_samp', 'r', 20)}", "intraday_volatility_skew_20": f"{over('stddev_samp', 'high / open', 20)} - {over('stddev_samp', 'open / low', 20)}"}, "s1"),
        "factor_volume": _sql(RET + f", s2 AS (SELECT *, {over('avg', 'volume', 5)} AS v5, {over('avg', 'volume', 10)} AS v10, {over('avg', 'volume', 20)} AS v20, {over('avg', 'abs(r) / (amount + 1)', 10)} AS il FROM s1)", {"turnover_20": f"v20 / {over('avg', 'volume', 60)}", "volume_mom_5": f"v5 / {lag('v5', 5)} - 1", "vosc_12_26": f"({over('avg', 'volume', 12)} - {over('avg', 'volume', 26)}) / ({over('avg', 'volume', 12)} + 0.000001)", "amihud_illiq_10": "il", "price_volume_divergence_10": f"(close / {lag('close', 10)} - 1) - (v10 / {lag('v10', 10)} - 1)", "quiet_breakout_20": f"(close / {lag('close', 20)} - 1) - (v5 / v20 - 1)"}),
        "factor_extremes": _sql(RET, {"price_position_20": f"(close - {over('min', 'low', 20)}) / ({over('max', 'high', 20)} - {over('min', 'low', 20)} + 1e-12)", "max_drawdown_20": f"{over('max', 'close', 20)} / close - 1", "boll_position_20": f"(close - {over('avg', 'close', 20)}) / (2 * {over('stddev_samp', 'close', 20)} + 0.000001)", "gap_risk_20": over("avg", "abs(open / pc - 1)", 20), "selling_pressure_20_60": f"{over('avg', '(open - close) / open', 20)} + {over('avg', '(open - close) / open', 60)}"}, "s1"),
        "factor_correlation": _sql(RET + f", s2 AS (SELECT *, close / {over('avg', 'close', 20)} AS c1, high / {over('avg', 'high', 20)} AS h1, volume / {over('avg', 'volume', 20)} AS v1, amount / {over('avg', 'amount', 20)} AS a1, volume / {lag('volume', 1)} - 1 AS vr, high / low - 1 AS hl FROM s1)", {"price_volume_divergence": "0 - " + _corr("c1", "v1", 20), "high_amount_divergence": "0 - " + _corr("h1", "a1", 20), "pv_corr_10": _corr("r", "vr", 10), "quiet_range_divergence": "0 - " + _corr("c1", "hl", 20)}),
        "factor_logic": _sql(RET + f", s2 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - pc, 0) END AS g1, CASE WHEN pc IS NOT NULL THEN greatest(pc - low, 0) END AS g2, CASE WHEN r IS NOT NULL THEN greatest(r, 0) END AS up, CASE WHEN r IS NOT NULL THEN least(r, 0) END AS dn, CASE WHEN coalesce(close > {over('avg', 'close', 21)}, false) AND coalesce({over('avg', 'close', 5)} > {over('avg', 'close', 13)}, false) THEN 1e0 ELSE 0e0 END AS f, {over('avg', 'volume', 5)} AS v5, {over('avg', 'close', 5)} AS m5, lag(volume) OVER {W} AS pv FROM s1), s3 AS (SELECT *, lag(f, 3) OVER {W} AS f3 FROM s2)", {"arbr_26": f"({over('sum', 'high - open', 26)} / ({over('sum', 'open - low', 26)} + 0.000001)) - ({over('sum', 'g1', 26)} / ({over('sum', 'g2', 26)} + 0.000001))", "breadth_proxy_20": f"{over('avg', 'up', 20)} - {over('avg', 'dn', 20)}", "downside_vol_20": over("stddev_samp", "dn * r", 20), "up_day": "CASE WHEN coalesce(close > pc, false) AND coalesce(volume >= v5, false) THEN 1e0 ELSE 0e0 END", "quiet_day": "CASE WHEN coalesce(close < m5, false) AND coalesce(volume <= pv, false) THEN 1e0 ELSE 0e0 END", "recent_up": over("max", "f3", 10)}, "s3"),
        "xs_purify": XS_PURIFY,
        "xs_neutralize": XS_NEUTRALIZE,
        "xs_neutralize_several": XS_SEVERAL,
        "ev_daily_ic": f"WITH {LONG} SELECT horizon, datetime, round(ic, 6) AS ic, round(rank_ic, 6) AS rank_ic, n FROM d",
        "ev_ic_summary": f"WITH {LONG} SELECT horizon, {r6(('ic_mean', 'ic_std', 'icir', 'rank_ic_mean', 'rank_ic_std', 'rank_icir'))}, observations FROM ({SUMMARY})",
        "ev_quantiles": f"WITH {LONG}, {QUANTS} SELECT CAST(horizon AS BIGINT) AS horizon, {r6(('q1', 'q2', 'q3', 'q4', 'q5'))}, round(q5 - q1, 6) AS long_short FROM qs",
        "ev_turnover": f"WITH {BARS}, {SIG}, {TOP} SELECT round(turnover, 6) AS turnover FROM tt",
        "ev_evaluate": f"WITH {LONG}, {QUANTS}, {TOP} SELECT CAST(h AS BIGINT) AS horizon, {r6(('ic_mean', 'ic_std', 'icir', 'rank_ic_mean', 'rank_ic_std', 'rank_icir'))}, coalesce(observations, 0) AS observations, {r6(('q1', 'q2', 'q3', 'q4', 'q5'))}, round(q5 - q1, 6) AS long_short, round(turnover, 6) AS turnover FROM (SELECT unnest([1, 5, 200]) AS h) LEFT JOIN ({SUMMARY}) s ON s.horizon = h LEFT JOIN qs ON qs.horizon = h CROSS JOIN tt",
        "ev_regime": f"WITH {REGIME} SELECT datetime, {r6(regime_columns)}, regime FROM reg",
        "ev_segments": f"""WITH {LONG}, {REGIME.replace(BARS + ",", "")}, j AS (SELECT year(d.datetime) AS y, coalesce(regime, 'unknown') AS regime, rank_ic FROM d LEFT JOIN reg USING (datetime) WHERE horizon = 1 AND n >= 10),
 u AS (SELECT 'overall' AS segment, 'all' AS value, rank_ic FROM j UNION ALL SELECT 'year', CAST(y AS VARCHAR), rank_ic FROM j UNION ALL SELECT 'regime', regime, rank_ic FROM j)
 SELECT segment, value, count(rank_ic) AS days, round(avg(rank_ic), 6) AS rank_ic_mean, round(avg(CASE WHEN rank_ic > 0 THEN 1.0 WHEN rank_ic IS NOT NULL THEN 0.0 END), 6) AS positive_rate FROM u GROUP BY 1, 2""",
        "ev_ranking": EV_RANKING,
    }
