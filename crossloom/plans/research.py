"""Queries over candidate factors: grid, checks, likeness, redundancy, diagnostics, reviews, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import with_factors
from ..operators import cross_section as xs
from ..operators import evaluation as ev
from ..operators import research as rs
from ..sources.tables import brand_bars
from .factors import BARS, EXTREMES, KEYS, MOMENTUM, REGIME, VOLATILITY, VOLUME, W, roll, rounded

FAMILIES = {"momentum": MOMENTUM, "volatility": VOLATILITY, "volume": VOLUME, "extremes": EXTREMES}
#: (family, name, expression, position) of the catalogue, and templates with their windows.
CATALOGUE = [(family, name, text, i) for i, (family, name, text) in enumerate((f, n, t) for f, g in FAMILIES.items() for n, t in g.items())]
TEMPLATES = [("momentum", "ret_{value}", "$close / Ref($close, {value}) - 1", [5, 20, 60]), ("volatility", "vol_{value}", "Std($close / Ref($close, 1) - 1, {value})", [10, 20]), ("gap", "gap", "$open / Ref($close, 1) - 1", []), ("odd", "skew_{value}", "Skew($vwap, {value})", [7])]
ALLOWED = {"families": ["momentum", "volatility", "gap", "odd"], "fields": ["open", "high", "low", "close", "volume"], "operators": ["Ref", "Mean", "Std", "Max", "Min"], "windows": [1, 5, 10, 20]}


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "family string, name string, expression string, position int")


def _text(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


CANDIDATES = "c(family, name, expression, position) AS (VALUES " + ", ".join(f"({_text(f)}, {_text(n)}, {_text(t)}, {i})" for f, n, t, i in CATALOGUE) + ")"


def fx_grid(spark, sf_dir):
    """Candidates of the templates with their complexity, the first broken rule, and the decision on made-up results."""
    templates = spark.createDataFrame(TEMPLATES, "family string, name string, expression string, parameters array<int>")
    made = rs.grid(templates)
    e = F.col("expression")
    score = rs.complexity(e)
    status, reason = rs.decision(F.col("value") * 100, F.length("name") / 250, score * 10, 600)
    return made.select("family", "name", "expression", score.alias("complexity"), rs.violation(F.col("family"), e, **ALLOWED).alias("violation"), status.alias("status"), reason.alias("reason"))


FX_GRID = r"""WITH t(family, name, expression, ps) AS (VALUES ('momentum', 'ret_{value}', '$close / Ref($close, {value}) - 1', [5, 20, 60]), ('volatility', 'vol_{value}', 'Std($close / Ref($close, 1) - 1, {value})', [10, 20]), ('gap', 'gap', '$open / Ref($close, 1) - 1', [NULL]), ('odd', 'skew_{value}', 'Skew($vwap, {value})', [7])),
u AS (SELECT family, name, expression, unnest(ps) AS v FROM t),
c AS (SELECT family, v, coalesce(replace(name, '{value}', CAST(v AS VARCHAR)), name) AS name, coalesce(replace(expression, '{value}', CAST(v AS VARCHAR)), expression) AS expression FROM u),
p AS (SELECT *, regexp_extract_all(expression, '\$([A-Za-z_][A-Za-z0-9_]*)', 1) AS fs, regexp_extract_all(expression, '\b([A-Z][A-Za-z0-9_]*)\s*\(', 1) AS os, list_transform(regexp_extract_all(expression, ',\s*(\d+)\s*\)', 1), lambda x: CAST(x AS BIGINT)) AS ws FROM c),
s AS (SELECT *, round(least(1, length(expression) / 500 + len(os) / 20 + len(list_distinct(fs)) / 20 + len(list_distinct(ws)) / 20), 6) AS complexity,
 list_min(list_filter(fs, lambda x: x NOT IN ('open', 'high', 'low', 'close', 'volume'))) AS bf, list_min(list_filter(os, lambda x: x NOT IN ('Ref', 'Mean', 'Std', 'Max', 'Min'))) AS bo, list_min(list_filter(ws, lambda x: x NOT IN (1, 5, 10, 20))) AS bw FROM p),
r AS (SELECT *, CASE WHEN coalesce(v * 100, 0) < 600 THEN 'observations_h20 below minimum_observations' WHEN length(name) / 250 < 0.01 THEN 'primary_metric below discard threshold' WHEN complexity * 10 > 0.7 THEN 'complexity_score above discard threshold' ELSE '' END AS reason FROM s)
SELECT family, name, expression, complexity, CASE WHEN bf IS NOT NULL THEN 'disallowed field: ' || bf WHEN bo IS NOT NULL THEN 'disallowed operator: ' || bo WHEN bw IS NOT NULL THEN 'disallowed window: ' || bw ELSE '' END AS violation, CASE WHEN reason = '' THEN 'review' ELSE 'discard_candidate' END AS status, reason FROM r"""


def fx_registry(spark, sf_dir):
    """Selected factors of the catalogue, with the number of registered ones."""
    return rs.select_registered(catalogue(spark).withColumnRenamed("family", "category"), ["ret_5", "vol_20", "vosc_12_26"], ["momentum", "volume"]).select("category", "name")


TOKENS = r"""k AS (SELECT *, list_distinct(list_concat(list_transform(regexp_extract_all(expression, '\$([A-Za-z_][A-Za-z0-9_]*)', 1), lambda x: 'field:' || lower(x)), list_transform(regexp_extract_all(expression, '\b([A-Z][A-Za-z0-9_]*)\s*\(', 1), lambda x: 'op:' || lower(x)),
 list_transform(regexp_extract_all(expression, ',\s*(\d+)\s*\)', 1), lambda x: 'w:' || x), list_filter(list_transform(regexp_extract_all(expression, '([A-Za-z]+)', 1), lambda x: lower(x)), lambda x: x NOT IN ('mean', 'corr', 'ref', 'max', 'min', 'std', 'abs')))) AS m,
 regexp_replace(regexp_replace(expression, '\$[A-Za-z_][A-Za-z0-9_]*', '$field', 'g'), '\s+', '', 'g') AS plain FROM c),
t AS (SELECT *, list_distinct(list_concat(regexp_extract_all(plain, '([A-Za-z]+)\(', 1), regexp_extract_all(plain, '(\$field|\d+|[+\-*/()])', 1))) AS s FROM k),
sim AS (SELECT a.family, a.name, b.name AS other, a.position AS pa, b.position AS pb,
 greatest(len(list_intersect(a.m, b.m)) / CAST(len(list_distinct(list_concat(a.m, b.m))) AS DOUBLE), len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE)) AS similarity FROM t a JOIN t b ON a.family = b.family AND a.position < b.position)"""


def fx_similarity(spark, sf_dir):
    return rounded(rs.similar_pairs(catalogue(spark)), [])


def fx_groups(spark, sf_dir):
    return rounded(rs.redundancy_groups(catalogue(spark), 0.7), [])


FX_GROUPS = f"""WITH RECURSIVE {CANDIDATES}, {TOKENS},
o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY position) AS i FROM t),
g(family, i, leaders, name, leader, similarity) AS (
 SELECT family, i, [name], name, name, 1e0 FROM o WHERE i = 1
 UNION ALL
 SELECT n.family, n.i, CASE WHEN b.v >= 0.7 THEN g.leaders ELSE list_append(g.leaders, n.name) END, n.name, CASE WHEN b.v >= 0.7 THEN b.l ELSE n.name END, CASE WHEN b.v >= 0.7 THEN b.v ELSE 1e0 END
 FROM g JOIN o n ON n.family = g.family AND n.i = g.i + 1
 JOIN (SELECT g2.family, g2.i, arg_max(s.name, (s.similarity, -s.pa)) AS l, max(s.similarity) AS v FROM g g2 JOIN o n2 ON n2.family = g2.family AND n2.i = g2.i + 1 JOIN sim s ON s.other = n2.name AND s.family = g2.family AND list_contains(g2.leaders, s.name) GROUP BY 1, 2) b ON b.family = g.family AND b.i = g.i),
f AS (SELECT name AS leader, printf('F%03d', row_number() OVER (ORDER BY position)) AS redundancy_group FROM g JOIN c USING (family, name) WHERE name = leader)
SELECT name, family, leader AS representative, round(similarity, 6) AS similarity, redundancy_group FROM g JOIN f USING (leader)"""

TESTED = {"ret_5": "momentum", "reversal_5": "momentum", "price_position_20": "", "max_drawdown_20": "extremes"}


def tested(spark, sf_dir) -> DataFrame:
    """Raw and size-neutral values of the tested factors with the next bar's return, one row per factor; in one panel."""
    formulas = {n: (MOMENTUM | EXTREMES)[n] for n in TESTED}
    panel = xs.size_proxy(ev.forward_return(with_factors(brand_bars(spark, sf_dir), formulas), 1, out="future"))
    for n in TESTED:
        panel = xs.neutralize(panel, n, ["size_proxy"], None, f"{n}_neutral")
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("raw"), F.col(f"{n}_neutral").alias("neutral")) for n in TESTED]))
    return panel.select(*KEYS, "future", rows)


def results(rows: DataFrame, signal: str) -> DataFrame:
    rows = rows.where(F.col(signal).isNotNull())
    known = rows.where("future is not null")
    by = ["factor"]
    found = ev.ic_summary(ev.daily_ic(known, signal, by), by).join(ev.quantile_returns(known, signal, 5, by), by, "left")
    return found.join(ev.top_turnover(rows, signal, 5, by), by, "left")


def ev_diagnostics(spark, sf_dir):
    """Neutral results of one factor are left out, so that the outer join has a gap."""
    rows = tested(spark, sf_dir)
    families = spark.createDataFrame(list(TESTED.items()), "factor string, family string")
    made = rs.diagnostics(results(rows, "raw"), results(rows.where("factor <> 'reversal_5'"), "neutral"), families)
    return rounded(made.drop("raw_rank_icir"), ["factor"], 5)


def _results_sql(tag: str, signal: str) -> str:
    return f"""{tag}l AS (SELECT factor, instrument, datetime, {signal} AS signal, future FROM long WHERE {signal} IS NOT NULL),
{tag}r AS (SELECT *, rank() OVER (PARTITION BY factor, datetime ORDER BY signal) + (count(*) OVER (PARTITION BY factor, datetime, signal) - 1) / 2 AS rs, rank() OVER (PARTITION BY factor, datetime ORDER BY future) + (count(*) OVER (PARTITION BY factor, datetime, future) - 1) / 2 AS rf FROM {tag}l WHERE future IS NOT NULL),
{tag}d AS (SELECT factor, datetime, CASE WHEN stddev_pop(rs) * stddev_pop(rf) > 1e-12 THEN covar_pop(rs, rf) / (stddev_pop(rs) * stddev_pop(rf)) END AS ic FROM {tag}r GROUP BY 1, 2),
{tag}s AS (SELECT factor, avg(ic) AS rank_ic_mean, CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) END AS rank_icir FROM {tag}d GROUP BY 1),
{tag}q AS (SELECT *, greatest(1, CAST(ceil((row_number() OVER (PARTITION BY factor, datetime ORDER BY signal, instrument) - 1) * 5 / greatest(count(*) OVER (PARTITION BY factor, datetime) - 1, 1)) AS INT)) AS q, count(*) OVER (PARTITION BY factor, datetime) AS n FROM {tag}l WHERE future IS NOT NULL),
{tag}qs AS (SELECT factor, avg(future) FILTER (q = 5) - avg(future) FILTER (q = 1) AS long_short FROM {tag}q WHERE n >= 5 GROUP BY 1),
{tag}p AS (SELECT *, row_number() OVER (PARTITION BY factor, datetime ORDER BY signal, instrument) / CAST(count(*) OVER (PARTITION BY factor, datetime) AS DOUBLE) AS share FROM {tag}l),
{tag}t AS (SELECT factor, instrument, dense_rank() OVER (PARTITION BY factor ORDER BY datetime) AS i FROM {tag}p WHERE share >= 1 - 1.0 / 5),
{tag}tt AS (SELECT factor, avg(x) AS turnover FROM (SELECT a.factor, a.i, 1 - count(b.instrument) / CAST(count(*) AS DOUBLE) AS x FROM {tag}t a LEFT JOIN {tag}t b ON b.factor = a.factor AND b.i = a.i + 1 AND b.instrument = a.instrument WHERE a.i < (SELECT max(i) FROM {tag}t z WHERE z.factor = a.factor) GROUP BY 1, 2) GROUP BY 1),
{tag} AS (SELECT * FROM {tag}s LEFT JOIN {tag}qs USING (factor) LEFT JOIN {tag}tt USING (factor))"""


def _neutral(n: str) -> str:
    ok = f"CASE WHEN {n} IS NOT NULL THEN "
    d = "OVER (PARTITION BY datetime)"
    return f"({n} - avg({n}) {d}) AS {n}_y, {ok}size - avg({ok}size END) {d} END AS {n}_x, count({n}) {d} AS {n}_n"


_tested = list(TESTED)
LONG = f"""{BARS}, x0 AS (SELECT *, close / lag(close, 5) OVER {W} - 1 AS ret_5, lag(close, 5) OVER {W} / close - 1 AS reversal_5, (close - min(low) OVER {roll(20)}) / (max(high) OVER {roll(20)} - min(low) OVER {roll(20)} + 1e-12) AS price_position_20, max(close) OVER {roll(20)} / close - 1 AS max_drawdown_20, lead(close) OVER {W} / close - 1 AS future, ln(1 + abs(close) * abs(volume)) AS size FROM bars),
x1 AS (SELECT *, {", ".join(map(_neutral, _tested))} FROM x0),
x2 AS (SELECT *, {", ".join(f"CASE WHEN {n}_n >= 2 THEN {n}_y - CASE WHEN sum({n}_x * {n}_x) OVER (PARTITION BY datetime) > 1e-12 THEN sum({n}_x * {n}_y) OVER (PARTITION BY datetime) / sum({n}_x * {n}_x) OVER (PARTITION BY datetime) ELSE 0 END * {n}_x END AS {n}_neutral" for n in _tested)} FROM x1),
long AS ({" UNION ALL ".join(f"SELECT instrument, datetime, future, '{n}' AS factor, {n} AS raw, {'NULL' if n == 'reversal_5' else n + '_neutral'} AS neutral FROM x2" for n in _tested)})"""
EV_DIAGNOSTICS = f"""WITH {LONG}, {_results_sql("ra", "raw")}, {_results_sql("nb", "neutral")},
f(factor, family) AS (VALUES {", ".join(f"('{n}', '{v}')" for n, v in TESTED.items())}),
j AS (SELECT factor, family, a.rank_ic_mean AS raw_rank_ic_mean, a.long_short AS raw_long_short, a.turnover AS raw_turnover, b.rank_ic_mean AS neutral_rank_ic_mean, b.rank_icir AS neutral_rank_icir, b.long_short AS neutral_long_short, b.turnover AS neutral_turnover, b.rank_ic_mean / nullif(a.rank_ic_mean, 0) AS retention FROM ra a FULL JOIN nb b USING (factor) LEFT JOIN f USING (factor)),
k AS (SELECT *, CASE WHEN neutral_rank_ic_mean >= 0.035 AND neutral_rank_icir >= 0.25 AND neutral_long_short > 0 AND retention >= 0.55 THEN 'core_candidate' WHEN neutral_rank_ic_mean >= 0.025 AND neutral_long_short > 0 THEN 'candidate_review' WHEN neutral_rank_ic_mean >= 0.025 THEN 'shadow_review' ELSE 'reject_review' END AS role,
 concat_ws(';', CASE WHEN neutral_long_short < 0 THEN 'negative_neutral_long_short' END, CASE WHEN retention < 0.55 THEN 'low_neutral_retention' END, CASE WHEN neutral_turnover > 0.2 THEN 'high_turnover' END) AS concerns,
 row_number() OVER (PARTITION BY CASE WHEN family = '' THEN factor ELSE family END ORDER BY coalesce(neutral_long_short, 0) <= 0, neutral_rank_ic_mean DESC NULLS LAST, neutral_long_short DESC NULLS LAST, factor) = 1 AS family_representative FROM j)
SELECT factor, family, round(raw_rank_ic_mean, 5) AS raw_rank_ic_mean, round(raw_long_short, 5) AS raw_long_short, round(raw_turnover, 5) AS raw_turnover, round(neutral_rank_ic_mean, 5) AS neutral_rank_ic_mean, round(neutral_rank_icir, 5) AS neutral_rank_icir, round(neutral_long_short, 5) AS neutral_long_short, round(neutral_turnover, 5) AS neutral_turnover, round(retention, 5) AS retention, role, concerns, family_representative,
 row_number() OVER (ORDER BY CASE role WHEN 'core_candidate' THEN 0 WHEN 'candidate_review' THEN 1 WHEN 'shadow_review' THEN 2 ELSE 3 END, family_representative DESC, neutral_rank_ic_mean DESC NULLS LAST, neutral_long_short DESC NULLS LAST, factor) AS review_order FROM k"""


def ev_months(spark, sf_dir):
    return rounded(rs.month_table(ev.market_regime(brand_bars(spark, sf_dir))), ["month"])


def ev_regime_summary(spark, sf_dir):
    return rounded(rs.regime_summary(ev.market_regime(brand_bars(spark, sf_dir))), ["last_date"])


def reviewed(spark, sf_dir) -> DataFrame:
    rows = tested(spark, sf_dir).where("future is not null").withColumn("horizon", F.lit(1))
    daily = ev.daily_ic(rows, "raw", ["factor", "horizon"])
    return rs.review_ic(daily, ev.market_regime(brand_bars(spark, sf_dir)), least=20)


def ev_review(spark, sf_dir):
    return rounded(reviewed(spark, sf_dir), [])


def ev_best(spark, sf_dir):
    """The factor with the best mean rank IC in each year and regime."""
    return rounded(rs.best_row(reviewed(spark, sf_dir).where("segment in ('year', 'regime')"), ["segment", "value"]).select("segment", "value", "factor", "rank_ic_mean"), [])


REVIEW = f"""WITH {LONG}, {_results_sql("ra", "raw")}, {REGIME.replace(BARS + ",", "")},
e AS (SELECT factor, datetime, ic, regime FROM rad JOIN (SELECT factor, datetime FROM rar GROUP BY 1, 2 HAVING count(*) >= 20) USING (factor, datetime) LEFT JOIN reg USING (datetime)),
u AS (SELECT factor, 'overall' AS segment, 'all' AS value, ic FROM e UNION ALL SELECT factor, 'year', CAST(year(datetime) AS VARCHAR), ic FROM e UNION ALL SELECT factor, 'month', strftime(datetime, '%Y-%m'), ic FROM e UNION ALL SELECT factor, 'regime', coalesce(regime, 'unknown'), ic FROM e),
v AS (SELECT factor, CAST(1 AS BIGINT) AS horizon, segment, value, count(ic) AS days, round(avg(ic), 6) AS rank_ic_mean, round(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END), 6) AS positive_rate FROM u GROUP BY 1, 3, 4)"""


def queries() -> dict:
    return {"fx_grid": fx_grid, "fx_registry": fx_registry, "fx_similarity": fx_similarity, "fx_groups": fx_groups, "ev_diagnostics": ev_diagnostics, "ev_months": ev_months, "ev_regime_summary": ev_regime_summary, "ev_review": ev_review, "ev_best": ev_best}


def oracle_sql() -> dict[str, str]:
    share = lambda r: f"round(avg(CASE WHEN regime = '{r}' THEN 1.0 ELSE 0.0 END), 6) AS {r}_share"
    return {
        "fx_grid": FX_GRID,
        "fx_registry": f"WITH {CANDIDATES} SELECT family AS category, name FROM c WHERE name IN ('ret_5', 'vol_20', 'vosc_12_26') AND family IN ('momentum', 'volume')",
        "fx_similarity": f"WITH {CANDIDATES}, {TOKENS} SELECT family, name, other, round(similarity, 6) AS similarity FROM sim",
        "fx_groups": FX_GROUPS,
        "ev_diagnostics": EV_DIAGNOSTICS,
        "ev_months": f"WITH {REGIME} SELECT strftime(datetime, '%Y-%m') AS month, round(product(1 + market_return) - 1, 6) AS market_return, count(*) AS dates, {share('up')}, {share('down')}, {share('sideways')} FROM reg GROUP BY 1",
        "ev_regime_summary": f"WITH {REGIME} SELECT max(datetime) AS last_date, arg_max(regime, datetime) AS last_regime, count(*) FILTER (regime = 'up') AS up_dates, count(*) FILTER (regime = 'down') AS down_dates, count(*) FILTER (regime = 'sideways') AS sideways_dates, count(*) FILTER (p IS NOT NULL AND p <> regime) AS switches FROM (SELECT *, lag(regime) OVER (ORDER BY datetime) AS p FROM reg)",
        "ev_review": f"{REVIEW} SELECT * FROM v",
        "ev_best": f"{REVIEW} SELECT segment, value, factor, rank_ic_mean FROM v WHERE segment IN ('year', 'regime') AND rank_ic_mean IS NOT NULL QUALIFY row_number() OVER (PARTITION BY segment, value ORDER BY rank_ic_mean DESC, factor) = 1",
    }
