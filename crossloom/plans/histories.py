"""Carried target portfolios and growing clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import histories as hs
from ..sources.tables import table
from .books import TRADABLE, checked
from .factors import brand_groups, rounded

SCORES = {"ensemble": "ensemble_score", "momentum": "family_momentum_score", "calm": "family_volatility_score"}


def strategies(spark, sf_dir) -> DataFrame:
    """Three rankings of the eligible names of each month."""
    rows = F.inline(F.array(*[F.struct(F.lit(s).alias("strategy"), F.round(c, 9).alias("ensemble_score")) for s, c in SCORES.items()]))
    return checked(spark, sf_dir).where("eligible").select("date", "instrument", rows)


def targets_history(spark, sf_dir):
    """Months of three strategies, each from what it held before; two begin with holdings."""
    held = brand_groups(spark, sf_dir).where("instrument like '%3' or instrument like '%8'").select("instrument", F.explode(F.array(F.lit("ensemble"), F.lit("calm"))).alias("strategy"))
    return rounded(hs.historical_targets(strategies(spark, sf_dir), 5, 9, 2, most=0.18, initial=held), ["date"])


TARGETS = f"""WITH RECURSIVE {TRADABLE},
st AS (SELECT strategy, date, instrument, round(score, 9) AS score FROM e, LATERAL (VALUES {", ".join(f"('{s}', {c})" for s, c in SCORES.items())}) v(strategy, score) WHERE reject_reasons = ''),
rk AS (SELECT *, row_number() OVER (PARTITION BY strategy, date ORDER BY score DESC NULLS LAST, instrument) AS k FROM st),
dl AS (SELECT strategy, date, list(instrument ORDER BY k) AS r, row_number() OVER (PARTITION BY strategy ORDER BY date) AS i FROM rk GROUP BY strategy, date),
hl AS (SELECT DISTINCT strategy, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS date, CASE WHEN strategy <> 'momentum' THEN (SELECT list(instrument) FROM g WHERE instrument LIKE '%3' OR instrument LIKE '%8') ELSE [] END AS chosen, CAST([] AS VARCHAR[]) AS held, CAST([] AS VARCHAR[]) AS keep FROM dl
 UNION ALL SELECT strategy, i, date, CASE WHEN len(held) = 0 THEN r[1:5] ELSE list_filter(r, lambda x: list_contains(keep, x) OR list_contains(fill, x))[1:5] END, held, keep FROM (
  SELECT *, list_filter(rest, lambda x: list_contains(held, x) OR list_contains(fresh, x))[1:greatest(5 - len(keep), 1)] AS fill FROM (
   SELECT *, list_filter(rest, lambda x: NOT list_contains(held, x))[1:2] AS fresh FROM (
    SELECT *, list_filter(r, lambda x: NOT list_contains(keep, x)) AS rest FROM (
     SELECT dl.strategy, dl.i, dl.date, dl.r, hl.chosen AS held, list_filter(dl.r[1:9], lambda x: list_contains(hl.chosen, x))[1:5] AS keep FROM hl JOIN dl ON dl.strategy = hl.strategy AND dl.i = hl.i + 1))))),
ct AS (SELECT *, unnest(chosen) AS instrument, unnest(range(1, len(chosen) + 1)) AS rank FROM hl WHERE i > 0)
SELECT ct.strategy, ct.date, ct.instrument, ct.rank, round(rk.score, 6) AS ensemble_score, CASE WHEN len(held) = 0 THEN 'top_ranked' WHEN list_contains(keep, ct.instrument) THEN 'held_by_dropout' WHEN list_contains(held, ct.instrument) THEN 'current_ranked' ELSE 'new_buy' END AS selection_reason, round(least(0.95 / len(chosen), 0.18), 6) AS target_weight
FROM ct JOIN rk ON rk.strategy = ct.strategy AND rk.date = ct.date AND rk.instrument = ct.instrument"""


def parts_as_candidates(spark, sf_dir) -> DataFrame:
    """Parts as expressions of their brand's family, with a selection score."""
    size = F.col("p_size").cast("string")
    df = table(spark, sf_dir, "part").withColumns({"name": F.concat_ws(" v", "p_name", F.col("p_partkey").cast("string")), "expression": F.concat(F.lit("Mean($"), F.lower("p_type"), F.lit(", "), size, F.lit(") / Ref($close, "), (F.col("p_size") % 10).cast("string"), F.lit(")"))})
    score = hs.selection_score(F.col("p_retailprice") / 1000, F.col("p_size") / 10, F.length("p_type").cast("double"), (F.col("p_partkey") % 7).cast("double"))
    return df.select(F.col("p_brand").alias("family"), "name", F.round(score, 9).alias("score"), hs.expression_tokens(F.col("name"), F.col("p_brand"), F.col("expression")).alias("tokens"))


def candidate_clusters(spark, sf_dir):
    return rounded(hs.growing_clusters(parts_as_candidates(spark, sf_dir), "family", "name", "tokens", "score"), [], 9)


CLUSTERS = rf"""WITH RECURSIVE a AS (SELECT p_brand AS family, p_name || ' v' || p_partkey AS name, 'Mean($' || lower(p_type) || ', ' || p_size || ') / Ref($close, ' || (p_size % 10) || ')' AS x, round(p_retailprice / 1000 + 0.15 * (p_size / 10) - (0.012 * length(p_type) + 0.004 * (p_partkey % 7)), 9) AS score FROM part),
t AS (SELECT family, name, score, list_distinct(list_filter(regexp_extract_all(lower(name || ' ' || family || ' ' || x), '[A-Za-z]+|[0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({", ".join(f"'{w}'" for w in hs.DROPPED)})) || regexp_extract_all(lower(x), '\$([A-Za-z_][A-Za-z0-9_]*)', 1) || list_transform(regexp_extract_all(x, '\b([A-Z][A-Za-z0-9_]*)\s*\(', 1), lambda f: lower(f)) || list_transform(regexp_extract_all(x, ',\s*([0-9]+)\s*\)', 1), lambda w: 'w' || w)) AS tokens,
  row_number() OVER (PARTITION BY family ORDER BY score DESC, name) AS i FROM a),
f AS (SELECT family, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[][]) AS sets, CAST(NULL AS BIGINT) AS cluster, CAST(NULL AS DOUBLE) AS similarity FROM t GROUP BY family
 UNION ALL SELECT family, i, CASE WHEN hit IS NULL THEN list_append(sets, tokens) ELSE list_transform(sets, lambda s, j: CASE WHEN j = hit THEN list_distinct(s || tokens) ELSE s END) END, coalesce(hit, len(sets) + 1), CASE WHEN hit IS NOT NULL THEN best END FROM (
  SELECT *, CASE WHEN best >= 0.48 THEN list_position(likes, best) END AS hit FROM (
   SELECT *, list_max(likes) AS best FROM (
    SELECT f.family, t.i, f.sets, t.tokens, list_transform(f.sets, lambda s: len(list_intersect(s, t.tokens)) / CAST(len(list_distinct(s || t.tokens)) AS DOUBLE)) AS likes FROM f JOIN t ON t.family = f.family AND t.i = f.i + 1))))
SELECT t.family, t.name, round(t.score, 9) AS score, f.cluster, round(f.similarity, 9) AS similarity, row_number() OVER (PARTITION BY t.family, f.cluster ORDER BY t.i) AS place FROM f JOIN t ON t.family = f.family AND t.i = f.i"""


def queries() -> dict:
    return {"targets_history": targets_history, "candidate_clusters": candidate_clusters}


def oracle_sql() -> dict[str, str]:
    return {"targets_history": TARGETS, "candidate_clusters": CLUSTERS}
