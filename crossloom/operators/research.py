"""Candidate factors as data: grids, checks, likeness, redundancy, diagnostics of raw against neutral results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, div
from .evaluation import role

#: What counts as a field, an operator and a window in a formula, and words that are no concept.
FIELD, OPERATOR, WINDOW = r"\$([A-Za-z_][A-Za-z0-9_]*)", r"\b([A-Z][A-Za-z0-9_]*)\s*\(", r",\s*(\d+)\s*\)"
NO_CONCEPT = ("mean", "corr", "ref", "max", "min", "std", "abs")
#: Fixed thresholds of the research rules.
LEAST_PRIMARY, MOST_COMPLEX, REDUNDANT = 0.01, 0.70, 0.45


def grid(templates: DataFrame, name: str = "name", expression: str = "expression", parameters: str = "parameters") -> DataFrame:
    """One candidate for each value of a template's `parameters` (an array; empty or null: the template alone).

    {value} in the name and the expression stands for it. Two candidates of one name are an error.
    """
    made = templates.withColumn("value", F.explode_outer(parameters)).drop(parameters)
    fill = lambda c: F.when(F.col("value").isNull(), F.col(c)).otherwise(F.replace(F.col(c), F.lit("{value}"), F.col("value").cast("string")))
    made = made.withColumns({name: fill(name), expression: fill(expression)})
    twice = F.count(F.lit(1)).over(Window.partitionBy(name))
    return made.withColumn("_twice", F.when(twice > 1, F.raise_error(F.concat(F.lit("two candidates are named "), F.col(name)))).cast("int")).where("_twice is null").drop("_twice")


def select_registered(registry: DataFrame, names: Sequence[str] = (), categories: Sequence[str] = ()) -> DataFrame:
    """Factors whose name and category are both asked for; an empty list asks for all."""
    wanted = F.lit(True)
    for column, values in (("name", names), ("category", categories)):
        if values:
            wanted = wanted & F.col(column).isin(*values)
    return registry.where(wanted)


def parts(expression: Column, pattern: str) -> Column:
    return F.regexp_extract_all(expression, F.lit(pattern), F.lit(1))


def complexity(expression: Column) -> Column:
    """Length, operators, different fields and different windows, weighed and cut to [0, 1], six digits."""
    distinct = lambda p: F.size(F.array_distinct(parts(expression, p)))
    windows = F.size(F.array_distinct(F.transform(parts(expression, WINDOW), lambda x: x.cast("long"))))
    return F.round(clip(F.length(expression) / 500 + F.size(parts(expression, OPERATOR)) / 20 + distinct(FIELD) / 20 + windows / 20, 0.0, 1.0), 6)


def violation(family: Column, expression: Column, families: Sequence[str], fields: Sequence[str], operators: Sequence[str], windows: Sequence[int], longest: int = 240, most_operators: int = 12, most_windows: int = 6) -> Column:
    """The first rule that a candidate breaks, or an empty text. Names in a message are the first in order."""
    unknown = lambda found, allowed: F.array_min(F.array_except(found, F.array(*[F.lit(x) for x in allowed])))
    field = unknown(parts(expression, FIELD), fields)
    operator = unknown(parts(expression, OPERATOR), operators)
    used = F.transform(parts(expression, WINDOW), lambda x: x.cast("int"))
    window = unknown(used, windows)
    return (
        F.when(~family.isin(*families), F.concat(F.lit("disallowed family: "), family))
        .when(F.length(expression) > longest, "expression exceeds max_expression_length")
        .when(field.isNotNull(), F.concat(F.lit("disallowed field: "), field))
        .when(F.size(parts(expression, OPERATOR)) > most_operators, "operator count exceeds max_operator_count")
        .when(operator.isNotNull(), F.concat(F.lit("disallowed operator: "), operator))
        .when(F.size(F.array_distinct(used)) > most_windows, "window count exceeds max_window_count")
        .when(window.isNotNull(), F.concat(F.lit("disallowed window: "), window.cast("string")))
        .otherwise("")
    )


def decision(observations: Column, primary: Column, complex_: Column, least: int) -> tuple[Column, Column]:
    """(status, reason): the first failing rule discards, else review. A null metric fails."""
    reason = (
        F.when(F.coalesce(observations, F.lit(0)) < least, "observations_h20 below minimum_observations")
        .when(primary.isNull() | (primary < LEAST_PRIMARY), "primary_metric below discard threshold")
        .when(F.coalesce(complex_, F.lit(0.0)) > MOST_COMPLEX, "complexity_score above discard threshold")
        .otherwise("")
    )
    return F.when(reason == "", "review").otherwise("discard_candidate"), reason


def meaning(expression: Column) -> Column:
    """Fields, operators, windows and the words of a formula, each once."""
    tagged = lambda p, tag: F.transform(parts(expression, p), lambda x: F.concat(F.lit(tag), F.lower(x)))
    words = F.filter(F.transform(parts(expression, "([A-Za-z]+)"), F.lower), lambda x: ~x.isin(*NO_CONCEPT))
    return F.array_distinct(F.concat(tagged(FIELD, "field:"), tagged(OPERATOR, "op:"), tagged(WINDOW, "w:"), words))


def structure(expression: Column) -> Column:
    """Functions, numbers and signs of a formula whose fields all read alike, each once."""
    plain = F.regexp_replace(F.regexp_replace(expression, FIELD, r"\$field"), r"\s+", "")
    return F.array_distinct(F.concat(parts(plain, r"([A-Za-z]+)\("), parts(plain, r"(\$field|\d+|[+\-*/()])")))


def likeness(a: Column, b: Column, p: Column, q: Column) -> Column:
    """The larger Jaccard similarity of meanings (a, b) and structures (p, q); without tokens on both sides 1."""
    jaccard = lambda x, y: F.coalesce(div(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.greatest(jaccard(a, b), jaccard(p, q)))


def similar_pairs(candidates: DataFrame) -> DataFrame:
    """family, name, other, similarity for the pairs of a family, each once (by position). Families are plan-time data: tens of rows."""
    side = candidates.select("family", "name", "position", meaning(F.col("expression")).alias("m"), structure(F.col("expression")).alias("s"))
    a, b = side.alias("a"), side.alias("b")
    pairs = a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("a.position") < F.col("b.position")))
    return pairs.select("a.family", "a.name", F.col("b.name").alias("other"), likeness(F.col("a.m"), F.col("b.m"), F.col("a.s"), F.col("b.s")).alias("similarity"))


def redundancy_groups(candidates: DataFrame, threshold: float = REDUNDANT) -> DataFrame:
    """name, family, representative, similarity, redundancy_group: in the order of position a candidate joins the most similar representative of its family, or becomes one.

    A family is folded inside one row, as its order matters; families hold tens of formulas. Groups are numbered F001, F002, ... in order of position.
    """
    item = F.struct("position", "name", meaning(F.col("expression")).alias("m"), structure(F.col("expression")).alias("s"))
    rows = candidates.groupBy("family").agg(F.sort_array(F.collect_list(item)).alias("items"))
    out = "array<struct<name:string,position:int,leader:string,similarity:double>>"

    def step(acc, x):
        scored = F.transform(acc["leaders"], lambda y, i: F.struct(likeness(x["m"], y["m"], x["s"], y["s"]).alias("v"), (-i).alias("i"), y["name"].alias("name")))
        best = F.array_max(F.filter(scored, lambda z: z["v"] > 0))
        joins = F.coalesce(best["v"] >= threshold, F.lit(False))
        row = F.struct(x["name"].alias("name"), x["position"].cast("int").alias("position"), F.when(joins, best["name"]).otherwise(x["name"]).alias("leader"), F.when(joins, best["v"]).otherwise(1.0).alias("similarity"))
        return F.struct(F.when(joins, acc["leaders"]).otherwise(F.concat(acc["leaders"], F.array(x))).alias("leaders"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.slice("items", 1, 0).alias("leaders"), F.array().cast(out).alias("rows"))
    rows = rows.select("family", F.inline(F.aggregate("items", start, step)["rows"]))
    leaders = rows.where("name = leader").select(F.col("name").alias("leader"), F.format_string("F%03d", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("position"))).alias("redundancy_group"))
    return rows.join(leaders, "leader").select("name", "family", F.col("leader").alias("representative"), "similarity", "redundancy_group")


def diagnostics(raw: DataFrame, neutral: DataFrame, metadata: DataFrame) -> DataFrame:
    """Raw and neutral results of each factor side by side, retention, role, concerns, the family's representative and the order of review.

    raw and neutral have factor, rank_ic_mean, rank_icir, long_short and turnover; a factor in only one of them
    keeps nulls for the other. metadata has factor and family; a blank family is the factor's own.
    """
    names = ("rank_ic_mean", "rank_icir", "long_short", "turnover")
    side = lambda df, tag: df.select("factor", *[F.col(c).alias(f"{tag}_{c}") for c in names])
    both = side(raw, "raw").join(side(neutral, "neutral"), "factor", "full_outer").join(metadata, "factor", "left")
    ic, ls, keep = F.col("neutral_rank_ic_mean"), F.col("neutral_long_short"), F.col("retention")
    both = both.withColumns({"family": F.coalesce("family", F.lit("")), "retention": div(ic, F.col("raw_rank_ic_mean"))})
    both = both.withColumn("role", role(ic, F.col("neutral_rank_icir"), ls, keep))
    concerns = F.concat_ws(";", F.when(ls < 0, "negative_neutral_long_short"), F.when(keep < 0.55, "low_neutral_retention"), F.when(F.col("neutral_turnover") > 0.2, "high_turnover"))
    own = F.when(F.col("family") == "", F.col("factor")).otherwise(F.col("family"))
    best = Window.partitionBy(own).orderBy(F.coalesce(ls, F.lit(0.0)) <= 0, F.desc_nulls_last(ic), F.desc_nulls_last(ls), "factor")
    both = both.withColumns({"concerns": concerns, "family_representative": F.row_number().over(best) == 1})
    place = F.when(F.col("role") == "core_candidate", 0).when(F.col("role") == "candidate_review", 1).when(F.col("role") == "shadow_review", 2).otherwise(3)
    order = Window.partitionBy(F.lit(1)).orderBy(place, F.desc("family_representative"), F.desc_nulls_last(ic), F.desc_nulls_last(ls), "factor")
    return both.withColumn("review_order", F.row_number().over(order))


def month_table(regime: DataFrame) -> DataFrame:
    """Per month: the compounded market return and the share of its dates in each regime. regime is market_regime()'s."""
    share = lambda r: F.avg((F.col("regime") == r).cast("double")).alias(f"{r}_share")
    return regime.groupBy(F.date_format("datetime", "yyyy-MM").alias("month")).agg((F.product(1 + F.col("market_return")) - 1).alias("market_return"), F.count(F.lit(1)).alias("dates"), *[share(r) for r in ("up", "down", "sideways")])


def regime_summary(regime: DataFrame) -> DataFrame:
    """One row: the last date and its regime, the number of dates of each regime, and how often it changed."""
    changed = F.lag("regime").over(Window.partitionBy(F.lit(1)).orderBy("datetime")) != F.col("regime")
    counts = [F.count(F.when(F.col("regime") == r, 1)).alias(f"{r}_dates") for r in ("up", "down", "sideways")]
    return regime.withColumn("_changed", changed).agg(F.max("datetime").alias("last_date"), F.max_by("regime", "datetime").alias("last_regime"), *counts, F.count(F.when(F.col("_changed"), 1)).alias("switches"))


def review_ic(daily: DataFrame, regime: DataFrame, by: Sequence[str] = ("factor", "horizon"), least: int = 10) -> DataFrame:
    """Rank IC of each factor and horizon: overall, by year, by month and by regime, in one pass of grouping sets. Dates with fewer than `least` names take no part."""
    rows = daily.where(F.col("n") >= least).join(regime.select("datetime", F.col("regime").alias("_regime")), "datetime", "left")
    rows = rows.select(*by, "rank_ic", F.year("datetime").cast("string").alias("_year"), F.date_format("datetime", "yyyy-MM").alias("_month"), F.coalesce("_regime", F.lit("unknown")).alias("_regime"))
    cuts = ("_year", "_month", "_regime")
    sets = rows.groupingSets([[*by], *[[*by, c] for c in cuts]], *by, *cuts)
    stats = sets.agg(*[F.grouping(c).alias(f"g{c}") for c in cuts], F.count("rank_ic").alias("days"), F.avg("rank_ic").alias("rank_ic_mean"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_rate"))
    kind = F.when(F.col("g_year") == 0, "year").when(F.col("g_month") == 0, "month").when(F.col("g_regime") == 0, "regime").otherwise("overall")
    return stats.select(*by, kind.alias("segment"), F.coalesce(*cuts, F.lit("all")).alias("value"), "days", "rank_ic_mean", "positive_rate")


def best_row(results: DataFrame, by: Sequence[str], metric: str = "rank_ic_mean") -> DataFrame:
    """Of each group the row with the largest metric; nulls don't count, ties go to the smaller factor name."""
    order = Window.partitionBy(*by).orderBy(F.desc(metric), "factor")
    return results.where(F.col(metric).isNotNull()).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
