"""Point-in-time joins: as of a date, within an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(panel: DataFrame, facts: DataFrame, by: str, at: str, known_at: str, columns: list[str], whole_row: bool = False, tie: str | None = None) -> DataFrame:
    """panel with, for each of `columns`, the latest fact known at or before the row's date.

    One shuffle by key: facts and panel rows form one series, facts first on
    equal dates. A null fact is passed over, unless whole_row: then the latest
    fact row counts as it is. Rows of panel without a fact keep nulls. Of facts known on
    the same day the one with the greatest `tie` wins (without it: the greatest values).
    """
    names = panel.columns
    left = panel.select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_side"))
    right = facts.select(F.col(by).alias("_by"), F.col(known_at).alias("_at"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(None)).alias("_tie"), F.struct(*columns).alias("_fact"))
    w = Window.partitionBy("_by").orderBy("_at", "_side", "_tie", "_fact").rowsBetween(Window.unboundedPreceding, 0)
    rows = left.unionByName(right, allowMissingColumns=True)
    if whole_row:
        found = {c: F.last("_fact", ignorenulls=True).over(w)[c] for c in columns}
    else:
        found = {c: F.last(F.col("_fact")[c], ignorenulls=True).over(w) for c in columns}
    return rows.withColumns({f"_v{i}": v for i, v in enumerate(found.values())}).where("_side = 1").select("_row.*", *[F.col(f"_v{i}").alias(c) for i, c in enumerate(found)])


def latest_per_key(df: DataFrame, by: list[str], at: str, until: Column | None = None, tie: list[str] | None = None) -> DataFrame:
    """The last row of each key, by date and `tie`, not after `until`."""
    df = df if until is None else df.where(F.col(at) <= until)
    w = Window.partitionBy(*by).orderBy(F.desc(at), *[F.desc(t) for t in tie or []])
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def in_force(rows: DataFrame, versions: DataFrame, keys: list[str], by: str, at: str, columns: list[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """rows with `columns` of the version in force (open end: still), the latest start if several; `missing` where there is none.

    `keys` identify a row. Rows meet versions by key, the range is part of the
    join's condition, and an aggregate keeps the best version before anything else moves.
    """
    v = versions.select(F.col(by).alias("_by"), F.col(start).alias("_start"), F.col(end).alias("_end"), F.struct(F.col(start).alias("s"), *columns).alias("_v"))
    hit = (F.col(by) == F.col("_by")) & (F.col(at) >= F.col("_start")) & (F.col("_end").isNull() | (F.col(at) <= F.col("_end")))
    best = rows.join(v, hit).groupBy(*keys).agg(F.max("_v").alias("_v"))
    out = rows.drop(*columns).join(best, keys, "left")
    return out.select("*", *[F.col("_v")[c].alias(c) for c in columns], F.col("_v").isNull().alias("missing")).drop("_v")


def active_events(rows: DataFrame, events: DataFrame, by: str, at: str, start: str, until: str) -> DataFrame:
    """rows x events of the same key with start <= date <= until.

    They meet by key and month: an event stands in each month that it touches, so a key with very many events spreads over its months.
    """
    months = F.sequence(F.trunc(start, "month"), F.trunc(until, "month"), F.expr("interval 1 month"))
    e = events.withColumnRenamed(by, "_by").where(F.col(start) <= F.col(until)).withColumn("_month", F.explode(months))
    hit = (F.col(by) == F.col("_by")) & (F.trunc(at, "month") == F.col("_month")) & (F.col(start) <= F.col(at)) & (F.col(until) >= F.col(at))
    return rows.join(e, hit).drop("_by", "_month")
