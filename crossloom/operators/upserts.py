"""Keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """All rows of both, one per key: the new one if there is one; within a side the last by `order` (all columns if not given)."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = order or [c for c in both.columns if c not in (*keys, "_side")]
    w = Window.partitionBy(*keys).orderBy(F.desc("_side"), *[F.desc_nulls_last(c) for c in rest])
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_side")


def merge_events(old: DataFrame, new: DataFrame, id_col: str, content: list[str]) -> DataFrame:
    """keep_last by the event's id, or by its content where the id is blank."""
    blank = F.coalesce(F.trim(id_col), F.lit("")) == ""
    key = F.when(blank, F.concat_ws("|", F.lit("content"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content])).otherwise(F.concat_ws("|", F.lit("id"), F.col(id_col)))
    return keep_last(old.withColumn("_key", key), new.withColumn("_key", key), ["_key"]).drop("_key")


def append_missing(primary: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """primary and those rows of extra whose key it lacks."""
    return primary.unionByName(extra.join(primary.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def collapse_versions(snapshots: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Dated snapshots -> one row per run of equal values: valid_from, and valid_to the day before the next (null: open)."""
    w = Window.partitionBy(*keys).orderBy(at)
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    starts = snapshots.withColumn("_same", same & (F.row_number().over(w) > 1)).where("not _same")
    return starts.select(*keys, *values, F.col(at).alias("valid_from"), F.date_sub(F.lead(at).over(w), 1).alias("valid_to"))


def merge_domains(store, changes: dict[str, tuple[DataFrame, list[str]]], derived: dict[str, tuple[DataFrame, list[str]]] | None = None) -> int:
    """Merge fetched rows into the stored domains by key and add derived domains, as one version: readers see all of them or none."""
    return store.upsert({**changes, **(derived or {})})
