"""Folds over ordered rows whose state is more than a number: carried holdings, and clusters that grow.

Each is one pass over rows that Spark has placed and sorted by group; a task holds one group's
state, never its rows. Groups run apart; inside a group every step needs the one before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a fold hands on at once.
BATCH = 4096


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def historical_targets(signal: DataFrame, k: int, dropout_rank: int | None = None, max_new: int | None = None, cash: float = 0.05, most: float = 0.08, initial: DataFrame | None = None, score: str = "ensemble_score", strategy: str = "strategy", date: str = "date") -> DataFrame:
    """Target portfolios of each strategy, date after date, where each date's selection starts from what the one before holds.

    Of the holdings, those ranked within dropout_rank stay; then the ranking fills up to k names, at least one of them, with at
    most max_new that aren't held; the k best remain, with equal weights up to `most`. Without holdings the k best are taken.
    signal has strategy, date, instrument and score, eligible rows only; ties go by instrument; rows without a score come last. A date
    that selects nothing is left out and its holdings are none. initial (strategy, instrument) is held before the first date.
    Returns strategy, date, instrument, rank, score, selection_reason and target_weight.

    Dates are ranked in Spark. A name can only matter if it is held at first or once stands among the first 2 k, which
    are all that can enter a portfolio; others don't travel. The fold then holds k names and their candidates.
    """
    order = Window.partitionBy("strategy", "date").orderBy(F.desc_nulls_last("score"), "instrument")
    ranked = signal.select(F.col(strategy).alias("strategy"), F.col(date).alias("date"), "instrument", F.col(score).cast("double").alias("score")).withColumn("rank", F.row_number().over(order))
    names = ranked.where(F.col("rank") <= 2 * k).select("strategy", "instrument")
    if initial is not None:
        held = initial.select(F.col(strategy).alias("strategy"), "instrument").distinct()
        names = names.unionByName(held)
    rows = ranked.join(names.distinct(), ["strategy", "instrument"], "left_semi").select("strategy", "date", "rank", "instrument", "score")
    if initial is not None:  # before every date
        rows = held.select("strategy", F.lit(None).cast(rows.schema["date"].dataType).alias("date"), F.lit(0).alias("rank"), "instrument", F.lit(None).cast("double").alias("score")).unionByName(rows)
    placed = rows.repartition("strategy").sortWithinPartitions("strategy", F.asc_nulls_first("date"), "rank")
    schema = T.StructType([placed.schema[c] for c in ("strategy", "date", "instrument")]).add("rank", T.IntegerType()).add("score", T.DoubleType()).add("selection_reason", T.StringType()).add("target_weight", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        out: list[tuple] = []
        group, day, held, keep, fill = None, None, set(), [], []
        new = 0

        def close() -> None:
            """End the present date: what it selects is held from now on."""
            nonlocal held, keep, fill, new
            if day is None:
                held = {r[1] for r in fill}  # the holdings before the first date
            else:
                free = max(k - len(keep), 1) if held and (dropout_rank is not None or max_new is not None) else k
                chosen = sorted([*keep, *fill[:free]])[:k]
                for place, (_, name, value, why) in enumerate(chosen):
                    out.append((*group, day, name, place + 1, value, why, min((1 - cash) / len(chosen), most)))
                held = {r[1] for r in chosen}
            keep, fill, new = [], [], 0

        for batch in batches:
            for s, d, rank, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (s,):
                    if group is not None:
                        close()
                    group, day, held = (s,), d, set()
                elif d != day:
                    close()
                    day = d
                if d is None:
                    fill.append((rank, name, value, ""))
                elif not held or (dropout_rank is None and max_new is None):
                    if len(fill) < k:
                        fill.append((rank, name, value, "top_ranked"))
                elif name in held and dropout_rank is not None and rank <= dropout_rank and len(keep) < k:
                    keep.append((rank, name, value, "held_by_dropout"))
                elif len(fill) < k and (name in held or max_new is None or new < max_new):
                    fill.append((rank, name, value, "current_ranked" if name in held else "new_buy"))
                    new += name not in held
            if len(out) >= BATCH:
                yield _emit(out, out_schema)
                out = []
        if group is not None:
            close()
        if out:
            yield _emit(out, out_schema)

    return placed.mapInArrow(run, schema).withColumnsRenamed({"strategy": strategy, "date": date, "score": score})


#: Words of expressions that say nothing about what they measure.
DROPPED = ("v", "mean", "ref", "max", "min", "corr", "abs", "close", "open", "high", "low", "volume", "amount")


def expression_tokens(name: Column, family: Column, expression: Column) -> Column:
    """Distinct words and numbers of the three (common ones and single letters left out), the expression's fields, its functions, and `w` with each last argument."""
    find = lambda text, pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    words = F.filter(find(F.lower(F.concat_ws(" ", name, family, expression)), "([A-Za-z]+|[0-9]+)", 1), lambda w: (F.length(w) > 1) & ~w.isin(*DROPPED))
    fields = find(F.lower(expression), r"\$([A-Za-z_][A-Za-z0-9_]*)", 1)
    functions = F.transform(find(expression, r"\b([A-Z][A-Za-z0-9_]*)\s*\(", 1), F.lower)
    windows = F.transform(find(expression, r",\s*([0-9]+)\s*\)", 1), lambda w: F.concat(F.lit("w"), w))
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (words, fields, functions, windows)]))


def selection_score(primary: Column, secondary: Column, complexity: Column, guard: Column) -> Column:
    return primary + 0.15 * secondary - (0.012 * complexity + 0.004 * guard)


def growing_clusters(rows: DataFrame, family: str, name: str, tokens: str, score: str, threshold: float = 0.48) -> DataFrame:
    """rows' (family, name, score) with the cluster of each: members in the order of the score, best first.

    In that order a row joins the cluster whose tokens are most like its own (Jaccard; of equals the older one), if they are like
    enough, and its tokens are added to the cluster's; else it begins a cluster. Rows without tokens are alike. Ties of the score go by name; nulls come last.
    Returns family, name, score, cluster (from 1, in the order of their best members), similarity when it joined (null for the first) and place in the cluster.

    Clusters are found by an index from their number of tokens and each token. A row of n tokens and a cluster of m with a similarity of at least s
    share s / (1 + s) (n + m) of them, so the cluster holds one of any n less so many plus one of the row's tokens: for each m the rarest so many are looked up.
    Numbers near n come first, and s is the best similarity found so far. A cluster with more tokens than the longest row of
    the family has over the threshold can't be joined any more and leaves the index.
    """
    placed = rows.select(F.col(family).alias("family"), F.col(name).alias("name"), F.col(score).cast("double").alias("score"), F.array_distinct(F.coalesce(F.col(tokens), F.array().cast("array<string>"))).alias("tokens"))
    placed = placed.withColumn("most", F.max(F.size("tokens")).over(Window.partitionBy("family")))
    placed = placed.repartition("family").sortWithinPartitions("family", F.desc_nulls_last("score"), "name")
    schema = T.StructType([placed.schema[c] for c in ("family", "name", "score")]).add("cluster", T.LongType()).add("similarity", T.DoubleType()).add("place", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        started, now = False, None
        holders: dict[int, dict[str, set[int]]] = {}  # by number of tokens and token
        held: dict[int, set[str]] = {}  # the tokens of each cluster that can still be joined
        members: list[int] = []
        bare = -1
        for batch in batches:
            out = []
            for f, label, s, own, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or f != now:
                    started, now, holders, held, members, bare = True, f, {}, {}, [], -1
                n, tokens = len(own), set(own)
                best, like = -1, 0.0
                for size in sorted((m for m in holders if threshold * n <= m + 1e-9 and threshold * m <= n + 1e-9), key=lambda m: abs(m - n)):
                    wanted = max(threshold, like)
                    least = max(1, math.ceil(wanted / (1 + wanted) * (n + size) - 1e-9))
                    if least > min(n, size):
                        continue
                    by_token = holders[size]
                    places = sorted((by_token.get(t, ()) for t in own), key=len)[: n - least + 1]
                    for c in set().union(*places):
                        both = len(tokens & held[c])
                        similarity = both / (size + n - both)
                        if similarity > like or (similarity == like and c < best):
                            best, like = c, similarity
                if not own and bare >= 0:
                    best, like = bare, 1.0
                if best < 0 or like < threshold:
                    best, like = len(members), None
                    members.append(0)
                    held[best] = set()
                    if not own:
                        bare = best
                before = held[best]
                now_held = before | tokens
                if len(now_held) > len(before):
                    for t in before:
                        at = holders[len(before)]
                        at[t].discard(best)
                        if not at[t]:
                            del at[t]
                    if len(now_held) * threshold > most + 1e-9:
                        del held[best]
                    else:
                        held[best] = now_held
                        by_token = holders.setdefault(len(now_held), {})
                        for t in now_held:
                            by_token.setdefault(t, set()).add(best)
                members[best] += 1
                out.append((f, label, s, best + 1, like, members[best]))
            if out:
                yield _emit(out, out_schema)

    return placed.mapInArrow(run, schema).withColumnsRenamed({"family": family, "name": name, "score": score})
