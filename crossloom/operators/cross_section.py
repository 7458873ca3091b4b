"""Per-date transformations of a signal: winsorize, standardize, rank, neutralize."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div, first_rank, group_count, z_population

#: The deviation of a normal distribution in units of its median absolute deviation. Fixed value.
MAD_SCALE = 1.4826


def mad_winsorize(df: DataFrame, c: str, out: str | None = None, n: float = 3.0, date: str = "datetime") -> DataFrame:
    """Clip to the date's median +- n scaled median absolute deviations; a zero or missing deviation leaves values as they are."""
    if n <= 0:
        raise ValueError("n must be positive")
    w = Window.partitionBy(date)
    df = df.withColumn("_m", F.median(c).over(w)).withColumn("_d", F.median(F.abs(F.col(c) - F.col("_m"))).over(w))
    reach = n * MAD_SCALE * F.col("_d")
    clipped = F.greatest(F.col("_m") - reach, F.least(F.col("_m") + reach, F.col(c)))
    return df.withColumn(out or c, F.when(F.col(c).isNull() | F.coalesce(F.col("_d") == 0, F.lit(True)), F.col(c)).otherwise(clipped)).drop("_m", "_d")


def zscore(df: DataFrame, c: str, out: str | None = None, date: str = "datetime") -> DataFrame:
    return df.withColumn(out or c, z_population(F.col(c), date))


def rank_standardize(df: DataFrame, c: str, out: str | None = None, date: str = "datetime", tie: str = "instrument") -> DataFrame:
    """(rank - 0.5) / n - 0.5 among the date's values; ties by `tie`; null stays null."""
    r = first_rank(F.col(c), tie, date)
    return df.withColumn(out or c, div(r - 0.5, group_count(F.col(c), date)) - 0.5)


def neutralize(df: DataFrame, c: str, exposures: Sequence[str] = (), group: str | None = None, out: str = "signal_neutral", date: str = "datetime") -> DataFrame:
    """Residual of a per-date regression on exposures and group dummies, with an intercept.

    Values and exposures are taken less their means within date and group, which covers the intercept and the dummies. One
    exposure then has a closed form; several give the normal equations, whose sums are aggregates of each date, and a
    fold over their pivots solves them. Exposures that depend on others change nothing. Dates
    with fewer than two complete rows, and incomplete rows, give null.
    """
    if not exposures and group is None:
        return df.withColumn(out, F.col(c))
    ok = F.col(c).isNotNull()
    for x in (*exposures, *([group] if group else [])):
        ok = ok & F.col(x).isNotNull()
    if len(exposures) > 1:
        return _several(df, c, list(exposures), group, out, date, ok)
    cell = Window.partitionBy(date, *([group] if group else []))
    whole = Window.partitionBy(date)
    mean = lambda x: F.avg(F.when(ok, F.col(x))).over(cell)
    df = df.withColumn("_y", F.when(ok, F.col(c) - mean(c))).withColumn("_n", F.count(F.when(ok, 1)).over(whole))
    rest = F.col("_y")
    if exposures:
        df = df.withColumn("_x", F.when(ok, F.col(exposures[0]) - mean(exposures[0])))
        df = df.withColumn("_xx", F.sum(F.col("_x") * F.col("_x")).over(whole)).withColumn("_xy", F.sum(F.col("_x") * F.col("_y")).over(whole))
        rest = rest - F.when(F.col("_xx") > 1e-12, div(F.col("_xy"), F.col("_xx"))).otherwise(0.0) * F.col("_x")
    return df.withColumn(out, F.when(F.col("_n") >= 2, rest)).drop("_y", "_n", "_x", "_xx", "_xy")


#: A pivot this small beside its exposure's own sum of squares means that the exposure depends on those before it.
DEPENDENT = 1e-10


def solved(matrix: Column, n: int) -> Column:
    """The solution of n normal equations, given as the array of rows (n coefficients, then the right side): one elimination step a pivot. Unknowns without a pivot are 0."""
    width = n + 1
    at = lambda m, i, j: F.get(m, i * width + j)
    diagonal = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: at(matrix, i, i))

    def step(m, k):
        pivot = at(m, k, k)
        usable = pivot > DEPENDENT * F.get(diagonal, k)

        def cell(v, place):
            i, j = F.floor(place / width).cast("int"), place % width
            return F.when(~usable | (i == k), v).otherwise(v - at(m, i, k) * at(m, k, j) / pivot)

        return F.when(usable, F.transform(m, cell)).otherwise(F.transform(m, lambda v, place: F.when((F.floor(place / width) == k) | (place % width == k), 0.0).otherwise(v)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, step)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(at(done, k, k) > 0, at(done, k, n) / at(done, k, k)).otherwise(0.0))


def _several(df: DataFrame, c: str, exposures: list[str], group: str | None, out: str, date: str, ok: Column) -> DataFrame:
    """Means by cell, then sums of products by date, are partial aggregates; only their few numbers meet the rows again."""
    keys = [date, *([group] if group else [])]
    n, width = len(exposures), len(exposures) + 1
    means = df.where(ok).groupBy(*keys).agg(*[F.avg(F.col(x).cast("double")).alias(f"_m{i}") for i, x in enumerate([*exposures, c])]).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f"_m{i}" for i in range(width)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    df = df.join(means, same & ok, "left").withColumns({f"_x{i}": F.when(ok, F.col(x) - F.col(f"_m{i}")) for i, x in enumerate([*exposures, c])}).drop(*[f"_k{i}" for i in range(len(keys))], *[f"_m{i}" for i in range(width)])
    products = {(i, j): F.coalesce(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")), F.lit(0.0)).alias(f"_p{i}_{j}") for i in range(n) for j in range(i, width)}
    sums = df.groupBy(F.col(date).alias("_date")).agg(F.count(f"_x{n}").alias("_n"), *products.values())
    matrix = F.array(*[F.col(f"_p{min(i, j)}_{max(i, j)}") for i in range(n) for j in range(width)])
    slopes = sums.select("_date", "_n", solved(matrix, n).alias("_b"))
    rest = F.col(f"_x{n}")
    for i in range(n):
        rest = rest - F.get("_b", F.lit(i)) * F.col(f"_x{i}")
    return df.join(slopes, F.col(date) == F.col("_date"), "left").withColumn(out, F.when(F.col("_n") >= 2, rest)).drop("_date", "_n", "_b", *[f"_x{i}" for i in range(width)])


def purify(df: DataFrame, c: str, steps: Sequence[str] = ("mad", "zscore"), out: str | None = None, exposures: Sequence[str] = (), group: str | None = None, n: float = 3.0, date: str = "datetime") -> DataFrame:
    """The named steps one after another on a copy of the column."""
    out = out or f"{c}_pure"
    df = df.withColumn(out, F.col(c))
    for step in (s.strip().lower() for s in steps):
        match step:
            case "mad":
                df = mad_winsorize(df, out, n=n, date=date)
            case "zscore":
                df = zscore(df, out, date=date)
            case "rank":
                df = rank_standardize(df, out, date=date)
            case "neutralize":
                df = neutralize(df, out, exposures, group, out, date)
            case _:
                raise ValueError(f"unknown step {step}")
    return df


def size_proxy(df: DataFrame, out: str = "size_proxy") -> DataFrame:
    """log(1 + |close| |volume|), or of |close| alone where the panel has no volume."""
    size = F.abs("close") * F.abs("volume") if "volume" in df.columns else F.abs("close")
    return df.withColumn(out, F.log1p(size))


def attach_group(df: DataFrame, groups: DataFrame, column: str = "industry", key: str = "instrument", order: str | None = None) -> DataFrame:
    """The group of each instrument; of several rows the first by `order` (the column itself if not given)."""
    one = groups.groupBy(key).agg(F.min_by(column, order or column).alias(column))
    return df.join(one, key, "left")


