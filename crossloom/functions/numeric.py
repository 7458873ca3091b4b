"""Column helpers whose null, zero and tie rules are fixed, so that every operator shares them."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null (ANSI mode would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(c: Column) -> Column:
    """Null instead of NaN or infinity."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clip(c: Column, low: float, high: float) -> Column:
    """Into [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def corr(x: Column, y: Column, over=None) -> Column:
    """Pearson correlation over the rows where both are present; null if either is constant there."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    on = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    spread = on(F.stddev_pop(a)) * on(F.stddev_pop(b))
    return F.when(spread > 1e-12, div(on(F.covar_pop(a, b)), spread))


def average_rank(c: Column, *by: Column | str) -> Column:
    """1-based rank among the non-null values of a group; ties share their mean rank."""
    w = Window.partitionBy(*by, c.isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    return F.when(c.isNotNull(), F.rank().over(w.orderBy(c)) + (ties - 1) / 2)


def first_rank(c: Column, tie: Column | str, *by: Column | str) -> Column:
    """1-based rank among the non-null values of a group; ties in the order of `tie`."""
    return F.when(c.isNotNull(), F.row_number().over(Window.partitionBy(*by, c.isNull()).orderBy(c, tie)))


def group_count(c: Column, *by: Column | str) -> Column:
    return F.count(c).over(Window.partitionBy(*by))


# Four z-scores that differ in the deviation's divisor and in what a constant or missing value becomes.


def z_population(c: Column, *by: Column | str) -> Column:
    """Divisor n; constant group: 0; null stays null."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(c).over(w)
    return F.when(c.isNotNull(), F.when(F.coalesce(sd, F.lit(0.0)) > 1e-12, div(c - F.avg(c).over(w), sd)).otherwise(0.0))


def z_population_strict(c: Column, *by: Column | str) -> Column:
    """Divisor n; constant group: null."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(c).over(w)
    return F.when(sd > 1e-12, div(c - F.avg(c).over(w), sd))


def z_sample(c: Column, *by: Column | str) -> Column:
    """Divisor n - 1; constant group and null value: 0."""
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(c).over(w)
    return F.coalesce(F.when(F.coalesce(sd, F.lit(0.0)) > 1e-12, div(c - F.avg(c).over(w), sd)), F.lit(0.0))


def min_max(c: Column, *by: Column | str) -> Column:
    """0 to 1 within the group; constant group: 1; null: 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(c.isNull(), 0.0).when(high == low, 1.0).otherwise(div(c - low, high - low))


# Four readings of a flag written as text.


def true_unless(c: Column) -> Column:
    """False for null, '', 0, false, no, nan; else true."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isNull() | text.isin("", "0", "false", "no", "nan"), False).otherwise(True)


def true_if(c: Column, *also: str) -> Column:
    """True for 1, true, yes, y and the words in `also`; else false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y", *also), F.lit(False))
