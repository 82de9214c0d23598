"""Semantics that differ between data frame libraries, settled once.

Sums of nothing are 0, ratios by 0 are null, ranks of nulls are null, angles wrap to positive remainders, ties have named rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(n: Column | str, d: Column | str, scale: float = 1.0) -> Column:
    """n / d as a double; null if d is 0 or null."""
    return F.try_divide(col(n).cast("double") * scale, col(d).cast("double"))


def ratio_or_zero(n: Column | str, d: Column | str, scale: float = 1.0) -> Column:
    return F.coalesce(ratio(n, d, scale), F.lit(0.0))


def sum_or_zero(c: Column | str) -> Column:
    return F.coalesce(F.sum(col(c)), F.lit(0))


def total_if(condition: Column, c: Column | str) -> Column:
    """Sum of c where the condition holds; 0 if nowhere."""
    return F.coalesce(F.sum(F.when(condition, col(c))), F.lit(0))


def distinct_with_null(c: Column | str) -> Column:
    """Distinct values, null being one."""
    return F.count_distinct(col(c)) + F.max(col(c).isNull().cast("int"))


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def ramp(x: Column, low: float, high: float) -> Column:
    """0 at low, 1 at high, straight between, either way round; null is 0."""
    return F.coalesce(clip((x - F.lit(float(low))) / F.lit(float(high - low)), 0.0, 1.0), F.lit(0.0))


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def exact_mean(x: Column | str) -> Column:
    """Aggregate: mean of doubles by their decimals (ten places), so that it doesn't depend on the order of the sum and halves stay halves.

    As doubles where a value is not finite or from 10^18 on.
    """
    whole = col(x).try_cast("decimal(28,10)")
    return F.when(F.count(whole) == F.count(col(x)), F.avg(whole).cast("double")).otherwise(F.avg(col(x)))


def masked_rank(keys: Sequence[str], by: str, descending: bool = False, dense: bool = False) -> Column:
    """Rank by a column within keys, the least of equals; null for null."""
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    window = Window.partitionBy(*keys).orderBy(order)
    return F.when(F.col(by).isNotNull(), F.dense_rank().over(window) if dense else F.rank().over(window))


def average_rank(keys: Sequence[str], by: str, descending: bool = False) -> Column:
    """Rank where equals share the mean of their places."""
    return masked_rank(keys, by, descending) + (F.count(F.col(by)).over(Window.partitionBy(*keys, by)) - 1) / 2.0


def first_by(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def nearest_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """(keys, point, value): at each point the value whose place is nearest to it (halves to the even place), without interpolation.

    point is the number of the point. Values are counted first, so that no key's rows come together; nulls are left out.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_upto", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    wanted = F.array(*[F.struct(F.lit(i).alias("point"), F.lit(float(q)).alias("q")) for i, q in enumerate(points)])
    place = lambda q: F.bround((F.col("_all") - 1) * q)
    here = F.filter(wanted, lambda w: (place(w["q"]) >= F.col("_upto") - F.col("_n")) & (place(w["q"]) < F.col("_upto")))
    return placed.select(*keys, F.col(value).alias("value"), F.explode(here).alias("_w")).select(*keys, F.col("_w.point").alias("point"), "value")


def weighted_percentile(value: Column | str, weight: Column | str, q: float) -> Column:
    """Aggregate: percentile of a histogram, linear between places."""
    return F.percentile(col(value), F.lit(float(q)), col(weight))


def share_at_most(values: Column, x: Column) -> Column:
    """Share of an array that is at most x: where x would be put from the right. 0 for null x, null for an empty array."""
    return F.when(F.size(values) > 0, F.coalesce(F.size(F.filter(values, lambda v: v <= x)) / F.size(values), F.lit(0.0)))


def floor_mod(x: Column, n: float) -> Column:
    return F.pmod(x, F.lit(n))


def logistic(z: Column, floor: float = 1e-6) -> Column:
    return clip(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), floor, 1.0 - floor)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X >= k) of n trials: terms from the recurrence of the binomial coefficient."""
    import math

    term = lambda i: F.exp(_log_factorial(n) - _log_factorial(i) - _log_factorial(n - i) + i * math.log(p) + (n - i) * math.log1p(-p))
    return F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).otherwise(F.aggregate(F.sequence(k.cast("int"), n.cast("int")), F.lit(0.0), lambda s, i: s + term(i)))


def _log_factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
