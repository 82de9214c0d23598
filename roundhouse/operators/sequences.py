"""Operators over ordered rows: change points, islands, running states, ranks with ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import masked_rank


def ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def change_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is positive and differs from the one before."""
    before = F.lag(value).over(ordered(keys, order))
    return df.withColumn("_before", before).where((F.col(value) > 0) & (F.col("_before").isNull() | (F.col("_before") != F.col(value)))).drop("_before")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 0; a row for which breaks holds begins one. breaks may use lag over the same window."""
    return df.withColumn("_new", F.coalesce(breaks.cast("int"), F.lit(0))).withColumn(name, F.sum("_new").over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def running(keys: Sequence[str], order: Sequence[str], c: Column) -> Column:
    """Running sum up to and with the row."""
    return F.sum(c).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, limit: float | Column, name: str) -> DataFrame:
    """What each row adds to a running sum that stops at a limit, which may be a column."""
    upto = running(keys, order, F.col(amount))
    lim = limit if isinstance(limit, Column) else F.lit(float(limit))
    return df.withColumn("_upto", upto).withColumn(name, F.greatest(F.least("_upto", lim) - F.least(F.col("_upto") - F.col(amount), lim), F.lit(0.0))).drop("_upto")


def alone_first(df: DataFrame, keys: Sequence[str], by: str, name: str) -> DataFrame:
    """Whether a row alone has the least value of its keys; ties have no first."""
    out = df.withColumn("_rank", masked_rank(keys, by))
    return out.withColumn(name, F.coalesce((F.col("_rank") == 1) & (F.sum((F.col("_rank") == 1).cast("int")).over(Window.partitionBy(*keys)) == 1), F.lit(False))).drop("_rank")


def majority(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each key; null if several are."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.withColumn("_rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("_n")))).where("_rank = 1")
    return top.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == 1, F.first(value)).alias(name))


def top_with_ties(df: DataFrame, keys: Sequence[str], by: str, k: int) -> DataFrame:
    return df.withColumn("_rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(by)))).where(F.col("_rank") <= k).drop("_rank")


def resampled(df: DataFrame, keys: Sequence[str], time: str, order: str, values: Sequence[str], step: int) -> DataFrame:
    """Values at every multiple of step between a key's first and last row: those of the last row up to then."""
    from .joins import asof

    grid = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    grid = grid.select(*keys, F.explode(F.sequence(F.ceil(F.col("_a") / step) * step, F.ceil(F.col("_b") / step) * step, F.lit(step).cast("long"))).alias(time)).join(grid, list(keys)).where(F.col(time) <= F.col("_b")).drop("_a", "_b")
    return asof(grid, df, keys, time, values, [order]).select(*keys, time, *[F.col(f"r_{v}").alias(v) for v in values])


def hysteresis(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, leave: float, back: float) -> DataFrame:
    """(keys, trip, first, last): runs of rows outside, which begin beyond leave and end within back; places in order, from 0. A run that never comes back ends at the last row.

    What is between both keeps the state of the row before it: the last row that said anything.
    """
    w = ordered(keys, order)
    said = F.when(F.col(value) > leave, 1).when(F.col(value) <= back, 0)
    rows = df.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("_at"), F.coalesce(F.last(said, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("_out"))
    runs = islands(rows, keys, ["_at"], ~F.col("_out").eqNullSafe(F.lag("_out").over(ordered(keys, ["_at"]))), "_run").where("_out = 1")
    found = runs.groupBy(*keys, "_run").agg(F.min("_at").alias("first"), F.max("_at").alias("last"))
    return found.withColumn("trip", (F.row_number().over(ordered(keys, ["first"])) - 1).cast("long")).select(*keys, "trip", "first", "last")


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Run lengths: each run of equal values with its first and last place and length."""
    w = ordered(keys, order)
    numbered = df.withColumn("_place", F.row_number().over(w)).withColumn("_differs", ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.col("_place") == 1))
    runs = islands(numbered, keys, order, F.col("_differs"))
    return runs.groupBy(*keys, "island", value).agg(F.min("_place").cast("long").alias("first_place"), F.max("_place").cast("long").alias("last_place"), F.count(F.lit(1)).alias("length"))
