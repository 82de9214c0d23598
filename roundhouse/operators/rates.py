"""Rates as mergeable numerators and denominators, with weak-sample flags, references and shrinkage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import nearest_quantiles, ratio


@dataclass(frozen=True)
class Rate:
    """A share: rows for which the SQL condition flag holds, among those for which of does. Weak below a number of these."""

    name: str
    flag: str
    of: str = "true"
    weak_below: int = 8

    def parts(self) -> list[Column]:
        base = F.expr(self.of)
        count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
        return [count(base & F.expr(self.flag)).alias(f"{self.name}_n"), count(base).alias(f"{self.name}_d")]

    def finished(self) -> list[Column]:
        n, d = F.col(f"{self.name}_n"), F.col(f"{self.name}_d")
        return [n, d, ratio(n, d).alias(self.name), (d < self.weak_below).alias(f"{self.name}_weak")]


def rates(df: DataFrame, keys: Sequence[str], specs: Sequence[Rate]) -> DataFrame:
    """Numerators and denominators by key: partial results that can be summed."""
    return df.groupBy(*keys).agg(*[p for s in specs for p in s.parts()])


def finished(parts: DataFrame, keys: Sequence[str], specs: Sequence[Rate]) -> DataFrame:
    return parts.select(*keys, *[c for s in specs for c in s.finished()])


def accumulated(parts: DataFrame, keys: Sequence[str], specs: Sequence[Rate]) -> DataFrame:
    """Partial results of several sources summed, then finished."""
    summed = parts.groupBy(*keys).agg(*[F.sum(f"{s.name}_{x}").cast("long").alias(f"{s.name}_{x}") for s in specs for x in "nd"])
    return finished(summed, keys, specs)


def others_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The median of the other rows of a key, nulls left out; null if there are no others.

    Of the sorted values only those about the middle matter: without one of them, the middle moves by one place at most.
    """
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(F.col(value).asc_nulls_last()))).withColumn("_n", F.count(value).over(w))
    here, left = F.col(value).isNotNull(), F.col("_n") - F.col(value).isNotNull().cast("int")
    low, high = F.floor((left + 1) / 2), F.floor(left / 2) + 1  # places among the others
    middle = F.floor(F.col("_n") / 2)
    near = {d: F.max(F.when(F.col("_r") == middle + d, F.col(value))).over(w) for d in (-1, 0, 1, 2)}
    rows = rows.select("*", *[x.alias(f"_v{d + 1}") for d, x in near.items()])
    own = lambda p: p + (here & (F.col("_r") <= p)).cast("int") - middle + 1  # noqa: E731  the place among all, from the one before the middle
    at = lambda p: F.element_at(F.array(*[F.col(f"_v{i}") for i in range(4)]), (own(p) + 1).cast("int"))
    return rows.withColumn(name, F.when(left > 0, (at(low) + at(high)) / 2)).drop("_r", "_n", "_v0", "_v1", "_v2", "_v3")


def shrunk(n: Column | str, value: Column | str, parent: Column | str, k: float) -> Column:
    """A value pulled to its parent's: weight n / (n + k)."""
    n, value, parent = (F.col(c) if isinstance(c, str) else c for c in (n, value, parent))
    w = n / (n + F.lit(float(k)))
    return F.when(n > 0, w * value + (1 - w) * parent).otherwise(parent)


def hierarchical(rows: DataFrame, levels: Sequence[Sequence[str]], value: str, weight: str, k: float = 20.0, weak_below: float = 20.0) -> DataFrame:
    """Weighted means at each level of keys, each shrunk to the level above; levels go from the coarsest to the finest."""
    out = None
    for keys in levels:
        here = rows.groupBy(*keys).agg(F.sum(weight).alias("n"), ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("raw"))
        if out is None:
            out = here.withColumn("rate", F.col("raw"))
        else:
            up = out.select(*above, F.col("rate").alias("_up"))
            out = here.join(up, list(above)).withColumn("rate", shrunk("n", "raw", "_up", k)).drop("_up")
        above = keys
    return out.withColumn("weak", F.col("n") < weak_below)


def method_of_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: variance within groups, between their means, and their ratio, by which a mean of few values is shrunk."""
    per = df.groupBy(group).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n")).where("n >= 2")
    return per.agg(F.avg("v").alias("within"), F.var_samp("m").alias("between"), ratio(F.avg("v"), F.var_samp("m")).alias("k"))


def outliers(df: DataFrame, keys: Sequence[str], value: str, name: str = "deviations") -> DataFrame:
    """How many scaled median absolute deviations a value is from its key's median; null if these are 0."""
    mid = df.join(df.groupBy(*keys).agg(F.median(value).alias("_mid")), list(keys))
    apart = mid.withColumn("_apart", F.abs(F.col(value) - F.col("_mid")))
    spread = apart.groupBy(*keys).agg((F.median("_apart") * 1.4826).alias("_spread"))
    return apart.join(spread, list(keys)).withColumn(name, ratio(F.col(value) - F.col("_mid"), "_spread")).drop("_mid", "_apart", "_spread")


def quantile_reference(df: DataFrame, keys: Sequence[str], values: Sequence[str], steps: int = 100, least: int = 1) -> DataFrame:
    """(keys, component, quantiles): each value's quantiles in steps, by the nearest place, where there are enough rows."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("component"), F.col(v).cast("double").alias("value")) for v in values])).alias("x")).select(*keys, "x.*").where("value is not null")
    enough = long.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    points = nearest_quantiles(long, [*keys, "component"], "value", [i / steps for i in range(steps + 1)])
    tables = points.groupBy(*keys, "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("point", "value"))), lambda p: p["value"]).alias("quantiles"))
    return tables.join(enough, [*keys, "component"])
