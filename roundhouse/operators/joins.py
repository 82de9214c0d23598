"""Joins that plain SQL has no word for, as unions, windows and equi-joins: no inequality join without an equal key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import first_by


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, take: Sequence[str], order: Sequence[str] = (), direction: str = "backward", exact: bool = True, tolerance: float | None = None, prefix: str = "r_") -> DataFrame:
    """left with the columns take of the nearest right row before (or after) it in on, within by; null if none.

    Both sides are one stream in time, with the right rows of a tie before the left ones or after, as exact says; the last (or
    next) right row is carried along: one shuffle by the keys. Among right rows at one time the last in order (before) or the
    first (after) is taken. direction: backward, forward or nearest, of two equally near the earlier. The found row's own time
    comes as prefix + on.
    """
    if direction == "nearest":
        both = asof(asof(left, right, by, on, take, order, "backward", exact, tolerance, "_b_"), right, by, on, take, order, "forward", exact, tolerance, "_f_")
        back = F.col(f"_b_{on}").isNotNull() & (F.col(f"_f_{on}").isNull() | (F.col(on) - F.col(f"_b_{on}") <= F.col(f"_f_{on}") - F.col(on)))
        return both.select(*left.columns, *[F.when(back, F.col(f"_b_{c}")).otherwise(F.col(f"_f_{c}")).alias(f"{prefix}{c}") for c in dict.fromkeys([on, *take])])
    found = list(dict.fromkeys([on, *take, *order]))
    backward = direction == "backward"
    first_on_tie = 0 if backward == exact else 2  # where right rows stand among left rows (1) of the same time
    rows = left.select(*[F.col(c) for c in by], F.col(on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*found)).schema[0].dataType).alias("_r"))
    facts = right.select(*[F.col(c) for c in by], F.col(on).alias("_t"), F.lit(first_on_tie).alias("_side"), F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), F.struct(*found).alias("_r"))
    window = Window.partitionBy(*by).orderBy("_t", "_side", *[F.col(f"_r.{c}") for c in order])
    carried = F.last("_r", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)) if backward else F.first("_r", ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))
    out = rows.unionByName(facts).withColumn("_r", carried).where("_side = 1")
    near = F.lit(True) if tolerance is None else F.abs(F.col("_r")[on] - F.col("_t")) <= tolerance
    return out.select("_l.*", *[F.when(near, F.col("_r")[c]).alias(f"{prefix}{c}") for c in dict.fromkeys([on, *take])])


def retaliation(kills: DataFrame, keys: Sequence[str], window: float) -> DataFrame:
    """Pairs of kills where the earlier killer dies at the hands of the earlier victim's side within window; both kills' columns, prefixed first_ and then_.

    Joined on who dies, so that a hash or merge join does it, with the time as a further condition.
    """
    a = kills.select([F.col(c).alias(f"first_{c}") for c in kills.columns])
    b = kills.select([F.col(c).alias(f"then_{c}") for c in kills.columns])
    on = [F.col(f"first_{k}") == F.col(f"then_{k}") for k in keys]
    gap = F.col("then_tick") - F.col("first_tick")
    return a.join(b, [*on, F.col("first_attacker") == F.col("then_victim"), F.col("then_attacker_side") == F.col("first_victim_side"), gap > 0, gap <= window])


def within_after(events: DataFrame, causes: DataFrame, on: Sequence[tuple[str, str]], start: Column, end: Column) -> DataFrame:
    """events joined with causes whose interval holds them. on: equal columns (of events, of causes); start and end in terms of both."""
    return events.join(causes, [F.col(a) == F.col(b) for a, b in on] + [start, end])


def nearest_row(left: DataFrame, right: DataFrame, on: Sequence[Column], keys: Sequence[str], gap: Column, *ties: Column | str) -> DataFrame:
    """Of the right rows that match, the one with the least gap for each key; left rows without any are left out."""
    return first_by(left.join(right, list(on)).withColumn("gap", gap), keys, "gap", *ties)


def bucketed_near(left: DataFrame, right: DataFrame, left_on: str, right_on: str, keys: Sequence[str], radius: float) -> DataFrame:
    """Pairs at most radius apart in one dimension: the right side goes to its bucket and both beside it, then the join is equal."""
    width = float(max(radius, 1))
    a = left.withColumn("_bucket", F.floor(F.col(left_on) / width))
    b = right.withColumn("_at", F.floor(F.col(right_on) / width)).withColumn("_bucket", F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1))).drop("_at")
    return a.join(b, [*keys, "_bucket"]).where(F.abs(F.col(left_on) - F.col(right_on)) <= radius).drop("_bucket")


def overridden(derived: DataFrame, manual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Derived rows, but manual ones where these have the key."""
    return derived.join(manual, list(keys), "left_anti").unionByName(manual, allowMissingColumns=True)


def with_fallback(df: DataFrame, fine: DataFrame, fine_keys: Sequence[str], coarse: DataFrame, coarse_keys: Sequence[str], value: str) -> DataFrame:
    """value from the fine table, else from the coarse one."""
    a = fine.select(*fine_keys, F.col(value).alias("_fine"))
    b = coarse.select(*coarse_keys, F.col(value).alias("_coarse"))
    return df.join(a, list(fine_keys), "left").join(b, list(coarse_keys), "left").withColumn(value, F.coalesce("_fine", "_coarse")).drop("_fine", "_coarse")


def densified(facts: DataFrame, spine: DataFrame, expected: DataFrame, spine_keys: Sequence[str], shared: Sequence[str], value: str) -> DataFrame:
    """Every expected row for every spine row that shares its keys, with the fact's value, or 0."""
    every = spine.join(expected, list(shared))
    keys = list(dict.fromkeys([*spine_keys, *expected.columns]))
    return every.join(facts.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def one_to_one(pairs: DataFrame, left: Sequence[str], right: Sequence[str], *order: Column | str) -> DataFrame:
    """Pairs kept greedily: of each left the first in order, then of these of each right the first."""
    return first_by(first_by(pairs, left, *order), right, *order)
