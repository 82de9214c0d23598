"""A mergeable log of typed operations: merge, undo, fold to a state, state at a time, validation, limits.

An operation has doc_id, op_id, seq, author, kind, target, field, value and t; in a document operations go by (seq, author, op_id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import first_by

ORDER = ("seq", "author", "op_id")


def merged(*replicas: DataFrame) -> DataFrame:
    """The union of replicas, each operation once: of one id the first in order. Merging again, or in another order, changes nothing."""
    every = replicas[0]
    for r in replicas[1:]:
        every = every.unionByName(r, allowMissingColumns=True)
    return first_by(every, ["doc_id", "op_id"], "seq", "author", *sorted(set(every.columns) - {"doc_id", "op_id", "seq", "author"}))


def active(ops: DataFrame) -> DataFrame:
    """Operations that aren't undone: the last undo or redo of an operation by its own author decides."""
    verdicts = ops.where(F.col("kind").isin("undo", "redo")).select("doc_id", F.col("target").alias("op_id"), "author", "kind", F.struct("seq", F.col("op_id").alias("own_id")).alias("at"))
    last = verdicts.groupBy("doc_id", "op_id", "author").agg(F.max_by("kind", "at").alias("verdict"))
    kept = ops.where(~F.col("kind").isin("undo", "redo")).join(last, ["doc_id", "op_id", "author"], "left")
    return kept.where("verdict is null or verdict = 'redo'").drop("verdict")


def state(ops: DataFrame) -> DataFrame:
    """(doc_id, target, field, value): of each target that is created and not removed after, each field's last value since it was created.

    Of several creations the first counts; sets before it are ignored, as are those of targets that aren't there.
    """
    live = active(ops)
    at = F.struct(*ORDER)
    life = live.groupBy("doc_id", "target").agg(F.min(F.when(F.col("kind") == "create", at)).alias("born"), F.max(F.when(F.col("kind") == "remove", at)).alias("gone"))
    there = life.where(F.col("born").isNotNull() & (F.col("gone").isNull() | (F.col("gone") < F.col("born")))).select("doc_id", "target", "born")
    sets = live.where(F.col("kind") == "set").join(there, ["doc_id", "target"]).where(at > F.col("born"))
    return sets.groupBy("doc_id", "target", "field").agg(F.max_by("value", at).alias("value"))


def interpolated(points: DataFrame, times: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """value at each time: straight between the points before and after it, held beyond the last; null before the first."""
    from .joins import asof

    before = asof(times, points, keys, time, [value], direction="backward", prefix="_a_")
    both = asof(before, points, keys, time, [value], direction="forward", exact=False, prefix="_b_")
    share = F.try_divide((F.col(time) - F.col(f"_a_{time}")).cast("double"), (F.col(f"_b_{time}") - F.col(f"_a_{time}")).cast("double"))
    between = F.col(f"_a_{value}") + share * (F.col(f"_b_{value}") - F.col(f"_a_{value}"))
    return both.withColumn(value, F.coalesce(between, F.col(f"_a_{value}"))).select(*times.columns, value)


def problems(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def over_limit(ops: DataFrame, keys: Sequence[str], time: str, seconds: int, most: int, name: str = "over") -> DataFrame:
    """Whether an operation is beyond the most that its author may send in the seconds up to it."""
    w = Window.partitionBy(*keys).orderBy(F.col(time)).rangeBetween(-(seconds - 1), 0)
    return ops.withColumn(name, F.count(F.lit(1)).over(w) > most)
