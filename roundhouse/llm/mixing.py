"""Mixing sources to target weights, with built-in functions only.

Tokens are summed by source, a share of the whole is dealt to each source by weight, and each document is then repeated
floor(rate) times, plus once more with a probability equal to the fraction. The draw depends on the document's key and a
seed, so reruns and retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, unit_hash, written

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Up to this many sources their targets are broadcast (some 100 bytes each); beyond it, they are joined by salted key.
BROADCAST_SOURCES = 50_000
SALTS = 64


def n_words(text: Column) -> Column:
    """Words of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: float = 3.0) -> DataFrame:
    """Targets of sources, from rows (source, source_size).

    Sources in code point order, null last, take the weights in turn. The targets share the sum of all sizes by weight; none is
    above max_repeats times its source's size, and what is cut off is shared again by weight among the others.

    Water filling: sources by size over weight ascending reach their caps in this order. A source's level, should all before it
    be full, is what they leave over the weights that remain; it is full if its cap is below its share at that level. As soon
    as one isn't full, none after it is, and all of these have that one's level.

    One row per source comes back: source, source_size, weight, target. Sources are few beside documents; they are ordered in
    one task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.coalesce(*[F.when(nth == i, F.lit(float(x))) for i, x in enumerate(weights)])
    cap = F.col("source_size") * F.lit(float(max_repeats))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        sizes.withColumn("weight", w)
        .withColumn("cap", cap)
        .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(onward))
        .withColumn("full", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
    )
    first = F.first(F.when(~F.col("full"), F.struct("left", "open")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("at", first).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("full") | F.col("at").isNull(), F.col("cap")).otherwise(F.col("weight") * F.col("at.left") / F.col("at.open")).alias("target"),
    )


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), max_repeats: float = 3.0, seed: str = "mix") -> DataFrame:
    """docs with the columns mix_size, mix_source_size, mix_target and mix_copies (int: how often the mix takes the document).

    A null text has size 0; an empty table gives no rows; null is a source of its own. Rows that repeat a key are drawn alike.
    Other columns pass through; those of the new names are replaced.

    One source may hold most rows: sums are taken before the shuffle, and the targets come back by broadcast while sources are
    few (counted first), else by a join on source and a salt, over which the rows of a source are spread.
    """
    docs, named = numbered(docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies"), key, text, source)
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(n_words(F.col(text))).alias("source_size"))
    targets = written(source_targets(sizes, weights, max_repeats)).select(
        F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")
    )
    sized = docs.withColumn("mix_size", n_words(F.col(text)))
    same = F.col(source).eqNullSafe(F.col("mix_source"))
    if targets.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), same)
    else:
        salted = targets.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.withColumn("mix_at", F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(SALTS)).cast("int"))
        joined = joined.join(salted, same & (F.col("mix_at") == F.col("mix_salt"))).drop("mix_at", "mix_salt")
    rate = F.coalesce(F.try_divide(F.col("mix_target"), F.col("mix_source_size").cast("double")), F.lit(0.0))
    whole = F.floor(rate)
    extra = F.when(unit_hash(F.col(key), seed) < rate - whole, 1).otherwise(0)
    return named(joined.withColumn("mix_copies", (whole + extra).cast("int")).select(*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document of docs as often as copies() says, with the columns of docs."""
    plain, named = numbered(docs, *[options.get(c, d) for c, d in (("key", "doc_id"), ("text", "text"), ("source", "source"))])
    took = copies(plain, **options).where("mix_copies > 0")
    return named(took.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*plain.columns))
