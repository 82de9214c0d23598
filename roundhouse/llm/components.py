"""Connected components of links between keys, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: A key with more than this share of all rows is hot; there can be only the inverse of it of such keys, so they are broadcast.
HOT_SHARE = 1.0 / 512
#: Parts that a hot key's rows are dealt over.
PARTS = 64


def _least(pairs: DataFrame, also: Column) -> DataFrame:
    """Of each u the least of its v and also, and its number of rows: partial sums before the shuffle."""
    return pairs.groupBy("u").agg(F.least(also, F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with the m of their u. Rows of a hot u are dealt over parts by v, and its least goes to each of them.

    least is a written table; a u has its part's number only if it is hot, so that all others meet in one place as ever.
    """
    hot = least.where(F.col("n") > max(PARTS, total * HOT_SHARE)).select(F.col("u").alias("hot"))
    dealt = rows.join(F.broadcast(hot), F.col("u") == F.col("hot"), "left").select("u", "v", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(PARTS).cast("long"))).otherwise(F.lit(0).cast("long")).alias("part"))
    copies = F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    sent = least.join(F.broadcast(hot), F.col("u") == F.col("hot"), "left").select("u", "m", F.explode(copies).alias("part"))
    return dealt.join(sent, ["u", "part"]).select("u", "v", "m")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; the component is its least node.

    Large stars and small stars take turns: a node's larger neighbours are linked to its least one, then itself and its smaller
    neighbours are; both keep components whole, and the links become stars around least nodes in some log-many rounds. A node may
    have any number of links, a third of all too: its least neighbour is aggregated before the shuffle, and its rows are dealt
    over parts for the join with it. Each step is a written table; how many links there are, and whether a node is both a centre
    and linked to another one, or linked to several centres, is all that the driver asks.
    """
    pairs = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        total = 2 * pairs.count()
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(_least(both, F.col("u")))
        large = written(_with_least(both, least, total).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        nearest = written(_least(large, F.col("u")))
        small = _with_least(large, nearest, total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(nearest.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct())
        for done in (pairs, least, large, nearest):
            dropped(done)
        pairs = after
        centres = pairs.select(F.col("v").alias("c")).distinct()
        linked = pairs.select("u").distinct().join(centres, F.col("u") == F.col("c"), "left_semi").select("u")
        several = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        if not linked.unionByName(several).limit(1).count():
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
