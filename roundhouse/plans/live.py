"""Streams drained into tables, held against the same queries in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import live
from .registry import query


@query("""SELECT time_bucket(INTERVAL 4 HOURS, ts) AS start_ts, user_id::BIGINT AS player, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3""")
def streamed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.drained(live.totals(live.events(spark, sf_dir, "events.parquet")), "streamed_totals", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start_ts"), "player", "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT a.event_id AS first_id, b.event_id AS then_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS""")
def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.drained(live.answers(live.events(spark, sf_dir, "events.parquet"), "view", "purchase", "6 hours"), "streamed_answers")
    return out.select("first_id", "then_id", "user_id")


@query("""SELECT event_id, user_id FROM events""")
def streamed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = live.events(spark, sf_dir, "events.parquet")
    return live.drained(live.once(raw.unionByName(raw), ["event_id"]), "streamed_once").select("event_id", "user_id")


@query()
def streamed_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(live.limited(live.events(spark, sf_dir, "events.parquet"), 3, 7200, 500), "streamed_limits")
