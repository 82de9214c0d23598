"""Structured Streaming forms of session operators.

Event time is ts; state is bounded by the watermark. Each function takes a streaming or a plain DataFrame of events.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sessions import made, shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_at_once: int = 8) -> DataFrame:
    """Files of events as they come."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def totals(df: DataFrame, late: str = "10 minutes", window: str = "4 hours") -> DataFrame:
    """Counts and sums by window, player and type."""
    player = F.col("user_id").alias("player")
    return df.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), player, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "player", "event_type", "n", "total")


def sessions(df: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events without a longer gap."""
    return df.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def answers(df: DataFrame, first: str, then: str, within: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Pairs of events of one user, a later one of another type within a time: a join of streams whose state the watermark bounds."""
    a = df.where(F.col("event_type") == first).select(F.col("event_id").alias("first_id"), F.col("user_id"), F.col("ts").alias("first_ts")).withWatermark("first_ts", late)
    b = df.where(F.col("event_type") == then).select(F.col("event_id").alias("then_id"), F.col("user_id").alias("then_user"), F.col("ts").alias("then_ts")).withWatermark("then_ts", late)
    on = (F.col("user_id") == F.col("then_user")) & (F.col("then_ts") > F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on).select("first_id", "then_id", "user_id", "first_ts", "then_ts")


def once(df: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once while the watermark remembers it."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def limited(df: DataFrame, most: int, seconds: int, jump: int = 1000, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, verdict): ok, rate (more than most in the seconds before) or jump (an id more than jump above the user's highest that was let through).

    A user's recent times and highest id are all the state there is; it goes a while after the user falls silent.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, highest = state.get if state.exists else ([], None)
        recent = list(recent)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for ts, i in zip(rows["ts"], rows["event_id"], strict=True):
            at = ts.timestamp()
            recent = [t for t in recent if t > at - seconds]
            verdict = "jump" if highest is not None and i > highest + jump else "rate" if len(recent) >= most else "ok"
            if verdict == "ok":
                recent.append(at)
                highest = max(highest or i, i)
            out.append((key[0], int(i), verdict))
        state.update((recent, highest))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["ts"].max().timestamp() * 1000)) + 1000 * seconds)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "verdict"])

    timed = df.withWatermark("ts", late).select("user_id", "event_id", "ts")
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, verdict string", "recent array<double>, highest long", "append", GroupStateTimeout.EventTimeTimeout)


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives of what is there now, as a table of files in the folder of spark.checkpoint.dir, where its state and offsets are too."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    made(spark, folder)
    out = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        q = out.format("parquet").option("path", f"{folder}/rows").start()
    else:  # each batch gives the whole result anew
        q = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")
