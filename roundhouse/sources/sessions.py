"""Session tables (rounds, kills, damages, blinds, shots, samples, economy, bombs) adapted from a plain table of events.

Ten users in a row are the players of a match, the first five of them team A; each day is a round of it, its time a tick of six
seconds. So matches grow with the users, and what a round or a player has does not grow with the table. Team A begins as t; sides
change after twelve rounds, and in overtime in blocks of three. What an event stands for goes by its type. Every table has
event_seq, by which events of one tick are ordered, and round_num is unique in the corpus (nth counts within the match).

Events are read once in an application: their columns, and the players' states on a grid of ticks, are written to the folder of
spark.checkpoint.dir, ordered by match, and every query reads what it needs of them.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import asof

ROUND = ["match_id", "round_num"]
ROUNDS, SLOTS, TICKS, GRID = 30, 10, 14_400, 600
WEAPONS = ("rifle", "sniper", "smg", "pistol", "he", "fire", "knife")

_layers: dict[tuple[str, str, str], DataFrame] = {}
_written: list[tuple[SparkSession, str]] = []


def made(spark: SparkSession, path: str) -> None:
    _written.append((spark, path))


@atexit.register
def _clean() -> None:
    """Tables and folders that this driver made go with it."""
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            if spark.sparkContext._jsc is not None:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="roundhouse-layer-")
        made(spark, folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def layer(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], order: Sequence[str] = ("match_id", "round_num", "tick")) -> DataFrame:
    """What make gives, as a table that is written once in an application, in ranges of matches, and read from then on."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _layers:
        df = make()
        path = f"{shared_folder(spark)}/session-{name}-{uuid.uuid4().hex}"
        made(spark, path)
        df.repartitionByRange("match_id").sortWithinPartitions(*order).write.parquet(path)
        _layers[key] = spark.read.schema(df.schema).parquet(path)
    return _layers[key]


def _choice(k: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))


def first_side(nth: Column) -> Column:
    """The side of the team that began as t, in the match's nth round."""
    return F.when(nth <= 12, "t").when(nth <= 24, "ct").when(F.pmod(F.floor((nth - 25) / 3), F.lit(4)).isin(1, 2), "t").otherwise("ct")


def side_of(player: Column, nth: Column) -> Column:
    """The side of a player by the slot: team A has the first five."""
    mine = first_side(nth)
    return F.when(player % SLOTS < 5, mine).otherwise(F.when(mine == "t", "ct").otherwise("t"))


def nth_round(round_num: Column) -> Column:
    return (round_num - 1) % ROUNDS + 1


class Session:
    """The tables of one folder; each is made when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def ev(self) -> DataFrame:
        raw = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
        match = F.floor(F.col("user_id") / SLOTS).cast("long")
        nth = ((F.dayofmonth("ts") - 1) % ROUNDS + 1).cast("long")
        tick = F.floor((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / 6).cast("long")
        rows = raw.select(
            match.alias("match_id"), (match * ROUNDS + nth).alias("round_num"), nth.alias("nth"), tick.alias("tick"), ((match * ROUNDS + nth) * TICKS + tick).alias("at"),
            F.col("event_id").cast("long").alias("event_seq"), F.col("user_id").cast("long").alias("player"), side_of(F.col("user_id"), nth).alias("side"),
            F.get_json_object("props", "$.k").cast("long").alias("k"), "value", "event_type",
        )
        return layer(self.spark, self.sf_dir, "ev", lambda: rows)

    def _of(self, kind: str) -> DataFrame:
        return self.ev.where(F.col("event_type") == kind)

    _at = [*ROUND, "tick", "event_seq"]

    @property
    def _foe(self) -> Column:
        return F.floor(F.col("player") / SLOTS) * SLOTS + F.when(F.col("player") % SLOTS < 5, 5 + F.col("k") % 5).otherwise(F.col("k") % 5)

    @property
    def _other(self) -> Column:
        return F.when(F.col("side") == "t", "ct").otherwise("t")

    @cached_property
    def kills(self) -> DataFrame:
        slot = F.col("player") % SLOTS
        mate = F.col("player") - slot + F.floor(slot / 5) * 5 + (slot + 1 + F.col("k") % 4) % 5
        return self._of("purchase").select(
            *self._at, F.col("player").alias("attacker"), F.col("side").alias("attacker_side"), self._foe.alias("victim"), self._other.alias("victim_side"), _choice(F.col("k"), WEAPONS).alias("weapon"), (F.col("k") % 3 == 0).cast("long").alias("headshot"),
            F.when(F.col("k") % 4 == 1, mate).alias("assister"), (F.col("k") % 8 == 1).alias("flash_assist"),
        )

    @cached_property
    def damages(self) -> DataFrame:
        return self._of("click").select(*self._at, F.col("player").alias("attacker"), F.col("side").alias("attacker_side"), self._foe.alias("victim"), self._other.alias("victim_side"), _choice(F.col("k"), WEAPONS).alias("weapon"), F.col("value").alias("dmg"), (20.0 + F.col("k") * 7 % 81).alias("victim_health"))

    @cached_property
    def blinds(self) -> DataFrame:
        slot = F.col("player") % SLOTS
        blinded = F.col("player") - slot + (slot + F.col("k")) % 10
        return self._of("view").select(*self._at, F.col("player").alias("thrower"), F.col("side").alias("thrower_side"), blinded.alias("victim"), side_of(blinded, F.col("nth")).alias("victim_side"), (F.col("value") / 100).alias("duration"))

    @cached_property
    def shots(self) -> DataFrame:
        return self._of("error").select(*self._at, "player", "side", _choice(F.col("k"), WEAPONS).alias("weapon"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"))

    @cached_property
    def ticks(self) -> DataFrame:
        """Where a player is at each of the own events."""
        k = F.col("k")
        return self.ev.select(*self._at, "at", "player", "side", F.col("value").alias("x"), (k * 5.0).alias("y"), ((k % 7) * 10.0).alias("z"), F.concat(F.lit("p"), (k % 8).cast("string")).alias("place"), (k * 3.6).alias("yaw"), (k - 50.0).alias("pitch"), _choice(k, WEAPONS).alias("weapon"))

    @cached_property
    def rounds(self) -> DataFrame:
        won = self.kills.groupBy(*ROUND).agg(F.sum(F.when(F.col("attacker_side") == "t", 1).otherwise(-1)).alias("lead"))
        spans = self.ev.groupBy(*ROUND, "nth").agg(F.min("tick").alias("freeze_end"), F.max("tick").alias("end"))
        return spans.join(won, ROUND, "left").select(*ROUND, "nth", "freeze_end", "end", F.when(F.coalesce("lead", F.lit(0)) >= 0, "t").otherwise("ct").alias("winner"))

    @cached_property
    def roster(self) -> DataFrame:
        """The ten players of each round that is there."""
        first = F.col("match_id") * SLOTS
        player = F.explode(F.sequence(first, first + SLOTS - 1))
        here = self.ev.select(*ROUND, "nth").distinct().select(*ROUND, "nth", player.alias("player"))
        return here.select(*ROUND, "player", side_of(F.col("player"), F.col("nth")).alias("side"))

    @cached_property
    def economy(self) -> DataFrame:
        """What each player of a round has: the value of the equipment, armour, the class of the main weapon."""
        nth, slot = nth_round(F.col("round_num")), F.col("player") % SLOTS
        base = F.when(nth.isin(1, 13), 200).otherwise((F.col("match_id") * 7 + nth * 5 + F.when(slot < 5, 3).otherwise(0)) % 10 * 450)
        rows = self.roster.select(*ROUND, "player", "side", (base + slot % 5 * 100).cast("long").alias("equip"), ((slot + nth) % 3 > 0).alias("armour"), slot.alias("slot"), nth.alias("nth"))
        item = F.when(F.col("equip") < 1000, "pistol").when(F.col("equip") < 2500, "smg").when((F.col("slot") + F.col("nth")) % 5 == 0, "sniper").otherwise("rifle")
        return rows.select(*ROUND, "player", "side", "equip", "armour", item.alias("item"))

    @cached_property
    def bombs(self) -> DataFrame:
        """The first plant of a round and the first defusal after it."""
        plant = self._of("signup").where("side = 't' and k % 2 = 0").groupBy(*ROUND).agg(F.min(F.struct("tick", "event_seq", "player", "k")).alias("p"))
        tries = self._of("signup").where("side = 'ct' and k % 2 = 1").select(*ROUND, F.col("tick").alias("t"))
        defused = plant.join(tries, ROUND, "left").groupBy(*ROUND, "p").agg(F.min(F.when(F.col("t") > F.col("p.tick"), F.col("t"))).alias("defuse_tick"))
        return defused.select(*ROUND, F.col("p.tick").alias("plant_tick"), F.col("p.player").alias("planter"), F.when(F.col("p.k") % 4 < 2, "A").otherwise("B").alias("site"), "defuse_tick")

    @cached_property
    def splashes(self) -> DataFrame:
        """What grenades do to anyone near, of either side."""
        slot = F.col("player") % SLOTS
        hit = F.col("player") - slot + (slot + F.col("k")) % 10
        rows = self._of("signup").select(*self._at, "player", "side", hit.alias("hit"), side_of(hit, F.col("nth")).alias("hit_side"), _choice(F.col("k"), WEAPONS).alias("weapon"), F.col("value").alias("dmg"))
        return rows.where(F.col("weapon").isin("he", "fire"))

    @cached_property
    def states(self) -> DataFrame:
        """The state of each player of a round at every grid tick: as at the last own event of the match, and whether alive."""
        tick = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TICKS - GRID).cast("long"), F.lit(GRID).cast("long")))
        grid = self.roster.select(*ROUND, "player", "side", tick.alias("tick")).withColumn("at", F.col("round_num") * TICKS + F.col("tick"))
        take = ["x", "y", "z", "place", "yaw", "pitch", "weapon"]
        last = asof(grid, self.ticks.select("player", "at", "event_seq", *take), ["player"], "at", take, ["event_seq"])
        deaths = self.kills.groupBy(*ROUND, F.col("victim").alias("player")).agg(F.min("tick").alias("died"))
        slot = F.col("player") % SLOTS
        start = {"x": slot * 10.0, "y": slot * 5.0, "z": F.lit(0.0), "place": F.lit("p0"), "yaw": F.lit(0.0), "pitch": F.lit(0.0), "weapon": F.lit("pistol")}
        rows = last.join(deaths, [*ROUND, "player"], "left").select(*ROUND, "player", "side", "tick", *[F.coalesce(f"r_{c}", start[c]).alias(c) for c in take], (F.col("died").isNull() | (F.col("died") > F.col("tick"))).alias("alive"))
        return layer(self.spark, self.sf_dir, "states", lambda: rows)


def session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(spark, sf_dir)


#: The same tables in the oracle's words, to begin each query with.
ORACLE = """
WITH ev0 AS (SELECT user_id // 10 AS match_id, (extract(day FROM ts) - 1) % 30 + 1 AS nth, (extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts))::BIGINT) // 6 AS tick, event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS k, value, event_type FROM events
), ev AS (SELECT match_id::BIGINT AS match_id, (match_id * 30 + nth)::BIGINT AS round_num, nth::BIGINT AS nth, tick::BIGINT AS tick, ((match_id * 30 + nth) * 14400 + tick)::BIGINT AS "at", event_id::BIGINT AS event_seq, user_id::BIGINT AS player,
  CASE WHEN (user_id % 10 < 5) = (nth <= 12 OR nth > 24 AND ((nth - 25) // 3) % 4 IN (1, 2)) THEN 't' ELSE 'ct' END AS side, k, value, event_type FROM ev0
), w AS (SELECT *, ['rifle', 'sniper', 'smg', 'pistol', 'he', 'fire', 'knife'][(k % 7 + 1)::INT] AS weapon, match_id * 10 + CASE WHEN player % 10 < 5 THEN 5 + k % 5 ELSE k % 5 END AS foe, CASE WHEN side = 't' THEN 'ct' ELSE 't' END AS other, match_id * 10 + (player % 10 + k) % 10 AS blinded, match_id * 10 + (player % 10) // 5 * 5 + (player % 10 + 1 + k % 4) % 5 AS mate FROM ev
), kills AS (SELECT match_id, round_num, tick, event_seq, player AS attacker, side AS attacker_side, foe AS victim, other AS victim_side, weapon, (k % 3 = 0)::BIGINT AS headshot, CASE WHEN k % 4 = 1 THEN mate END AS assister, k % 8 = 1 AS flash_assist FROM w WHERE event_type = 'purchase'
), damages AS (SELECT match_id, round_num, tick, event_seq, player AS attacker, side AS attacker_side, foe AS victim, other AS victim_side, weapon, value AS dmg, (20 + k * 7 % 81)::DOUBLE AS victim_health FROM w WHERE event_type = 'click'
), blinds AS (SELECT match_id, round_num, tick, event_seq, player AS thrower, side AS thrower_side, blinded AS victim, CASE WHEN (blinded % 10 < 5) = (player % 10 < 5) THEN side ELSE other END AS victim_side, value / 100 AS duration FROM w WHERE event_type = 'view'
), shots AS (SELECT match_id, round_num, tick, event_seq, player, side, weapon, value AS x, k::DOUBLE AS y FROM w WHERE event_type = 'error'
), ticks AS (SELECT match_id, round_num, tick, event_seq, "at", player, side, value AS x, k * 5.0::DOUBLE AS y, (k % 7) * 10.0::DOUBLE AS z, 'p' || (k % 8) AS place, k * 3.6::DOUBLE AS yaw, k - 50.0::DOUBLE AS pitch, weapon FROM w
), lead_of AS (SELECT round_num, sum(CASE WHEN attacker_side = 't' THEN 1 ELSE -1 END) AS lead FROM kills GROUP BY 1
), rounds AS (SELECT e.match_id, e.round_num, e.nth, min(e.tick) AS freeze_end, max(e.tick) AS "end", CASE WHEN coalesce(any_value(l.lead), 0) >= 0 THEN 't' ELSE 'ct' END AS winner FROM ev e LEFT JOIN lead_of l USING (round_num) GROUP BY 1, 2, 3
), roster AS (SELECT match_id, round_num, match_id * 10 + i AS player, CASE WHEN (i < 5) = (nth <= 12 OR nth > 24 AND ((nth - 25) // 3) % 4 IN (1, 2)) THEN 't' ELSE 'ct' END AS side FROM (SELECT DISTINCT match_id, round_num, nth FROM ev), range(10) g(i)
), economy AS (SELECT match_id, round_num, player, side, equip, armour, CASE WHEN equip < 1000 THEN 'pistol' WHEN equip < 2500 THEN 'smg' WHEN (player % 10 + nth) % 5 = 0 THEN 'sniper' ELSE 'rifle' END AS item FROM (SELECT *, (CASE WHEN nth IN (1, 13) THEN 200 ELSE (match_id * 7 + nth * 5 + CASE WHEN player % 10 < 5 THEN 3 ELSE 0 END) % 10 * 450 END + player % 5 * 100)::BIGINT AS equip, (player % 10 + nth) % 3 > 0 AS armour FROM (SELECT *, (round_num - 1) % 30 + 1 AS nth FROM roster))
), plants AS (SELECT match_id, round_num, min((tick, event_seq, player, k)) AS p FROM ev WHERE event_type = 'signup' AND side = 't' AND k % 2 = 0 GROUP BY 1, 2
), bombs AS (SELECT q.match_id, q.round_num, q.p[1] AS plant_tick, q.p[3] AS planter, CASE WHEN q.p[4] % 4 < 2 THEN 'A' ELSE 'B' END AS site, min(e.tick) FILTER (e.tick > q.p[1]) AS defuse_tick FROM plants q LEFT JOIN ev e ON e.round_num = q.round_num AND e.event_type = 'signup' AND e.side = 'ct' AND e.k % 2 = 1 GROUP BY 1, 2, q.p
), grid AS (SELECT r.*, i * 600 AS tick, r.round_num * 14400 + i * 600 AS "at" FROM roster r, range(24) g(i)
), last_of AS (SELECT player, "at", max_by(struct_pack(x, y, z, place, yaw, pitch, weapon), event_seq) AS s FROM ticks GROUP BY 1, 2
), died_of AS (SELECT round_num, victim, min(tick) AS died FROM kills GROUP BY 1, 2
), states AS (SELECT g.match_id, g.round_num, g.player, g.side, g.tick, coalesce(l.s.x, g.player % 10 * 10.0::DOUBLE) AS x, coalesce(l.s.y, g.player % 10 * 5.0::DOUBLE) AS y, coalesce(l.s.z, 0) AS z, coalesce(l.s.place, 'p0') AS place, coalesce(l.s.yaw, 0) AS yaw, coalesce(l.s.pitch, 0) AS pitch, coalesce(l.s.weapon, 'pistol') AS weapon, d.died IS NULL OR d.died > g.tick AS alive
  FROM grid g ASOF LEFT JOIN last_of l ON g.player = l.player AND g."at" >= l."at" LEFT JOIN died_of d ON d.round_num = g.round_num AND d.victim = g.player
)
"""
