"""Where players look: samples, the usual pitch of a place, scores against the nearest enemy and the next contact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compat import ramp
from ..functions.geometry import distance, pitch_to, yaw_difference, yaw_to
from ..operators.joins import asof
from ..sources.sessions import GRID, ROUND, Session
from .combat import BY
from .registry import on_session
from .timing import nearest_foe

#: Fixed values of the metric: what pitch and yaw are good and bad, in degrees, and the weights of height and direction. Distance and window are of the sample sessions.
PITCH_GOOD, PITCH_BAD, YAW_GOOD, YAW_BAD, HEIGHT, DIRECTION = 5.0, 20.0, 10.0, 60.0, 0.4, 0.6
MOST_APART, CONTACT_WINDOW, SUPPORT = 150.0, 1200, 4
NOT_AIMED = ("he", "fire", "knife")

SAMPLES_SQL = f""", sa AS (SELECT s.* FROM states s JOIN rounds r USING (match_id, round_num) WHERE s.alive AND s.weapon NOT IN ('he', 'fire', 'knife') AND s.tick % 1200 = 0 AND s.tick BETWEEN r.freeze_end AND r."end" AND NOT EXISTS (FROM blinds b WHERE b.round_num = s.round_num AND b.victim = s.player AND b.tick <= s.tick AND s.tick < b.tick + b.duration * {GRID}))
"""


def samples(s: Session) -> DataFrame:
    """States at every second grid tick of who is alive, sees, and has something to aim with."""
    inside = s.states.where(F.col("alive") & ~F.col("weapon").isin(*NOT_AIMED) & (F.pmod("tick", F.lit(2 * GRID)) == 0)).join(s.rounds.select(*ROUND, "freeze_end", "end"), ROUND).where(F.col("tick").between(F.col("freeze_end"), F.col("end"))).drop("freeze_end", "end")
    b = s.blinds.select(*ROUND, F.col("victim").alias("player"), F.col("tick").alias("b"), "duration")
    blind = inside.join(b, BY).where((F.col("b") <= F.col("tick")) & (F.col("tick") < F.col("b") + F.col("duration") * GRID)).select(*BY, "tick").distinct()
    return inside.join(blind, [*BY, "tick"], "left_anti")


@on_session(SAMPLES_SQL + "SELECT match_id, round_num, player, count(*) AS n FROM sa GROUP BY 1, 2, 3")
def aim_samples(s: Session) -> DataFrame:
    return samples(s).groupBy(*BY).agg(F.count(F.lit(1)).alias("n"))


PITCH_SQL = SAMPLES_SQL + f""", rp AS (SELECT place, side, median(pitch) AS usual FROM sa GROUP BY 1, 2 HAVING count(*) >= {SUPPORT})
"""


def usual_pitch(s: Session) -> DataFrame:
    return samples(s).groupBy("place", "side").agg(F.median("pitch").alias("usual"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT).drop("n")


@on_session(PITCH_SQL + "SELECT place, side, round(usual, 4) AS usual FROM rp")
def reference_pitch(s: Session) -> DataFrame:
    """The median pitch at a place, where enough samples say so."""
    return usual_pitch(s).select("place", "side", F.round("usual", 4).alias("usual"))


AIM_SQL = PITCH_SQL + f""", nf AS (SELECT a.round_num, a.tick, a.player, min((sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), b.player, b.x, b.y, b.z)) AS m FROM states a JOIN states b ON a.round_num = b.round_num AND a.tick = b.tick AND a.side <> b.side WHERE a.alive AND b.alive GROUP BY 1, 2, 3),
co AS (SELECT round_num, player, tick FROM (SELECT round_num, attacker AS player, tick FROM damages UNION ALL SELECT round_num, victim, tick FROM damages)),
am AS (SELECT s.match_id, s.round_num, s.tick, s.player, s.side, n.m[2] AS foe, n.m[1] AS apart, abs(((s.yaw - degrees(atan2(n.m[4] - s.y, n.m[3] - s.x)) + 180) % 360 + 360) % 360 - 180) AS off_yaw, abs(s.pitch - rp.usual) AS off_pitch, EXISTS (FROM co c WHERE c.round_num = s.round_num AND c.player = s.player AND c.tick >= s.tick AND c.tick - s.tick <= {CONTACT_WINDOW}) AS before_contact FROM sa s JOIN nf n ON n.round_num = s.round_num AND n.tick = s.tick AND n.player = s.player LEFT JOIN rp ON rp.place = s.place AND rp.side = s.side WHERE n.m[1] <= {MOST_APART}),
ai AS (SELECT *, {HEIGHT} * CASE WHEN off_pitch IS NULL THEN 0.5 ELSE greatest(0, least(1, (off_pitch - {PITCH_BAD}) / ({PITCH_GOOD - PITCH_BAD}))) END + {DIRECTION} * greatest(0, least(1, (off_yaw - {YAW_BAD}) / ({YAW_GOOD - YAW_BAD}))) AS aim FROM am)
"""


def aims(s: Session) -> DataFrame:
    """Samples near an enemy: off the nearest one's direction and the place's usual pitch (0.5 where none is known), and whether a contact follows soon."""
    foe = nearest_foe(s).where(F.col("apart") <= MOST_APART)
    rows = samples(s).join(foe, [*BY, "tick"]).join(F.broadcast(usual_pitch(s)), ["place", "side"], "left")  # places by sides
    hits = s.damages.select(*ROUND, "tick", "event_seq", F.explode(F.array("attacker", "victim")).alias("player"))
    rows = asof(rows, hits, BY, "tick", ["event_seq"], ["event_seq"], "forward", tolerance=CONTACT_WINDOW)
    off = yaw_difference(F.col("yaw"), yaw_to(F.col("fx") - F.col("x"), F.col("fy") - F.col("y")))
    height = F.when(F.col("usual").isNull(), 0.5).otherwise(ramp(F.abs(F.col("pitch") - F.col("usual")), PITCH_BAD, PITCH_GOOD))
    return rows.withColumn("off_yaw", off).withColumn("aim", HEIGHT * height + DIRECTION * ramp(off, YAW_BAD, YAW_GOOD)).withColumn("before_contact", F.col("r_event_seq").isNotNull())


@on_session(AIM_SQL + "SELECT match_id, round_num, tick, player, foe, round(off_yaw, 4) AS off_yaw, round(aim, 4) AS aim, before_contact::BIGINT AS before_contact FROM ai")
def aim_scores(s: Session) -> DataFrame:
    return aims(s).select(*ROUND, "tick", "player", "foe", F.round("off_yaw", 4).alias("off_yaw"), F.round("aim", 4).alias("aim"), F.col("before_contact").cast("long").alias("before_contact"))


@on_session(AIM_SQL + "SELECT match_id, player, count(*) AS n, round(avg(aim), 4) AS mean, round(median(aim), 4) AS middle, round(avg(aim) FILTER (before_contact), 4) AS before_contact FROM ai GROUP BY 1, 2")
def aim_summary(s: Session) -> DataFrame:
    return aims(s).groupBy("match_id", "player").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("aim"), 4).alias("mean"), F.round(F.median("aim"), 4).alias("middle"), F.round(F.avg(F.when(F.col("before_contact"), F.col("aim"))), 4).alias("before_contact"))


@on_session(""", k AS (SELECT k.*, a.x, a.y, a.z, b.x AS vx, b.y AS vy, b.z AS vz FROM kills k JOIN states a ON a.round_num = k.round_num AND a.player = k.attacker AND a.tick = k.tick // 600 * 600 JOIN states b ON b.round_num = k.round_num AND b.player = k.victim AND b.tick = a.tick)
SELECT event_seq, round(sqrt((vx - x) ** 2 + (vy - y) ** 2), 4) AS away, round(-degrees(atan2(vz - z, sqrt((vx - x) ** 2 + (vy - y) ** 2))), 4) + 0.0 AS pitch FROM k""")
def kill_angles(s: Session) -> DataFrame:
    """How far off and how much lower a victim was."""
    t = F.floor(F.col("tick") / GRID) * GRID
    of = lambda who, p: s.states.select(*ROUND, F.col("tick").alias("t"), F.col("player").alias(who), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    k = s.kills.withColumn("t", t).join(of("attacker", "a"), [*ROUND, "attacker", "t"]).join(of("victim", "v"), [*ROUND, "victim", "t"])
    away = distance((F.col("vx"), F.col("ax")), (F.col("vy"), F.col("ay")))
    return k.select("event_seq", F.round(away, 4).alias("away"), (F.round(pitch_to(away, F.col("vz") - F.col("az")), 4) + 0.0).alias("pitch"))
