"""Mistakes: candidates with the first reason, in order, why they don't count; how bad they are; what is above the normal.

Who sees whom goes by the angle between view and direction at the ticks of the grid; walls have no data here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import nearest_quantiles
from ..functions.geometry import distance, yaw_difference, yaw_to
from ..operators.joins import asof, retaliation
from ..sources.sessions import GRID, ROUND, Session, layer
from .chances import DELTAS_SQL, deltas
from .combat import TRADE_WINDOW, opening
from .economy import BUYS_SQL, buys
from .registry import on_session

#: Windows and thresholds, in the units of the sample sessions: fixed values.
DUEL, SIGHT, NEAR, RETREAT, SEEN, WON, LOST = 1200, 53.0, 60.0, 64.0, 2, 0.95, 0.05
TEAM_SECONDS, ONE_FLASH, LEAST_FLASH, TEAM_DAMAGE = 2.0, 0.9, 0.2, 20.0
UNARMED = ("he", "fire", "knife")


# ---- what every mistake is held against

CONTEXT_SQL = DELTAS_SQL + BUYS_SQL + f""", eco AS (SELECT round_num, side FROM buys WHERE class IN ('eco', 'pistol') GROUP BY 1, 2 HAVING sum(weight) >= 0.5),
av AS (SELECT DISTINCT a.event_seq FROM kills a JOIN kills b ON a.round_num = b.round_num AND b.victim = a.attacker AND b.attacker_side = a.victim_side AND b.tick > a.tick AND b.tick - a.tick <= {TRADE_WINDOW}),
ch AS (SELECT round_num, tick, max_by(p_after, event_seq) AS p FROM dl GROUP BY 1, 2)
"""


def _round_filter_sql(alias: str, player_side: str) -> str:
    """Of rows with round_num and tick."""
    p = f"coalesce((SELECT max_by(c.p, c.tick) FROM ch c WHERE c.round_num = {alias}.round_num AND c.tick < {alias}.tick), 0.5)"
    mine = f"CASE WHEN {player_side} = 't' THEN {p} ELSE 1 - {p} END"
    return f"""CASE WHEN EXISTS (FROM eco WHERE eco.round_num = {alias}.round_num AND eco.side = {player_side}) THEN 'economy' WHEN EXISTS (FROM bombs q JOIN rounds z USING (round_num) WHERE q.round_num = {alias}.round_num AND q.plant_tick <= {alias}.tick AND z.winner <> {player_side}) THEN 'saving'
 WHEN {alias}.tick > (SELECT z."end" FROM rounds z WHERE z.round_num = {alias}.round_num) THEN 'after the end' WHEN {mine} > {WON} OR {mine} < {LOST} THEN 'decided' END"""


def with_round_filter(s: Session, rows: DataFrame, side: str, name: str = "excused") -> DataFrame:
    """rows (round, tick, event_seq, a side's column) with the first reason of the round: economy, saving, after the end, decided."""
    poor = buys(s).where(F.col("class").isin("eco", "pistol")).groupBy(*ROUND, F.col("side").alias(side)).agg(F.sum("weight").alias("_poor"))
    chances = deltas(s).groupBy(*ROUND, "tick").agg(F.max_by("p_after", "event_seq").alias("_p"))
    out = asof(rows, chances, ROUND, "tick", ["_p"], direction="backward", exact=False)
    out = out.join(poor, [*ROUND, side], "left").join(s.bombs.select(*ROUND, "plant_tick"), ROUND, "left").join(s.rounds.select(*ROUND, "winner", F.col("end").alias("_end")), ROUND)
    p = F.coalesce("r__p", F.lit(0.5))
    mine = F.when(F.col(side) == "t", p).otherwise(1 - p)
    reason = F.when(F.col("_poor") >= 0.5, "economy").when((F.col("plant_tick") <= F.col("tick")) & (F.col("winner") != F.col(side)), "saving").when(F.col("tick") > F.col("_end"), "after the end").when((mine > WON) | (mine < LOST), "decided")
    return out.select(*rows.columns, reason.alias(name))


def avenged(s: Session) -> DataFrame:
    return retaliation(s.kills, ROUND, TRADE_WINDOW).select(F.col("first_match_id").alias("match_id"), F.col("first_round_num").alias("round_num"), F.col("first_event_seq").alias("event_seq")).distinct()


def first(*reasons: Column) -> Column:
    return F.coalesce(*reasons)


# ---- mates of who dies unavenged

MATES_SQL = CONTEXT_SQL + f""", fdt AS (SELECT round_num, victim AS player, min(tick) AS died FROM kills GROUP BY 1, 2),
cm AS (SELECT k.match_id, k.round_num, k.event_seq, k.tick, k.victim, k.attacker, k.victim_side AS side, o.player AS mate FROM kills k JOIN roster o ON o.round_num = k.round_num AND o.side = k.victim_side AND o.player <> k.victim LEFT JOIN fdt f ON f.round_num = k.round_num AND f.player = o.player WHERE (f.died IS NULL OR f.died > k.tick)),
vs AS (SELECT c.event_seq, c.mate, a.tick, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS apart, abs(((a.yaw - degrees(atan2(b.y - a.y, b.x - a.x)) + 180) % 360 + 360) % 360 - 180) <= {SIGHT} AS seen FROM cm c JOIN states a ON a.round_num = c.round_num AND a.player = c.mate AND a.tick > c.tick AND a.tick <= c.tick + {TRADE_WINDOW} AND a.alive JOIN states b ON b.round_num = c.round_num AND b.player = c.attacker AND b.tick = a.tick AND b.alive),
vf AS (SELECT event_seq, mate, count(*) FILTER (seen) AS seen, min(tick) FILTER (seen) AS first_seen FROM vs GROUP BY 1, 2), vr AS (SELECT v.event_seq, v.mate, max_by(v.apart, v.tick) - min_by(v.apart, v.tick) AS retreat FROM vs v JOIN vf USING (event_seq, mate) WHERE v.tick >= vf.first_seen GROUP BY 1, 2),
fx AS (SELECT c.*, coalesce(vf.seen, 0) AS seen, vr.retreat, EXISTS (FROM blinds b WHERE b.round_num = c.round_num AND b.victim = c.mate AND b.tick <= c.tick AND c.tick < b.tick + b.duration * {GRID}) AS blind,
 EXISTS (FROM damages d WHERE d.round_num = c.round_num AND (d.attacker = c.mate OR d.victim = c.mate) AND d.tick > c.tick - {DUEL} AND d.tick <= c.tick) AS duel, (SELECT max_by(x.weapon, x.tick) FROM states x WHERE x.round_num = c.round_num AND x.player = c.mate AND x.tick <= c.tick) IN ('he', 'fire', 'knife') AS unarmed,
 EXISTS (FROM shots h WHERE h.round_num = c.round_num AND h.player = c.mate AND h.tick > c.tick AND h.tick <= c.tick + {TRADE_WINDOW}) AS shot, coalesce((SELECT sum(d.dmg) FROM damages d WHERE d.round_num = c.round_num AND d.attacker = c.mate AND d.victim = c.attacker AND d.tick > c.tick AND d.tick <= c.tick + {TRADE_WINDOW}), 0) AS hurt, f.died AS mate_died, c.event_seq IN (FROM av) AS avenged
 FROM cm c LEFT JOIN vf USING (event_seq, mate) LEFT JOIN vr USING (event_seq, mate) LEFT JOIN fdt f ON f.round_num = c.round_num AND f.player = c.mate),
fr AS (SELECT *, {_round_filter_sql("fx", "fx.side")} AS of_round, shot OR hurt > 0 OR (seen > 0 AND -coalesce(retreat, 0) >= {RETREAT}) AS engaged FROM fx),
nt AS (SELECT *, coalesce(of_round, CASE WHEN blind THEN 'blind' WHEN duel THEN 'in a duel' WHEN unarmed THEN 'unarmed' WHEN seen = 0 THEN 'not in sight' WHEN seen < {SEEN} THEN 'in sight too short' WHEN engaged THEN 'engaged' END) AS excused FROM fr WHERE NOT avenged)
"""


def mates(s: Session) -> DataFrame:
    """For each death and each living mate what the mate saw and did in the window after it, and the round's reason; written once."""
    return layer(s.spark, s.sf_dir, "mates", lambda: _mates(s))


def _mates(s: Session) -> DataFrame:
    died = s.kills.groupBy(*ROUND, F.col("victim").alias("mate")).agg(F.min("tick").alias("mate_died"))
    cases = s.kills.select(*ROUND, "event_seq", "tick", "victim", "attacker", F.col("victim_side").alias("side"))
    cases = cases.join(s.roster.withColumnRenamed("player", "mate"), [*ROUND, "side"]).where("mate <> victim").join(died, [*ROUND, "mate"], "left").where("mate_died is null or mate_died > tick")
    key = [*ROUND, "event_seq", "mate"]
    at = s.states.where("alive").select(*ROUND, F.col("tick").alias("t"), F.col("player").alias("mate"), "x", "y", "yaw")
    foe = s.states.where("alive").select(*ROUND, F.col("tick").alias("t"), F.col("player").alias("attacker"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    # the grid ticks of the window are equal keys, so that a mate's states of other times never meet the case
    ticks = F.explode(F.sequence(F.floor(F.col("tick") / GRID) * GRID + GRID, F.floor((F.col("tick") + TRADE_WINDOW) / GRID) * GRID, F.lit(GRID).cast("long")))
    seen = cases.withColumn("t", ticks).join(at, [*ROUND, "mate", "t"]).join(foe, [*ROUND, "attacker", "t"])
    sight = yaw_difference(F.col("yaw"), yaw_to(F.col("fx") - F.col("x"), F.col("fy") - F.col("y"))) <= SIGHT
    seen = seen.select(*key, "t", distance((F.col("x"), F.col("fx")), (F.col("y"), F.col("fy"))).alias("apart"), sight.alias("sight")).withColumn("since", F.min(F.when(F.col("sight"), F.col("t"))).over(Window.partitionBy(*key)))
    later = F.col("t") >= F.col("since")
    seen = seen.groupBy(*key).agg(F.count_if("sight").alias("seen"), (F.max_by(F.when(later, F.col("apart")), F.when(later, F.col("t"))) - F.min_by(F.when(later, F.col("apart")), F.when(later, F.col("t")))).alias("retreat"))
    flag = lambda df, on, name: cases.join(df, [*ROUND, "mate"]).where(on).select(*key).distinct().withColumn(name, F.lit(True))
    blind = flag(s.blinds.select(*ROUND, F.col("victim").alias("mate"), F.col("tick").alias("b"), "duration"), (F.col("b") <= F.col("tick")) & (F.col("tick") < F.col("b") + F.col("duration") * GRID), "blind")
    hits = s.damages.select(*ROUND, F.explode(F.array("attacker", "victim")).alias("mate"), F.col("tick").alias("b"))
    duel = flag(hits, (F.col("b") > F.col("tick") - DUEL) & (F.col("b") <= F.col("tick")), "duel")
    shot = flag(s.shots.select(*ROUND, F.col("player").alias("mate"), F.col("tick").alias("b")), (F.col("b") > F.col("tick")) & (F.col("b") <= F.col("tick") + TRADE_WINDOW), "shot")
    dealt = s.damages.select(*ROUND, F.col("attacker").alias("mate"), F.col("victim").alias("attacker"), F.col("tick").alias("b"), "dmg")
    hurt = cases.join(dealt, [*ROUND, "mate", "attacker"]).where((F.col("b") > F.col("tick")) & (F.col("b") <= F.col("tick") + TRADE_WINDOW)).groupBy(*key).agg(F.sum("dmg").alias("hurt"))
    held = s.states.select(*ROUND, F.col("player").alias("mate"), F.col("tick").alias("t"), "weapon")
    unarmed = cases.withColumn("t", F.floor(F.col("tick") / GRID) * GRID).join(held, [*ROUND, "mate", "t"], "left").select(*key, F.col("weapon").isin(*UNARMED).alias("unarmed"))
    rows = cases
    for part in (seen, blind, duel, shot, hurt, unarmed):
        rows = rows.join(part, key, "left")
    rows = rows.join(avenged(s).withColumn("avenged", F.lit(True)), [*ROUND, "event_seq"], "left").na.fill(False, ["blind", "duel", "shot", "avenged", "unarmed"]).na.fill(0, ["seen"]).na.fill(0.0, ["hurt"])
    rows = with_round_filter(s, rows, "side", "of_round")
    return rows.withColumn("engaged", F.col("shot") | (F.col("hurt") > 0) | ((F.col("seen") > 0) & (-F.coalesce("retreat", F.lit(0.0)) >= RETREAT)))


def untraded(s: Session) -> DataFrame:
    reasons = F.when(F.col("blind"), "blind").when(F.col("duel"), "in a duel").when(F.col("unarmed"), "unarmed").when(F.col("seen") == 0, "not in sight").when(F.col("seen") < SEEN, "in sight too short").when(F.col("engaged"), "engaged")
    return mates(s).where("not avenged").withColumn("excused", first(F.col("of_round"), reasons))


@on_session(MATES_SQL + "SELECT match_id, round_num, event_seq, mate AS player, seen, round(retreat, 4) AS retreat, excused FROM nt")
def did_not_trade(s: Session) -> DataFrame:
    """Living mates of who died unavenged, with the first reason why it isn't their mistake."""
    return untraded(s).select(*ROUND, "event_seq", F.col("mate").alias("player"), "seen", F.round("retreat", 4).alias("retreat"), "excused")


@on_session(MATES_SQL + f"SELECT match_id, round_num, event_seq, mate AS player, coalesce(excused, CASE WHEN coalesce(retreat, 0) < {RETREAT} THEN 'did not retreat' END) AS excused FROM nt")
def possible_baits(s: Session) -> DataFrame:
    """The same, of those who went away from the killer they saw."""
    away = F.when(F.coalesce("retreat", F.lit(0.0)) < RETREAT, "did not retreat")
    return untraded(s).select(*ROUND, "event_seq", F.col("mate").alias("player"), first(F.col("excused"), away).alias("excused"))


LOST_SQL = MATES_SQL + f""", lt AS (SELECT f.* FROM fr f WHERE f.mate_died > f.tick AND f.mate_died <= f.tick + {TRADE_WINDOW} AND NOT EXISTS (FROM kills k WHERE k.round_num = f.round_num AND k.attacker = f.mate AND k.victim = f.attacker AND k.tick > f.tick AND k.tick <= f.tick + {TRADE_WINDOW}))
"""


@on_session(LOST_SQL + """, od AS (SELECT round_num, victim, tick, min(event_seq) AS event_seq FROM kills GROUP BY 1, 2, 3)
SELECT l.match_id, l.round_num, l.event_seq, l.mate AS player, coalesce(l.of_round, CASE WHEN od.event_seq IN (FROM av) THEN 'avenged' WHEN NOT l.engaged THEN 'did not engage' END) AS excused FROM lt l JOIN od ON od.round_num = l.round_num AND od.victim = l.mate AND od.tick = l.mate_died""")
def lost_trades(s: Session) -> DataFrame:
    """Mates who went for the killer and died in the window without killing that one."""
    m = mates(s).where((F.col("mate_died") > F.col("tick")) & (F.col("mate_died") <= F.col("tick") + TRADE_WINDOW))
    done = s.kills.select(*ROUND, F.col("attacker").alias("mate"), F.col("victim").alias("attacker"), F.col("tick").alias("b"))
    won = m.join(done, [*ROUND, "mate", "attacker"]).where((F.col("b") > F.col("tick")) & (F.col("b") <= F.col("tick") + TRADE_WINDOW)).select(*ROUND, "event_seq", "mate").distinct()
    own = s.kills.groupBy(*ROUND, F.col("victim").alias("mate"), F.col("tick").alias("mate_died")).agg(F.min("event_seq").alias("own_seq"))
    later = avenged(s).select(*ROUND, F.col("event_seq").alias("own_seq"), F.lit(True).alias("own_avenged"))
    rows = m.join(won, [*ROUND, "event_seq", "mate"], "left_anti").join(own, [*ROUND, "mate", "mate_died"]).join(later, [*ROUND, "own_seq"], "left")
    return rows.select(*ROUND, "event_seq", F.col("mate").alias("player"), first(F.col("of_round"), F.when(F.col("own_avenged"), "avenged").when(~F.col("engaged"), "did not engage")).alias("excused"))


# ---- deaths

NEAR_SQL = MATES_SQL + f""", ps AS (SELECT k.event_seq, min(sqrt((v.x - m.x) ** 2 + (v.y - m.y) ** 2)) AS near FROM cm k JOIN states v ON v.round_num = k.round_num AND v.player = k.victim AND v.tick = k.tick // {GRID} * {GRID} JOIN states m ON m.round_num = k.round_num AND m.player = k.mate AND m.tick = v.tick GROUP BY 1),
ld AS (SELECT k.match_id, k.round_num, k.event_seq, k.tick, k.victim AS player, k.victim_side AS side, ps.near, coalesce((SELECT max(seen) FROM fx WHERE fx.event_seq = k.event_seq), 0) AS seen FROM kills k LEFT JOIN ps USING (event_seq) WHERE k.event_seq NOT IN (FROM av)),
ln AS (SELECT *, coalesce({_round_filter_sql("ld", "ld.side")}, CASE WHEN near IS NULL THEN 'last alive' WHEN near <= {NEAR} OR seen >= {SEEN} THEN 'mate near or saw the killer' END) AS excused FROM ld)
"""


def alone(s: Session) -> DataFrame:
    """Unavenged deaths, with the distance to the nearest living mate at the grid tick before it and the most that one saw of the killer."""
    m = mates(s)
    t = F.floor(F.col("tick") / GRID) * GRID
    v = s.states.select(*ROUND, F.col("tick").alias("t"), F.col("player").alias("victim"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    a = s.states.select(*ROUND, F.col("tick").alias("t"), F.col("player").alias("mate"), "x", "y")
    near = m.withColumn("t", t).join(v, [*ROUND, "t", "victim"]).join(a, [*ROUND, "t", "mate"]).groupBy(*ROUND, "event_seq").agg(F.min(distance((F.col("x"), F.col("vx")), (F.col("y"), F.col("vy")))).alias("near"), F.max("seen").alias("seen"))
    rows = s.kills.join(avenged(s), [*ROUND, "event_seq"], "left_anti").select(*ROUND, "event_seq", "tick", F.col("victim").alias("player"), F.col("victim_side").alias("side")).join(near, [*ROUND, "event_seq"], "left")
    helped = F.when(F.col("near").isNull(), "last alive").when((F.col("near") <= NEAR) | (F.col("seen") >= SEEN), "mate near or saw the killer")
    return with_round_filter(s, rows, "side", "of_round").withColumn("excused", first(F.col("of_round"), helped))


@on_session(NEAR_SQL + "SELECT match_id, round_num, event_seq, player, round(near, 4) AS near, excused, CASE WHEN excused IS NULL THEN CASE WHEN near > 200 THEN 'high' WHEN near > 100 THEN 'middle' ELSE 'low' END END AS severity FROM ln")
def lonely_deaths(s: Session) -> DataFrame:
    """Unavenged deaths with no mate near who could see the killer; how bad goes by the distance."""
    level = F.when(F.col("near") > 200, "high").when(F.col("near") > 100, "middle").otherwise("low")
    return alone(s).select(*ROUND, "event_seq", "player", F.round("near", 4).alias("near"), "excused", F.when(F.col("excused").isNull(), level).alias("severity"))


@on_session(CONTEXT_SQL + f", op AS (SELECT match_id, round_num, event_seq, tick, victim AS player, victim_side AS side FROM (SELECT *, row_number() OVER (PARTITION BY round_num ORDER BY tick, event_seq) AS n FROM kills) WHERE n = 1 AND event_seq NOT IN (FROM av)) SELECT match_id, round_num, event_seq, player, {_round_filter_sql('op', 'op.side')} AS excused FROM op")
def untraded_openings(s: Session) -> DataFrame:
    """First deaths of a round that aren't avenged."""
    rows = opening(s).join(avenged(s), [*ROUND, "event_seq"], "left_anti").select(*ROUND, "event_seq", "tick", F.col("victim").alias("player"), F.col("victim_side").alias("side"))
    return with_round_filter(s, rows, "side").select(*ROUND, "event_seq", "player", "excused")


# ---- against the own side

FLASH_SQL = CONTEXT_SQL + f""", tf AS (SELECT match_id, round_num, tick, thrower AS player, thrower_side AS side, min(event_seq) AS event_seq, sum(duration) AS value FROM blinds WHERE thrower_side = victim_side AND thrower <> victim GROUP BY ALL), tg AS (SELECT *, {_round_filter_sql("tf", "tf.side")} AS of_round FROM tf),
th AS (SELECT *, coalesce(sum(value) FILTER (of_round IS NULL) OVER (PARTITION BY match_id, player, side), 0) AS total FROM tg)
"""


def over_limit(rows: DataFrame, total: float, single: float | None, least: float) -> DataFrame:
    """rows (player, side, value, of_round) with what the side's sum is, and the first reason: the round's, below the limits, too little in itself.

    The sum is of what the round does not excuse. Below its limit a row counts only beyond the limit of one.
    """
    w = Window.partitionBy("match_id", "player", "side")
    rows = rows.withColumn("total", F.coalesce(F.sum(F.when(F.col("of_round").isNull(), F.col("value"))).over(w), F.lit(0.0)))
    below = (F.col("total") <= total) & ((F.col("value") <= single) if single is not None else F.lit(True))
    return rows.withColumn("excused", first(F.col("of_round"), F.when(below, "below the limit"), F.when(F.col("value") < least, "too little")))


@on_session(FLASH_SQL + f"SELECT match_id, round_num, event_seq, player, side, round(value, 4) AS value, round(total, 4) AS total, coalesce(of_round, CASE WHEN total <= {TEAM_SECONDS} AND value <= {ONE_FLASH} THEN 'below the limit' WHEN value < {LEAST_FLASH} THEN 'too little' END) AS excused FROM th")
def team_flashes(s: Session) -> DataFrame:
    """Flashes that blind the own side, by the seconds of one and of all of a player's on that side."""
    rows = s.blinds.where("thrower_side = victim_side and thrower <> victim").groupBy(*ROUND, "tick", F.col("thrower").alias("player"), F.col("thrower_side").alias("side")).agg(F.min("event_seq").alias("event_seq"), F.sum("duration").alias("value"))
    return over_limit(with_round_filter(s, rows, "side", "of_round"), TEAM_SECONDS, ONE_FLASH, LEAST_FLASH).select(*ROUND, "event_seq", "player", "side", F.round("value", 4).alias("value"), F.round("total", 4).alias("total"), "excused")


UTILITY_SQL = CONTEXT_SQL + f""", hg AS (SELECT match_id, round_num, tick, event_seq, player, side, blinded AS hit, CASE WHEN (blinded % 10 < 5) = (player % 10 < 5) THEN side ELSE other END AS hit_side, weapon, value AS dmg FROM w WHERE event_type = 'signup' AND weapon IN ('he', 'fire')),
tf AS (SELECT match_id, round_num, min(tick) AS tick, player, side, weapon, min(event_seq) AS event_seq, sum(dmg) AS value FROM hg WHERE hit_side = side AND hit <> player GROUP BY match_id, round_num, player, side, weapon, CASE WHEN weapon = 'he' THEN tick END), tg AS (SELECT *, {_round_filter_sql("tf", "tf.side")} AS of_round FROM tf),
th AS (SELECT *, coalesce(sum(value) FILTER (of_round IS NULL) OVER (PARTITION BY match_id, player, side), 0) AS total FROM tg)
"""


@on_session(UTILITY_SQL + f"SELECT match_id, round_num, event_seq, player, side, weapon, round(value, 4) AS value, round(total, 4) AS total, coalesce(of_round, CASE WHEN total <= {TEAM_DAMAGE} THEN 'below the limit' WHEN value < 0.01 THEN 'too little' END) AS excused FROM th")
def team_utility_damage(s: Session) -> DataFrame:
    """Grenades that hurt the own side: an explosion by its tick, a fire once a round."""
    rows = s.splashes.where("hit_side = side and hit <> player").groupBy(*ROUND, "player", "side", "weapon", F.when(F.col("weapon") == "he", F.col("tick")).alias("one")).agg(F.min("tick").alias("tick"), F.min("event_seq").alias("event_seq"), F.sum("dmg").alias("value")).drop("one")
    return over_limit(with_round_filter(s, rows, "side", "of_round"), TEAM_DAMAGE, None, 0.01).select(*ROUND, "event_seq", "player", "side", "weapon", F.round("value", 4).alias("value"), F.round("total", 4).alias("total"), "excused")


# ---- all of them

ALL_SQL = NEAR_SQL + f""", tf AS (SELECT match_id, round_num, tick, thrower AS player, thrower_side AS side, min(event_seq) AS event_seq, sum(duration) AS value FROM blinds WHERE thrower_side = victim_side AND thrower <> victim GROUP BY ALL), tg AS (SELECT *, {_round_filter_sql("tf", "tf.side")} AS of_round FROM tf), th AS (SELECT *, coalesce(sum(value) FILTER (of_round IS NULL) OVER (PARTITION BY match_id, player, side), 0) AS total FROM tg),
oc AS (SELECT 'did not trade' AS kind, match_id, round_num, event_seq, mate AS player, side, excused FROM nt UNION ALL SELECT 'died alone', match_id, round_num, event_seq, player, side, excused FROM ln UNION ALL SELECT 'flashed the team', match_id, round_num, event_seq, player, side, coalesce(of_round, CASE WHEN total <= {TEAM_SECONDS} AND value <= {ONE_FLASH} THEN 'below the limit' WHEN value < {LEAST_FLASH} THEN 'too little' END) FROM th)
"""


def occurrences(s: Session) -> DataFrame:
    """(kind, match_id, round_num, event_seq, player, side, excused) of the mistakes of several kinds; written once."""
    return layer(s.spark, s.sf_dir, "occurrences", lambda: _occurrences(s), ["match_id", "round_num", "event_seq"])


def _occurrences(s: Session) -> DataFrame:
    cols = [*ROUND, "event_seq", "player", "side", "excused"]
    rows = s.blinds.where("thrower_side = victim_side and thrower <> victim").groupBy(*ROUND, "tick", F.col("thrower").alias("player"), F.col("thrower_side").alias("side")).agg(F.min("event_seq").alias("event_seq"), F.sum("duration").alias("value"))
    flashes = over_limit(with_round_filter(s, rows, "side", "of_round"), TEAM_SECONDS, ONE_FLASH, LEAST_FLASH)
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), *cols)
    return named(untraded(s).withColumnRenamed("mate", "player"), "did not trade").unionByName(named(alone(s), "died alone")).unionByName(named(flashes, "flashed the team"))


@on_session(ALL_SQL + "SELECT kind, match_id, round_num, event_seq, player, side, row_number() OVER (PARTITION BY match_id, player ORDER BY round_num, event_seq, kind, side) AS nth FROM oc WHERE excused IS NULL")
def all_mistakes(s: Session) -> DataFrame:
    """What counts of all kinds, in the order of the match for each player."""
    w = Window.partitionBy("match_id", "player").orderBy("round_num", "event_seq", "kind", "side")
    return occurrences(s).where("excused is null").drop("excused").withColumn("nth", F.row_number().over(w).cast("long"))


@on_session(ALL_SQL + """, ct AS (SELECT kind, match_id, player, side, CASE WHEN player % 5 = 0 THEN 'first' ELSE 'other' END AS role, count(*) AS n FROM oc WHERE excused IS NULL GROUP BY ALL), cells AS (SELECT kind, side, role, list(n ORDER BY n) AS v FROM ct GROUP BY ALL), sides AS (SELECT kind, side, list(n ORDER BY n) AS v FROM ct GROUP BY ALL)
SELECT ct.kind, ct.match_id, ct.player, ct.side, ct.n, CASE WHEN len(c.v) >= 20 THEN 'role' ELSE 'side' END AS scope, CASE WHEN len(c.v) >= 20 THEN c.v[round_even((len(c.v) - 1) * 0.75, 0)::INT + 1] ELSE d.v[round_even((len(d.v) - 1) * 0.75, 0)::INT + 1] END AS normal, (ct.n >= 2 AND ct.n > CASE WHEN len(c.v) >= 20 THEN c.v[round_even((len(c.v) - 1) * 0.75, 0)::INT + 1] ELSE d.v[round_even((len(d.v) - 1) * 0.75, 0)::INT + 1] END)::BIGINT AS above
FROM ct JOIN cells c USING (kind, side, role) JOIN sides d USING (kind, side)""")
def above_normal(s: Session) -> DataFrame:
    """Players with more mistakes of a kind on a side than three quarters of those of their role there, or of the side if the role has few."""
    ct = occurrences(s).where("excused is null").withColumn("role", F.when(F.col("player") % 5 == 0, "first").otherwise("other")).groupBy("kind", "match_id", "player", "side", "role").agg(F.count(F.lit(1)).alias("n"))
    of = lambda keys, name: nearest_quantiles(ct, keys, "n", [0.75]).select(*keys, F.col("value").alias(name)).join(ct.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_n")), keys)
    rows = ct.join(of(["kind", "side", "role"], "fine"), ["kind", "side", "role"]).join(of(["kind", "side"], "coarse"), ["kind", "side"])
    enough = F.col("fine_n") >= 20
    normal = F.when(enough, F.col("fine")).otherwise(F.col("coarse"))
    return rows.select("kind", "match_id", "player", "side", "n", F.when(enough, "role").otherwise("side").alias("scope"), normal.alias("normal"), ((F.col("n") >= 2) & (F.col("n") > normal)).cast("long").alias("above"))


@on_session(CONTEXT_SQL + f", c AS (SELECT k.match_id, k.attacker AS player, k.attacker_side AS side, count(*) AS kills, count(*) FILTER (k.event_seq IN (SELECT b.event_seq FROM kills a JOIN kills b ON a.round_num = b.round_num AND b.victim = a.attacker AND b.attacker_side = a.victim_side AND b.tick > a.tick AND b.tick - a.tick <= {TRADE_WINDOW})) AS traded FROM kills k GROUP BY 1, 2, 3), n AS (SELECT match_id, player, side, count(*) AS rounds FROM roster GROUP BY 1, 2, 3) SELECT n.match_id, n.player, n.side, rounds, coalesce(kills, 0) AS kills, coalesce(traded, 0) AS traded, round(coalesce(traded, 0) / rounds, 5) AS per_round, (rounds < 8)::BIGINT AS weak FROM n LEFT JOIN c USING (match_id, player, side)")
def side_strengths(s: Session) -> DataFrame:
    """Numerators and denominators of a player on either side by itself."""
    trade = retaliation(s.kills, ROUND, TRADE_WINDOW).select(F.col("then_match_id").alias("match_id"), F.col("then_round_num").alias("round_num"), F.col("then_event_seq").alias("event_seq")).distinct().withColumn("trade", F.lit(1))
    c = s.kills.join(trade, [*ROUND, "event_seq"], "left").groupBy("match_id", F.col("attacker").alias("player"), F.col("attacker_side").alias("side")).agg(F.count(F.lit(1)).alias("kills"), F.count("trade").alias("traded"))
    n = s.roster.groupBy("match_id", "player", "side").agg(F.count(F.lit(1)).alias("rounds"))
    rows = n.join(c, ["match_id", "player", "side"], "left").na.fill(0, ["kills", "traded"])
    return rows.select("match_id", "player", "side", "rounds", "kills", "traded", F.round(F.col("traded") / F.col("rounds"), 5).alias("per_round"), (F.col("rounds") < 8).cast("long").alias("weak"))

