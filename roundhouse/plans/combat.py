"""Damage, kills, trades, participation, utility and openings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import first_by, ratio, ratio_or_zero, sum_or_zero, total_if
from ..operators.joins import retaliation, within_after
from ..operators.sequences import capped
from ..sources.sessions import ROUND, Session
from .registry import on_session

#: Seconds in which a death is avenged, and after a blinding in which a kill is assisted by it. The sample rounds take hours.
TRADE_WINDOW = 1800
FLASH_GRACE = 900
UTILITY = ("he", "fire")
BY = [*ROUND, "player"]


def enemy(df: DataFrame, a: str = "attacker_side", b: str = "victim_side") -> DataFrame:
    return df.where(F.col(a) != F.col(b))


@on_session("""SELECT r.match_id, r.player, round(coalesce(sum(d.dmg), 0), 4) AS damage, count(DISTINCT r.round_num) AS rounds, round(coalesce(sum(d.dmg), 0) / count(DISTINCT r.round_num), 4) AS adr
FROM roster r LEFT JOIN (SELECT match_id, round_num, attacker, sum(dmg) AS dmg FROM damages WHERE attacker_side <> victim_side GROUP BY ALL) d ON r.round_num = d.round_num AND r.player = d.attacker GROUP BY 1, 2""")
def damage_per_round(s: Session) -> DataFrame:
    dealt = enemy(s.damages).groupBy(*ROUND, F.col("attacker").alias("player")).agg(F.sum("dmg").alias("dmg"))
    total = s.roster.join(dealt, BY, "left").groupBy("match_id", "player").agg(sum_or_zero("dmg").alias("total"), F.count(F.lit(1)).alias("rounds"))
    return total.select("match_id", "player", F.round("total", 4).alias("damage"), "rounds", F.round(ratio("total", "rounds"), 4).alias("adr"))


@on_session("""SELECT r.match_id, r.round_num, r.player, round(coalesce(sum(d.dmg), 0), 4) AS utility_damage FROM roster r
LEFT JOIN damages d ON r.round_num = d.round_num AND r.player = d.attacker AND d.attacker_side <> d.victim_side AND d.weapon IN ('he', 'fire') GROUP BY 1, 2, 3""")
def utility_damage(s: Session) -> DataFrame:
    dealt = enemy(s.damages).where(F.col("weapon").isin(*UTILITY)).groupBy(*ROUND, F.col("attacker").alias("player")).agg(F.sum("dmg").alias("dmg"))
    return s.roster.join(dealt, BY, "left").select(*BY, F.round(F.coalesce("dmg", F.lit(0.0)), 4).alias("utility_damage"))


@on_session("""SELECT match_id, round_num, victim, tick, round(sum(greatest(least(upto, victim_health) - least(upto - dmg, victim_health), 0)), 4) AS credited, round(sum(dmg), 4) AS raw FROM (
SELECT *, sum(dmg) OVER (PARTITION BY match_id, round_num, victim, tick ORDER BY event_seq ROWS UNBOUNDED PRECEDING) AS upto FROM damages) GROUP BY 1, 2, 3, 4""")
def damage_cap(s: Session) -> DataFrame:
    """What a tick's hits took of a victim's health: no more than there was before it."""
    rows = capped(s.damages, [*ROUND, "victim", "tick"], ["event_seq"], "dmg", F.col("victim_health"), "credited")
    return rows.groupBy(*ROUND, "victim", "tick").agg(F.round(F.sum("credited"), 4).alias("credited"), F.round(F.sum("dmg"), 4).alias("raw"))


@on_session("""SELECT a.match_id, a.round_num, a.event_seq AS first_seq, b.event_seq AS then_seq, a.attacker AS avenged_on, b.attacker AS avenger, a.victim AS avenged, b.tick - a.tick AS gap FROM kills a
JOIN kills b ON a.round_num = b.round_num AND b.victim = a.attacker AND b.attacker_side = a.victim_side AND b.tick > a.tick AND b.tick - a.tick <= 1800""")
def trade_pairs(s: Session) -> DataFrame:
    t = retaliation(s.kills, ROUND, TRADE_WINDOW)
    return t.select(F.col("first_match_id").alias("match_id"), F.col("first_round_num").alias("round_num"), F.col("first_event_seq").alias("first_seq"), F.col("then_event_seq").alias("then_seq"), F.col("first_attacker").alias("avenged_on"), F.col("then_attacker").alias("avenger"), F.col("first_victim").alias("avenged"), (F.col("then_tick") - F.col("first_tick")).alias("gap"))


def trades(s: Session) -> DataFrame:
    """(match_id, round_num, avenged, avenger, then_seq)"""
    return retaliation(s.kills, ROUND, TRADE_WINDOW).select(F.col("first_match_id").alias("match_id"), F.col("first_round_num").alias("round_num"), F.col("first_victim").alias("avenged"), F.col("then_attacker").alias("avenger"), F.col("then_event_seq").alias("event_seq"))


@on_session(""", t AS (SELECT DISTINCT b.event_seq FROM kills a JOIN kills b ON a.round_num = b.round_num AND b.victim = a.attacker AND b.attacker_side = a.victim_side AND b.tick > a.tick AND b.tick - a.tick <= 1800)
SELECT k.match_id, k.attacker AS player, count(*) AS kills, count(t.event_seq) AS trade_kills, round(100.0 * count(t.event_seq) / count(*), 4) AS trade_pct FROM kills k LEFT JOIN t USING (event_seq) GROUP BY 1, 2""")
def trade_kills(s: Session) -> DataFrame:
    flagged = s.kills.join(trades(s).select("event_seq", F.lit(1).alias("trade")).distinct(), "event_seq", "left")
    out = flagged.groupBy("match_id", F.col("attacker").alias("player")).agg(F.count(F.lit(1)).alias("kills"), F.count("trade").alias("trade_kills"))
    return out.withColumn("trade_pct", F.round(ratio_or_zero("trade_kills", "kills", 100.0), 4))


def participation(s: Session) -> DataFrame:
    """Per round and player: killed, assisted (damaged a victim that another one killed), survived, was avenged."""
    killed = s.kills.select(*ROUND, F.col("attacker").alias("player"), F.lit(True).alias("killed")).distinct()
    died = s.kills.select(*ROUND, F.col("victim").alias("player"), F.lit(True).alias("died")).distinct()
    hit = enemy(s.damages).select(*ROUND, "victim", F.col("attacker").alias("player")).distinct()
    assisted = hit.join(s.kills.select(*ROUND, "victim", "attacker").distinct(), [*ROUND, "victim"]).where("attacker <> player").select(*BY, F.lit(True).alias("assisted")).distinct()
    traded = trades(s).select(*ROUND, F.col("avenged").alias("player"), F.lit(True).alias("traded")).distinct()
    out = s.roster
    for flag in (killed, died, assisted, traded):
        out = out.join(flag, BY, "left")
    on = lambda c: F.coalesce(c, F.lit(False))
    return out.select(*BY, "side", on("killed").alias("killed"), on("assisted").alias("assisted"), (~on("died")).alias("survived"), on("traded").alias("traded"))


PARTICIPATION_SQL = """, trade AS (SELECT DISTINCT a.round_num, a.victim AS player FROM kills a JOIN kills b ON a.round_num = b.round_num AND b.victim = a.attacker AND b.attacker_side = a.victim_side AND b.tick > a.tick AND b.tick - a.tick <= 1800),
part AS (SELECT r.*, EXISTS (FROM kills k WHERE k.round_num = r.round_num AND k.attacker = r.player) AS killed,
 EXISTS (FROM damages d JOIN kills k ON k.round_num = d.round_num AND k.victim = d.victim AND k.attacker <> d.attacker WHERE d.round_num = r.round_num AND d.attacker = r.player AND d.attacker_side <> d.victim_side) AS assisted,
 NOT EXISTS (FROM kills k WHERE k.round_num = r.round_num AND k.victim = r.player) AS survived, EXISTS (FROM trade t WHERE t.round_num = r.round_num AND t.player = r.player) AS traded FROM roster r)
"""


@on_session(PARTICIPATION_SQL + "SELECT match_id, player, count(*) AS rounds, count(*) FILTER (killed OR assisted OR survived OR traded) AS took_part, round(100.0 * count(*) FILTER (killed OR assisted OR survived OR traded) / count(*), 4) AS kast FROM part GROUP BY 1, 2")
def kast(s: Session) -> DataFrame:
    out = participation(s).groupBy("match_id", "player").agg(F.count(F.lit(1)).alias("rounds"), F.count_if(F.col("killed") | F.col("assisted") | F.col("survived") | F.col("traded")).alias("took_part"))
    return out.withColumn("kast", F.round(ratio("took_part", "rounds", 100.0), 4))


@on_session("""SELECT match_id, round_num, thrower, count(*) AS thrown, round(coalesce(sum(duration) FILTER (thrower_side <> victim_side), 0), 4) AS enemy_seconds,
round(coalesce(sum(duration) FILTER (thrower_side = victim_side AND thrower <> victim), 0), 4) AS team_seconds, round(coalesce(sum(duration) FILTER (thrower = victim), 0), 4) AS own_seconds, count(*) FILTER (thrower_side <> victim_side AND duration >= 1) AS effective FROM blinds GROUP BY 1, 2, 3""")
def flash_impact(s: Session) -> DataFrame:
    foe = F.col("thrower_side") != F.col("victim_side")
    own = F.col("thrower") == F.col("victim")
    return s.blinds.groupBy(*ROUND, "thrower").agg(
        F.count(F.lit(1)).alias("thrown"), F.round(total_if(foe, "duration"), 4).alias("enemy_seconds"), F.round(total_if(~foe & ~own, "duration"), 4).alias("team_seconds"),
        F.round(total_if(own, "duration"), 4).alias("own_seconds"), F.count_if(foe & (F.col("duration") >= 1)).alias("effective"),
    )


@on_session("""SELECT match_id, round_num, event_seq, thrower, killer, gap FROM (SELECT b.match_id, b.round_num, k.event_seq, b.thrower, k.attacker AS killer, k.tick - b.tick AS gap, row_number() OVER (PARTITION BY b.round_num, b.thrower, k.event_seq ORDER BY b.tick, b.event_seq) AS nth
FROM kills k JOIN blinds b ON k.round_num = b.round_num AND k.victim = b.victim AND k.tick >= b.tick AND k.tick <= b.tick + b.duration * 64 + 900 WHERE b.thrower_side <> b.victim_side AND k.attacker_side = b.thrower_side) WHERE nth = 1""")
def flash_assists(s: Session) -> DataFrame:
    b = s.blinds.select(*[F.col(c).alias(f"b_{c}") for c in s.blinds.columns])
    k = s.kills
    found = within_after(k, b, [("match_id", "b_match_id"), ("round_num", "b_round_num"), ("victim", "b_victim")], F.col("tick") >= F.col("b_tick"), F.col("tick") <= F.col("b_tick") + F.col("b_duration") * 64 + FLASH_GRACE)
    found = found.where((F.col("b_thrower_side") != F.col("b_victim_side")) & (F.col("attacker_side") == F.col("b_thrower_side")))
    once = first_by(found, [*ROUND, "b_thrower", "event_seq"], "b_tick", "b_event_seq")
    return once.select(*ROUND, "event_seq", F.col("b_thrower").alias("thrower"), F.col("attacker").alias("killer"), (F.col("tick") - F.col("b_tick")).alias("gap"))


@on_session(""", e AS (SELECT match_id, round_num, thrower AS player, 'flash' AS kind, event_seq // 2 AS entity FROM blinds UNION SELECT match_id, round_num, player, weapon, event_seq // 2 FROM shots WHERE weapon IN ('he', 'fire'))
SELECT match_id, round_num, player, count(*) FILTER (kind = 'flash') AS flash, count(*) FILTER (kind = 'he') AS he, count(*) FILTER (kind = 'fire') AS fire FROM e GROUP BY 1, 2, 3""")
def thrown_counts(s: Session) -> DataFrame:
    """Things thrown by kind; what several rows say of one thing counts once."""
    entity = F.floor(F.col("event_seq") / 2).alias("entity")
    flashes = s.blinds.select(*ROUND, F.col("thrower").alias("player"), F.lit("flash").alias("kind"), entity)
    others = s.shots.where(F.col("weapon").isin(*UTILITY)).select(*BY, F.col("weapon").alias("kind"), entity)
    return flashes.unionByName(others).distinct().groupBy(*BY).pivot("kind", ["flash", "he", "fire"]).agg(F.count(F.lit(1))).na.fill(0)


@on_session("""SELECT b.match_id, b.round_num, b.thrower AS player, min(b.tick) - any_value(r.freeze_end) AS first_utility FROM blinds b JOIN rounds r USING (match_id, round_num) GROUP BY 1, 2, 3""")
def first_utility(s: Session) -> DataFrame:
    first = s.blinds.groupBy(*ROUND, F.col("thrower").alias("player")).agg(F.min("tick").alias("tick"))
    return first.join(s.rounds.select(*ROUND, "freeze_end"), ROUND).select(*BY, (F.col("tick") - F.col("freeze_end")).alias("first_utility"))


def opening(s: Session) -> DataFrame:
    return first_by(enemy(s.kills), ROUND, "tick", "event_seq")


@on_session(""", o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, round_num ORDER BY tick, event_seq) AS nth FROM kills) WHERE nth = 1)
SELECT player, count(*) AS duels, sum(won)::BIGINT AS won FROM (SELECT attacker AS player, 1 AS won FROM o UNION ALL SELECT victim, 0 FROM o) GROUP BY 1""")
def opening_duels(s: Session) -> DataFrame:
    both = opening(s).select(F.explode(F.array(F.struct(F.col("attacker").alias("player"), F.lit(1).alias("won")), F.struct(F.col("victim").alias("player"), F.lit(0).alias("won")))).alias("x"))
    return both.groupBy("x.player").agg(F.count(F.lit(1)).alias("duels"), F.sum("x.won").alias("won"))


@on_session("""SELECT match_id, round_num, player, min(tick) AS first_contact FROM (SELECT match_id, round_num, attacker AS player, tick FROM damages UNION ALL SELECT match_id, round_num, victim, tick FROM damages) GROUP BY 1, 2, 3""")
def first_contact(s: Session) -> DataFrame:
    roles = s.damages.select(*ROUND, "tick", F.explode(F.array("attacker", "victim")).alias("player"))
    return roles.groupBy(*BY).agg(F.min("tick").alias("first_contact"))


@on_session(""", h AS (SELECT match_id, attacker AS player, count(*) AS kills, count(*) FILTER (weapon = 'sniper') AS sniper_kills, sum(headshot)::BIGINT AS headshots FROM kills GROUP BY 1, 2)
SELECT match_id, player, kills, sniper_kills, headshots, round(sniper_kills / kills, 4) AS sniper_share, round(headshots / kills, 4) AS headshot_share FROM h""")
def sniper_summary(s: Session) -> DataFrame:
    out = s.kills.groupBy("match_id", F.col("attacker").alias("player")).agg(F.count(F.lit(1)).alias("kills"), F.count_if(F.col("weapon") == "sniper").alias("sniper_kills"), F.sum("headshot").alias("headshots"))
    return out.withColumn("sniper_share", F.round(ratio("sniper_kills", "kills"), 4)).withColumn("headshot_share", F.round(ratio("headshots", "kills"), 4))


@on_session("""SELECT k.match_id, k.round_num, k.attacker AS player, count(*) AS kills FROM kills k GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def multikills(s: Session) -> DataFrame:
    return s.kills.groupBy(*ROUND, F.col("attacker").alias("player")).agg(F.count(F.lit(1)).alias("kills")).where("kills >= 2")


@on_session("""SELECT k.match_id, k.round_num, k.event_seq, k.attacker, round(coalesce(sum(d.dmg), 0), 4) AS own_damage, CASE WHEN coalesce(sum(d.dmg), 0) >= 60 THEN 1 ELSE 0 END::BIGINT AS clean FROM kills k
LEFT JOIN damages d ON d.round_num = k.round_num AND d.attacker = k.attacker AND d.victim = k.victim AND (d.tick < k.tick OR d.tick = k.tick AND d.event_seq < k.event_seq) GROUP BY 1, 2, 3, 4""")
def clean_kills(s: Session) -> DataFrame:
    hits = s.damages.select(*ROUND, "attacker", "victim", F.col("tick").alias("t"), F.col("event_seq").alias("q"), "dmg")
    before = (F.col("t") < F.col("tick")) | ((F.col("t") == F.col("tick")) & (F.col("q") < F.col("event_seq")))
    own = s.kills.join(hits, [*ROUND, "attacker", "victim"], "left").groupBy(*ROUND, "event_seq", "attacker").agg(total_if(before, "dmg").alias("own"))
    return own.select(*ROUND, "event_seq", "attacker", F.round("own", 4).alias("own_damage"), (F.col("own") >= 60).cast("long").alias("clean"))


@on_session("""SELECT p.window_s, count(*) AS pairs, count(DISTINCT b.event_seq) AS trade_kills FROM (VALUES (600), (1200), (1800), (3600)) p(window_s) JOIN kills a ON true
JOIN kills b ON a.round_num = b.round_num AND b.victim = a.attacker AND b.attacker_side = a.victim_side AND b.tick > a.tick AND b.tick - a.tick <= p.window_s GROUP BY 1""")
def trade_window_sweep(s: Session) -> DataFrame:
    pairs = retaliation(s.kills, ROUND, 3600).withColumn("gap", F.col("then_tick") - F.col("first_tick"))
    swept = pairs.select("gap", "then_event_seq", F.explode(F.array(*[F.lit(w) for w in (600, 1200, 1800, 3600)])).alias("window_s")).where("gap <= window_s")
    return swept.groupBy("window_s").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("then_event_seq").alias("trade_kills"))


@on_session("""SELECT match_id, round_num, attacker AS player, tick, event_seq, min(tick) OVER w AS next_death FROM (SELECT *, 0 FROM kills) WINDOW w AS (PARTITION BY match_id, round_num ORDER BY tick, event_seq ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING)""")
def next_kill(s: Session) -> DataFrame:
    w = Window.partitionBy(*ROUND).orderBy("tick", "event_seq")
    return s.kills.select(*ROUND, F.col("attacker").alias("player"), "tick", "event_seq", F.lead("tick").over(w).alias("next_death"))


@on_session(""", best AS (SELECT round_num, victim, thrower, thrower_side, tick, duration FROM blinds)
SELECT match_id, round_num, event_seq, longest AS thrower FROM (SELECT k.match_id, k.round_num, k.event_seq, k.attacker_side, arg_max(struct_pack(p := b.thrower, s := b.thrower_side), (b.duration, b.tick, b.thrower)) AS f FROM kills k
JOIN best b ON b.round_num = k.round_num AND b.victim = k.victim AND b.tick <= k.tick AND b.tick >= k.tick - 1800 GROUP BY 1, 2, 3, 4) x, LATERAL (SELECT x.f.p AS longest, x.f.s AS side) y WHERE side = attacker_side""")
def longest_flash_credit(s: Session) -> DataFrame:
    b = s.blinds.select(*ROUND, "victim", "thrower", "thrower_side", F.col("tick").alias("b_tick"), "duration")
    near = s.kills.join(b, [*ROUND, "victim"]).where((F.col("b_tick") <= F.col("tick")) & (F.col("b_tick") >= F.col("tick") - 1800))
    best = near.groupBy(*ROUND, "event_seq", "attacker_side").agg(F.max_by(F.struct("thrower", "thrower_side"), F.struct("duration", "b_tick", "thrower")).alias("f"))
    return best.where("f.thrower_side = attacker_side").select(*ROUND, "event_seq", F.col("f.thrower").alias("thrower"))
