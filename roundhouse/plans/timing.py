"""As-of, nearest, island and running-state queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import average_rank, first_by, masked_rank
from ..functions.geometry import distance
from ..operators.joins import asof, bucketed_near, densified, one_to_one, overridden, with_fallback
from ..operators.sequences import alone_first, change_points, islands, majority, resampled, running, segments, top_with_ties
from ..sources.sessions import ROUND, Session
from .combat import BY, first_contact
from .registry import on_session


def _asof(s: Session, direction: str, exact: bool = True, tolerance: float | None = None) -> DataFrame:
    hits = s.damages.select(*ROUND, "tick", F.col("attacker").alias("player"), "event_seq", "dmg")
    out = asof(s.shots.select(*BY, "tick", "event_seq"), hits, BY, "tick", ["dmg"], ["event_seq"], direction, exact, tolerance)
    return out.select(*ROUND, "event_seq", F.col("r_tick").alias("hit_tick"), "r_dmg")


ASOF_SQL = """SELECT match_id, round_num, event_seq, {pick}.tick AS hit_tick, {pick}.dmg AS r_dmg FROM (SELECT s.match_id, s.round_num, s.event_seq,
(SELECT {agg}(struct_pack(tick := d.tick, dmg := d.dmg), (d.tick, d.event_seq)) FROM damages d WHERE d.round_num = s.round_num AND d.attacker = s.player AND {when}) AS f FROM shots s)"""


@on_session(ASOF_SQL.format(pick="f", agg="arg_max", when="d.tick <= s.tick"))
def asof_backward(s: Session) -> DataFrame:
    return _asof(s, "backward")


@on_session(ASOF_SQL.format(pick="f", agg="arg_max", when="d.tick < s.tick"))
def asof_backward_exclusive(s: Session) -> DataFrame:
    return _asof(s, "backward", exact=False)


@on_session(ASOF_SQL.format(pick="f", agg="arg_min", when="d.tick >= s.tick"))
def asof_forward(s: Session) -> DataFrame:
    return _asof(s, "forward")


@on_session(ASOF_SQL.format(pick="f", agg="arg_min", when="d.tick >= s.tick AND d.tick - s.tick <= 1200"))
def asof_forward_within(s: Session) -> DataFrame:
    return _asof(s, "forward", tolerance=1200)


@on_session(""", b AS (SELECT s.match_id, s.round_num, s.event_seq, s.tick, (SELECT max(d.tick) FROM damages d WHERE d.round_num = s.round_num AND d.attacker = s.player AND d.tick <= s.tick) AS lo,
(SELECT min(d.tick) FROM damages d WHERE d.round_num = s.round_num AND d.attacker = s.player AND d.tick >= s.tick) AS hi FROM shots s)
SELECT match_id, round_num, event_seq, CASE WHEN lo IS NOT NULL AND (hi IS NULL OR tick - lo <= hi - tick) THEN lo ELSE hi END AS hit_tick FROM b""")
def asof_nearest(s: Session) -> DataFrame:
    hits = s.damages.select(*ROUND, "tick", F.col("attacker").alias("player"), "event_seq", "dmg")
    out = asof(s.shots.select(*BY, "tick", "event_seq"), hits, BY, "tick", [], ["event_seq"], "nearest")
    return out.select(*ROUND, "event_seq", F.col("r_tick").alias("hit_tick"))


@on_session("""SELECT match_id, round_num, event_seq, sample_seq, gap FROM (SELECT k.match_id, k.round_num, k.event_seq, t.event_seq AS sample_seq, abs(t.tick - k.tick) AS gap,
row_number() OVER (PARTITION BY k.event_seq ORDER BY abs(t.tick - k.tick), t.tick, CASE WHEN t.tick <= k.tick THEN -t.event_seq ELSE t.event_seq END) AS nth FROM kills k JOIN ticks t ON t.round_num = k.round_num AND t.player = k.victim) WHERE nth = 1""")
def nearest_sample(s: Session) -> DataFrame:
    """A victim's sample nearest to the kill, before or after."""
    samples = s.ticks.select(*ROUND, F.col("player").alias("victim"), "tick", F.col("event_seq").alias("sample_seq"))
    out = asof(s.kills.select(*ROUND, "victim", "tick", "event_seq"), samples, [*ROUND, "victim"], "tick", ["sample_seq"], ["sample_seq"], "nearest").where("r_sample_seq is not null")
    return out.select(*ROUND, "event_seq", F.col("r_sample_seq").alias("sample_seq"), F.abs(F.col("r_tick") - F.col("tick")).alias("gap"))


@on_session("""SELECT match_id, round_num, player, arg_max(place, (tick, event_seq)) AS place FROM (SELECT t.*, r.freeze_end FROM ticks t JOIN rounds r USING (match_id, round_num)) WHERE tick <= freeze_end + 5000 GROUP BY 1, 2, 3""")
def setup_snapshot(s: Session) -> DataFrame:
    near = s.ticks.join(s.rounds.select(*ROUND, "freeze_end"), ROUND).where(F.col("tick") <= F.col("freeze_end") + 5000)
    return near.groupBy(*BY).agg(F.max_by("place", F.struct("tick", "event_seq")).alias("place"))


@on_session("""SELECT match_id, round_num, tick, player, foe, round(apart, 4) AS apart FROM (SELECT a.match_id, a.round_num, a.tick, a.player, b.player AS foe, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS apart,
row_number() OVER (PARTITION BY a.round_num, a.tick, a.player ORDER BY sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), b.player) AS nth FROM states a JOIN states b ON a.round_num = b.round_num AND a.tick = b.tick AND a.side <> b.side WHERE a.alive AND b.alive) WHERE nth = 1""")
def nearest_enemy(s: Session) -> DataFrame:
    """The nearest living enemy of each living player at the same tick."""
    return nearest_foe(s).select(*ROUND, "tick", "player", "foe", F.round("apart", 4).alias("apart"))


def nearest_foe(s: Session) -> DataFrame:
    """(match_id, round_num, tick, player, foe, apart, fx, fy, fz): round and tick are equal keys, so that no more than five enemies meet."""
    a = s.states.where("alive").select(*ROUND, "tick", "player", "side", "x", "y", "z")
    b = a.select(*ROUND, "tick", F.when(F.col("side") == "t", "ct").otherwise("t").alias("side"), F.col("player").alias("foe"), *[F.col(c).alias(f"f{c}") for c in "xyz"])
    apart = distance(*[(F.col(c), F.col(f"f{c}")) for c in "xyz"])
    best = a.join(b, [*ROUND, "tick", "side"]).groupBy(*ROUND, "tick", "player").agg(F.min(F.struct(apart.alias("apart"), "foe", "fx", "fy", "fz")).alias("m"))
    return best.select(*ROUND, "tick", "player", "m.*")


@on_session(""", d AS (SELECT b.match_id, b.round_num, b.event_seq, s.event_seq AS cause, abs(b.tick - s.tick) AS gap FROM blinds b JOIN shots s ON b.round_num = s.round_num AND abs(b.tick - s.tick) <= 300),
n AS (SELECT *, row_number() OVER (PARTITION BY event_seq ORDER BY gap, cause) AS nth, lead(gap) OVER (PARTITION BY event_seq ORDER BY gap, cause) AS other FROM d)
SELECT match_id, round_num, event_seq, CASE WHEN other IS NULL OR other - gap > 60 THEN cause END AS cause, CASE WHEN other IS NULL OR other - gap > 60 THEN 'only' ELSE 'ambiguous' END AS verdict FROM n WHERE nth = 1""")
def attributed_causes(s: Session) -> DataFrame:
    b = s.blinds.select(*ROUND, F.col("tick").alias("b_tick"), "event_seq")
    c = s.shots.select(*ROUND, F.col("tick").alias("c_tick"), F.col("event_seq").alias("cause"))
    near = bucketed_near(b, c, "b_tick", "c_tick", ROUND, 300).withColumn("gap", F.abs(F.col("b_tick") - F.col("c_tick")))
    w = Window.partitionBy("event_seq").orderBy("gap", "cause")
    one = near.withColumn("other", F.lead("gap").over(w)).withColumn("nth", F.row_number().over(w)).where("nth = 1")
    sure = F.col("other").isNull() | (F.col("other") - F.col("gap") > 60)
    return one.select(*ROUND, "event_seq", F.when(sure, F.col("cause")).alias("cause"), F.when(sure, "only").otherwise("ambiguous").alias("verdict"))


@on_session(""", d AS (SELECT b.match_id, b.round_num, b.event_seq AS b_seq, s.event_seq AS s_seq, abs(b.tick - s.tick) AS gap FROM blinds b JOIN shots s ON b.round_num = s.round_num AND abs(b.tick - s.tick) <= 600),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b_seq ORDER BY gap, s_seq, b_seq) AS n FROM d) WHERE n = 1)
SELECT match_id, round_num, b_seq, s_seq, gap FROM (SELECT *, row_number() OVER (PARTITION BY s_seq ORDER BY gap, s_seq, b_seq) AS m FROM l) WHERE m = 1""")
def greedy_matching(s: Session) -> DataFrame:
    b = s.blinds.select(*ROUND, F.col("tick").alias("b_tick"), F.col("event_seq").alias("b_seq"))
    c = s.shots.select(*ROUND, F.col("tick").alias("c_tick"), F.col("event_seq").alias("s_seq"))
    near = bucketed_near(b, c, "b_tick", "c_tick", ROUND, 600).withColumn("gap", F.abs(F.col("b_tick") - F.col("c_tick")))
    return one_to_one(near, ["b_seq"], ["s_seq"], "gap", "s_seq", "b_seq").select(*ROUND, "b_seq", "s_seq", "gap")


@on_session("""SELECT r.match_id, r.round_num, r.player FROM roster r WHERE NOT EXISTS (FROM kills k WHERE k.round_num = r.round_num AND k.victim = r.player)""")
def survivors(s: Session) -> DataFrame:
    return s.roster.select(*BY).join(s.kills.select(*ROUND, F.col("victim").alias("player")), BY, "left_anti")


@on_session("""SELECT match_id, round_num, player, tick FROM ticks t WHERE EXISTS (FROM shots s WHERE s.round_num = t.round_num AND s.player = t.player AND s.tick = t.tick)""")
def ticks_with_shots(s: Session) -> DataFrame:
    return s.ticks.join(s.shots.select(*BY, "tick").distinct(), [*BY, "tick"], "left_semi").select(*BY, "tick")


@on_session(""", c AS (SELECT place, side, round(avg(yaw), 4) AS yaw FROM ticks GROUP BY 1, 2), m AS (SELECT 'p' || i AS place, 't' AS side, 90.0::DOUBLE AS yaw FROM range(0, 3) g(i))
SELECT place, side, yaw FROM m UNION ALL SELECT * FROM c WHERE NOT EXISTS (FROM m WHERE m.place = c.place AND m.side = c.side)""")
def overridden_angles(s: Session) -> DataFrame:
    derived = s.ticks.groupBy("place", "side").agg(F.round(F.avg("yaw"), 4).alias("yaw"))
    manual = s.ticks.sparkSession.range(3).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("place"), F.lit("t").alias("side"), F.lit(90.0).alias("yaw"))
    return overridden(derived, manual, ["place", "side"])


@on_session(""", e AS (SELECT DISTINCT side, place FROM ticks), o AS (SELECT match_id, round_num, side, place, count(*) AS n FROM ticks GROUP BY ALL), sp AS (SELECT DISTINCT match_id, round_num, side FROM ticks)
SELECT sp.match_id, sp.round_num, sp.side, e.place, coalesce(o.n, 0) AS n FROM sp JOIN e USING (side) LEFT JOIN o ON o.round_num = sp.round_num AND o.side = sp.side AND o.place = e.place""")
def dense_occupancy(s: Session) -> DataFrame:
    facts = s.ticks.groupBy(*ROUND, "side", "place").agg(F.count(F.lit(1)).alias("n"))
    return densified(facts, s.ticks.select(*ROUND, "side").distinct(), s.ticks.select("side", "place").distinct(), [*ROUND, "side"], ["side"], "n")


@on_session(""", f AS (SELECT weapon, attacker_side, avg(dmg) AS v FROM damages WHERE weapon <> 'knife' GROUP BY 1, 2 HAVING count(*) >= 160), c AS (SELECT attacker_side, avg(dmg) AS v FROM damages GROUP BY 1)
SELECT k.event_seq, round(coalesce(f.v, c.v), 4) AS expected FROM kills k LEFT JOIN f USING (weapon, attacker_side) LEFT JOIN c USING (attacker_side)""")
def fallback_lookup(s: Session) -> DataFrame:
    fine = s.damages.where("weapon <> 'knife'").groupBy("weapon", "attacker_side").agg(F.avg("dmg").alias("v"), F.count(F.lit(1)).alias("n")).where("n >= 160")
    coarse = s.damages.groupBy("attacker_side").agg(F.avg("dmg").alias("v"))
    return with_fallback(s.kills, fine, ["weapon", "attacker_side"], coarse, ["attacker_side"], "v").select("event_seq", F.round("v", 4).alias("expected"))


@on_session("""SELECT match_id, round_num, player, event_seq, island FROM (SELECT *, sum(brk) OVER (PARTITION BY match_id, round_num, player ORDER BY tick, event_seq ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM
(SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY match_id, round_num, player ORDER BY tick, event_seq) > 900 THEN 1 ELSE 0 END AS brk FROM ticks))""")
def activity_islands(s: Session) -> DataFrame:
    gap = F.col("tick") - F.lag("tick").over(Window.partitionBy(*BY).orderBy("tick", "event_seq"))
    return islands(s.ticks, BY, ["tick", "event_seq"], gap > 900).select(*BY, "event_seq", "island")


@on_session("""SELECT match_id, round_num, victim, event_seq, duration FROM (SELECT *, lag(duration) OVER (PARTITION BY match_id, victim ORDER BY round_num, tick, event_seq) AS b FROM (SELECT * REPLACE (floor(duration) AS duration) FROM blinds)) WHERE duration > 0 AND (b IS NULL OR b <> duration)""")
def blind_starts(s: Session) -> DataFrame:
    whole = s.blinds.withColumn("duration", F.floor("duration").cast("double"))
    return change_points(whole, ["match_id", "victim"], ["round_num", "tick", "event_seq"], "duration").select(*ROUND, "victim", "event_seq", "duration")


@on_session(""", c AS (SELECT match_id, round_num, player, min(tick) AS t FROM (SELECT match_id, round_num, attacker AS player, tick FROM damages UNION ALL SELECT match_id, round_num, victim, tick FROM damages) GROUP BY 1, 2, 3),
j AS (SELECT r.*, c.t FROM roster r LEFT JOIN c USING (match_id, round_num, player)), k AS (SELECT *, CASE WHEN t IS NOT NULL THEN rank() OVER (PARTITION BY match_id, round_num, side ORDER BY t NULLS LAST) END AS rk FROM j)
SELECT match_id, round_num, player, (rk = 1 AND count(*) FILTER (rk = 1) OVER (PARTITION BY match_id, round_num, side) = 1 AND rk IS NOT NULL)::BIGINT AS first_of_team FROM k""")
def first_of_team(s: Session) -> DataFrame:
    rows = s.roster.join(first_contact.of(s), BY, "left")
    return alone_first(rows, [*ROUND, "side"], "first_contact", "alone").select(*BY, F.col("alone").cast("long").alias("first_of_team"))


@on_session(""", n AS (SELECT match_id, round_num, side, place, count(*) AS n FROM ticks GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY match_id, round_num, side ORDER BY n DESC) AS rk FROM n)
SELECT match_id, round_num, side, CASE WHEN count(*) = 1 THEN any_value(place) END AS place FROM k WHERE rk = 1 GROUP BY 1, 2, 3""")
def majority_place(s: Session) -> DataFrame:
    return majority(s.ticks, [*ROUND, "side"], "place", "place_").withColumnRenamed("place_", "place")


@on_session(""", d AS (SELECT match_id, attacker AS player, round(sum(dmg), 4) AS dmg FROM damages GROUP BY 1, 2) SELECT match_id, player, dmg FROM (SELECT *, rank() OVER (PARTITION BY match_id ORDER BY dmg DESC) AS rk FROM d) WHERE rk <= 3""")
def top_three(s: Session) -> DataFrame:
    d = s.damages.groupBy("match_id", F.col("attacker").alias("player")).agg(F.round(F.sum("dmg"), 4).alias("dmg"))
    return top_with_ties(d, ["match_id"], "dmg", 3)


@on_session(""", d AS (SELECT match_id, attacker AS player, count(*) AS n FROM kills GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY match_id ORDER BY n DESC) AS r, count(*) OVER (PARTITION BY match_id, n) AS ties, count(*) OVER (PARTITION BY match_id) AS all_n FROM d)
SELECT match_id, player, round((r + (ties - 1) / 2.0 - 1) / (all_n - 1), 4) AS place FROM k WHERE all_n > 1""")
def average_places(s: Session) -> DataFrame:
    d = s.kills.groupBy("match_id", F.col("attacker").alias("player")).agg(F.count(F.lit(1)).alias("n"))
    out = d.withColumn("r", average_rank(["match_id"], "n", True)).withColumn("all_n", F.count(F.lit(1)).over(Window.partitionBy("match_id"))).where("all_n > 1")
    return out.select("match_id", "player", F.round((F.col("r") - 1) / (F.col("all_n") - 1), 4).alias("place"))


@on_session(""", a AS (SELECT match_id, round_num, tick, event_seq, victim, victim_side FROM (SELECT *, row_number() OVER (PARTITION BY round_num, victim ORDER BY tick, event_seq) AS n FROM kills) WHERE n = 1)
SELECT match_id, round_num, event_seq, victim, 5 - sum((victim_side = 't')::INT) OVER w AS alive_t, 5 - sum((victim_side = 'ct')::INT) OVER w AS alive_ct FROM a WINDOW w AS (PARTITION BY match_id, round_num ORDER BY tick, event_seq ROWS UNBOUNDED PRECEDING)""")
def alive_counts(s: Session) -> DataFrame:
    deaths = first_by(s.kills, [*ROUND, "victim"], "tick", "event_seq")
    left = lambda side: (F.lit(5) - running(ROUND, ["tick", "event_seq"], (F.col("victim_side") == side).cast("int"))).cast("long")
    return deaths.select(*ROUND, "event_seq", "victim", left("t").alias("alive_t"), left("ct").alias("alive_ct"))


CLUTCH_SQL = """, a AS (SELECT match_id, round_num, tick, event_seq, victim, victim_side FROM (SELECT *, row_number() OVER (PARTITION BY round_num, victim ORDER BY tick, event_seq) AS n FROM kills) WHERE n = 1),
al AS (SELECT *, 5 - sum((victim_side = 't')::INT) OVER w AS t, 5 - sum((victim_side = 'ct')::INT) OVER w AS ct FROM a WINDOW w AS (PARTITION BY match_id, round_num ORDER BY tick, event_seq ROWS UNBOUNDED PRECEDING)),
m AS (SELECT match_id, round_num, 't' AS side, tick, event_seq, ct AS foes FROM al WHERE t = 1 AND ct >= 1 UNION ALL SELECT match_id, round_num, 'ct', tick, event_seq, t FROM al WHERE ct = 1 AND t >= 1),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY round_num, side ORDER BY tick, event_seq) AS n FROM m) WHERE n = 1)
"""


@on_session(CLUTCH_SQL + """SELECT f.match_id, f.round_num, f.side, p.player, f.foes::BIGINT AS foes, f.tick AS start_tick, (r.winner = f.side)::BIGINT AS won FROM f JOIN rounds r USING (match_id, round_num)
JOIN roster p ON p.round_num = f.round_num AND p.side = f.side
WHERE NOT EXISTS (FROM a WHERE a.round_num = f.round_num AND a.victim = p.player AND (a.tick, a.event_seq) <= (f.tick, f.event_seq))""")
def clutches(s: Session) -> DataFrame:
    alive = alive_counts.of(s).join(s.kills.select("event_seq", "tick"), "event_seq")
    sides = F.explode(F.array(F.struct(F.lit("t").alias("side"), F.col("alive_t").alias("own"), F.col("alive_ct").alias("foes")), F.struct(F.lit("ct").alias("side"), F.col("alive_ct").alias("own"), F.col("alive_t").alias("foes"))))
    moments = alive.select(*ROUND, "tick", "event_seq", sides.alias("s")).where("s.own = 1 and s.foes >= 1").select(*ROUND, "tick", "event_seq", "s.side", "s.foes")
    begun = first_by(moments, [*ROUND, "side"], "tick", "event_seq")
    dead = first_by(s.kills, [*ROUND, "victim"], "tick", "event_seq").select(*ROUND, F.col("victim").alias("player"), F.col("tick").alias("d_tick"), F.col("event_seq").alias("d_seq"))
    last = begun.join(s.roster, [*ROUND, "side"]).join(dead, BY, "left").where(F.col("d_tick").isNull() | (F.struct("d_tick", "d_seq") > F.struct("tick", "event_seq")))
    return last.join(s.rounds.select(*ROUND, "winner"), ROUND).select(*ROUND, "side", "player", "foes", F.col("tick").alias("start_tick"), (F.col("winner") == F.col("side")).cast("long").alias("won"))


@on_session("""SELECT match_id, round_num, winner, sum((winner = 't')::INT) OVER w AS score_t, sum((winner = 'ct')::INT) OVER w AS score_ct FROM rounds WINDOW w AS (PARTITION BY match_id ORDER BY round_num ROWS UNBOUNDED PRECEDING)""")
def score_progression(s: Session) -> DataFrame:
    score = lambda side: running(["match_id"], ["round_num"], (F.col("winner") == side).cast("int")).cast("long")
    return s.rounds.select(*ROUND, "winner", score("t").alias("score_t"), score("ct").alias("score_ct"))


@on_session("""SELECT match_id, player, count(*) AS steps, round(sum(d), 4) AS path, round(max(d), 4) AS longest FROM (SELECT match_id, player, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM ticks WINDOW w AS (PARTITION BY match_id, round_num, player ORDER BY tick, event_seq)) WHERE d IS NOT NULL GROUP BY 1, 2""")
def path_length(s: Session) -> DataFrame:
    w = Window.partitionBy(*BY).orderBy("tick", "event_seq")
    steps = s.ticks.select("match_id", "player", distance((F.col("x"), F.lag("x").over(w)), (F.col("y"), F.lag("y").over(w))).alias("d")).where("d is not null")
    return steps.groupBy("match_id", "player").agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum("d"), 4).alias("path"), F.round(F.max("d"), 4).alias("longest"))


@on_session(""", g AS (SELECT match_id, round_num, player, unnest(generate_series((ceil(min(tick) / 600.0) * 600)::BIGINT, max(tick), 600)) AS tick FROM ticks GROUP BY 1, 2, 3)
SELECT g.match_id, g.round_num, g.player, g.tick, (SELECT arg_max(t.x, (t.tick, t.event_seq)) FROM ticks t WHERE t.round_num = g.round_num AND t.player = g.player AND t.tick <= g.tick) AS x FROM g""")
def resampled_positions(s: Session) -> DataFrame:
    return resampled(s.ticks, BY, "tick", "event_seq", ["x"], 600)


@on_session(""", n AS (SELECT *, row_number() OVER w AS p, coalesce(place IS DISTINCT FROM lag(place) OVER w OR lag(place) OVER w IS NULL, true) AS d FROM ticks WINDOW w AS (PARTITION BY match_id, player ORDER BY round_num, tick, event_seq)),
i AS (SELECT *, sum(d::INT) OVER (PARTITION BY match_id, player ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT match_id, player, island::BIGINT AS island, place, min(p) AS first_place, max(p) AS last_place, count(*) AS length FROM i GROUP BY 1, 2, 3, 4""")
def place_runs(s: Session) -> DataFrame:
    return segments(s.ticks, ["match_id", "player"], ["round_num", "tick", "event_seq"], "place").select("match_id", "player", "island", "place", "first_place", "last_place", "length")


@on_session("""SELECT match_id, round_num, player, event_seq, CASE WHEN duration IS NOT NULL THEN rank() OVER (PARTITION BY match_id, round_num ORDER BY duration NULLS LAST) END AS rk FROM (SELECT match_id, round_num, thrower AS player, event_seq, CASE WHEN duration >= 0.2 THEN duration END AS duration FROM blinds)""")
def rank_with_nulls(s: Session) -> DataFrame:
    rows = s.blinds.select(*ROUND, F.col("thrower").alias("player"), "event_seq", F.when(F.col("duration") >= 0.2, F.col("duration")).alias("duration"))
    return rows.select(*BY, "event_seq", masked_rank(ROUND, "duration").cast("long").alias("rk"))


@on_session(""", n AS (SELECT a.match_id, a.round_num, a.tick, a.player, min(sqrt((a.x-b.x)**2 + (a.y-b.y)**2)) AS d FROM states a JOIN states b ON a.round_num = b.round_num AND a.tick = b.tick AND a.side = b.side AND a.player <> b.player WHERE a.alive AND b.alive GROUP BY 1, 2, 3, 4)
SELECT match_id, round_num, player, round(avg(d), 4) AS nearest_mate, round(avg((d > 60)::INT), 4) AS alone, (avg((d > 60)::INT) >= 0.5)::BIGINT AS isolated FROM n GROUP BY 1, 2, 3""")
def isolation(s: Session) -> DataFrame:
    """The mean distance to the nearest living mate over a round's ticks, and the share of them without a mate near."""
    return mate_distances(s).groupBy(*BY).agg(F.round(F.avg("d"), 4).alias("nearest_mate"), F.round(F.avg((F.col("d") > 60).cast("int")), 4).alias("alone"), (F.avg((F.col("d") > 60).cast("int")) >= 0.5).cast("long").alias("isolated"))


def mate_distances(s: Session) -> DataFrame:
    """(match_id, round_num, tick, player, d): the distance to the nearest living mate at each tick; who is the last alive has none."""
    a = s.states.where("alive").select(*ROUND, "tick", "player", "side", "x", "y")
    b = a.select(*ROUND, "tick", "side", F.col("player").alias("mate"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return a.join(b, [*ROUND, "tick", "side"]).where("player <> mate").groupBy(*ROUND, "tick", "player").agg(F.min(distance((F.col("x"), F.col("bx")), (F.col("y"), F.col("by")))).alias("d"))


@on_session("""SELECT match_id, round_num, player, round(avg(d), 4) AS mean_apart, round(max(d), 4) AS most_apart, count(DISTINCT place) AS places FROM (SELECT *, sqrt((x - avg(x) OVER w) ** 2 + (y - avg(y) OVER w) ** 2) AS d FROM states WHERE alive WINDOW w AS (PARTITION BY match_id, round_num, tick, side)) GROUP BY 1, 2, 3""")
def position_profile(s: Session) -> DataFrame:
    """How far a player is from the centre of the living side at each tick, and how many places the player was in."""
    w = Window.partitionBy(*ROUND, "tick", "side")
    rows = s.states.where("alive").withColumn("d", distance((F.col("x"), F.avg("x").over(w)), (F.col("y"), F.avg("y").over(w))))
    return rows.groupBy(*BY).agg(F.round(F.avg("d"), 4).alias("mean_apart"), F.round(F.max("d"), 4).alias("most_apart"), F.count_distinct("place").alias("places"))
