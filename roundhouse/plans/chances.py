"""The state of a round, its chances by a logistic model, the credit that goes with them, and the chances of a match by its score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compat import first_by, logistic
from ..operators.joins import asof, retaliation
from ..operators.models import logistic_fit
from ..operators.sequences import running
from ..sources.sessions import ROUND, Session, layer
from .combat import BY, TRADE_WINDOW
from .registry import on_session

#: What a round and a bomb last, in ticks of the sample sessions.
ROUND_TICKS, BOMB_TICKS = 14_400, 2_400
#: Weights of a round model in the order of FEATURES, and its bias: fixed values of the sample sessions.
FEATURES = ("alive", "equip", "bomb", "is_ct", "share", "elimination", "elapsed", "bomb_elapsed")
WEIGHTS = (0.35, 0.08, 0.9, -0.05, 0.8, 3.0, 0.3, -0.6)
BIAS = 0.02
#: Shares of a kill's credit: fixed values of the metric. And its windows, in ticks.
DAMAGE_SHARE, FLASH_SHARE, TRADE_SHARE, LEAST_DAMAGE, FLASH_WINDOW = 0.25, 0.10, 0.10, 20.0, 900


def features(side: str, alive: tuple[Column, Column], equip: tuple[Column, Column], tick: Column, plant: Column) -> dict[str, Column]:
    """The state of a round as one side sees it; alive and equip are of t, then of ct."""
    mine, sign = (0, 1.0) if side == "t" else (1, -1.0)
    a, b = alive[mine], alive[1 - mine]
    planted = plant.isNotNull() & (plant <= tick)
    return {
        "alive": (a - b).cast("double"),
        "equip": (equip[mine] - equip[1 - mine]) / 1000.0,
        "bomb": F.when(planted, sign).otherwise(0.0),
        "is_ct": F.lit(0.0 if side == "t" else 1.0),
        "share": F.coalesce(F.try_divide((a - b).cast("double"), (a + b).cast("double")), F.lit(0.0)),
        "elimination": (b <= 0).cast("double") - (a <= 0).cast("double"),
        "elapsed": F.lit(-sign) * tick / float(ROUND_TICKS),
        "bomb_elapsed": F.when(planted, F.lit(-sign) * (tick - plant) / float(BOMB_TICKS)).otherwise(0.0),
    }


def chance(of: dict[str, Column]) -> Column:
    return logistic(sum((F.lit(w) * of[f] for f, w in zip(FEATURES, WEIGHTS, strict=True)), F.lit(BIAS)))


def deaths(s: Session) -> DataFrame:
    """Each player's first death of a round, with both sides' numbers and equipment before and after it."""
    first = first_by(s.kills, [*ROUND, "victim"], "tick", "event_seq")
    own = s.economy.select(*ROUND, F.col("player").alias("victim"), "equip")
    both = s.economy.groupBy(*ROUND).agg(*[F.sum(F.when(F.col("side") == x, F.col("equip")).otherwise(0)).alias(f"all_{x}") for x in ("t", "ct")])
    rows = first.join(own, [*ROUND, "victim"]).join(both, ROUND).join(s.bombs.select(*ROUND, "plant_tick"), ROUND, "left")
    lost = lambda side, c: running(ROUND, ["tick", "event_seq"], F.when(F.col("victim_side") == side, c).otherwise(0))
    now = lambda side, c: F.when(F.col("victim_side") == side, c).otherwise(0)
    for side in ("t", "ct"):
        rows = rows.withColumn(f"alive_{side}", (5 - lost(side, F.lit(1))).cast("long")).withColumn(f"equip_{side}", F.col(f"all_{side}") - lost(side, F.col("equip")))
    return rows.select("*", *[(F.col(f"alive_{x}") + now(x, F.lit(1))).alias(f"were_{x}") for x in ("t", "ct")], *[(F.col(f"equip_{x}") + now(x, F.col("equip"))).alias(f"had_{x}") for x in ("t", "ct")])


def after(side: str) -> dict[str, Column]:
    return features(side, (F.col("alive_t"), F.col("alive_ct")), (F.col("equip_t"), F.col("equip_ct")), F.col("tick"), F.col("plant_tick"))


def before(side: str) -> dict[str, Column]:
    return features(side, (F.col("were_t"), F.col("were_ct")), (F.col("had_t"), F.col("had_ct")), F.col("tick"), F.col("plant_tick"))


def state_samples(s: Session) -> DataFrame:
    """Two rows for each death, as each side sees the state after it, with whether the side won."""
    seen = F.explode(F.array(*[F.struct(F.lit(x).alias("side"), *[c.alias(n) for n, c in after(x).items()]) for x in ("t", "ct")]))
    rows = deaths(s).select(*ROUND, "event_seq", seen.alias("f")).select(*ROUND, "event_seq", "f.*")
    return rows.join(s.rounds.select(*ROUND, "winner"), ROUND).withColumn("won", (F.col("winner") == F.col("side")).cast("int")).drop("winner")


def _features_sql(side: str, alive: str, equip: str) -> str:
    a, b = (f"{alive}_t", f"{alive}_ct") if side == "t" else (f"{alive}_ct", f"{alive}_t")
    e, g = (f"{equip}_t", f"{equip}_ct") if side == "t" else (f"{equip}_ct", f"{equip}_t")
    sign = 1 if side == "t" else -1
    return f"""({a} - {b})::DOUBLE AS alive, ({e} - {g}) / 1000.0 AS equip, CASE WHEN plant_tick <= tick THEN {sign}.0 ELSE 0.0 END AS bomb, {0 if side == "t" else 1}.0 AS is_ct,
 coalesce(({a} - {b}) / nullif({a} + {b}, 0)::DOUBLE, 0) AS share, ({b} <= 0)::INT::DOUBLE - ({a} <= 0)::INT::DOUBLE AS elimination, {-sign} * tick / {ROUND_TICKS}.0 AS elapsed, CASE WHEN plant_tick <= tick THEN {-sign} * (tick - plant_tick) / {BOMB_TICKS}.0 ELSE 0.0 END AS bomb_elapsed"""


DEATHS_SQL = """, fd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY round_num, victim ORDER BY tick, event_seq) AS n FROM kills) WHERE n = 1),
both_ AS (SELECT round_num, sum(equip) FILTER (side = 't') AS all_t, sum(equip) FILTER (side = 'ct') AS all_ct FROM economy GROUP BY 1),
de0 AS (SELECT f.*, e.equip AS own, b.all_t, b.all_ct, p.plant_tick FROM fd f JOIN economy e ON e.round_num = f.round_num AND e.player = f.victim JOIN both_ b ON b.round_num = f.round_num LEFT JOIN bombs p ON p.round_num = f.round_num),
de1 AS (SELECT *, 5 - sum((victim_side = 't')::INT) OVER q AS alive_t, 5 - sum((victim_side = 'ct')::INT) OVER q AS alive_ct, all_t - coalesce(sum(own) FILTER (victim_side = 't') OVER q, 0) AS equip_t, all_ct - coalesce(sum(own) FILTER (victim_side = 'ct') OVER q, 0) AS equip_ct FROM de0 WINDOW q AS (PARTITION BY round_num ORDER BY tick, event_seq ROWS UNBOUNDED PRECEDING)),
de AS (SELECT *, alive_t + (victim_side = 't')::INT AS were_t, alive_ct + (victim_side = 'ct')::INT AS were_ct, equip_t + CASE WHEN victim_side = 't' THEN own ELSE 0 END AS had_t, equip_ct + CASE WHEN victim_side = 'ct' THEN own ELSE 0 END AS had_ct FROM de1)
"""
STATES_SQL = DEATHS_SQL + f""", sm AS (SELECT match_id, round_num, event_seq, 't' AS side, {_features_sql("t", "alive", "equip")} FROM de UNION ALL SELECT match_id, round_num, event_seq, 'ct', {_features_sql("ct", "alive", "equip")} FROM de)
"""
SCORE_SQL = "greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(" + " + ".join([str(BIAS)] + [f"{w} * {f}" for f, w in zip(FEATURES, WEIGHTS, strict=True)]) + ")))))"
#: Deltas of deaths before a round's end: of t's chance, and of the killer's side.
DELTAS_SQL = DEATHS_SQL + f""", pa AS (SELECT event_seq, {SCORE_SQL} AS p FROM (SELECT event_seq, {_features_sql("t", "alive", "equip")} FROM de)), pb AS (SELECT event_seq, {SCORE_SQL} AS p FROM (SELECT event_seq, {_features_sql("t", "were", "had")} FROM de)),
dl AS (SELECT de.*, pb.p AS p_before, pa.p AS p_after, CASE WHEN attacker_side = 't' THEN pa.p - pb.p ELSE pb.p - pa.p END AS delta FROM de JOIN pa USING (event_seq) JOIN pb USING (event_seq) JOIN rounds r ON r.round_num = de.round_num AND de.tick < r."end")
"""


@on_session(STATES_SQL + "SELECT match_id, round_num, event_seq, side, " + ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES) + ", (r.winner = side)::INT AS won FROM sm JOIN rounds r USING (match_id, round_num)")
def round_states(s: Session) -> DataFrame:
    return state_samples(s).select(*ROUND, "event_seq", "side", *[F.round(f, 6).alias(f) for f in FEATURES], "won")


@on_session()
def fitted_round_model(s: Session) -> DataFrame:
    """Weights of the round model, fitted on the state samples; null names the bias."""
    weights, bias = logistic_fit(state_samples(s), FEATURES, "won")
    return s.spark.createDataFrame([*zip(FEATURES, weights, strict=True), (None, bias)], "feature string, weight double")


def deltas(s: Session) -> DataFrame:
    """Deaths before the end of their round, with t's chance before and after, and what the killer's side gained; written once."""
    return layer(s.spark, s.sf_dir, "deltas", lambda: _deltas(s))


def _deltas(s: Session) -> DataFrame:
    rows = deaths(s).join(s.rounds.select(*ROUND, "end"), ROUND).where("tick < end")
    rows = rows.withColumn("p_before", chance(before("t"))).withColumn("p_after", chance(after("t")))
    gain = F.col("p_after") - F.col("p_before")
    return rows.withColumn("delta", F.when(F.col("attacker_side") == "t", gain).otherwise(-gain))


@on_session(DELTAS_SQL + "SELECT match_id, round_num, event_seq, round(p_before, 6) AS p_before, round(p_after, 6) AS p_after, round(delta, 6) + 0.0 AS delta FROM dl")
def win_probability_deltas(s: Session) -> DataFrame:
    return deltas(s).select(*ROUND, "event_seq", F.round("p_before", 6).alias("p_before"), F.round("p_after", 6).alias("p_after"), (F.round("delta", 6) + 0.0).alias("delta"))


SWING_SQL = DELTAS_SQL + f""", hp AS (SELECT d.event_seq, h.attacker AS player, d.delta, sum(h.dmg) AS dmg FROM dl d JOIN damages h ON h.round_num = d.round_num AND h.victim = d.victim AND h.attacker <> d.attacker AND h.attacker_side = d.attacker_side AND h.tick <= d.tick GROUP BY 1, 2, 3 HAVING sum(h.dmg) >= {LEAST_DAMAGE}),
cr1 AS (SELECT event_seq, player, {DAMAGE_SHARE} * delta * dmg / sum(dmg) OVER (PARTITION BY event_seq) AS credit FROM hp),
fl AS (SELECT d.event_seq, d.attacker, d.attacker_side, d.delta, max_by(struct_pack(p := b.thrower, s := b.thrower_side), (b.duration, b.tick, b.event_seq)) AS f FROM dl d JOIN blinds b ON b.round_num = d.round_num AND b.victim = d.victim AND b.tick <= d.tick AND b.tick >= d.tick - {FLASH_WINDOW} GROUP BY 1, 2, 3, 4),
cr2 AS (SELECT event_seq, f.p AS player, {FLASH_SHARE} * delta AS credit FROM fl WHERE f.s = attacker_side AND f.p <> attacker),
tr AS (SELECT DISTINCT b.event_seq FROM kills a JOIN kills b ON a.round_num = b.round_num AND b.victim = a.attacker AND b.attacker_side = a.victim_side AND b.tick > a.tick AND b.tick - a.tick <= {TRADE_WINDOW}),
cr3 AS (SELECT d.event_seq, d.attacker AS player, {TRADE_SHARE} * d.delta AS credit FROM dl d JOIN tr USING (event_seq)),
sh AS (SELECT *, 'damage' AS kind FROM cr1 UNION ALL SELECT *, 'flash' FROM cr2 UNION ALL SELECT *, 'trade' FROM cr3),
kl AS (SELECT d.match_id, d.round_num, d.attacker AS player, d.delta - coalesce((SELECT sum(credit) FROM sh WHERE sh.event_seq = d.event_seq), 0) AS credit, 'kill' AS kind FROM dl d),
fs AS (SELECT round_num, max_by(p_after, (tick, event_seq)) AS p FROM dl GROUP BY 1),
jp AS (SELECT r.match_id, r.round_num, r.winner, 1 - CASE WHEN r.winner = 't' THEN coalesce(f.p, 0.5) ELSE 1 - coalesce(f.p, 0.5) END AS jump FROM rounds r LEFT JOIN fs f USING (round_num)),
al AS (SELECT o.*, d.event_seq IS NULL AS lives, d.tick AS d_tick, d.event_seq AS d_seq FROM roster o LEFT JOIN dl d ON d.round_num = o.round_num AND d.victim = o.player),
wn AS (SELECT a.match_id, a.round_num, a.player, jump / count(*) OVER (PARTITION BY a.round_num) AS credit FROM jp JOIN al a ON a.round_num = jp.round_num AND a.side = jp.winner QUALIFY lives OR bool_and(NOT lives) OVER (PARTITION BY a.round_num)),
wn2 AS (SELECT match_id, round_num, player, jump / count(*) OVER (PARTITION BY round_num) AS credit FROM (SELECT a.*, jump, bool_or(lives) OVER (PARTITION BY a.round_num) AS any_ FROM jp JOIN al a ON a.round_num = jp.round_num AND a.side = jp.winner) WHERE lives OR NOT any_),
ls AS (SELECT match_id, round_num, player, -jump / count(*) OVER (PARTITION BY round_num) AS credit FROM (SELECT a.*, jump, bool_or(lives) OVER (PARTITION BY a.round_num) AS any_, row_number() OVER (PARTITION BY a.round_num ORDER BY d_tick DESC NULLS LAST, d_seq DESC) AS nth FROM jp JOIN al a ON a.round_num = jp.round_num AND a.side <> jp.winner) WHERE lives OR NOT any_ AND nth = 1),
cred AS (SELECT d.match_id, d.round_num, sh.player, sh.credit, sh.kind FROM sh JOIN dl d USING (event_seq) UNION ALL SELECT * FROM kl UNION ALL SELECT match_id, round_num, victim, -delta, 'death' FROM dl UNION ALL SELECT *, 'end' FROM wn2 UNION ALL SELECT *, 'end' FROM ls)
"""
SWING_SQL = SWING_SQL.replace(SWING_SQL[SWING_SQL.index("wn AS ("):SWING_SQL.index("wn2 AS (")], "")


def swing_rows(s: Session) -> DataFrame:
    """(match_id, round_num, player, credit, kind): what each death moves the round's chances by, and what its end does.

    A victim pays what the killer's side gains. Of it mates who had hurt the victim, and the one who had blinded it longest, have
    their shares, a kill that avenges has one of its own; the killer has what is left. What the end adds to the last chance goes to
    the winners who live (all, if none does) and comes from the losers who do (the last to die, if none does). Written once.
    """
    return layer(s.spark, s.sf_dir, "swing", lambda: _swing_rows(s), ["match_id", "round_num", "player"])


def _swing_rows(s: Session) -> DataFrame:
    gains = deltas(s).select(*ROUND, "event_seq", "tick", "attacker", "attacker_side", "victim", "delta", "p_after")
    hits = s.damages.select(*ROUND, "victim", F.col("attacker").alias("player"), F.col("attacker_side").alias("hit_side"), F.col("tick").alias("hit_tick"), "dmg")
    helped = gains.join(hits, [*ROUND, "victim"]).where("player <> attacker and hit_side = attacker_side and hit_tick <= tick")
    helped = helped.groupBy(*ROUND, "event_seq", "player", "delta").agg(F.sum("dmg").alias("dmg")).where(F.col("dmg") >= LEAST_DAMAGE)
    hurt = helped.select(*ROUND, "event_seq", "player", (DAMAGE_SHARE * F.col("delta") * F.col("dmg") / F.sum("dmg").over(Window.partitionBy(*ROUND, "event_seq"))).alias("credit"), F.lit("damage").alias("kind"))
    b = s.blinds.select(*ROUND, "victim", F.col("thrower").alias("player"), "thrower_side", F.col("tick").alias("b_tick"), F.col("event_seq").alias("b_seq"), "duration")
    near = gains.join(b, [*ROUND, "victim"]).where((F.col("b_tick") <= F.col("tick")) & (F.col("b_tick") >= F.col("tick") - FLASH_WINDOW))
    longest = near.groupBy(*ROUND, "event_seq", "attacker", "attacker_side", "delta").agg(F.max_by(F.struct("player", "thrower_side"), F.struct("duration", "b_tick", "b_seq")).alias("f"))
    blinded = longest.where("f.thrower_side = attacker_side and f.player <> attacker").select(*ROUND, "event_seq", F.col("f.player").alias("player"), (FLASH_SHARE * F.col("delta")).alias("credit"), F.lit("flash").alias("kind"))
    avenging = retaliation(s.kills, ROUND, TRADE_WINDOW).select(F.col("then_match_id").alias("match_id"), F.col("then_round_num").alias("round_num"), F.col("then_event_seq").alias("event_seq")).distinct()
    traded = gains.join(avenging, [*ROUND, "event_seq"], "left_semi").select(*ROUND, "event_seq", F.col("attacker").alias("player"), (TRADE_SHARE * F.col("delta")).alias("credit"), F.lit("trade").alias("kind"))
    shares = hurt.unionByName(blinded).unionByName(traded)
    given = shares.groupBy(*ROUND, "event_seq").agg(F.sum("credit").alias("given"))
    killers = gains.join(given, [*ROUND, "event_seq"], "left").select(*ROUND, F.col("attacker").alias("player"), (F.col("delta") - F.coalesce("given", F.lit(0.0))).alias("credit"), F.lit("kill").alias("kind"))
    victims = gains.select(*ROUND, F.col("victim").alias("player"), (-F.col("delta")).alias("credit"), F.lit("death").alias("kind"))
    last = gains.groupBy(*ROUND).agg(F.max_by("p_after", F.struct("tick", "event_seq")).alias("p"))
    p = F.coalesce("p", F.lit(0.5))
    jumps = s.rounds.select(*ROUND, "winner").join(last, ROUND, "left").select(*ROUND, "winner", (1 - F.when(F.col("winner") == "t", p).otherwise(1 - p)).alias("jump"))
    dead = gains.select(*ROUND, F.col("victim").alias("player"), F.struct("tick", "event_seq").alias("died"))
    side = Window.partitionBy(*ROUND, "side")
    ends = s.roster.join(dead, BY, "left").join(jumps, ROUND).withColumn("wins", F.col("side") == F.col("winner")).withColumn("lives", F.col("died").isNull())
    ends = ends.withColumn("some", F.bool_or("lives").over(side)).withColumn("latest", F.max("died").over(side))
    counts = F.col("lives") | (~F.col("some") & (F.col("wins") | (F.col("died") == F.col("latest"))))
    ends = ends.where(counts).withColumn("credit", F.when(F.col("wins"), F.col("jump")).otherwise(-F.col("jump")) / F.count(F.lit(1)).over(side))
    return shares.drop("event_seq").unionByName(killers).unionByName(victims).unionByName(ends.select(*BY, "credit", F.lit("end").alias("kind")))


@on_session(SWING_SQL + "SELECT match_id, round_num, player, kind, round(sum(credit), 5) + 0.0 AS swing FROM cred GROUP BY 1, 2, 3, 4")
def round_swing(s: Session) -> DataFrame:
    return swing_rows(s).groupBy(*BY, "kind").agg((F.round(F.sum("credit"), 5) + 0.0).alias("swing"))


@on_session(SWING_SQL + ", q AS (SELECT round_num, player, sum(credit) AS x FROM cred GROUP BY 1, 2) SELECT player, count(*) AS rounds, round(avg(x), 5) + 0.0 AS mean, round(sqrt(greatest(sum(x * x) / count(*) - avg(x) ** 2, 0) / count(*)), 5) AS error FROM q GROUP BY 1")
def swing_by_player(s: Session) -> DataFrame:
    q = swing_rows(s).groupBy(*BY).agg(F.sum("credit").alias("x"))
    sums = q.groupBy("player").agg(F.count(F.lit(1)).alias("rounds"), F.sum("x").alias("a"), F.sum(F.col("x") * F.col("x")).alias("b"))
    mean = F.col("a") / F.col("rounds")
    return sums.select("player", "rounds", (F.round(mean, 5) + 0.0).alias("mean"), F.round(F.sqrt(F.greatest(F.col("b") / F.col("rounds") - mean * mean, F.lit(0.0)) / F.col("rounds")), 5).alias("error"))


# ---- matches

#: Rounds to win a match, rounds of a side in overtime, overtimes that are told apart, and the rule of decisive rounds: fixed values.
HALF, OVERTIME_HALF, OVERTIMES, DECISIVE, TIE, TOP = 12, 3, 5, 1.5, 0.02, 3


def target(a: int, b: int, half: int = HALF) -> int:
    """Rounds that win from a score: one more than two halves' half, and three more for each overtime that has begun."""
    least = min(a, b)
    return half + 1 if least < half else half + OVERTIME_HALF * ((least - half) // OVERTIME_HALF + 1) + 1


def chance_table(spark: SparkSession, half: int = HALF, p: float = 0.5) -> DataFrame:
    """(a, b, chance) that who has a wins comes out ahead of who has b, by the recurrence from the end; some thousand rows.

    After two halves of equal wins come overtimes of twice three rounds: four of them win, three each go on to the next. What is
    still level after the last overtime told apart is even.
    """
    most = half + OVERTIME_HALF * OVERTIMES
    known: dict[tuple[int, int], float] = {}
    for total in range(2 * most + 1, -1, -1):
        for a in range(max(0, total - most - 1), min(total, most + 1) + 1):
            b = total - a
            need = target(a, b, half)
            if a == b == most:
                known[a, b] = 0.5
            elif a >= need or b >= need:
                known[a, b] = 1.0 if a >= need else 0.0
            elif (a + 1, b) in known and (a, b + 1) in known:
                known[a, b] = p * known[a + 1, b] + (1 - p) * known[a, b + 1]
    return spark.createDataFrame([(a, b, x) for (a, b), x in known.items()], "a long, b long, chance double")


_NEED = "CASE WHEN least(a, b) < 12 THEN 13 ELSE 16 + 3 * ((least(a, b) - 12) // 3) END"
CHANCES_SQL = f""", RECURSIVE_ walk AS (SELECT 0 AS i, a.i AS a0, b.i AS b0, a.i AS a, b.i AS b, 1.0::DOUBLE AS p FROM range(0, 17) a(i), range(0, 17) b(i)
 UNION ALL SELECT i + 1, a0, b0, a + x, b + 1 - x, sum(p * 0.5) FROM walk, range(2) g(x) WHERE a < {_NEED} AND b < {_NEED} AND NOT (a = 27 AND b = 27) GROUP BY ALL),
ch AS (SELECT a0 AS a, b0 AS b, sum(p * CASE WHEN a = 27 AND b = 27 THEN 0.5 WHEN a >= {_NEED} THEN 1 ELSE 0 END) AS chance FROM walk WHERE a >= {_NEED} OR b >= {_NEED} OR a = 27 AND b = 27 GROUP BY 1, 2),
sc AS (SELECT match_id, round_num, nth, won_a, sum(won_a::INT) OVER q AS a, sum((NOT won_a)::INT) OVER q AS b FROM (SELECT *, (winner = 't') = (nth <= 12 OR nth > 24 AND ((nth - 25) // 3) % 4 IN (1, 2)) AS won_a FROM rounds) WINDOW q AS (PARTITION BY match_id ORDER BY round_num ROWS UNBOUNDED PRECEDING)),
cv0 AS (SELECT sc.*, x.chance AS after_, y.chance AS before_ FROM sc JOIN ch x ON x.a = least(sc.a, 16) AND x.b = least(sc.b, 16) JOIN ch y ON y.a = least(sc.a - sc.won_a::INT, 16) AND y.b = least(sc.b - (NOT sc.won_a)::INT, 16) WHERE sc.a <= 16 AND sc.b <= 16),
open_ AS (SELECT *, (a - won_a::INT >= CASE WHEN least(a - won_a::INT, b - (NOT won_a)::INT) < 12 THEN 13 ELSE 16 + 3 * ((least(a - won_a::INT, b - (NOT won_a)::INT) - 12) // 3) END OR b - (NOT won_a)::INT >= CASE WHEN least(a - won_a::INT, b - (NOT won_a)::INT) < 12 THEN 13 ELSE 16 + 3 * ((least(a - won_a::INT, b - (NOT won_a)::INT) - 12) // 3) END) AS over FROM cv0),
cv AS (SELECT match_id, round_num, won_a, a, b, before_, after_, after_ - before_ AS moved FROM open_ WHERE NOT over)
"""


def curve(s: Session) -> DataFrame:
    """Each round of a match that isn't decided yet: team A's chance before and after it."""
    w = Window.partitionBy("match_id").orderBy("round_num").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("nth")
    first = (n <= 12) | ((n > 24) & F.pmod(F.floor((n - 25) / 3), F.lit(4)).isin(1, 2))
    won = (F.col("winner") == "t") == first
    rows = s.rounds.select(*ROUND, won.alias("won_a")).withColumn("a", F.sum(F.col("won_a").cast("long")).over(w)).withColumn("b", F.sum((~F.col("won_a")).cast("long")).over(w))
    rows = rows.withColumn("a0", F.col("a") - F.col("won_a").cast("long")).withColumn("b0", F.col("b") - (~F.col("won_a")).cast("long"))
    table = F.broadcast(chance_table(s.spark))  # some thousand rows
    rows = rows.join(table.withColumnRenamed("chance", "after_"), ["a", "b"]).join(table.select(F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("chance").alias("before_")), ["a0", "b0"])
    least = F.least("a0", "b0")
    need = F.when(least < HALF, HALF + 1).otherwise(HALF + OVERTIME_HALF * (F.floor((least - HALF) / OVERTIME_HALF) + 1) + 1)
    return rows.where((F.col("a0") < need) & (F.col("b0") < need)).select(*ROUND, "won_a", "a", "b", "before_", "after_", (F.col("after_") - F.col("before_")).alias("moved"))


def _with_recursion(sql: str) -> str:
    """DuckDB wants RECURSIVE at the head of all common tables."""
    return sql.replace(", RECURSIVE_ walk", ", walk")


@on_session(_with_recursion(CHANCES_SQL) + "SELECT match_id, round_num, a::BIGINT AS score_a, b::BIGINT AS score_b, round(before_, 6) AS before, round(after_, 6) AS after, round(moved, 6) + 0.0 AS moved FROM cv", recursive=True)
def match_chances(s: Session) -> DataFrame:
    """The chance to win the match by the score, and what each round moved it by."""
    return curve(s).select(*ROUND, F.col("a").alias("score_a"), F.col("b").alias("score_b"), F.round("before_", 6).alias("before"), F.round("after_", 6).alias("after"), (F.round("moved", 6) + 0.0).alias("moved"))


@on_session(_with_recursion(CHANCES_SQL) + """, lo AS (SELECT 1.5 * (x.chance - y.chance) AS least FROM ch x, ch y WHERE x.a = 1 AND x.b = 0 AND y.a = 0 AND y.b = 0), rk AS (SELECT cv.*, row_number() OVER (PARTITION BY match_id ORDER BY round(abs(moved), 9) DESC, round_num) AS place, round(max(abs(moved)) OVER (PARTITION BY match_id), 9) AS most, lead(abs(moved)) OVER (PARTITION BY match_id ORDER BY round(abs(moved), 9) DESC, round_num) AS next_ FROM cv)
SELECT match_id, place, round_num, round(abs(moved), 6) AS moved, (place = 1 AND most >= round(least, 9))::BIGINT AS decisive, coalesce(place = 1 AND most >= round(least, 9) AND abs(moved) - next_ < 0.02, false)::BIGINT AS tied FROM rk, lo WHERE place <= 3""", recursive=True)
def decisive_rounds(s: Session) -> DataFrame:
    """The three rounds of a match that moved its chances most; the first is decisive if it moved them by half as much again as an even match's first round does, and tied if the next one comes near."""
    table = {(r["a"], r["b"]): r["chance"] for r in chance_table(s.spark).where("a + b <= 1").collect()}
    least = round(DECISIVE * (table[1, 0] - table[0, 0]), 9)
    w = Window.partitionBy("match_id").orderBy(F.desc("size"), "round_num")
    rows = curve(s).withColumn("size", F.round(F.abs("moved"), 9)).withColumn("place", F.row_number().over(w).cast("long")).withColumn("next", F.lead("size").over(w))
    first = (F.col("place") == 1) & (F.col("size") >= least)
    return rows.where(F.col("place") <= TOP).select("match_id", "place", "round_num", F.round("size", 6).alias("moved"), first.cast("long").alias("decisive"), F.coalesce(first & (F.col("size") - F.col("next") < TIE), F.lit(False)).cast("long").alias("tied"))


@on_session(""", n AS (SELECT match_id, nth, mode(side) AS side FROM rounds JOIN roster USING (match_id, round_num) WHERE player % 10 < 5 GROUP BY 1, 2), f AS (SELECT match_id, min(nth) FILTER (side = 'ct') AS turned FROM n GROUP BY 1)
SELECT match_id, turned, CASE WHEN turned = 13 THEN 'twelve' WHEN turned = 16 THEN 'fifteen' ELSE 'unknown' END AS format FROM f""")
def match_format(s: Session) -> DataFrame:
    """How long a half is, from the first round in which most of the team that began as t are ct."""
    sides = s.rounds.join(s.roster.where("player % 10 < 5"), ROUND).groupBy("match_id", "nth").agg(F.mode("side", True).alias("side"))
    turned = sides.groupBy("match_id").agg(F.min(F.when(F.col("side") == "ct", F.col("nth"))).alias("turned"))
    return turned.select("match_id", "turned", F.when(F.col("turned") == 13, "twelve").when(F.col("turned") == 16, "fifteen").otherwise("unknown").alias("format"))


@on_session("""SELECT k.match_id, k.round_num, k.event_seq, (SELECT max(t.tick) FROM kills t WHERE t.round_num = k.round_num AND t.tick < k.tick) AS before FROM kills k""")
def last_death_before(s: Session) -> DataFrame:
    """The tick of the last death before each one, equal ones left out."""
    return asof(s.kills.select(*ROUND, "tick", "event_seq"), s.kills.select(*ROUND, "tick", "event_seq"), ROUND, "tick", [], ["event_seq"], "backward", exact=False).select(*ROUND, "event_seq", F.col("r_tick").alias("before"))
