"""Buys, matchups of equipment, the worth of kills by them, sub-ratings and the rating, and rates of impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import clip, first_by, ratio
from ..operators.joins import retaliation
from ..operators.rates import hierarchical
from ..sources.sessions import ROUND, Session
from .chances import SWING_SQL, swing_rows
from .combat import BY, PARTICIPATION_SQL, TRADE_WINDOW, participation
from .registry import on_session

CLASSES = ("eco", "force", "full")
#: The line of a kill's worth by the killer's chance to win with that equipment, through two published points, and its bounds: fixed values.
POINTS, LEAST_WORTH, MOST_WORTH = ((0.48, 1.10), (0.75, 0.54)), 0.30, 2.00
SLOPE = (POINTS[1][1] - POINTS[0][1]) / (POINTS[1][0] - POINTS[0][0])
BASE = POINTS[0][1] - SLOPE * POINTS[0][0]
CLEAN_DAMAGE = 60.0
#: Weights of the rating, and its intercept: fixed values of the metric.
RATING = {"clean": 0.256, "assisted": 0.023, "damage": 0.239, "survival": 0.111, "traded": 0.046, "kast": 0.22, "multi": 0.077, "swing": 0.516}
INTERCEPT = -0.406
#: Components that count by their distance from the mean in deviations, as it may be 0; scaled as the others are spread in the median.
SPREAD = ("swing",)


def buy_class(item: Column, armour: Column) -> Column:
    """What a side bought, from the class of weapon that most have and whether half have armour."""
    return F.when((item == "pistol") & armour, "pistol").when((item == "pistol") & ~armour, "eco").when(item.isin("rifle", "sniper") & armour, "full").otherwise("force")


def items(s: Session) -> DataFrame:
    """(match_id, round_num, side, item, armour, weight): the classes of weapon that most of a side have; of tied ones each its part."""
    side = Window.partitionBy(*ROUND, "side")
    n = s.economy.groupBy(*ROUND, "side", "item").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("armour").cast("int")).alias("a"))
    armour = F.sum("a").over(side) / F.sum("n").over(side) >= 0.5
    top = n.withColumn("armour", armour).withColumn("rk", F.rank().over(side.orderBy(F.desc("n")))).where("rk = 1")
    return top.select(*ROUND, "side", "item", "armour", (1.0 / F.count(F.lit(1)).over(side)).alias("weight"))


def buys(s: Session) -> DataFrame:
    return items(s).groupBy(*ROUND, "side", buy_class(F.col("item"), F.col("armour")).alias("class")).agg(F.sum("weight").alias("weight"))


BUYS_SQL = """, ar AS (SELECT round_num, side, avg(armour::INT) >= 0.5 AS armour FROM economy GROUP BY 1, 2), it AS (SELECT match_id, round_num, side, item, count(*) AS n FROM economy GROUP BY ALL),
md AS (SELECT *, rank() OVER (PARTITION BY round_num, side ORDER BY n DESC) AS rk FROM it), tw AS (SELECT match_id, round_num, side, item, armour, 1.0::DOUBLE / count(*) OVER (PARTITION BY round_num, side) AS weight FROM md JOIN ar USING (round_num, side) WHERE rk = 1),
buys AS (SELECT match_id, round_num, side, CASE WHEN item = 'pistol' AND armour THEN 'pistol' WHEN item = 'pistol' THEN 'eco' WHEN item IN ('rifle', 'sniper') AND armour THEN 'full' ELSE 'force' END AS class, sum(weight) AS weight FROM tw GROUP BY ALL)
"""


@on_session(BUYS_SQL + "SELECT match_id, round_num, side, class, round(weight, 4) AS weight FROM buys")
def buy_classes(s: Session) -> DataFrame:
    return buys(s).select(*ROUND, "side", "class", F.round("weight", 4).alias("weight"))


MATCHUPS_SQL = BUYS_SQL + """, mu0 AS (SELECT a.side, a.item, b.item AS other, a.weight * b.weight AS w, (r.winner = a.side)::INT::DOUBLE AS won FROM tw a JOIN tw b ON a.round_num = b.round_num AND a.side <> b.side JOIN rounds r ON r.round_num = a.round_num),
l1 AS (SELECT side, sum(won * w) / sum(w) AS rate FROM mu0 GROUP BY 1), l2 AS (SELECT m.side, m.item, sum(w) AS n, sum(w) / (sum(w) + 20) * sum(won * w) / sum(w) + (1 - sum(w) / (sum(w) + 20)) * any_value(l1.rate) AS rate FROM mu0 m JOIN l1 USING (side) GROUP BY 1, 2),
mu AS (SELECT m.side, m.item, m.other, sum(w) AS n, sum(w) / (sum(w) + 20) * sum(won * w) / sum(w) + (1 - sum(w) / (sum(w) + 20)) * any_value(l2.rate) AS rate FROM mu0 m JOIN l2 USING (side, item) GROUP BY 1, 2, 3)
"""


def matchups(s: Session) -> DataFrame:
    """(side, item, other, n, rate, weak): how often a side with one class of weapon beats another, shrunk to its own class's rate, and that to the side's."""
    w = items(s).select(*ROUND, "side", "item", "weight")
    theirs = w.select(*ROUND, F.when(F.col("side") == "t", "ct").otherwise("t").alias("side"), F.col("item").alias("other"), F.col("weight").alias("other_weight"))
    rows = w.join(theirs, [*ROUND, "side"]).join(s.rounds.select(*ROUND, "winner"), ROUND)
    rows = rows.select("side", "item", "other", (F.col("weight") * F.col("other_weight")).alias("w"), (F.col("winner") == F.col("side")).cast("double").alias("won"))
    return hierarchical(rows, [["side"], ["side", "item"], ["side", "item", "other"]], "won", "w")


@on_session(MATCHUPS_SQL + "SELECT side, item, other, round(n, 4) AS n, round(rate, 6) AS rate, (n < 20)::BIGINT AS weak FROM mu")
def weapon_matchups(s: Session) -> DataFrame:
    return matchups(s).select("side", "item", "other", F.round("n", 4).alias("n"), F.round("rate", 6).alias("rate"), F.col("weak").cast("long").alias("weak"))


def worth(rate: Column) -> Column:
    """What a kill counts for: less where the killer's side was likelier to win. An unknown matchup is even."""
    return clip(F.lit(BASE) + F.lit(SLOPE) * F.coalesce(rate, F.lit(0.5)), LEAST_WORTH, MOST_WORTH)


WORTH_SQL = f"greatest({LEAST_WORTH}, least({MOST_WORTH}, {BASE!r} + {SLOPE!r} * coalesce(u.rate, 0.5)))"
KILLS_SQL = MATCHUPS_SQL + f""", kw AS (SELECT k.*, {WORTH_SQL} AS worth FROM kills k JOIN economy a ON a.round_num = k.round_num AND a.player = k.attacker JOIN economy v ON v.round_num = k.round_num AND v.player = k.victim LEFT JOIN mu u ON u.side = k.attacker_side AND u.item = a.item AND u.other = v.item),
cl AS (SELECT k.event_seq, coalesce(sum(d.dmg), 0) >= {CLEAN_DAMAGE} AS clean FROM kills k LEFT JOIN damages d ON d.round_num = k.round_num AND d.attacker = k.attacker AND d.victim = k.victim GROUP BY 1)
"""


def weighed(s: Session, rows: DataFrame) -> DataFrame:
    """rows with attacker and victim, with the worth of what one does to the other."""
    have = s.economy.select(*ROUND, "player", "item")
    as_ = lambda who, c: have.select(*ROUND, F.col("player").alias(who), F.col("item").alias(c))
    table = F.broadcast(matchups(s).select(F.col("side").alias("attacker_side"), "item", "other", "rate"))  # sides by classes by classes
    return rows.join(as_("attacker", "item"), [*ROUND, "attacker"]).join(as_("victim", "other"), [*ROUND, "victim"]).join(table, ["attacker_side", "item", "other"], "left").withColumn("worth", worth(F.col("rate"))).drop("rate")


@on_session(KILLS_SQL + "SELECT match_id, round_num, event_seq, attacker, round(worth, 6) AS worth, clean::BIGINT AS clean FROM kw JOIN cl USING (event_seq)")
def kill_worths(s: Session) -> DataFrame:
    return kills_weighed(s).select(*ROUND, "event_seq", "attacker", F.round("worth", 6).alias("worth"), F.col("clean").cast("long").alias("clean"))


def kills_weighed(s: Session) -> DataFrame:
    """Kills with their worth, and whether the killer had done enough damage to the victim in the round."""
    dealt = s.damages.groupBy(*ROUND, "attacker", "victim").agg(F.sum("dmg").alias("dealt"))
    return weighed(s, s.kills).join(dealt, [*ROUND, "attacker", "victim"], "left").withColumn("clean", F.coalesce("dealt", F.lit(0.0)) >= CLEAN_DAMAGE)


SUBS_SQL = KILLS_SQL + PARTICIPATION_SQL + SWING_SQL + f""", pk AS (SELECT attacker AS player, sum(worth) AS kills, sum(worth) FILTER (clean) AS clean FROM kw JOIN cl USING (event_seq) GROUP BY 1),
ps AS (SELECT assister AS player, sum(worth) AS assisted FROM kw WHERE assister IS NOT NULL GROUP BY 1), pm AS (SELECT player, sum((n - 1) * worth) AS multi FROM (SELECT attacker AS player, round_num, count(*) AS n, avg(worth) AS worth FROM kw GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1),
pd AS (SELECT d.attacker AS player, sum(dmg * {WORTH_SQL}) AS damage FROM damages d JOIN economy a ON a.round_num = d.round_num AND a.player = d.attacker JOIN economy v ON v.round_num = d.round_num AND v.player = d.victim LEFT JOIN mu u ON u.side = d.attacker_side AND u.item = a.item AND u.other = v.item GROUP BY 1),
pw AS (SELECT player, sum(credit) AS swing FROM cred GROUP BY 1),
sb AS (SELECT match_id, p.player, count(*) AS rounds, coalesce(any_value(pk.kills), 0) / count(*) AS kills, coalesce(any_value(pk.clean), 0) / count(*) AS clean, coalesce(any_value(assisted), 0) / count(*) AS assisted, coalesce(any_value(damage), 0) / count(*) AS damage, avg(survived::INT) AS survival,
 avg((traded AND NOT survived)::INT) AS traded, avg((killed OR assisted_ OR survived OR traded)::INT) AS kast, coalesce(any_value(multi), 0) / count(*) AS multi, coalesce(any_value(swing), 0) / count(*) AS swing FROM (SELECT * RENAME (assisted AS assisted_) FROM part) p LEFT JOIN pk USING (player) LEFT JOIN ps USING (player) LEFT JOIN pm USING (player) LEFT JOIN pd USING (player) LEFT JOIN pw USING (player) GROUP BY 1, 2)
"""


def sub_ratings(s: Session) -> DataFrame:
    """Per player of a match: weighted kills, clean and assisted ones, damage, survival, avenged deaths, participation, multiple kills and what they moved the rounds by."""
    k = kills_weighed(s)
    per = k.groupBy(*ROUND, F.col("attacker").alias("player")).agg(F.sum("worth").alias("kills"), F.sum(F.when(F.col("clean"), F.col("worth")).otherwise(0.0)).alias("clean"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("multi", F.when(F.col("n") >= 2, (F.col("n") - 1) * F.col("kills") / F.col("n")).otherwise(0.0)).drop("n")
    helped = k.where("assister is not null").groupBy(*ROUND, F.col("assister").alias("player")).agg(F.sum("worth").alias("helped"))
    damage = weighed(s, s.damages).groupBy(*ROUND, F.col("attacker").alias("player")).agg(F.sum(F.col("dmg") * F.col("worth")).alias("damage"))
    took = F.col("killed") | F.col("assisted") | F.col("survived") | F.col("traded")
    rows = participation(s).select(*BY, "side", F.col("survived").cast("double").alias("survival"), (F.col("traded") & ~F.col("survived")).cast("double").alias("traded"), took.cast("double").alias("kast"))
    swing = swing_rows(s).groupBy(*BY).agg(F.sum("credit").alias("swing"))
    rows = rows.join(per, BY, "left").join(helped.withColumnRenamed("helped", "assisted"), BY, "left").join(damage, BY, "left").join(swing, BY, "left")
    return rows.na.fill(0.0, ["kills", "clean", "multi", "assisted", "damage", "swing"])


def _subs(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rounds"), *[F.avg(c).alias(c) for c in ("kills", *RATING)])


@on_session(SUBS_SQL + "SELECT match_id, player, rounds, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("kills", *RATING)) + " FROM sb")
def rating_components(s: Session) -> DataFrame:
    return _subs(sub_ratings(s), ["match_id", "player"]).select("match_id", "player", "rounds", *[(F.round(c, 6) + 0.0).alias(c) for c in ("kills", *RATING)])


SPREADS = ", ".join(f"s_{c} / m_{c}" for c in RATING if c not in SPREAD)


@on_session(SUBS_SQL + ", m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in RATING) + f" FROM sb) SELECT match_id, player, round({INTERCEPT} + " + " + ".join(f"{w} * " + (f"{c} / m_{c}" if c not in SPREAD else f"(1 + ({c} - m_{c}) / s_{c} * list_aggregate([{SPREADS}], 'median'))") for c, w in RATING.items()) + ", 5) AS rating, (rounds < 30)::BIGINT AS weak FROM sb, m")
def rating(s: Session) -> DataFrame:
    """Each component over its corpus mean (swing by its deviation), weighted, summed."""
    subs = _subs(sub_ratings(s), ["match_id", "player"])
    m = subs.agg(*[f(c).alias(f"{n}_{c}") for c in RATING for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    spreads = F.array_sort(F.array(*[ratio(f"s_{c}", f"m_{c}") for c in RATING if c not in SPREAD]))
    spread = F.element_at(spreads, (len(RATING) - len(SPREAD) + 1) // 2)  # an odd number of them
    norm = lambda c: ratio(c, f"m_{c}") if c not in SPREAD else 1 + ratio(F.col(c) - F.col(f"m_{c}"), f"s_{c}") * spread
    total = sum((F.lit(w) * norm(c) for c, w in RATING.items()), F.lit(INTERCEPT))
    return subs.crossJoin(F.broadcast(m)).select("match_id", "player", F.round(total, 5).alias("rating"), (F.col("rounds") < 30).cast("long").alias("weak"))  # one row


@on_session(KILLS_SQL + PARTICIPATION_SQL + """, pk AS (SELECT attacker AS player, attacker_side AS side, sum(worth) AS kills FROM kw GROUP BY 1, 2), sb AS (SELECT p.match_id, p.player, p.side, count(*) AS rounds, coalesce(any_value(pk.kills), 0) / count(*) AS kills, avg(p.survived::INT) AS survival FROM part p LEFT JOIN pk USING (player, side) GROUP BY 1, 2, 3)
SELECT match_id, player, max(rounds) FILTER (side = 't') AS t_rounds, round(max(kills) FILTER (side = 't'), 6) AS t_kills, round(max(survival) FILTER (side = 't'), 6) AS t_survival, max(rounds) FILTER (side = 'ct') AS ct_rounds, round(max(kills) FILTER (side = 'ct'), 6) AS ct_kills, round(max(survival) FILTER (side = 'ct'), 6) AS ct_survival FROM sb GROUP BY 1, 2""")
def side_components(s: Session) -> DataFrame:
    """The components by side, wide."""
    subs = _subs(sub_ratings(s), ["match_id", "player", "side"])
    return subs.groupBy("match_id", "player").pivot("side", ["t", "ct"]).agg(F.max("rounds").alias("rounds"), F.round(F.max("kills"), 6).alias("kills"), F.round(F.max("survival"), 6).alias("survival"))


@on_session(SWING_SQL + ", q AS (SELECT round_num, player, sum(credit) AS x FROM cred GROUP BY 1, 2) SELECT o.match_id, o.player, o.side, count(*) AS rounds, round(avg(coalesce(x, 0)), 6) + 0.0 AS swing FROM roster o LEFT JOIN q USING (round_num, player) GROUP BY 1, 2, 3")
def swing_by_side(s: Session) -> DataFrame:
    q = swing_rows(s).groupBy(*BY).agg(F.sum("credit").alias("x"))
    return s.roster.join(q, BY, "left").groupBy("match_id", "player", "side").agg(F.count(F.lit(1)).alias("rounds"), (F.round(F.avg(F.coalesce("x", F.lit(0.0))), 6) + 0.0).alias("swing"))


# ---- impact

SITUATIONS_SQL = """, mo AS (SELECT round_num, victim AS player, min(tick) AS died FROM kills GROUP BY 1, 2), si AS (SELECT o.match_id, o.round_num, o.player, o.side, (r.winner = o.side)::BIGINT AS won, (m.died IS NULL)::BIGINT AS lived, (SELECT count(*) FROM kills k WHERE k.round_num = o.round_num AND k.attacker = o.player AND k.tick >= b.plant_tick) AS kills
 FROM roster o JOIN bombs b USING (match_id, round_num) JOIN rounds r USING (match_id, round_num) LEFT JOIN mo m ON m.round_num = o.round_num AND m.player = o.player WHERE m.died IS NULL OR m.died >= b.plant_tick)
"""


def situations(s: Session) -> DataFrame:
    """Who is alive when the bomb is planted: kills after it, whether the player's side won, whether the player lived."""
    plant = s.bombs.select(*ROUND, "plant_tick")
    died = s.kills.groupBy(*ROUND, F.col("victim").alias("player")).agg(F.min("tick").alias("died"))
    after = s.kills.join(plant, ROUND).where("tick >= plant_tick").groupBy(*ROUND, F.col("attacker").alias("player")).agg(F.count(F.lit(1)).alias("kills"))
    alive = s.roster.join(plant, ROUND).join(s.rounds.select(*ROUND, "winner"), ROUND).join(died, BY, "left").where("died is null or died >= plant_tick")
    return alive.join(after, BY, "left").select(*BY, "side", (F.col("winner") == F.col("side")).cast("long").alias("won"), F.col("died").isNull().cast("long").alias("lived"), F.coalesce("kills", F.lit(0)).alias("kills"))


@on_session(SITUATIONS_SQL + "SELECT * FROM si")
def post_plant(s: Session) -> DataFrame:
    return situations(s)


IMPACT = (
    ("he_damage", "he_dealt", "he_thrown"), ("fire_damage", "fire_dealt", "fire_thrown"), ("blinded_per_flash", "blinded", "flashes"), ("blind_seconds_per_flash", "blind_seconds", "flashes"), ("team_seconds_per_flash", "team_seconds", "flashes"),
    ("post_plant_won", "won_t", "alive_t"), ("post_plant_kills", "kills_t", "alive_t"), ("post_plant_lived", "lived_t", "alive_t"), ("retakes_won", "won_ct", "alive_ct"), ("retake_kills", "kills_ct", "alive_ct"), ("retakes_lived", "lived_ct", "alive_ct"),
    ("openings_t", "opened_t", "duels_t"), ("openings_ct", "opened_ct", "duels_ct"), *[(f"adr_{c}", f"dealt_{c}", f"rounds_{c}") for c in CLASSES], *[(f"kast_{c}", f"took_{c}", f"rounds_{c}") for c in CLASSES],
    ("kills_against_full", "kills_full", "against_full"), ("kills_against_eco", "kills_eco", "against_eco"),
)
_sides = lambda f: [f(x) for x in ("t", "ct")]
IMPACT_SQL = SITUATIONS_SQL + BUYS_SQL + PARTICIPATION_SQL + f""", i1 AS (SELECT attacker AS player, sum(dmg) FILTER (weapon = 'he') AS he_dealt, sum(dmg) FILTER (weapon = 'fire') AS fire_dealt FROM damages GROUP BY 1), i2 AS (SELECT player, count(*) FILTER (weapon = 'he') AS he_thrown, count(*) FILTER (weapon = 'fire') AS fire_thrown FROM shots GROUP BY 1),
i3 AS (SELECT thrower AS player, count(*) AS flashes, count(*) FILTER (thrower_side <> victim_side) AS blinded, sum(duration) FILTER (thrower_side <> victim_side) AS blind_seconds, sum(duration) FILTER (thrower_side = victim_side AND thrower <> victim) AS team_seconds FROM blinds GROUP BY 1),
i4 AS (SELECT player, {", ".join(_sides(lambda x: f"count(*) FILTER (side = '{x}') AS alive_{x}, sum(won) FILTER (side = '{x}') AS won_{x}, sum(kills) FILTER (side = '{x}') AS kills_{x}, sum(lived) FILTER (side = '{x}') AS lived_{x}"))} FROM si GROUP BY 1),
op AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY round_num ORDER BY tick, event_seq) AS n FROM kills) WHERE n = 1), i5 AS (SELECT player, {", ".join(_sides(lambda x: f"count(*) FILTER (side = '{x}') AS duels_{x}, sum(w) FILTER (side = '{x}') AS opened_{x}"))} FROM (SELECT attacker AS player, attacker_side AS side, 1 AS w FROM op UNION ALL SELECT victim, victim_side, 0 FROM op) GROUP BY 1),
pr AS (SELECT p.round_num, p.player, p.side, (killed OR assisted OR survived OR traded)::INT AS took, coalesce((SELECT sum(dmg) FROM damages d WHERE d.round_num = p.round_num AND d.attacker = p.player), 0) AS dealt, (SELECT count(*) FROM kills k WHERE k.round_num = p.round_num AND k.attacker = p.player) AS kills FROM part p),
i6 AS (SELECT player, {", ".join(f"sum(weight * dealt) FILTER (class = '{c}') AS dealt_{c}, sum(weight * took) FILTER (class = '{c}') AS took_{c}, sum(weight) FILTER (class = '{c}') AS rounds_{c}" for c in CLASSES)} FROM pr JOIN buys USING (round_num, side) GROUP BY 1),
i7 AS (SELECT player, {", ".join(f"sum(weight * kills) FILTER (class = '{c}') AS kills_{c}, sum(weight) FILTER (class = '{c}') AS against_{c}" for c in ("full", "eco"))} FROM pr JOIN buys b ON b.round_num = pr.round_num AND b.side <> pr.side GROUP BY 1),
i8 AS (SELECT player, median(gap) AS trade_time FROM (SELECT b.attacker AS player, b.event_seq, min(b.tick - a.tick) AS gap FROM kills a JOIN kills b ON a.round_num = b.round_num AND b.victim = a.attacker AND b.attacker_side = a.victim_side AND b.tick > a.tick AND b.tick - a.tick <= {TRADE_WINDOW} GROUP BY 1, 2) GROUP BY 1)
"""


@on_session(IMPACT_SQL + "SELECT match_id, o.player, " + ", ".join(f"round(coalesce({n}, 0) / nullif({d}, 0) + 1e-9::DOUBLE, 4) AS {name}" for name, n, d in IMPACT) + ", trade_time FROM (SELECT DISTINCT match_id, player FROM roster) o " + " ".join(f"LEFT JOIN i{i} USING (player)" for i in range(1, 9)))
def impact_rates(s: Session) -> DataFrame:
    """What a player's grenades, situations, openings and rounds by class of buy come to: numerators over denominators, null over none."""
    if_ = lambda c, x="1": F.sum(F.when(c, F.expr(x)).otherwise(0))
    of = lambda df, who, *a: df.groupBy(F.col(who).alias("player")).agg(*a)
    dealt = of(s.damages, "attacker", if_(F.col("weapon") == "he", "dmg").alias("he_dealt"), if_(F.col("weapon") == "fire", "dmg").alias("fire_dealt"))
    thrown = of(s.shots, "player", if_(F.col("weapon") == "he").alias("he_thrown"), if_(F.col("weapon") == "fire").alias("fire_thrown"))
    foe, mate = F.col("thrower_side") != F.col("victim_side"), (F.col("thrower_side") == F.col("victim_side")) & (F.col("thrower") != F.col("victim"))
    flashes = of(s.blinds, "thrower", F.count(F.lit(1)).alias("flashes"), if_(foe).alias("blinded"), if_(foe, "duration").alias("blind_seconds"), if_(mate, "duration").alias("team_seconds"))
    side = lambda x: F.col("side") == x
    plants = of(situations(s), "player", *[a for x in ("t", "ct") for a in (if_(side(x)).alias(f"alive_{x}"), if_(side(x), "won").alias(f"won_{x}"), if_(side(x), "kills").alias(f"kills_{x}"), if_(side(x), "lived").alias(f"lived_{x}"))])
    first = first_by(s.kills, ROUND, "tick", "event_seq")
    duel = F.explode(F.array(F.struct(F.col("attacker").alias("player"), F.col("attacker_side").alias("side"), F.lit(1).alias("w")), F.struct(F.col("victim").alias("player"), F.col("victim_side").alias("side"), F.lit(0).alias("w"))))
    openings = of(first.select(duel.alias("d")).select("d.*"), "player", *[a for x in ("t", "ct") for a in (if_(side(x)).alias(f"duels_{x}"), if_(side(x), "w").alias(f"opened_{x}"))])
    took = (F.col("killed") | F.col("assisted") | F.col("survived") | F.col("traded")).cast("int")
    per = participation(s).select(*BY, "side", took.alias("took"))
    per = per.join(s.damages.groupBy(*ROUND, F.col("attacker").alias("player")).agg(F.sum("dmg").alias("dealt")), BY, "left").join(s.kills.groupBy(*ROUND, F.col("attacker").alias("player")).agg(F.count(F.lit(1)).alias("kills")), BY, "left").na.fill(0)
    classes = buys(s)
    own = of(per.join(classes, [*ROUND, "side"]), "player", *[a for c in CLASSES for a in (if_(F.col("class") == c, "weight * dealt").alias(f"dealt_{c}"), if_(F.col("class") == c, "weight * took").alias(f"took_{c}"), if_(F.col("class") == c, "weight").alias(f"rounds_{c}"))])
    theirs = classes.withColumn("side", F.when(F.col("side") == "t", "ct").otherwise("t"))
    against = of(per.join(theirs, [*ROUND, "side"]), "player", *[a for c in ("full", "eco") for a in (if_(F.col("class") == c, "weight * kills").alias(f"kills_{c}"), if_(F.col("class") == c, "weight").alias(f"against_{c}"))])
    pairs = retaliation(s.kills, ROUND, TRADE_WINDOW).groupBy(F.col("then_attacker").alias("player"), "then_event_seq").agg(F.min(F.col("then_tick") - F.col("first_tick")).alias("gap"))
    out = s.roster.select("match_id", "player").distinct()
    for part in (dealt, thrown, flashes, plants, openings, own, against, of(pairs, "player", F.median("gap").alias("trade_time"))):
        out = out.join(part, "player", "left")
    return out.select("match_id", "player", *[F.round(ratio(F.coalesce(n, F.lit(0)), d) + 1e-9, 4).alias(name) for name, n, d in IMPACT], "trade_time")
