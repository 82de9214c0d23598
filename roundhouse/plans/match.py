"""What a match is and how it is told: format and teams, purchases, rounds of events, names, autopsies, contexts and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compat import average_rank, first_by, nearest_quantiles, ratio
from ..functions.geometry import cell, distance
from ..operators.joins import asof
from ..operators.sequences import islands
from ..sources.sessions import GRID, ROUND, TICKS, Session
from .chances import DELTAS_SQL, deaths, deltas
from .combat import BY, TRADE_WINDOW, opening
from .economy import BUYS_SQL, buys
from .mistakes import avenged
from .registry import on_session, query

#: What a map shows: its origin and units a pixel (fixed values of the sample sessions).
ORIGIN_X, ORIGIN_Y, UNITS = -50.0, 550.0, 2.0


@on_session("""SELECT e.match_id, e.round_num, e.event_seq FROM ev e JOIN rounds r ON r.match_id = e.match_id AND e."at" BETWEEN r.round_num * 14400 + r.freeze_end AND r.round_num * 14400 + r."end" """)
def events_in_rounds(s: Session) -> DataFrame:
    """Events of the corpus clock in the round that holds them: the last one that began by then, if it has not ended."""
    spans = s.rounds.select("match_id", F.col("round_num").alias("found"), (F.col("round_num") * TICKS + F.col("freeze_end")).alias("at"), (F.col("round_num") * TICKS + F.col("end")).alias("until"))
    rows = asof(s.ev.select("match_id", "at", "event_seq"), spans, ["match_id"], "at", ["found", "until"], ["found"])
    return rows.where("r_found is not null and at <= r_until").select("match_id", F.col("r_found").alias("round_num"), "event_seq")


@on_session("""SELECT s.match_id, s.round_num, s.player, s.weapon, e.equip, e.armour::BIGINT AS armour FROM states s JOIN rounds r USING (match_id, round_num) JOIN economy e ON e.round_num = s.round_num AND e.player = s.player WHERE s.tick = ((r.freeze_end + 599) // 600) * 600""")
def purchases(s: Session) -> DataFrame:
    """What each player holds and has at the first grid tick after the freeze."""
    when = s.rounds.select(*ROUND, (F.floor((F.col("freeze_end") + GRID - 1) / GRID) * GRID).alias("tick"))
    return s.states.join(when, [*ROUND, "tick"]).select(*BY, "weapon").join(s.economy.select(*BY, "equip", F.col("armour").cast("long").alias("armour")), BY)


@on_session("""SELECT match_id, player, CASE WHEN arg_min(side, round_num) = 't' THEN 'A' ELSE 'B' END AS team FROM roster WHERE (match_id, round_num) IN (SELECT match_id, min(round_num) FROM rounds GROUP BY 1) GROUP BY 1, 2""")
def teams(s: Session) -> DataFrame:
    """Who began as t is of team A."""
    first = s.rounds.groupBy("match_id").agg(F.min("round_num").alias("round_num"))
    return s.roster.join(first, ROUND).select("match_id", "player", F.when(F.col("side") == "t", "A").otherwise("B").alias("team"))


@on_session("""SELECT match_id, round_num FROM (SELECT match_id, round_num, side, lead(side) OVER (PARTITION BY match_id ORDER BY round_num) AS next_ FROM roster WHERE player % 10 = 0) WHERE next_ <> side""")
def half_ends(s: Session) -> DataFrame:
    """Rounds after which the sides change."""
    one = s.roster.where("player % 10 = 0").withColumn("next", F.lead("side").over(Window.partitionBy("match_id").orderBy("round_num")))
    return one.where("next <> side").select(*ROUND)


@on_session(""", d AS (SELECT match_id, median(defuse_tick - plant_tick) AS mid FROM bombs WHERE defuse_tick IS NOT NULL GROUP BY 1), f AS (SELECT match_id, list(v ORDER BY v) AS v FROM (SELECT match_id, round(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 6) AS v FROM states WINDOW w AS (PARTITION BY round_num, player ORDER BY tick)) WHERE v IS NOT NULL GROUP BY 1)
SELECT f.match_id, mid AS timer, round(f.v[round_even((len(f.v) - 1) * 0.995, 0)::INT + 1], 4) AS speed, CASE WHEN mid IS NOT NULL THEN CASE WHEN abs(mid / 40 - 64) <= abs(mid / 40 - 128) THEN 64 ELSE 128 END WHEN abs(f.v[round_even((len(f.v) - 1) * 0.995, 0)::INT + 1] - 250) <= 125 THEN 64 ELSE 128 END::BIGINT AS rate FROM f LEFT JOIN d USING (match_id)""")
def tick_rates(s: Session) -> DataFrame:
    """The likelier of two rates, by how long bombs take in the median; without any, by how fast players are at most."""
    timer = s.bombs.where("defuse_tick is not null").groupBy("match_id").agg(F.median(F.col("defuse_tick") - F.col("plant_tick")).alias("timer"))
    w = Window.partitionBy(*BY).orderBy("tick")
    speed = s.states.select("match_id", F.round(distance((F.col("x"), F.lag("x").over(w)), (F.col("y"), F.lag("y").over(w))), 6).alias("v"))
    fast = nearest_quantiles(speed, ["match_id"], "v", [0.995]).select("match_id", F.col("value").alias("speed"))
    rate = F.when(F.col("timer").isNotNull(), F.when(F.abs(F.col("timer") / 40 - 64) <= F.abs(F.col("timer") / 40 - 128), 64).otherwise(128)).when(F.abs(F.col("speed") - 250) <= 125, 64).otherwise(128)
    return fast.join(timer, "match_id", "left").select("match_id", "timer", F.round("speed", 4).alias("speed"), rate.cast("long").alias("rate"))


@query("""WITH k AS (SELECT s_suppkey, s_name, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS key FROM supplier), a(key, name) AS (VALUES ('supplier000000001', 'First Supplier'), ('supplier000000002', 'Second Supplier')) SELECT s_suppkey, coalesce(a.name, min(s_name) OVER (PARTITION BY k.key)) AS name FROM k LEFT JOIN a USING (key)""")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name for all spellings of one key; a table of aliases comes first."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", F.regexp_replace(F.lower("s_name"), "[^a-z0-9]", "").alias("key"))
    alias = spark.createDataFrame([("supplier000000001", "First Supplier"), ("supplier000000002", "Second Supplier")], "key string, alias string")
    return rows.join(F.broadcast(alias), "key", "left").join(rows.groupBy("key").agg(F.min("s_name").alias("one")), "key").select("s_suppkey", F.coalesce("alias", "one").alias("name"))


@on_session("""SELECT match_id, round_num, event_seq, cause FROM (SELECT b.match_id, b.round_num, b.event_seq, h.event_seq AS cause, count(*) OVER (PARTITION BY b.event_seq) AS n FROM blinds b JOIN shots h ON h.round_num = b.round_num AND h.tick // 200 + 1 = b.tick // 200) WHERE n = 1""")
def offset_causes(s: Session) -> DataFrame:
    """What happened a fixed time before, if just one thing did."""
    c = s.shots.select(*ROUND, (F.floor(F.col("tick") / 200) + 1).alias("slot"), F.col("event_seq").alias("cause"))
    rows = s.blinds.withColumn("slot", F.floor(F.col("tick") / 200)).join(c, [*ROUND, "slot"])
    return rows.groupBy(*ROUND, "event_seq").agg(F.count(F.lit(1)).alias("n"), F.min("cause").alias("cause")).where("n = 1").drop("n")


@on_session(""", f AS (SELECT DISTINCT b.round_num, b.event_seq, b.thrower FROM blinds b JOIN kills k ON k.round_num = b.round_num AND k.victim = b.victim AND k.tick >= b.tick AND k.tick <= b.tick + 900 AND k.attacker <> b.thrower AND k.attacker_side = b.thrower_side WHERE b.thrower_side <> b.victim_side) SELECT round_num, thrower AS player, count(*) AS converted FROM f GROUP BY 1, 2""")
def converted_flashes(s: Session) -> DataFrame:
    """Flashes whose victim a mate of the thrower killed soon after."""
    b = s.blinds.where("thrower_side <> victim_side").select(*ROUND, "victim", "thrower", "thrower_side", F.col("tick").alias("b"), F.col("event_seq").alias("seq"))
    hit = s.kills.join(b, [*ROUND, "victim"]).where((F.col("tick") >= F.col("b")) & (F.col("tick") <= F.col("b") + 900) & (F.col("attacker") != F.col("thrower")) & (F.col("attacker_side") == F.col("thrower_side")))
    return hit.select("round_num", "seq", F.col("thrower").alias("player")).distinct().groupBy("round_num", "player").agg(F.count(F.lit(1)).alias("converted"))


@on_session("""SELECT match_id, attacker AS player, round(coalesce(sum(dmg) FILTER (weapon = 'he'), 0), 4) AS he, round(coalesce(sum(dmg) FILTER (weapon = 'fire'), 0), 4) AS fire, count(*) FILTER (weapon IN ('he', 'fire')) AS hits FROM damages GROUP BY 1, 2""")
def grenade_damage(s: Session) -> DataFrame:
    rows = s.damages.groupBy("match_id", F.col("attacker").alias("player"))
    of = lambda w: F.round(F.coalesce(F.sum(F.when(F.col("weapon") == w, F.col("dmg"))), F.lit(0.0)), 4)
    return rows.agg(of("he").alias("he"), of("fire").alias("fire"), F.count_if(F.col("weapon").isin("he", "fire")).alias("hits"))


@on_session(""", r AS (SELECT match_id, round_num, thrower AS player, count(*) AS thrown, sum(duration) FILTER (thrower_side <> victim_side) AS seconds FROM blinds GROUP BY 1, 2, 3), u AS (SELECT b.round_num, b.thrower AS player, min(b.tick) - any_value(r.freeze_end) AS first_ FROM blinds b JOIN rounds r USING (round_num) GROUP BY 1, 2)
SELECT match_id, player, count(*) AS rounds, sum(thrown)::BIGINT AS thrown, round(coalesce(sum(seconds), 0) / nullif(sum(thrown), 0), 4) AS seconds_each, median(first_) AS usual_first FROM r JOIN u USING (round_num, player) GROUP BY 1, 2""")
def grenade_summary(s: Session) -> DataFrame:
    foe = F.col("thrower_side") != F.col("victim_side")
    r = s.blinds.groupBy(*ROUND, F.col("thrower").alias("player")).agg(F.count(F.lit(1)).alias("thrown"), F.sum(F.when(foe, F.col("duration"))).alias("seconds"), F.min("tick").alias("t")).join(s.rounds.select(*ROUND, "freeze_end"), ROUND)
    return r.groupBy("match_id", "player").agg(F.count(F.lit(1)).alias("rounds"), F.sum("thrown").alias("thrown"), F.round(ratio(F.coalesce(F.sum("seconds"), F.lit(0.0)), F.sum("thrown")), 4).alias("seconds_each"), F.median(F.col("t") - F.col("freeze_end")).alias("usual_first"))


@on_session(""", h AS (SELECT match_id, round_num, player FROM economy WHERE item = 'sniper'), e AS (SELECT h.*, min(t.tick) AS first_shot FROM h LEFT JOIN shots t ON t.round_num = h.round_num AND t.player = h.player GROUP BY 1, 2, 3), o AS (SELECT round_num, arg_min(attacker, (tick, event_seq)) AS player, arg_min(weapon, (tick, event_seq)) AS weapon FROM kills GROUP BY 1)
SELECT e.match_id, e.player, count(*) AS rounds, count(e.first_shot) AS engaged, count(*) FILTER (o.player = e.player) AS opened, round(100.0 * count(*) FILTER (o.player = e.player) / count(*), 4) AS opened_pct FROM e LEFT JOIN o USING (round_num) GROUP BY 1, 2""")
def sniper_rounds(s: Session) -> DataFrame:
    """Rounds with a sniper's weapon: those in which the player shot, and those that the player opened."""
    held = s.economy.where("item = 'sniper'").select(*BY).join(s.shots.groupBy(*BY).agg(F.min("tick").alias("first_shot")), BY, "left")
    rows = held.join(opening(s).select(*ROUND, F.col("attacker").alias("opener")), ROUND, "left").groupBy("match_id", "player")
    opened = F.count_if(F.col("opener") == F.col("player"))
    return rows.agg(F.count(F.lit(1)).alias("rounds"), F.count("first_shot").alias("engaged"), opened.alias("opened"), F.round(ratio(opened, F.count(F.lit(1)), 100.0), 4).alias("opened_pct"))


# ---- told


@on_session(BUYS_SQL + """, mx AS (SELECT match_id, round_num, side, avg(equip) AS equip FROM economy GROUP BY 1, 2, 3) SELECT a.match_id, a.round_num, round(a.equip, 2) AS t_equip, round(b.equip, 2) AS ct_equip, CASE WHEN abs(a.equip - b.equip) < 1500 THEN 'even' WHEN a.equip > b.equip THEN 't' ELSE 'ct' END AS richer FROM mx a JOIN mx b ON a.round_num = b.round_num AND a.side = 't' AND b.side = 'ct'""")
def economic_context(s: Session) -> DataFrame:
    """The mean equipment of both sides, and which is richer by what matters."""
    m = s.economy.groupBy(*ROUND).pivot("side", ["t", "ct"]).agg(F.avg("equip"))
    richer = F.when(F.abs(F.col("t") - F.col("ct")) < 1500, "even").when(F.col("t") > F.col("ct"), "t").otherwise("ct")
    return m.select(*ROUND, F.round("t", 2).alias("t_equip"), F.round("ct", 2).alias("ct_equip"), richer.alias("richer"))


AUTOPSY_SQL = DELTAS_SQL + f""", tdx AS (SELECT DISTINCT a.event_seq FROM kills a JOIN kills b ON a.round_num = b.round_num AND b.victim = a.attacker AND b.attacker_side = a.victim_side AND b.tick > a.tick AND b.tick - a.tick <= {TRADE_WINDOW}),
lz AS (SELECT r.match_id, r.round_num, CASE WHEN r.winner = 't' THEN 'ct' ELSE 't' END AS loser, r.nth FROM rounds r), opn AS (SELECT round_num, arg_min(victim_side, (tick, event_seq)) AS side, arg_min(event_seq, (tick, event_seq)) AS event_seq FROM kills GROUP BY 1),
bh AS (SELECT d.round_num, d.tick, d.event_seq, CASE WHEN l.loser = 't' THEN alive_t - alive_ct ELSE alive_ct - alive_t END AS lead_ FROM de d JOIN lz l USING (round_num)), bm AS (SELECT *, max(lead_) OVER (PARTITION BY round_num ORDER BY tick DESC, event_seq DESC ROWS UNBOUNDED PRECEDING) AS later FROM bh), bp AS (SELECT round_num, min(tick) FILTER (later < 0) AS behind_from FROM bm GROUP BY 1),
ut AS (SELECT l.round_num, count(*) AS untraded FROM kills k JOIN lz l ON l.round_num = k.round_num AND k.victim_side = l.loser WHERE k.event_seq NOT IN (FROM tdx) GROUP BY 1), us AS (SELECT l.round_num, min(t.tick) AS first_thrown FROM lz l JOIN (SELECT round_num, thrower_side AS side, tick FROM blinds UNION ALL SELECT round_num, side, tick FROM shots WHERE weapon IN ('he', 'fire')) t ON t.round_num = l.round_num AND t.side = l.loser GROUP BY 1)
"""


@on_session(AUTOPSY_SQL + """SELECT l.match_id, l.round_num, l.loser, coalesce(o.side = l.loser, false)::BIGINT AS lost_opening, coalesce(o.side = l.loser AND o.event_seq IN (FROM tdx), false)::BIGINT AS opening_avenged, bp.behind_from, coalesce(ut.untraded, 0) AS untraded, (coalesce(ut.untraded, 0) >= 2)::BIGINT AS many_untraded, (us.first_thrown IS NULL OR us.first_thrown >= coalesce(bp.behind_from, 99999))::BIGINT AS no_utility, (l.loser = 't' AND b.plant_tick IS NULL)::BIGINT AS no_plant, (l.loser = 'ct' AND b.plant_tick IS NOT NULL)::BIGINT AS lost_retake, (l.nth IN (12, 24))::BIGINT AS half_end
FROM lz l LEFT JOIN opn o USING (round_num) LEFT JOIN bp USING (round_num) LEFT JOIN ut USING (round_num) LEFT JOIN us USING (round_num) LEFT JOIN bombs b USING (round_num)""")
def round_autopsies(s: Session) -> DataFrame:
    """What went wrong for a round's losers: the opening, when they were behind for good, deaths that nobody avenged, no utility before that, no plant or a lost retake."""
    loser = s.rounds.select(*ROUND, "nth", F.when(F.col("winner") == "t", "ct").otherwise("t").alias("loser"))
    pairs = avenged(s).withColumn("traded", F.lit(True))
    first = opening(s).select(*ROUND, F.col("victim_side").alias("o_side"), "event_seq").join(pairs, [*ROUND, "event_seq"], "left").select(*ROUND, "o_side", F.coalesce("traded", F.lit(False)).alias("o_traded"))
    lead = F.when(F.col("loser") == "t", F.col("alive_t") - F.col("alive_ct")).otherwise(F.col("alive_ct") - F.col("alive_t"))
    w = Window.partitionBy(*ROUND).orderBy(F.desc("tick"), F.desc("event_seq")).rowsBetween(Window.unboundedPreceding, 0)
    behind = deaths(s).join(loser, ROUND).withColumn("later", F.max(lead).over(w)).groupBy(*ROUND).agg(F.min(F.when(F.col("later") < 0, F.col("tick"))).alias("behind_from"))
    lost = s.kills.join(loser, ROUND).where("victim_side = loser").join(pairs, [*ROUND, "event_seq"], "left_anti").groupBy(*ROUND).agg(F.count(F.lit(1)).alias("untraded"))
    thrown = s.blinds.select(*ROUND, F.col("thrower_side").alias("loser"), "tick").unionByName(s.shots.where("weapon in ('he', 'fire')").select(*ROUND, F.col("side").alias("loser"), "tick"))
    used = thrown.join(loser, [*ROUND, "loser"]).groupBy(*ROUND).agg(F.min("tick").alias("first_thrown"))
    rows = loser
    for part in (first, behind, lost, used, s.bombs.select(*ROUND, "plant_tick")):
        rows = rows.join(part, ROUND, "left")
    n = F.coalesce("untraded", F.lit(0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    return rows.select(
        *ROUND, "loser", flag(F.col("o_side") == F.col("loser")).alias("lost_opening"), flag((F.col("o_side") == F.col("loser")) & F.col("o_traded")).alias("opening_avenged"), "behind_from", n.alias("untraded"), (n >= 2).cast("long").alias("many_untraded"),
        flag(F.col("first_thrown").isNull() | (F.col("first_thrown") >= F.coalesce("behind_from", F.lit(99999)))).alias("no_utility"), flag((F.col("loser") == "t") & F.col("plant_tick").isNull()).alias("no_plant"), flag((F.col("loser") == "ct") & F.col("plant_tick").isNotNull()).alias("lost_retake"), F.col("nth").isin(12, 24).cast("long").alias("half_end"),
    )


@on_session("""SELECT match_id, round_num, event_seq, printf('%d:%02d', tick // 600, tick % 600 // 10) AS clock, upper(attacker_side) || ' ' || attacker || ' > ' || victim || CASE WHEN headshot = 1 THEN ' (head)' ELSE '' END AS told FROM kills""")
def told_kills(s: Session) -> DataFrame:
    """A line for each kill, with the round's clock."""
    clock = F.format_string("%d:%02d", F.floor(F.col("tick") / 600), F.floor(F.col("tick") % 600 / 10))
    line = F.concat(F.upper("attacker_side"), F.lit(" "), F.col("attacker").cast("string"), F.lit(" > "), F.col("victim").cast("string"), F.when(F.col("headshot") == 1, " (head)").otherwise(""))
    return s.kills.select(*ROUND, "event_seq", clock.alias("clock"), line.alias("told"))


@on_session(f"""SELECT event_seq, round((x - ({ORIGIN_X})) / {UNITS}, 4) AS px, round(({ORIGIN_Y} - y) / {UNITS}, 4) AS py, round((x - ({ORIGIN_X})) / {UNITS} * {UNITS} + ({ORIGIN_X}) - x, 6) + 0.0 AS back FROM ticks""")
def radar_points(s: Session) -> DataFrame:
    """Where a place is on the map, and that the way back gives the place."""
    px, py = (F.col("x") - ORIGIN_X) / UNITS, (F.lit(ORIGIN_Y) - F.col("y")) / UNITS
    return s.ticks.select("event_seq", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"), (F.round(px * UNITS + ORIGIN_X - F.col("x"), 6) + 0.0).alias("back"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(p_brand, '#', 'No'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '_+', ' ', 'g')) AS words, printf('%,.2f', p_retailprice) AS price FROM part""")
def words_and_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in camel case as words, and money with its commas."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_retailprice")
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace("p_brand", F.lit("#"), F.lit("No")), "([a-z])([A-Z])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2"), "_+", " ")
    return p.select("p_partkey", F.trim(words).alias("words"), F.format_string("%,.2f", "p_retailprice").alias("price"))


@on_session(DELTAS_SQL + """, m AS (SELECT match_id, round_num, sum(abs(delta)) AS moved, count(*) AS deaths FROM dl GROUP BY 1, 2) SELECT match_id, round_num, round(moved, 5) AS moved, deaths, nth FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(moved, 9) DESC, round_num) AS nth FROM m) WHERE nth <= 3""")
def suggested_rounds(s: Session) -> DataFrame:
    """The three rounds of a match whose chances went up and down most (a top-k report)."""
    m = deltas(s).groupBy(*ROUND).agg(F.sum(F.abs("delta")).alias("moved"), F.count(F.lit(1)).alias("deaths"))
    w = Window.partitionBy("match_id").orderBy(F.desc(F.round("moved", 9)), "round_num")
    return m.withColumn("nth", F.row_number().over(w).cast("long")).where("nth <= 3").select(*ROUND, F.round("moved", 5).alias("moved"), "deaths", "nth")


@on_session(BUYS_SQL + """SELECT r.match_id, '{"match":' || r.match_id || ',"rounds":[' || string_agg('{"round":' || r.nth || ',"winner":"' || r.winner || '","t":"' || a.class || '","ct":"' || b.class || '"}', ',' ORDER BY r.nth) || ']}' AS json FROM rounds r JOIN (SELECT round_num, min(class) AS class FROM buys WHERE side = 't' GROUP BY 1) a USING (round_num) JOIN (SELECT round_num, min(class) AS class FROM buys WHERE side = 'ct' GROUP BY 1) b USING (round_num) GROUP BY r.match_id""")
def insights(s: Session) -> DataFrame:
    """One document for each match: its rounds in order, with the winner and what both sides bought."""
    of = lambda side: buys(s).where(F.col("side") == side).groupBy(*ROUND).agg(F.min("class").alias(side))
    rows = s.rounds.select(*ROUND, "nth", "winner").join(of("t"), ROUND).join(of("ct"), ROUND)
    listed = F.array_sort(F.collect_list(F.struct(F.col("nth").alias("round"), "winner", "t", "ct")))  # at most as many as a match has rounds
    return rows.groupBy("match_id").agg(listed.alias("rounds")).select("match_id", F.to_json(F.struct(F.col("match_id").alias("match"), "rounds")).alias("json"))


@on_session(""", b AS (SELECT *, CASE WHEN place IS DISTINCT FROM lag(place) OVER q THEN 1 ELSE 0 END AS brk, sqrt((x - lag(x) OVER q) ** 2 + (y - lag(y) OVER q) ** 2) / 600 AS v FROM states WINDOW q AS (PARTITION BY round_num, player ORDER BY tick)), i AS (SELECT *, sum(brk) OVER (PARTITION BY round_num, player ORDER BY tick ROWS UNBOUNDED PRECEDING) AS isl FROM b),
g AS (SELECT side, round_num, player, isl, (row_number() OVER (PARTITION BY round_num, player, isl ORDER BY tick) - 1) // 4 AS win, v FROM i), u AS (SELECT side, round_num, player, isl, win, avg(coalesce(v, 0)) AS v FROM g GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = 4) SELECT side, count(*) AS windows, round(quantile_cont(v, 0.25), 6) AS p25, round(median(v), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75 FROM u GROUP BY 1""")
def window_speeds(s: Session) -> DataFrame:
    """Speeds in fixed windows within stays at a place."""
    q = Window.partitionBy(*BY).orderBy("tick")
    rows = s.states.withColumn("v", distance((F.col("x"), F.lag("x").over(q)), (F.col("y"), F.lag("y").over(q))) / 600)
    runs = islands(rows, BY, ["tick"], ~F.col("place").eqNullSafe(F.lag("place").over(q)))
    nth = F.row_number().over(Window.partitionBy(*BY, "island").orderBy("tick")) - 1
    u = runs.withColumn("win", F.floor(nth / 4)).groupBy("side", *BY, "island", "win").agg(F.avg(F.coalesce("v", F.lit(0.0))).alias("v"), F.count(F.lit(1)).alias("n")).where("n = 4")
    return u.groupBy("side").agg(F.count(F.lit(1)).alias("windows"), *[F.round(F.percentile("v", F.lit(p)), 6).alias(n) for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))])


@on_session(""", k AS (SELECT match_id, attacker AS player, count(*) AS n FROM kills GROUP BY 1, 2), d AS (SELECT match_id, attacker AS player, sum(dmg) AS v FROM damages GROUP BY 1, 2), j AS (SELECT match_id, player, coalesce(n, 0) AS n, round(coalesce(v, 0), 6) AS v FROM (SELECT DISTINCT match_id, player FROM roster) LEFT JOIN k USING (match_id, player) LEFT JOIN d USING (match_id, player)),
r AS (SELECT match_id, player, (rank() OVER (PARTITION BY match_id ORDER BY n DESC) + (count(*) OVER (PARTITION BY match_id, n) - 1) / 2.0 - 1) / 9 AS a, (rank() OVER (PARTITION BY match_id ORDER BY v DESC) + (count(*) OVER (PARTITION BY match_id, v) - 1) / 2.0 - 1) / 9 AS b FROM j) SELECT match_id, player, round((a + b) / 2, 5) AS place FROM (SELECT *, row_number() OVER (PARTITION BY match_id, player % 10 < 5 ORDER BY round(a + b, 9), player) AS nth FROM r) WHERE nth = 1""")
def leader_candidates(s: Session) -> DataFrame:
    """Who is first of a team by the mean of normalised ranks."""
    base = s.roster.select("match_id", "player").distinct()
    k = s.kills.groupBy("match_id", F.col("attacker").alias("player")).agg(F.count(F.lit(1)).alias("n"))
    d = s.damages.groupBy("match_id", F.col("attacker").alias("player")).agg(F.round(F.sum("dmg"), 6).alias("v"))
    j = base.join(k, ["match_id", "player"], "left").join(d, ["match_id", "player"], "left").na.fill(0, ["n"]).na.fill(0.0, ["v"])
    r = j.withColumn("a", (average_rank(["match_id"], "n", True) - 1) / 9).withColumn("b", (average_rank(["match_id"], "v", True) - 1) / 9).withColumn("team", F.col("player") % 10 < 5).withColumn("sum", F.round(F.col("a") + F.col("b"), 9))
    return first_by(r, ["match_id", "team"], "sum", "player").select("match_id", "player", F.round((F.col("a") + F.col("b")) / 2, 5).alias("place"))


@on_session(""", v AS (SELECT match_id, player, round(count(*) FILTER (k % 3 = 0) / count(*), 9) AS x FROM ev GROUP BY 1, 2), f AS (SELECT list(round(x, 9) ORDER BY round(x, 9)) AS v FROM v), p AS (SELECT v[round_even((len(v) - 1) * 0.75, 0)::INT + 1] AS at_ FROM f) SELECT round(at_, 6) AS floor, count(*) FILTER (x >= at_) AS above, count(*) FILTER (abs(x - at_) <= 0.02) AS near FROM v, p GROUP BY 1""")
def proposed_floors(s: Session) -> DataFrame:
    """A floor at three quarters of the players, who is above it, and how many are too near to call."""
    v = s.ev.groupBy("match_id", "player").agg(F.round(ratio(F.count_if(F.col("k") % 3 == 0), F.count(F.lit(1))), 9).alias("x"))
    at = nearest_quantiles(v, [], "x", [0.75]).select(F.col("value").alias("at"))
    return v.crossJoin(F.broadcast(at)).groupBy(F.round("at", 6).alias("floor")).agg(F.count_if(F.col("x") >= F.col("at")).alias("above"), F.count_if(F.abs(F.col("x") - F.col("at")) <= 0.02).alias("near"))  # one row


@on_session(""", a AS (SELECT match_id, attacker AS player, count(*) AS n FROM kills GROUP BY 1, 2), b AS (SELECT match_id, attacker AS player, count(*) + CASE WHEN attacker % 7 = 0 THEN 1 ELSE 0 END AS n FROM kills GROUP BY 1, 2) SELECT match_id, count(*) AS players, count(*) FILTER (a.n = b.n) AS equal, max(abs(a.n - b.n)) AS most_off FROM a JOIN b USING (match_id, player) GROUP BY 1""")
def official_counters(s: Session) -> DataFrame:
    """How many of a match's counters are those of another source."""
    a = s.kills.groupBy("match_id", F.col("attacker").alias("player")).agg(F.count(F.lit(1)).alias("n"))
    b = a.select("match_id", "player", (F.col("n") + (F.col("player") % 7 == 0).cast("int")).alias("m"))
    return a.join(b, ["match_id", "player"]).groupBy("match_id").agg(F.count(F.lit(1)).alias("players"), F.count_if(F.col("n") == F.col("m")).alias("equal"), F.max(F.abs(F.col("n") - F.col("m"))).alias("most_off"))


@on_session(""", g AS (SELECT floor(x / 64)::BIGINT AS cx, floor(y / 64)::BIGINT AS cy, count(*) AS n FROM states GROUP BY 1, 2 HAVING count(*) >= 3) SELECT cx, cy, n, (SELECT count(*) FROM g o WHERE abs(o.cx - g.cx) + abs(o.cy - g.cy) = 1) AS sides, ((SELECT count(*) FROM g o WHERE abs(o.cx - g.cx) + abs(o.cy - g.cy) = 1) = 4)::BIGINT AS inner_ FROM g""")
def region_edges(s: Session) -> DataFrame:
    """Cells that enough samples fall in, and how many of their four sides border on another one."""
    g = s.states.groupBy(cell(F.col("x"), 64).alias("cx"), cell(F.col("y"), 64).alias("cy")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = g.select("cx", "cy", steps.alias("d")).select((F.col("cx") + F.col("d.a")).alias("cx"), (F.col("cy") + F.col("d.b")).alias("cy")).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("sides"))
    sides = F.coalesce("sides", F.lit(0))
    return g.join(near, ["cx", "cy"], "left").select("cx", "cy", "n", sides.alias("sides"), (sides == 4).cast("long").alias("inner_"))
