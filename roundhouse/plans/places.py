"""Places, areas, roles and movement between places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import first_by, ratio
from ..functions.geometry import distance
from ..operators.sequences import islands, majority
from ..sources.sessions import ROUND, Session, nth_round, side_of
from .combat import BY, first_contact
from .registry import on_session

#: Places of each area: fixed values of the sample sessions.
AREAS = {"p0": "A", "p1": "A", "p2": "A", "p3": "mid", "p4": "mid", "p5": "B", "p6": "B", "p7": "B"}
AREA_SQL = "CASE WHEN place IN ('p0', 'p1', 'p2') THEN 'A' WHEN place IN ('p3', 'p4') THEN 'mid' ELSE 'B' END"


def area(place: str = "place"):
    return F.create_map(*[F.lit(x) for kv in AREAS.items() for x in kv])[F.col(place)]


SHARES_SQL = f", sh AS (SELECT match_id, round_num, player, side, {AREA_SQL} AS area, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY match_id, round_num, player) AS share FROM ticks GROUP BY 1, 2, 3, 4, 5), hm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, round_num, player ORDER BY n DESC, area) AS nth FROM sh) WHERE nth = 1)\n"


def shares(s: Session) -> DataFrame:
    """Samples and share of each round and player by area."""
    n = s.ticks.groupBy(*BY, "side", area().alias("area")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*BY)))


def homes(s: Session) -> DataFrame:
    return first_by(shares(s), BY, F.desc("n"), "area")


@on_session(SHARES_SQL + "SELECT match_id, round_num, player, area, n, round(share, 4) AS share FROM sh")
def area_shares(s: Session) -> DataFrame:
    return shares(s).select(*BY, "area", "n", F.round("share", 4).alias("share"))


@on_session(SHARES_SQL + """, c AS (SELECT match_id, player, area, count(*) AS n FROM hm GROUP BY 1, 2, 3), k AS (SELECT *, rank() OVER (PARTITION BY match_id, player ORDER BY n DESC) AS rk FROM c), a AS (SELECT match_id, player, CASE WHEN count(*) = 1 THEN any_value(area) END AS anchor FROM k WHERE rk = 1 GROUP BY 1, 2)
SELECT a.match_id, a.player, a.anchor, count(*) FILTER (hm.area <> a.anchor) AS rotated, round(avg(hm.share) FILTER (hm.area = a.anchor) + 1e-9::DOUBLE, 4) AS held FROM a JOIN hm USING (match_id, player) GROUP BY 1, 2, 3""")
def anchors(s: Session) -> DataFrame:
    """The area a player mostly is in (none if tied), rounds elsewhere, and the share of time held in rounds there."""
    h = homes(s)
    a = majority(h, ["match_id", "player"], "area", "anchor")
    there = F.col("area") == F.col("anchor")
    out = h.join(a, ["match_id", "player"]).groupBy("match_id", "player", "anchor")
    return out.agg(F.count_if(~there).alias("rotated"), F.round(F.avg(F.when(there, F.col("share"))) + 1e-9, 4).alias("held"))


@on_session(SHARES_SQL + """, m AS (SELECT a.match_id, a.round_num, a.player, a.area AS own, b.area, count(*) AS n FROM hm a JOIN hm b ON a.round_num = b.round_num AND a.side = b.side AND a.player <> b.player GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY round_num, player ORDER BY n DESC) AS rk FROM m),
g AS (SELECT match_id, round_num, player, own, CASE WHEN count(*) = 1 THEN any_value(area) END AS others FROM k WHERE rk = 1 GROUP BY 1, 2, 3, 4) SELECT match_id, round_num, player, own, others, coalesce(own <> others, false)::BIGINT AS lurk FROM g""")
def lurkers(s: Session) -> DataFrame:
    """Whether a player is elsewhere than most of the others of the side; a tie is no majority."""
    h = homes(s).select(*BY, "side", "area")
    mates = h.select(*BY, "side", F.col("area").alias("own")).join(h.select(*ROUND, "side", F.col("player").alias("mate"), "area"), [*ROUND, "side"]).where("player <> mate")
    others = majority(mates, [*BY, "own"], "area", "others")
    return others.select(*BY, "own", "others", F.coalesce(F.col("own") != F.col("others"), F.lit(False)).cast("long").alias("lurk"))


@on_session(""", c AS (SELECT place, avg(x) AS x, avg(y) AS y FROM ticks GROUP BY 1), a AS (SELECT x, y FROM c WHERE place = 'p0'), b AS (SELECT x, y FROM c WHERE place = 'p7'), d AS (SELECT c.place, sqrt((c.x-a.x)**2 + (c.y-a.y)**2) AS da, sqrt((c.x-b.x)**2 + (c.y-b.y)**2) AS db FROM c, a, b)
SELECT place, round(da / nullif(da + db, 0), 4) AS towards, CASE WHEN da / nullif(da + db, 0) < 0.4 THEN 'A' WHEN da / nullif(da + db, 0) > 0.6 THEN 'B' ELSE 'mid' END AS area FROM d""")
def derived_areas(s: Session) -> DataFrame:
    """Places by how near they are to two sites' centres, with a margin for the middle."""
    c = s.ticks.groupBy("place").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    site = lambda p, n: F.broadcast(c.where(F.col("place") == p).select(F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")))  # noqa: E731  one row
    away = lambda n: distance((F.col("x"), F.col(f"{n}x")), (F.col("y"), F.col(f"{n}y")))
    d = c.crossJoin(site("p0", "a")).crossJoin(site("p7", "b")).select("place", ratio(away("a"), away("a") + away("b")).alias("r"))
    return d.select("place", F.round("r", 4).alias("towards"), F.when(F.col("r") < 0.4, "A").when(F.col("r") > 0.6, "B").otherwise("mid").alias("area"))


@on_session(""", n AS (SELECT floor(x / 32)::BIGINT AS cx, floor(y / 32)::BIGINT AS cy, place, match_id % 2 AS fold, count(*) AS n FROM ticks GROUP BY ALL), tr AS (SELECT cx, cy, arg_min(place, (-n, place)) AS said FROM n WHERE fold = 0 GROUP BY 1, 2)
SELECT count(*) AS cells, sum(n)::BIGINT AS samples, round(sum(n * (place = said)::INT) / sum(n), 4) AS accuracy FROM n JOIN tr USING (cx, cy) WHERE fold = 1""")
def raster_accuracy(s: Session) -> DataFrame:
    """A map of cells to their most frequent place, learnt on half of the sessions and held against the other."""
    cell = lambda c: F.floor(F.col(c) / 32).cast("long")
    n = s.ticks.groupBy(cell("x").alias("cx"), cell("y").alias("cy"), "place", (F.col("match_id") % 2).alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    said = n.where("fold = 0").groupBy("cx", "cy").agg(F.min_by("place", F.struct(-F.col("n"), F.col("place"))).alias("said"))
    out = n.where("fold = 1").join(said, ["cx", "cy"])
    return out.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("samples"), F.round(ratio(F.sum(F.when(F.col("place") == F.col("said"), F.col("n")).otherwise(0)), F.sum("n")), 4).alias("accuracy"))


@on_session(""", v AS (SELECT *, lead(place) OVER w AS next_place, lead(tick) OVER w AS next_tick FROM ticks WINDOW w AS (PARTITION BY match_id, round_num, player ORDER BY tick, event_seq))
SELECT place, next_place, count(*) AS n, count(DISTINCT match_id) AS matches, quantile_cont(next_tick - tick, 0.25) AS p25, median(next_tick - tick) AS p50, quantile_cont(next_tick - tick, 0.75) AS p75 FROM v WHERE place <> next_place AND next_tick - tick <= 3000 GROUP BY 1, 2 HAVING count(*) >= 20 AND count(DISTINCT match_id) >= 3""")
def travel_times(s: Session) -> DataFrame:
    w = Window.partitionBy(*BY).orderBy("tick", "event_seq")
    v = s.ticks.select("match_id", "place", F.lead("place").over(w).alias("next_place"), (F.lead("tick").over(w) - F.col("tick")).alias("d")).where("place <> next_place and d <= 3000")
    out = v.groupBy("place", "next_place").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("match_id").alias("matches"), *[F.percentile("d", F.lit(q)).alias(p) for q, p in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return out.where("n >= 20 and matches >= 3")


@on_session(""", v AS (SELECT match_id, round_num, player, floor(x / 64)::BIGINT AS cx, floor(y / 64)::BIGINT AS cy, lead(floor(x / 64)::BIGINT) OVER w AS nx, lead(floor(y / 64)::BIGINT) OVER w AS ny FROM ticks WINDOW w AS (PARTITION BY match_id, round_num, player ORDER BY tick, event_seq))
SELECT cx, cy, nx, ny, count(*) AS n, count(DISTINCT match_id * 10 + player) AS tracks FROM v WHERE nx IS NOT NULL AND (cx <> nx OR cy <> ny) GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT match_id * 10 + player) >= 3""")
def movement_graph(s: Session) -> DataFrame:
    """Links between cells that enough tracks take."""
    w = Window.partitionBy(*BY).orderBy("tick", "event_seq")
    cell = lambda c: F.floor(F.col(c) / 64).cast("long")
    v = s.ticks.select("match_id", "player", cell("x").alias("cx"), cell("y").alias("cy"), F.lead(cell("x")).over(w).alias("nx"), F.lead(cell("y")).over(w).alias("ny"))
    links = v.where("nx is not null and (cx <> nx or cy <> ny)").groupBy("cx", "cy", "nx", "ny").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("match_id") * 10 + F.col("player")).alias("tracks"))
    return links.where("tracks >= 3")


@on_session(""", d AS (SELECT *, CASE WHEN place IS DISTINCT FROM lag(place) OVER w OR tick - lag(tick) OVER w > 2000 THEN 1 ELSE 0 END AS brk FROM ticks WINDOW w AS (PARTITION BY match_id, round_num, player ORDER BY tick, event_seq)), i AS (SELECT *, sum(brk) OVER (PARTITION BY match_id, round_num, player ORDER BY tick, event_seq ROWS UNBOUNDED PRECEDING) AS visit FROM d)
SELECT match_id, round_num, player, place, min(tick) AS came, max(tick) AS went FROM i GROUP BY match_id, round_num, player, place, visit""")
def visits(s: Session) -> DataFrame:
    """Stays at a place: without leaving, and without a gap of more than 2000."""
    w = Window.partitionBy(*BY).orderBy("tick", "event_seq")
    breaks = ~F.col("place").eqNullSafe(F.lag("place").over(w)) | (F.col("tick") - F.lag("tick").over(w) > 2000)
    runs = islands(s.ticks, BY, ["tick", "event_seq"], breaks, "visit")
    return runs.groupBy(*BY, "place", "visit").agg(F.min("tick").alias("came"), F.max("tick").alias("went")).drop("visit")


@on_session(""", c AS (SELECT match_id, round_num, player, min(tick) AS t FROM (SELECT match_id, round_num, attacker AS player, tick FROM damages UNION ALL SELECT match_id, round_num, victim, tick FROM damages) GROUP BY 1, 2, 3),
h AS (SELECT c.*, (SELECT arg_max(place, (k.tick, k.event_seq)) FROM ticks k WHERE k.round_num = c.round_num AND k.player = c.player AND k.tick <= c.t) AS place, q.side FROM c JOIN roster q USING (match_id, round_num, player))
SELECT h.match_id, h.round_num, h.player, count(DISTINCT k.player) AS followers FROM h LEFT JOIN ticks k ON k.round_num = h.round_num AND k.place = h.place AND k.side = h.side AND k.player <> h.player AND k.tick > h.t AND k.tick <= h.t + 2400 GROUP BY 1, 2, 3""")
def followers(s: Session) -> DataFrame:
    """Mates who come to the place of a player's first contact soon after it."""
    from ..operators.joins import asof

    contact = first_contact.of(s).withColumnRenamed("first_contact", "tick")
    placed = asof(contact, s.ticks.select(*BY, "tick", "event_seq", "place"), BY, "tick", ["place"], ["event_seq"]).withColumn("side", side_of(F.col("player"), nth_round(F.col("round_num"))))
    mates = s.ticks.select(*ROUND, "side", F.col("place").alias("r_place"), F.col("player").alias("mate"), F.col("tick").alias("m_tick"))
    came = placed.join(mates, [*ROUND, "side", "r_place"]).where("mate <> player and m_tick > tick and m_tick <= tick + 2400").groupBy(*BY).agg(F.count_distinct("mate").alias("n"))
    return contact.join(came, BY, "left").select(*BY, F.coalesce("n", F.lit(0)).alias("followers"))


@on_session(""", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, round_num, player ORDER BY tick, event_seq) AS n FROM shots) WHERE n = 1), p AS (SELECT f.match_id, f.round_num, f.player, f.tick AS t, k.tick, k.event_seq, k.x, k.y FROM f JOIN ticks k ON k.round_num = f.round_num AND k.player = f.player AND k.tick BETWEEN f.tick - 3600 AND f.tick),
l AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM p WINDOW w AS (PARTITION BY match_id, round_num, player ORDER BY tick, event_seq)), g AS (SELECT match_id, round_num, player, coalesce(sum(step), 0) AS path, sqrt((arg_max(x, (tick, event_seq)) - arg_min(x, (tick, event_seq))) ** 2 + (arg_max(y, (tick, event_seq)) - arg_min(y, (tick, event_seq))) ** 2) AS net FROM l GROUP BY 1, 2, 3)
SELECT match_id, round_num, player, round(path, 4) AS path, round(net, 4) AS net, CASE WHEN net <= 60 THEN 'hold' WHEN net >= 200 THEN 'peek' ELSE 'mixed' END AS style FROM g""")
def engagement_styles(s: Session) -> DataFrame:
    """How far a player moved before the round's first shot."""
    f = first_by(s.shots, BY, "tick", "event_seq").select(*BY, F.col("tick").alias("t"))
    p = s.ticks.select(*BY, "tick", "event_seq", "x", "y").join(f, BY).where("tick between t - 3600 and t")
    w = Window.partitionBy(*BY).orderBy("tick", "event_seq")
    at = F.struct("tick", "event_seq")
    g = p.withColumn("step", distance((F.col("x"), F.lag("x").over(w)), (F.col("y"), F.lag("y").over(w)))).groupBy(*BY).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), *[f_(c, at).alias(f"{n}{c}") for c in "xy" for n, f_ in (("a", F.min_by), ("b", F.max_by))])
    net = distance((F.col("ax"), F.col("bx")), (F.col("ay"), F.col("by")))
    return g.select(*BY, F.round("path", 4).alias("path"), F.round(net, 4).alias("net"), F.when(net <= 60, "hold").when(net >= 200, "peek").otherwise("mixed").alias("style"))


@on_session(""", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, round_num, player ORDER BY tick, event_seq) AS n FROM shots) WHERE n = 1)
SELECT f.match_id, f.round_num, f.player, min(k.tick) FILTER (k.attacker = f.player) - f.tick AS killed_after, min(k.tick) FILTER (k.victim = f.player) - f.tick AS died_after,
CASE WHEN min(k.tick) FILTER (k.attacker = f.player) IS NULL AND min(k.tick) FILTER (k.victim = f.player) IS NULL THEN 'none' WHEN coalesce(min(k.tick) FILTER (k.attacker = f.player), 1e9) <= coalesce(min(k.tick) FILTER (k.victim = f.player), 1e9) THEN 'won' ELSE 'lost' END AS outcome
FROM f LEFT JOIN kills k ON k.round_num = f.round_num AND (k.attacker = f.player OR k.victim = f.player) AND k.tick BETWEEN f.tick AND f.tick + 1800 GROUP BY 1, 2, 3, f.tick""")
def engagement_outcomes(s: Session) -> DataFrame:
    f = first_by(s.shots, BY, "tick", "event_seq").select(*BY, F.col("tick").alias("t"))
    both = s.kills.select(*ROUND, "tick", F.explode(F.array(F.struct(F.col("attacker").alias("player"), F.lit(True).alias("did")), F.struct(F.col("victim").alias("player"), F.lit(False).alias("did")))).alias("r")).select(*ROUND, "tick", "r.*")
    near = f.join(both, BY, "left").withColumn("ok", F.col("tick").between(F.col("t"), F.col("t") + 1800))
    g = near.groupBy(*BY, "t").agg(F.min(F.when(F.col("ok") & F.col("did"), F.col("tick") - F.col("t"))).alias("killed_after"), F.min(F.when(F.col("ok") & ~F.col("did"), F.col("tick") - F.col("t"))).alias("died_after"))
    k, d = F.col("killed_after"), F.col("died_after")
    return g.select(*BY, k, d, F.when(k.isNull() & d.isNull(), "none").when(d.isNull() | (k <= d), "won").otherwise("lost").alias("outcome"))
