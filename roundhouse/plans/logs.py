"""Limits, quotas and clean-up of operation logs; throws; graphs; resampled intervals and held-out fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import nearest_quantiles, ratio
from ..functions.geometry import angle_between
from ..operators import oplog
from ..operators.models import left_out, poisson_resamples
from ..operators.sequences import ordered
from ..sources.sessions import Session
from .combat import BY
from .places import travel_times
from .registry import on_session

#: Operations that an author may send in so many ticks; operations and bytes of a document; idle days. Fixed values of the sample sessions.
LIMITS, MOST_OPS, MOST_VALUE, IDLE_ROUNDS = ((20, 1), (3600, 4), (43_200, 20)), 20, 900.0, 5


@on_session(", q AS (SELECT event_seq, " + ", ".join(f"count(*) OVER (PARTITION BY player ORDER BY \"at\" RANGE BETWEEN {s - 1} PRECEDING AND CURRENT ROW) > {n} AS l{i}" for i, (s, n) in enumerate(LIMITS)) + " FROM ev) SELECT event_seq, l0::BIGINT AS in_short, l1::BIGINT AS in_middle, l2::BIGINT AS in_long, (l0 OR l1 OR l2)::BIGINT AS refused FROM q")
def three_limits(s: Session) -> DataFrame:
    """Which of an author's limits an operation breaks: short, middle and long ones."""
    rows = s.ev.select("player", "at", "event_seq")
    for i, (seconds, most) in enumerate(LIMITS):
        rows = oplog.over_limit(rows, ["player"], "at", seconds, most, f"l{i}")
    return rows.select("event_seq", *[F.col(f"l{i}").cast("long").alias(n) for i, n in enumerate(("in_short", "in_middle", "in_long"))], (F.col("l0") | F.col("l1") | F.col("l2")).cast("long").alias("refused"))


@on_session(f""", q AS (SELECT match_id, round_num, event_seq, row_number() OVER w AS nth, round(sum(value) OVER w, 6) AS size FROM ev WINDOW w AS (PARTITION BY match_id, round_num ORDER BY tick, event_seq ROWS UNBOUNDED PRECEDING)) SELECT event_seq, CASE WHEN nth > {MOST_OPS} THEN 'operations' WHEN size > {MOST_VALUE} THEN 'size' END AS refused FROM q""")
def quotas(s: Session) -> DataFrame:
    """Operations beyond a document's number or size, in the order in which they came."""
    w = Window.partitionBy("match_id", "round_num").orderBy("tick", "event_seq")
    rows = s.ev.select("event_seq", F.row_number().over(w).alias("nth"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("size"))
    return rows.select("event_seq", F.when(F.col("nth") > MOST_OPS, "operations").when(F.col("size") > MOST_VALUE, "size").alias("refused"))


@on_session(f""", d AS (SELECT match_id, player, max(nth) AS last_, count(*) FILTER (event_type = 'purchase') AS refs FROM ev GROUP BY 1, 2), m AS (SELECT match_id, max(nth) AS now_ FROM ev GROUP BY 1) SELECT match_id, player, last_, (now_ - last_ >= {IDLE_ROUNDS})::BIGINT AS idle, (now_ - last_ >= 2 AND refs = 0)::BIGINT AS forgotten FROM d JOIN m USING (match_id)""")
def idle_documents(s: Session) -> DataFrame:
    """What goes because nothing came for long, and what goes sooner because nothing refers to it."""
    d = s.ev.groupBy("match_id", "player").agg(F.max("nth").alias("last_"), F.count_if(F.col("event_type") == "purchase").alias("refs"))
    now = s.ev.groupBy("match_id").agg(F.max("nth").alias("now"))
    since = F.col("now") - F.col("last_")
    return d.join(now, "match_id").select("match_id", "player", "last_", (since >= IDLE_ROUNDS).cast("long").alias("idle"), ((since >= 2) & (F.col("refs") == 0)).cast("long").alias("forgotten"))


@on_session(""", j AS (SELECT *, max(k) OVER (PARTITION BY player ORDER BY "at", event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev) SELECT event_seq, coalesce(k > before + 40, false)::BIGINT AS jumps FROM j""")
def clock_jumps(s: Session) -> DataFrame:
    """Logical clocks that jump too far above an author's highest so far."""
    w = Window.partitionBy("player").orderBy("at", "event_seq").rowsBetween(Window.unboundedPreceding, -1)
    return s.ev.select("event_seq", F.coalesce(F.col("k") > F.max("k").over(w) + 40, F.lit(False)).cast("long").alias("jumps"))


# ---- throws

#: Speeds of the three ways to throw, and how far off one may be: fixed values.
BUTTONS, TOLERANCE = {"short": 202.5, "middle": 438.7, "long": 675.0}, 0.15


@on_session(f""", l AS (SELECT *, x - lag(x) OVER q AS ax, y - lag(y) OVER q AS ay, lead(x) OVER q - x AS bx, lead(y) OVER q - y AS by_ FROM ticks WINDOW q AS (PARTITION BY round_num, player ORDER BY tick, event_seq)),
a AS (SELECT *, degrees(acos(greatest(-1, least(1, (ax * bx + ay * by_) / nullif(sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_), 0))))) AS turn FROM l WHERE ax IS NOT NULL AND bx IS NOT NULL AND (ax <> 0 OR ay <> 0) AND (bx <> 0 OR by_ <> 0)) SELECT match_id, round_num, player, event_seq, round(turn, 3) AS turn FROM a WHERE turn >= 25""")
def collisions(s: Session) -> DataFrame:
    """Points of a track where it turns by 25 degrees and more."""
    w = ordered(BY, ["tick", "event_seq"])
    d = lambda c: (F.col(c) - F.lag(c).over(w), F.lead(c).over(w) - F.col(c))
    (ax, bx), (ay, by) = d("x"), d("y")
    rows = s.ticks.select(*BY, "event_seq", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    rows = rows.where("(ax <> 0 or ay <> 0) and (bx <> 0 or by <> 0)").withColumn("turn", angle_between((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))))
    return rows.where("turn >= 25").select(*BY, "event_seq", F.round("turn", 3).alias("turn"))


@on_session(""", v AS (SELECT event_seq, 6.0 * value + 2 * k AS speed FROM ev WHERE event_type = 'error'), d AS (SELECT v.*, b.name, abs(speed - b.s) / b.s AS off FROM v, (VALUES ('short', 202.5), ('middle', 438.7), ('long', 675.0)) b(name, s)) SELECT event_seq, round(speed, 4) AS speed, CASE WHEN min(off) <= 0.15 THEN arg_min(name, off) END AS button FROM d GROUP BY 1, 2""")
def throw_buttons(s: Session) -> DataFrame:
    """The way of throwing whose speed is nearest, if it is near enough."""
    speed = 6.0 * F.col("value") + 2 * F.col("k")
    off = F.array(*[F.struct((F.abs(speed - b) / b).alias("off"), F.lit(n).alias("name")) for n, b in BUTTONS.items()])
    rows = s.ev.where("event_type = 'error'").select("event_seq", speed.alias("speed"), F.array_min(off).alias("b"))
    return rows.select("event_seq", F.round("speed", 4).alias("speed"), F.when(F.col("b.off") <= TOLERANCE, F.col("b.name")).alias("button"))


@on_session(""", c AS (SELECT t.event_seq, g.dx, g.dy, min(sqrt((t.x + g.dx - s.x) ** 2 + (t.y + g.dy - s.y) ** 2)) AS r FROM shots t JOIN states s ON s.round_num = t.round_num AND s.player = t.player AND s.tick BETWEEN t.tick - 1800 AND t.tick, (SELECT a.i * 10.0::DOUBLE AS dx, b.i * 10.0::DOUBLE AS dy FROM range(-1, 2) a(i), range(-1, 2) b(i)) g GROUP BY 1, 2, 3)
SELECT dx, dy, round(m, 4) AS residual, nth FROM (SELECT *, row_number() OVER (ORDER BY round(m, 9), dx, dy) AS nth FROM (SELECT dx, dy, median(r) AS m FROM c GROUP BY 1, 2))""")
def anchor_offsets(s: Session) -> DataFrame:
    """Of a grid of offsets the one that brings releases nearest to where the player was shortly before, in the median: places from the best on."""
    steps = F.explode(F.array(*[F.struct(F.lit(a * 10.0).alias("dx"), F.lit(b * 10.0).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    t = s.shots.select(*BY, "event_seq", F.explode(F.sequence(F.ceil((F.col("tick") - 1800) / 600) * 600, F.floor(F.col("tick") / 600) * 600, F.lit(600).cast("long"))).alias("tick"), "x", "y")
    at = s.states.select(*BY, "tick", F.col("x").alias("sx"), F.col("y").alias("sy"))
    rows = t.join(at, [*BY, "tick"]).select("event_seq", "x", "y", "sx", "sy", steps.alias("d")).select("event_seq", "d.*", F.sqrt((F.col("x") + F.col("d.dx") - F.col("sx")) * (F.col("x") + F.col("d.dx") - F.col("sx")) + (F.col("y") + F.col("d.dy") - F.col("sy")) * (F.col("y") + F.col("d.dy") - F.col("sy"))).alias("r"))
    m = rows.groupBy("event_seq", "dx", "dy").agg(F.min("r").alias("r")).groupBy("dx", "dy").agg(F.median("r").alias("m"))
    return m.select("dx", "dy", F.round("m", 4).alias("residual"), F.row_number().over(Window.orderBy(F.round("m", 9), "dx", "dy")).cast("long").alias("nth"))  # nine rows


# ---- graphs


REACH_SQL = """, v AS (SELECT *, lead(place) OVER q AS next_place, lead(tick) OVER q AS next_tick FROM ticks WINDOW q AS (PARTITION BY match_id, round_num, player ORDER BY tick, event_seq)),
tt AS (SELECT place, next_place FROM v WHERE place <> next_place AND next_tick - tick <= 3000 GROUP BY 1, 2 HAVING count(*) >= 20 AND count(DISTINCT match_id) >= 3), reach AS (SELECT place AS a, next_place AS b FROM tt UNION SELECT r.a, t.next_place FROM reach r JOIN tt t ON t.place = r.b)
"""


@on_session(REACH_SQL + "SELECT p.place, least(p.place, coalesce(min(x.b), p.place)) AS component FROM (SELECT DISTINCT place FROM ticks) p LEFT JOIN reach x ON x.a = p.place AND EXISTS (FROM reach y WHERE y.a = x.b AND y.b = x.a) GROUP BY p.place", recursive=True)
def strong_components(s: Session) -> DataFrame:
    """Places that can be reached from each other, by the least of them. Paths are squared until no place is new; there are few places."""
    edges = travel_times.of(s).select(F.col("place").alias("a"), F.col("next_place").alias("b"))
    nodes = s.ticks.select("place").distinct()
    known = {(r["a"], r["b"]) for r in edges.collect()}  # places by places
    while True:
        more = known | {(a, d) for a, b in known for c, d in known if b == c}
        if more == known:
            break
        known = more
    reach = s.spark.createDataFrame(sorted(known), "a string, b string")
    both = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
    least = both.groupBy(F.col("a").alias("place")).agg(F.min("b").alias("m"))
    return nodes.join(least, "place", "left").select("place", F.least("place", F.coalesce("m", "place")).alias("component"))


# ---- resampled and held out


@on_session(""", m AS (SELECT match_id, round(sum(dmg), 6) AS dmg, count(*) AS n FROM damages GROUP BY 1), d AS (SELECT m.*, r.i AS resample, ('0x' || substr(md5('9:' || match_id || ':' || r.i), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM m, range(40) r(i)),
p AS (SELECT *, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT AS times FROM d), q AS (SELECT resample, sum(dmg * times) / sum(n * times) AS x FROM p GROUP BY 1 HAVING sum(n * times) > 0), l AS (SELECT list(round(x, 9) ORDER BY round(x, 9)) AS v FROM q)
SELECT round((SELECT sum(dmg) / sum(n) FROM m), 5) AS mean, round(v[round_even((len(v) - 1) * 0.025, 0)::INT + 1], 5) AS low, round(v[round_even((len(v) - 1) * 0.975, 0)::INT + 1], 5) AS high FROM l""")
def resampled_interval(s: Session) -> DataFrame:
    """The mean damage with an interval over resampled matches; each match comes as often as a Poisson draw by its hash says, so that no draw needs all matches."""
    m = s.damages.groupBy("match_id").agg(F.round(F.sum("dmg"), 6).alias("dmg"), F.count(F.lit(1)).alias("n"))
    q = poisson_resamples(m, ["match_id"], 40, 9).groupBy("resample").agg(F.sum(F.col("dmg") * F.col("times")).alias("d"), F.sum(F.col("n") * F.col("times")).alias("n")).where("n > 0").select(F.round(F.col("d") / F.col("n"), 9).alias("x"))
    ends = nearest_quantiles(q, [], "x", [0.025, 0.975]).groupBy().pivot("point", [0, 1]).agg(F.first("value")).toDF("low", "high")
    mean = m.agg(F.round(ratio(F.sum("dmg"), F.sum("n")), 5).alias("mean"))
    return mean.crossJoin(ends).select("mean", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))  # one row each


@on_session()
def held_out_weights(s: Session) -> DataFrame:
    """Non-negative weights of two components for a third, fitted without each fold of matches, and the mean error on it."""
    k = s.kills.groupBy("match_id", F.col("attacker").alias("player")).agg(F.count(F.lit(1)).cast("double").alias("kills"))
    d = s.damages.groupBy("match_id", F.col("attacker").alias("player")).agg((F.sum("dmg") / 100).alias("damage"), F.count(F.lit(1)).cast("double").alias("hits"))
    rows = k.join(d, ["match_id", "player"]).withColumn("fold", F.pmod("match_id", F.lit(3)))
    return left_out(rows, ["damage", "hits"], "kills", "fold")
