"""Cleaning, round credit, mistakes, win probability, operation logs, and star-schema analogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compat import first_by, ratio
from ..operators import grouped, oplog
from ..operators.joins import asof
from ..operators.models import parabola, resamples
from ..operators.sequences import hysteresis
from ..sources.sessions import ROUND, Session, first_side, nth_round
from .combat import BY
from .places import travel_times
from .registry import on_session, query

# ---- cleaning


@on_session(""", f AS (SELECT match_id, min(round_num) AS r FROM damages GROUP BY 1), k AS (SELECT match_id, round_num FROM damages JOIN f USING (match_id) WHERE round_num = r GROUP BY 1, 2 HAVING bool_and(weapon <> 'sniper'))
SELECT d.match_id, CASE WHEN k.round_num IS NOT NULL THEN d.round_num - 1 ELSE d.round_num END AS round_num, d.event_seq FROM damages d LEFT JOIN k ON k.match_id = d.match_id WHERE k.round_num IS NULL OR d.round_num <> k.round_num""")
def dropped_opening_round(s: Session) -> DataFrame:
    """A first round all of whose damage fits a pattern is taken out, and later ones are numbered anew."""
    first = s.damages.groupBy("match_id").agg(F.min("round_num").alias("round_num"))
    odd = s.damages.join(first, ROUND).groupBy(*ROUND).agg(F.bool_and(F.col("weapon") != "sniper").alias("odd")).where("odd").select("match_id", F.col("round_num").alias("out"))
    kept = s.damages.join(odd, "match_id", "left").where("out is null or round_num <> out")
    return kept.select("match_id", F.when(F.col("out").isNotNull(), F.col("round_num") - 1).otherwise(F.col("round_num")).alias("round_num"), "event_seq")


@on_session("""SELECT k.match_id, k.round_num, k.event_seq FROM kills k JOIN rounds r USING (match_id, round_num) WHERE k.tick >= r.freeze_end + 600 AND (k.tick <= r."end" - 600 OR r.nth NOT IN (12, 24))""")
def played_kills(s: Session) -> DataFrame:
    """Kills after the freeze, and before the end of the last round of a half."""
    k = s.kills.join(s.rounds, ROUND).where((F.col("tick") >= F.col("freeze_end") + 600) & ((F.col("tick") <= F.col("end") - 600) | (~F.col("nth").isin(12, 24))))
    return k.select(*ROUND, "event_seq")


@on_session("""SELECT match_id, round_num, CASE WHEN nth <= 12 THEN 't' WHEN nth <= 24 THEN 'ct' WHEN ((nth - 25) // 3) % 4 IN (1, 2) THEN 't' ELSE 'ct' END AS side, nth IN (12, 24) OR nth > 24 AND (nth - 24) % 3 = 0 AS half_end FROM rounds""")
def side_by_round(s: Session) -> DataFrame:
    """The side of the team that began as t, and whether sides change after the round: twelve rounds each, then blocks of three."""
    nth = F.col("nth")
    return s.rounds.select(*ROUND, first_side(nth).alias("side"), (nth.isin(12, 24) | ((nth > 24) & ((nth - 24) % 3 == 0))).alias("half_end"))


@on_session("""SELECT match_id, round_num, player, count(*) AS samples FROM states t JOIN rounds r USING (match_id, round_num) WHERE alive AND tick % 1200 = 0 AND tick BETWEEN r.freeze_end AND r."end" GROUP BY 1, 2, 3""")
def position_samples(s: Session) -> DataFrame:
    """Samples at every so many ticks of who is alive, while the round is played."""
    inside = s.states.where(F.col("alive") & (F.pmod("tick", F.lit(1200)) == 0)).join(s.rounds.select(*ROUND, "freeze_end", "end"), ROUND).where(F.col("tick").between(F.col("freeze_end"), F.col("end")))
    return inside.groupBy(*BY).agg(F.count(F.lit(1)).alias("samples"))


@on_session(""", n AS (SELECT player, place, count(*) AS n, max(match_id) AS last FROM ticks GROUP BY 1, 2) SELECT player, place AS shown FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY n DESC, last DESC, place) AS nth FROM n) WHERE nth = 1""")
def display_names(s: Session) -> DataFrame:
    """The most frequent name, of equals the latest one."""
    n = s.ticks.groupBy("player", "place").agg(F.count(F.lit(1)).alias("n"), F.max("match_id").alias("last"))
    return first_by(n, ["player"], F.desc("n"), F.desc("last"), "place").select("player", F.col("place").alias("shown"))


@on_session(""", p AS (SELECT match_id // 8 AS recording, match_id, max(nth) AS r, max(tick) AS t FROM ev GROUP BY 1, 2), o AS (SELECT match_id, coalesce(sum(r) OVER w, 0)::BIGINT AS r0, coalesce(sum(t) OVER w, 0)::BIGINT AS t0 FROM p WINDOW w AS (PARTITION BY recording ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_seq, match_id // 8 AS recording, nth + r0 AS round_num, tick + t0 AS tick FROM ev JOIN o USING (match_id)""")
def merged_parts(s: Session) -> DataFrame:
    """Parts of a recording (here eight sessions) laid end to end: each goes on from the sum of those before."""
    recording = F.floor(F.col("match_id") / 8)
    parts = s.ev.groupBy(recording.alias("recording"), "match_id").agg(F.max("nth").alias("r"), F.max("tick").alias("t"))
    w = Window.partitionBy("recording").orderBy("match_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("match_id", F.coalesce(F.sum("r").over(w), F.lit(0)).alias("r0"), F.coalesce(F.sum("t").over(w), F.lit(0)).alias("t0"))
    return s.ev.join(offsets, "match_id").select("event_seq", recording.alias("recording"), (F.col("nth") + F.col("r0")).alias("round_num"), (F.col("tick") + F.col("t0")).alias("tick"))


# ---- mistakes and what to show


@on_session(""", k AS (SELECT match_id, round_num, attacker, count(*) AS n FROM kills GROUP BY 1, 2, 3) SELECT r.match_id, r.round_num, round(coalesce(max(8.0 * greatest(k.n - 2, 0)), 0) + CASE WHEN count(DISTINCT k.attacker) >= 5 THEN 12 ELSE 0 END + CASE WHEN r.winner = 'ct' THEN 3.5 ELSE 0 END, 2)::DOUBLE AS points FROM rounds r LEFT JOIN k USING (match_id, round_num) GROUP BY 1, 2, r.winner""")
def spectacle(s: Session) -> DataFrame:
    k = s.kills.groupBy(*ROUND, "attacker").agg(F.count(F.lit(1)).alias("n")).groupBy(*ROUND).agg(F.max(8.0 * F.greatest(F.col("n") - 2, F.lit(0))).alias("many"), F.count(F.lit(1)).alias("killers"))
    points = F.coalesce("many", F.lit(0.0)) + F.when(F.col("killers") >= 5, 12).otherwise(0) + F.when(F.col("winner") == "ct", 3.5).otherwise(0.0)
    return s.rounds.join(k, ROUND, "left").select(*ROUND, F.round(points, 2).alias("points"))


# ---- operation logs


def _ops(s: Session) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("create", "set", "set", "set", "remove", "undo", "redo", "set")]), (F.col("k") % 8 + 1).cast("int"))
    back = F.concat(F.lit("o"), (F.col("event_seq") - F.col("k") % 5 * 3).cast("string"))
    target = F.when(kind.isin("undo", "redo"), back).otherwise(F.concat(F.lit("n"), (F.floor(F.col("k") / 8) % 3).cast("string")))
    return s.ev.select(F.col("round_num").alias("doc_id"), F.concat(F.lit("o"), F.col("event_seq").cast("string")).alias("op_id"), F.col("tick").alias("seq"), (F.col("player") % 3).alias("author"), kind.alias("kind"), target.alias("target"), F.when(F.col("player") % 10 < 5, "x").otherwise("y").alias("field"), "value")


OPS_SQL = """, ops AS (SELECT round_num AS doc_id, 'o' || event_seq AS op_id, tick AS seq, player % 3 AS author, ['create', 'set', 'set', 'set', 'remove', 'undo', 'redo', 'set'][(k % 8 + 1)::INT] AS kind, CASE WHEN k % 8 IN (5, 6) THEN 'o' || (event_seq - k % 5 * 3) ELSE 'n' || ((k // 8) % 3) END AS target, CASE WHEN player % 10 < 5 THEN 'x' ELSE 'y' END AS field, value FROM ev),
vd AS (SELECT doc_id, target AS op_id, author, arg_max(kind, (seq, op_id)) AS verdict FROM ops WHERE kind IN ('undo', 'redo') GROUP BY 1, 2, 3), live AS (SELECT o.* FROM ops o LEFT JOIN vd USING (doc_id, op_id, author) WHERE o.kind NOT IN ('undo', 'redo') AND (verdict IS NULL OR verdict = 'redo'))
"""


@on_session(OPS_SQL + "SELECT doc_id, op_id, kind, target FROM live")
def active_operations(s: Session) -> DataFrame:
    return oplog.active(_ops(s)).select("doc_id", "op_id", "kind", "target")


@on_session(OPS_SQL + """, life AS (SELECT doc_id, target, min((seq, author, op_id)) FILTER (kind = 'create') AS born, max((seq, author, op_id)) FILTER (kind = 'remove') AS gone FROM live GROUP BY 1, 2)
SELECT l.doc_id, l.target, l.field, arg_max(l.value, (l.seq, l.author, l.op_id)) AS value FROM live l JOIN life f ON f.doc_id = l.doc_id AND f.target = l.target WHERE l.kind = 'set' AND f.born IS NOT NULL AND (f.gone IS NULL OR f.gone < f.born) AND (l.seq, l.author, l.op_id) > f.born GROUP BY 1, 2, 3""")
def log_state(s: Session) -> DataFrame:
    return oplog.state(_ops(s))


@on_session(OPS_SQL + "SELECT doc_id, op_id, kind, author FROM ops")
def merged_logs(s: Session) -> DataFrame:
    """Two replicas that overlap merge to the whole log."""
    ops = _ops(s)
    return oplog.merged(ops.where("author <> 0"), ops.where("author <> 1")).select("doc_id", "op_id", "kind", "author")


@on_session("""SELECT event_seq, (count(*) OVER (PARTITION BY match_id, player ORDER BY round_num * 20000 + tick RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) > 3)::BIGINT AS over_limit FROM ev""")
def rate_limits(s: Session) -> DataFrame:
    timed = s.ev.withColumn("at", F.col("round_num") * 20000 + F.col("tick"))
    return oplog.over_limit(timed, ["match_id", "player"], "at", 3600, 3).select("event_seq", F.col("over").cast("long").alias("over_limit"))


@on_session("""SELECT event_seq, list_filter([CASE WHEN k > 90 THEN 'k' END, CASE WHEN value > 200 THEN 'value' END, CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN 'type' END], lambda x: x IS NOT NULL) AS problems FROM ev WHERE k > 90 OR value > 200 OR (event_type = 'signup' AND k % 2 = 0)""")
def validation(s: Session) -> DataFrame:
    found = oplog.problems({"k": F.col("k") > 90, "value": F.col("value") > 200, "type": (F.col("event_type") == "signup") & (F.col("k") % 2 == 0)})
    return s.ev.select("event_seq", found.alias("problems")).where(F.size("problems") > 0)


@on_session(""", w1 AS (SELECT match_id, round_num, player, tick, arg_max(x, event_seq) AS x FROM ticks GROUP BY 1, 2, 3, 4), g AS (SELECT match_id, round_num, player, i * 1800 AS tick FROM roster, range(1, 8) r(i)),
b AS (SELECT g.*, (SELECT arg_max(struct_pack(t := w1.tick, x := w1.x), w1.tick) FROM w1 WHERE w1.round_num = g.round_num AND w1.player = g.player AND w1.tick <= g.tick) AS a, (SELECT arg_min(struct_pack(t := w1.tick, x := w1.x), w1.tick) FROM w1 WHERE w1.round_num = g.round_num AND w1.player = g.player AND w1.tick > g.tick) AS n FROM g)
SELECT match_id, round_num, player, tick, round(CASE WHEN n IS NULL THEN a.x ELSE a.x + (tick - a.t) / (n.t - a.t) * (n.x - a.x) END + 1e-9::DOUBLE, 4) AS x FROM b""")
def interpolated_positions(s: Session) -> DataFrame:
    points = s.ticks.groupBy(*BY, "tick").agg(F.max_by("x", "event_seq").alias("x"))
    times = s.roster.select(*BY, F.explode(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: (i * 1800).cast("long"))).alias("tick"))
    return oplog.interpolated(points, times, BY, "tick", "x").withColumn("x", F.round(F.col("x") + 1e-9, 4))


# ---- grouped


@on_session()
def direction_modes(s: Session) -> DataFrame:
    return grouped.angular_modes(s.ticks, ["place", "side"], "yaw")


@on_session()
def speed_modes(s: Session) -> DataFrame:
    return grouped.linear_modes(s.ticks, ["side"], "x")


@on_session(""", n AS (SELECT match_id, player, row_number() OVER q - 1 AS pos, coalesce(last_value(CASE WHEN x > 60 THEN 1 WHEN x <= 30 THEN 0 END IGNORE NULLS) OVER (PARTITION BY match_id, player ORDER BY round_num, tick, event_seq ROWS UNBOUNDED PRECEDING), 0) AS out_ FROM ticks WINDOW q AS (PARTITION BY match_id, player ORDER BY round_num, tick, event_seq)),
c AS (SELECT *, sum(d) OVER (PARTITION BY match_id, player ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN out_ <> coalesce(lag(out_) OVER (PARTITION BY match_id, player ORDER BY pos), -1) THEN 1 ELSE 0 END AS d FROM n))
SELECT match_id, player, row_number() OVER (PARTITION BY match_id, player ORDER BY min(pos)) - 1 AS trip, min(pos) AS first, max(pos) AS last FROM c WHERE out_ = 1 GROUP BY match_id, player, run""")
def trips_outside(s: Session) -> DataFrame:
    return hysteresis(s.ticks, ["match_id", "player"], ["round_num", "tick", "event_seq"], "x", 60.0, 30.0)


@on_session()
def simplified_tracks(s: Session) -> DataFrame:
    return grouped.simplified(s.ticks, BY, "tick", ["x", "y"], 32.0, ["event_seq"])


@on_session(""", r AS (SELECT match_id, player, x AS v, greatest(max(tick) OVER w - min(tick) OVER w, 1)::DOUBLE AS scale, (tick - min(tick) OVER w) / greatest(max(tick) OVER w - min(tick) OVER w, 1)::DOUBLE AS u FROM ticks WINDOW w AS (PARTITION BY match_id, player)),
s AS (SELECT match_id, player, max(scale) AS scale, count(DISTINCT u) AS times, count(*)::DOUBLE AS s0, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(v) AS v0, sum(v*u) AS v1, sum(v*u*u) AS v2 FROM r GROUP BY 1, 2),
f AS (SELECT match_id, player, scale, (v0*(s2*s4-s3*s3) - s1*(v1*s4-s3*v2) + s2*(v1*s3-s2*v2)) / nullif(s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2), 0) AS a, (s0*(v1*s4-s3*v2) - v0*(s1*s4-s3*s2) + s2*(s1*v2-v1*s2)) / nullif(s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2), 0) AS b, (s0*(s2*v2-v1*s3) - s1*(s1*v2-v1*s2) + v0*(s1*s3-s2*s2)) / nullif(s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2), 0) AS c FROM s WHERE times >= 3)
SELECT match_id, player, round(a, 4) AS start, round(b / f.scale * 1000, 4) AS speed, round(max(abs(a + b * u + c * u * u - v)), 3) AS residual FROM f JOIN r USING (match_id, player) GROUP BY match_id, player, a, b, f.scale""")
def fitted_parabolas(s: Session) -> DataFrame:
    """A parabola through each player's values over time: where it starts, how fast, and what strays most."""
    fit = parabola(s.ticks, ["match_id", "player"], "tick", "x").where("a is not null")
    return fit.select("match_id", "player", F.round("a", 4).alias("start"), F.round(F.col("b") * 1000, 4).alias("speed"), F.round("residual", 3).alias("residual"))


@on_session()
def official_times(s: Session) -> DataFrame:
    both = s.shots.select(*BY, F.col("tick").alias("want"), F.lit(None).cast("long").alias("have")).unionByName(s.damages.select(*ROUND, F.col("attacker").alias("player"), F.lit(None).cast("long").alias("want"), F.col("tick").alias("have")))
    return grouped.greedy_latest(both, BY, "want", "have", 900)


@on_session(""", v AS (SELECT *, lead(place) OVER q AS next_place, lead(tick) OVER q AS next_tick FROM ticks WINDOW q AS (PARTITION BY match_id, round_num, player ORDER BY tick, event_seq)),
e AS (SELECT place AS a, next_place AS b, median(next_tick - tick) AS cost FROM v WHERE place <> next_place AND next_tick - tick <= 3000 GROUP BY 1, 2 HAVING count(*) >= 20 AND count(DISTINCT match_id) >= 3), pl AS (SELECT DISTINCT place FROM ticks),
r AS (SELECT place AS a, place AS b, 0.0::DOUBLE AS cost, 0 AS hops FROM pl UNION ALL SELECT r.a, e.b, r.cost + e.cost, r.hops + 1 FROM r JOIN e ON e.a = r.b WHERE r.hops < 4)
SELECT x.place AS a, y.place AS b, min((cost, hops))[1] AS cost, min((cost, hops))[2]::BIGINT AS hops FROM pl x CROSS JOIN pl y LEFT JOIN r ON r.a = x.place AND r.b = y.place GROUP BY 1, 2""", recursive=True)
def place_routes(s: Session) -> DataFrame:
    """Quickest ways between places over the links that enough tracks take, at their median times; places are few, so their pairs and links are too."""
    edges = [(r["place"], r["next_place"], float(r["p50"])) for r in travel_times.of(s).select("place", "next_place", "p50").collect()]
    places = s.ticks.select(F.col("place").alias("a")).distinct()
    return grouped.shortest_paths(places.crossJoin(F.broadcast(places.select(F.col("a").alias("b")))), edges, "a", "b")


@on_session(""", u AS (SELECT match_id, round_num, row_number() OVER (PARTITION BY match_id ORDER BY round_num) AS nth, count(*) OVER (PARTITION BY match_id) AS n FROM rounds), dr AS (SELECT match_id, resample, n, ('0x' || substr(md5('7:' || match_id || ':' || resample || ':' || nth), 1, 12))::BIGINT % n + 1 AS nth FROM u, range(50) g(resample)),
m AS (SELECT dr.match_id, resample, u.round_num, count(*) AS times FROM dr JOIN u ON u.match_id = dr.match_id AND u.nth = dr.nth GROUP BY 1, 2, 3), k AS (SELECT round_num, attacker AS player, count(*) AS n FROM kills GROUP BY 1, 2), t AS (SELECT m.match_id, resample, player, sum(n * times) AS n FROM m JOIN k USING (round_num) GROUP BY 1, 2, 3)
SELECT match_id, player, round(count(*) FILTER (rk = 1) / 50.0, 4) AS share, (count(*) FILTER (rk = 1) / 50.0 < 0.7)::BIGINT AS tendency FROM (SELECT *, rank() OVER (PARTITION BY match_id, resample, player % 10 < 5 ORDER BY n DESC) AS rk FROM t) GROUP BY 1, 2""")
def stability(s: Session) -> DataFrame:
    """How often a player has the most kills of a team when a match's rounds are drawn with replacement 50 times; below 0.7 it is but a tendency."""
    k = s.kills.groupBy(*ROUND, F.col("attacker").alias("player")).agg(F.count(F.lit(1)).alias("n"))
    drawn = k.join(resamples(s.rounds, ["match_id"], "round_num", 50, 7), ROUND).groupBy("match_id", "resample", "player").agg(F.sum(F.col("n") * F.col("multiplicity")).alias("n"))
    top = drawn.withColumn("team", F.col("player") % 10 < 5).withColumn("rk", F.rank().over(Window.partitionBy("match_id", "resample", "team").orderBy(F.desc("n"))))
    share = ratio(F.count_if(F.col("rk") == 1), F.lit(50))
    return top.groupBy("match_id", "player").agg(F.round(share, 4).alias("share"), (share < 0.7).cast("long").alias("tendency"))


# ---- star schema


@query("""WITH d AS (SELECT DISTINCT l_partkey, l_shipdate FROM lineitem), b AS (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_partkey ORDER BY l_shipdate) AS before FROM d)
SELECT l_orderkey, l_linenumber, date_diff('day', before, l_shipdate) AS days_since FROM lineitem JOIN b USING (l_partkey, l_shipdate)""")
def days_since_last_shipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join of a table with itself: the last earlier shipment of the same part."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    out = asof(items, items, ["l_partkey"], "l_shipdate", [], ["l_orderkey", "l_linenumber"], "backward", exact=False)
    return out.select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", "r_l_shipdate").cast("long").alias("days_since"))


@query("""SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent, round(coalesce(100.0 * count(o_orderkey) FILTER (o_orderstatus = 'F') / nullif(count(o_orderkey), 0), 0), 2) AS finished_pct, (count(o_orderkey) < 8)::BIGINT AS weak FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def customer_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    spine = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    sums = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    n = F.coalesce("n", F.lit(0))
    return spine.join(sums, "c_custkey", "left").select("c_custkey", n.alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("spent"), F.round(F.coalesce(ratio("done", "n", 100.0), F.lit(0.0)), 2).alias("finished_pct"), (n < 8).cast("long").alias("weak"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"))


@query("""SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 QUALIFY rank() OVER (PARTITION BY n_name ORDER BY sum(o_totalprice) DESC) <= 2""")
def top_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    rows = read("orders", "o_custkey", "o_totalprice").join(read("customer", "c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read("nation", "n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    sums = rows.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    return sums.withColumn("rk", F.rank().over(Window.partitionBy("n_name").orderBy(F.desc("total")))).where("rk <= 2").select("n_name", "c_mktsegment", "orders", F.round("total", 2).alias("total"))
