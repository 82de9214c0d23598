"""Rates, references, economy, ratings, roles, models and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compat import binomial_tail, exact_mean, first_by, half_even, logistic, nearest_quantiles, ramp, ratio, ratio_or_zero, share_at_most, weighted_percentile
from ..functions.geometry import angle_between, cell, circular_mean, distance, pitch_to, view_vector, yaw_difference, yaw_to
from ..operators.models import imputed, nearest_centre, rand_index, scored, standardised
from ..operators.rates import Rate, accumulated, finished, hierarchical, method_of_moments, others_median, outliers, quantile_reference, rates, shrunk
from ..sources.sessions import ROUND, Session
from .combat import BY, PARTICIPATION_SQL, participation
from .registry import on_session, query

SPECS = (
    Rate("kill_share", "killed"),
    Rate("survival", "survived"),
    Rate("traded_share", "traded", "not survived", 4),
    Rate("assist_share", "assisted", "killed", 4),
)


def _rate_sql(name: str, flag: str, of: str = "true", weak: int = 8) -> str:
    return f"count(*) FILTER ({of} AND {flag}) AS {name}_n, count(*) FILTER ({of}) AS {name}_d, count(*) FILTER ({of} AND {flag}) / nullif(count(*) FILTER ({of}), 0) AS {name}_r, (count(*) FILTER ({of}) < {weak}) AS {name}_w"


RATES_SQL = ", ".join((_rate_sql("kill_share", "killed"), _rate_sql("survival", "survived"), _rate_sql("traded_share", "traded", "NOT survived", 4), _rate_sql("assist_share", "assisted", "killed", 4)))
SHOWN_SQL = ", ".join(f"{n}_n, {n}_d, round({n}_r, 4) AS {n}, {n}_w::BIGINT AS {n}_weak" for n in ("kill_share", "survival", "traded_share", "assist_share"))


def _shown(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[c for s in SPECS for c in (F.col(f"{s.name}_n"), F.col(f"{s.name}_d"), F.round(s.name, 4).alias(s.name), F.col(f"{s.name}_weak").cast("long").alias(f"{s.name}_weak"))])


@on_session(PARTICIPATION_SQL + f", q AS (SELECT match_id, player, {RATES_SQL} FROM part GROUP BY 1, 2) SELECT match_id, player, {SHOWN_SQL} FROM q")
def profile_rates(s: Session) -> DataFrame:
    keys = ["match_id", "player"]
    return _shown(finished(rates(participation(s), keys, SPECS), keys, SPECS), keys)


@on_session(PARTICIPATION_SQL + f", q AS (SELECT player, {RATES_SQL} FROM part GROUP BY 1) SELECT player, {SHOWN_SQL} FROM q")
def accumulated_rates(s: Session) -> DataFrame:
    return _shown(accumulated(rates(participation(s), ["match_id", "player"], SPECS), ["player"], SPECS), ["player"])


@on_session(PARTICIPATION_SQL + """, q AS (SELECT match_id, player, count(*) FILTER (killed) / count(*) AS v FROM part GROUP BY 1, 2) SELECT a.match_id, a.player, round(a.v, 4) AS own, round(median(b.v), 4) AS others FROM q a LEFT JOIN q b ON a.match_id = b.match_id AND a.player <> b.player GROUP BY 1, 2, 3""")
def leave_one_out_reference(s: Session) -> DataFrame:
    q = participation(s).groupBy("match_id", "player").agg(ratio(F.count_if("killed"), F.count(F.lit(1))).alias("v"))
    return others_median(q, ["match_id"], "v", "o").select("match_id", "player", F.round("v", 4).alias("own"), F.round("o", 4).alias("others"))


@on_session(""", d AS (SELECT attacker_side AS side, weapon, round_num % 4 AS class, headshot::DOUBLE AS v FROM kills), a AS (SELECT side, count(*)::DOUBLE AS n, avg(v) AS raw FROM d GROUP BY 1),
b AS (SELECT side, weapon, count(*)::DOUBLE AS n, avg(v) AS raw FROM d GROUP BY 1, 2), b2 AS (SELECT b.*, b.n / (b.n + 20) * b.raw + (1 - b.n / (b.n + 20)) * a.raw AS rate FROM b JOIN a USING (side)),
c AS (SELECT side, weapon, class, count(*)::DOUBLE AS n, avg(v) AS raw FROM d GROUP BY 1, 2, 3)
SELECT c.side, c.weapon, c.class, c.n, round(c.raw, 6) AS raw, round(c.n / (c.n + 20) * c.raw + (1 - c.n / (c.n + 20)) * b2.rate, 6) AS rate, (c.n < 20)::BIGINT AS weak FROM c JOIN b2 USING (side, weapon)""")
def shrunk_matchups(s: Session) -> DataFrame:
    rows = s.kills.select(F.col("attacker_side").alias("side"), "weapon", (F.col("round_num") % 4).alias("class"), F.col("headshot").cast("double").alias("v"), F.lit(1.0).alias("w"))
    out = hierarchical(rows, [["side"], ["side", "weapon"], ["side", "weapon", "class"]], "v", "w")
    return out.select("side", "weapon", "class", "n", F.round("raw", 6).alias("raw"), F.round("rate", 6).alias("rate"), F.col("weak").cast("long").alias("weak"))


@query("""WITH q AS (SELECT l_returnflag, p_brand, count(*)::DOUBLE AS n, avg(l_discount) AS raw FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), u AS (SELECT l_returnflag, avg(l_discount) AS up FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_returnflag, p_brand, n, round(raw, 6) AS raw, round(n / (n + 50) * raw + (1 - n / (n + 50)) * up, 6) AS rate FROM q JOIN u USING (l_returnflag)""")
def shrunk_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_returnflag", "l_discount")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = items.join(parts, "l_partkey").withColumn("w", F.lit(1.0))
    out = hierarchical(rows, [["l_returnflag"], ["l_returnflag", "p_brand"]], "l_discount", "w", 50.0)
    return out.select("l_returnflag", "p_brand", "n", F.round("raw", 6).alias("raw"), F.round("rate", 6).alias("rate"))


@on_session(""", p AS (SELECT attacker AS player, avg(dmg) AS m, var_samp(dmg) AS v FROM damages GROUP BY 1 HAVING count(*) >= 2) SELECT round(avg(v), 4) AS within, round(var_samp(m), 4) AS between_, round(avg(v) / var_samp(m), 4) AS k FROM p""")
def moments_shrinkage(s: Session) -> DataFrame:
    out = method_of_moments(s.damages, "attacker", "dmg")
    return out.select(F.round("within", 4).alias("within"), F.round("between", 4).alias("between_"), F.round("k", 4).alias("k"))


@on_session(""", m AS (SELECT attacker_side, median(dmg) AS mid FROM damages GROUP BY 1), d AS (SELECT d.*, abs(dmg - mid) AS apart, mid FROM damages d JOIN m USING (attacker_side)), sp AS (SELECT attacker_side, 1.4826 * median(apart) AS spread FROM d GROUP BY 1)
SELECT event_seq, round((dmg - mid) / spread, 4) AS deviations FROM d JOIN sp USING (attacker_side) WHERE abs((dmg - mid) / spread) >= 3""")
def damage_outliers(s: Session) -> DataFrame:
    out = outliers(s.damages, ["attacker_side"], "dmg").where(F.abs("deviations") >= 3)
    return out.select("event_seq", F.round("deviations", 4).alias("deviations"))


@on_session(""", q AS (SELECT attacker_side, list(dmg ORDER BY dmg) AS v FROM damages GROUP BY 1) SELECT attacker_side, 'dmg' AS component, i AS place, round(v[round_even((len(v) - 1) * i / 10.0, 0)::INT + 1], 4) AS value FROM q, range(11) g(i)""")
def quantile_table(s: Session) -> DataFrame:
    out = quantile_reference(s.damages, ["attacker_side"], ["dmg"], 10)
    return out.select("attacker_side", "component", F.posexplode("quantiles").alias("place", "value")).select("attacker_side", "component", F.col("place").cast("long").alias("place"), F.round("value", 4).alias("value"))


@on_session(""", v AS (SELECT attacker_side, list(dmg ORDER BY dmg) AS v FROM damages GROUP BY 1), r AS (SELECT attacker_side, list_transform(range(21), lambda i: v[round_even((len(v) - 1) * i / 20.0, 0)::INT + 1]) AS q FROM v)
SELECT event_seq, round(len(list_filter(q, lambda x: x <= dmg)) / len(q), 4) AS percentile FROM damages JOIN r USING (attacker_side)""")
def percentile_against_reference(s: Session) -> DataFrame:
    ref = quantile_reference(s.damages, ["attacker_side"], ["dmg"], 20).select("attacker_side", "quantiles")
    return s.damages.join(F.broadcast(ref), "attacker_side").select("event_seq", F.round(share_at_most(F.col("quantiles"), F.col("dmg")), 4).alias("percentile"))  # a row for each side


@on_session(""", h AS (SELECT attacker_side, floor(dmg / 10) * 10 AS bin, count(*) AS n FROM damages GROUP BY 1, 2), e AS (SELECT attacker_side, bin FROM h, range(n) g(i))
SELECT attacker_side, round(quantile_cont(bin, 0.9), 4) AS p90, round(quantile_cont(bin, 0.5), 4) AS p50 FROM e GROUP BY 1""")
def histogram_percentiles(s: Session) -> DataFrame:
    h = s.damages.groupBy("attacker_side", (F.floor(F.col("dmg") / 10) * 10).cast("double").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("attacker_side").agg(F.round(weighted_percentile("bin", "n", 0.9), 4).alias("p90"), F.round(weighted_percentile("bin", "n", 0.5), 4).alias("p50"))


@on_session(""", o AS (SELECT attacker, dmg, row_number() OVER (PARTITION BY attacker ORDER BY dmg) - 1 AS i, count(*) OVER (PARTITION BY attacker) AS n FROM damages) SELECT attacker, dmg AS p25 FROM o WHERE i = round_even((n - 1) * 0.25, 0)""")
def nearest_rank_quantiles(s: Session) -> DataFrame:
    return nearest_quantiles(s.damages, ["attacker"], "dmg", [0.25]).select("attacker", F.col("value").alias("p25"))


@on_session("""SELECT side, floor(x / 64)::BIGINT AS cx, floor(y / 64)::BIGINT AS cy, floor(x / 64) * 64 + 32 AS mid_x, floor(y / 64) * 64 + 32 AS mid_y, count(*) AS n FROM ticks GROUP BY ALL""")
def heat_map(s: Session) -> DataFrame:
    cells = s.ticks.groupBy("side", cell(F.col("x"), 64).alias("cx"), cell(F.col("y"), 64).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    return cells.select("side", "cx", "cy", (F.col("cx") * 64 + 32.0).alias("mid_x"), (F.col("cy") * 64 + 32.0).alias("mid_y"), "n")


@on_session(""", o AS (SELECT match_id, round_num, side, place, count(*) / sum(count(*)) OVER (PARTITION BY match_id, round_num, side) AS share FROM ticks GROUP BY 1, 2, 3, 4), r AS (SELECT match_id, side, count(DISTINCT round_num) AS rounds FROM ticks GROUP BY ALL),
st AS (SELECT o.match_id, o.side, place, sum(share) / any_value(rounds) AS usual FROM o JOIN r USING (match_id, side) GROUP BY 1, 2, 3), sp AS (SELECT DISTINCT match_id, round_num, side FROM ticks)
SELECT sp.match_id, sp.round_num, sp.side, round(0.5 * sum(abs(coalesce(o.share, 0) - st.usual)) + 1e-9::DOUBLE, 4) AS deviation FROM sp JOIN st USING (match_id, side) LEFT JOIN o ON o.round_num = sp.round_num AND o.side = sp.side AND o.place = st.place GROUP BY 1, 2, 3""")
def setup_deviation(s: Session) -> DataFrame:
    counts = s.ticks.groupBy(*ROUND, "side", "place").agg(F.count(F.lit(1)).alias("n"))
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*ROUND, "side"))).drop("n")
    rounds = s.ticks.groupBy("match_id", "side").agg(F.count_distinct("round_num").alias("rounds"))
    usual = share.join(rounds, ["match_id", "side"]).groupBy("match_id", "side", "place").agg((F.sum("share") / F.first("rounds")).alias("usual"))
    every = s.ticks.select(*ROUND, "side").distinct().join(usual, ["match_id", "side"]).join(share, [*ROUND, "side", "place"], "left")
    return every.groupBy(*ROUND, "side").agg(F.round(0.5 * F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.col("usual"))) + 1e-9, 4).alias("deviation"))


@on_session(""", n AS (SELECT match_id, round_num, player, place, count(*) AS n FROM ticks GROUP BY ALL), sh AS (SELECT *, n / sum(n) OVER (PARTITION BY match_id, round_num, player) AS share, row_number() OVER (PARTITION BY match_id, round_num, player ORDER BY n DESC, place) AS nth FROM n)
SELECT match_id, round_num, player, place, round(share, 4) AS share FROM sh WHERE nth = 1""")
def dominant_place(s: Session) -> DataFrame:
    n = s.ticks.groupBy(*BY, "place").agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*BY)))
    return first_by(share, BY, F.desc("n"), "place").select(*BY, "place", F.round("share", 4).alias("share"))


@on_session("""SELECT place, side, round(((degrees(atan2(avg(sin(radians(yaw))), avg(cos(radians(yaw))))) % 360) + 360) % 360, 4) AS yaw, count(*) AS n FROM ticks GROUP BY 1, 2 HAVING count(*) >= 4""")
def mean_directions(s: Session) -> DataFrame:
    some = s.ticks.groupBy("place", "side").agg(circular_mean(F.col("yaw")).alias("yaw"), F.count(F.lit(1)).alias("n")).where("n >= 4")
    return some.withColumn("yaw", F.round("yaw", 4))


@on_session(""", v AS (SELECT event_seq, cos(radians(pitch)) * cos(radians(yaw)) AS a, cos(radians(pitch)) * sin(radians(yaw)) AS b, -sin(radians(pitch)) AS c FROM ticks)
SELECT event_seq, round(degrees(acos(greatest(-1, least(1, a / sqrt(a * a + b * b + c * c))))), 3) AS angle FROM v""")
def view_angles(s: Session) -> DataFrame:
    v = view_vector(F.col("pitch"), F.col("yaw"))
    return s.ticks.select("event_seq", F.round(angle_between(v, (F.lit(1.0), F.lit(0.0), F.lit(0.0))), 3).alias("angle"))


@on_session(""", f AS (SELECT attacker AS player, count(*) AS n, sum(headshot)::BIGINT AS k FROM kills GROUP BY 1) SELECT player, n, k, round(1 - coalesce((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(1/3.0) + (n - i) * ln(2/3.0))) FROM range(0, 400) g(i) WHERE i < k), 0), 5) AS tail FROM f""")
def chance_of_headshots(s: Session) -> DataFrame:
    f = s.kills.groupBy(F.col("attacker").alias("player")).agg(F.count(F.lit(1)).alias("n"), F.sum("headshot").alias("k"))
    return f.withColumn("tail", F.round(binomial_tail(F.col("n"), F.col("k"), 1 / 3.0), 5))


@on_session(""", c AS (SELECT match_id, round_num, side, player, k % 4 AS class FROM ev), n AS (SELECT match_id, round_num, side, class, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT *, rank() OVER (PARTITION BY match_id, round_num, side ORDER BY n DESC) AS rk FROM n),
wt AS (SELECT match_id, round_num, side, class, 1.0 / count(*) OVER (PARTITION BY match_id, round_num, side) AS weight FROM m WHERE rk = 1)
SELECT a.class AS own, b.class AS other, round(sum(a.weight * b.weight), 4) AS weight, round(sum(a.weight * b.weight * (r.winner = 't')::INT) / sum(a.weight * b.weight), 4) AS rate FROM wt a JOIN wt b ON a.round_num = b.round_num AND a.side = 't' AND b.side = 'ct' JOIN rounds r ON r.round_num = a.round_num GROUP BY 1, 2""")
def split_ties_matchups(s: Session) -> DataFrame:
    n = s.ev.groupBy(*ROUND, "side", (F.col("k") % 4).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    modes = n.withColumn("rk", F.rank().over(Window.partitionBy(*ROUND, "side").orderBy(F.desc("n")))).where("rk = 1")
    w = modes.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*ROUND, "side")))
    of = lambda side, c, v: w.where(F.col("side") == side).select(*ROUND, F.col("class").alias(c), F.col("weight").alias(v))
    both = of("t", "own", "a").join(of("ct", "other", "b"), ROUND).join(s.rounds, ROUND).withColumn("x", F.col("a") * F.col("b"))
    return both.groupBy("own", "other").agg(F.round(F.sum("x"), 4).alias("weight"), F.round(ratio(F.sum(F.when(F.col("winner") == "t", F.col("x")).otherwise(0.0)), F.sum("x")), 4).alias("rate"))


@query("""WITH c AS (SELECT j, i, ((i * 7 + j * 13) % 11 - 5) / 50.0 AS v FROM range(4) a(j), range(64) b(i)), e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
d AS (SELECT vec_id, j, sum((x - v) * (x - v)) AS apart FROM e JOIN c USING (i) GROUP BY 1, 2) SELECT vec_id, cluster FROM (SELECT vec_id, j::BIGINT AS cluster, row_number() OVER (PARTITION BY vec_id ORDER BY apart, j) AS n FROM d) WHERE n = 1""")
def nearest_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by the nearest of some fixed centres, over all their components."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cols = [F.element_at("embedding", i + 1).cast("double") for i in range(64)]
    return e.select("vec_id", nearest_centre(cols, [[((i * 7 + j * 13) % 11 - 5) / 50.0 for i in range(64)] for j in range(4)]).alias("cluster"))


MODEL = {"mean": (48.0, 240.0, 30.0), "scale": (50.0, 140.0, 20.0), "centre": (0.0, 0.0, 0.0), "components": ((0.6, 0.8, 0.0), (0.0, 0.6, 0.8)), "centres": ((-1.0, -1.0), (0.0, 1.0), (1.0, 0.0), (1.5, 1.5))}


@on_session(""", z AS (SELECT event_seq, (x - 48.0) / 50.0 AS a, (y - 240.0) / 140.0 AS b, (z - 30.0) / 20.0 AS c FROM ticks), p AS (SELECT event_seq, a * 0.6 + b * 0.8 AS u, b * 0.6 + c * 0.8 AS v FROM z), c(i, u, v) AS (VALUES (0, -1.0, -1.0), (1, 0.0, 1.0), (2, 1.0, 0.0), (3, 1.5, 1.5))
SELECT event_seq, cluster FROM (SELECT event_seq, c.i::BIGINT AS cluster, row_number() OVER (PARTITION BY event_seq ORDER BY (p.u - c.u) * (p.u - c.u) + (p.v - c.v) * (p.v - c.v), c.i) AS n FROM p, c) WHERE n = 1""")
def saved_model_clusters(s: Session) -> DataFrame:
    return scored(s.ticks, ["x", "y", "z"], MODEL).select("event_seq", "cluster")


@on_session(""", f AS (SELECT player, avg(x) AS x, CASE WHEN player % 10 <> 3 THEN avg(y) END AS y FROM ticks GROUP BY 1), i AS (SELECT player, x, coalesce(y, (SELECT median(y) FROM f)) AS y FROM f)
SELECT player, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 4) AS x, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 4) AS y FROM i""")
def standardised_features(s: Session) -> DataFrame:
    f = s.ticks.groupBy("player").agg(F.avg("x").alias("x"), F.avg(F.when(F.col("player") % 10 != 3, F.col("y"))).alias("y"))
    out = standardised(imputed(f, ["x", "y"]), ["x", "y"])
    return out.select("player", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@on_session("""SELECT event_seq, round(greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(0.02 * (dmg - 50) + 0.3 * (weapon = 'sniper')::INT - 0.1))))), 6) AS p FROM damages""")
def logistic_scores(s: Session) -> DataFrame:
    z = 0.02 * (F.col("dmg") - 50) + 0.3 * (F.col("weapon") == "sniper").cast("int") - 0.1
    return s.damages.select("event_seq", F.round(logistic(z), 6).alias("p"))


@on_session(""", l AS (SELECT event_seq, k % 4 AS a, (k // 4) % 3 AS b FROM ev), c AS (SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2), x AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c), f AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY a)), g AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((x.s - f.s * g.s / (x.t * (x.t - 1) / 2)) / ((f.s + g.s) / 2 - f.s * g.s / (x.t * (x.t - 1) / 2)), 6) AS index FROM x, f, g""")
def label_agreement(s: Session) -> DataFrame:
    labels = s.ev.select((F.col("k") % 4).alias("a"), F.floor(F.col("k") / 4).alias("q")).select("a", (F.col("q") % 3).alias("b"))
    return rand_index(labels, "a", "b").select(F.round("index", 6).alias("index"))


@on_session("""SELECT player, round_even(avg(x), 1) AS x1, round_even(2.5 + (player % 2), 0)::DOUBLE AS half FROM ticks GROUP BY 1""")
def half_even_rounding(s: Session) -> DataFrame:
    return s.ticks.groupBy("player").agg(half_even(exact_mean("x"), 1).alias("x1")).withColumn("half", half_even(F.lit(2.5) + F.col("player") % 2, 0))


@on_session("""SELECT round(corr(x, y), 6) AS r, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS base, regr_count(y, x)::BIGINT AS n FROM shots""")
def regression(s: Session) -> DataFrame:
    return s.shots.agg(F.round(F.corr("x", "y"), 6).alias("r"), F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("base"), F.regr_count("y", "x").cast("long").alias("n"))


@on_session(""", q AS (SELECT match_id, round_num, side, count(*) FILTER (x > 100) AS n, count(*) AS d FROM ticks GROUP BY ALL) SELECT round_num, max(n) FILTER (side = 't') AS t_n, max(d) FILTER (side = 't') AS t_d, max(n) FILTER (side = 'ct') AS ct_n, max(d) FILTER (side = 'ct') AS ct_d FROM q GROUP BY 1""")
def rates_by_side(s: Session) -> DataFrame:
    q = s.ticks.groupBy("round_num", "side").agg(F.count_if(F.col("x") > 100).alias("n"), F.count(F.lit(1)).alias("d"))
    return q.groupBy("round_num").pivot("side", ["t", "ct"]).agg(F.max("n").alias("n"), F.max("d").alias("d"))


@on_session("""SELECT player, CASE WHEN n > 0 THEN round(n / (n + 20.0) * raw + (1 - n / (n + 20.0)) * 0.5, 4) ELSE 0.5 END AS rate, round(coalesce(100.0 * n / nullif(n, 0), 0), 2) AS pct FROM (SELECT attacker AS player, count(*) AS n, avg(headshot) AS raw FROM kills GROUP BY 1)""")
def shrunk_headshots(s: Session) -> DataFrame:
    q = s.kills.groupBy(F.col("attacker").alias("player")).agg(F.count(F.lit(1)).alias("n"), F.avg("headshot").alias("raw"))
    return q.select("player", F.round(shrunk("n", "raw", F.lit(0.5), 20), 4).alias("rate"), F.round(ratio_or_zero("n", "n", 100.0), 2).alias("pct"))
