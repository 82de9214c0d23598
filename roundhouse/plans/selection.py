"""Text helpers, matching of rosters, validation, and choices of what to show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compat import clip, first_by, logistic, ratio
from ..operators.sequences import running
from ..sources.sessions import ROUND, Session
from .registry import on_session, query


@on_session(""", s(weapon, strength) AS (VALUES ('sniper', 5), ('rifle', 4), ('smg', 3), ('pistol', 2), ('he', 1)) SELECT match_id, round_num, player, arg_max(weapon, strength) AS best, count(*) AS mapped FROM w JOIN s USING (weapon) GROUP BY 1, 2, 3""")
def best_items(s: Session) -> DataFrame:
    """The strongest known item that a player has in a round, as a maximum over its rows."""
    strength = F.create_map(*[F.lit(x) for kv in {"sniper": 5, "rifle": 4, "smg": 3, "pistol": 2, "he": 1}.items() for x in kv])
    known = s.ticks.select(*ROUND, "player", "weapon", strength[F.col("weapon")].alias("s")).where("s is not null")
    return known.groupBy(*ROUND, "player").agg(F.max_by("weapon", "s").alias("best"), F.count(F.lit(1)).alias("mapped"))


@on_session(""", a AS (SELECT round_num, list_sort(list(DISTINCT player % 10)) AS r FROM kills, LATERAL (SELECT unnest([attacker, victim]) AS player) GROUP BY 1) SELECT round_num, min(round_num) OVER (PARTITION BY r) AS like_round, count(*) OVER (PARTITION BY r) AS alike FROM a""")
def same_rosters(s: Session) -> DataFrame:
    """Rounds with equal sets of slots: each with the first one of its set, so that equal sets give no pairs."""
    a = s.kills.select("round_num", F.explode(F.array("attacker", "victim")).alias("player")).groupBy("round_num").agg(F.array_sort(F.collect_set(F.col("player") % 10)).alias("r"))
    sets = a.groupBy("r").agg(F.min("round_num").alias("like_round"), F.count(F.lit(1)).alias("alike"))
    return a.join(sets, "r").select("round_num", "like_round", "alike")


@query("""SELECT p_partkey, lower(p_name) AS name, levenshtein(lower(p_brand), 'brand#12')::BIGINT AS far, regexp_replace(p_type, '([A-Z])([A-Z]+)', '\\1.', 'g') AS short FROM part""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.lower("p_name").alias("name"), F.levenshtein(F.lower("p_brand"), F.lit("brand#12")).cast("long").alias("far"), F.regexp_replace("p_type", "([A-Z])([A-Z]+)", "$1.").alias("short"))


@on_session(""", p AS (SELECT event_seq, match_id % 3 AS fold, 1 / (1 + exp(-(0.01 * dmg - 0.4))) AS p, (weapon = 'sniper' OR dmg > 60)::INT AS y FROM damages)
SELECT fold, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss FROM p GROUP BY 1""")
def fold_scores(s: Session) -> DataFrame:
    p = s.damages.select((F.col("match_id") % 3).alias("fold"), logistic(0.01 * F.col("dmg") - 0.4).alias("p"), ((F.col("weapon") == "sniper") | (F.col("dmg") > 60)).cast("int").alias("y"))
    loss = F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p"))
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 6).alias("brier"), F.round(-F.avg(loss), 6).alias("log_loss"))


@on_session(""", r AS (SELECT dmg, (weapon = 'sniper')::INT AS y, rank() OVER (ORDER BY dmg) + (count(*) OVER (PARTITION BY dmg) - 1) / 2.0 AS rk FROM damages) SELECT round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r""")
def rank_auc(s: Session) -> DataFrame:
    """Area under the curve from ranks with ties shared; counted by distinct score, so that no window orders all rows in one task."""
    by = s.damages.groupBy("dmg").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("weapon") == "sniper").alias("y"))
    below = by.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("dmg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = below.agg(F.sum(F.col("y") * (F.col("before") + (F.col("n") + 1) / 2.0)).alias("r"), F.sum("y").alias("y"), F.sum("n").alias("n"))
    return sums.select(F.round((F.col("r") - F.col("y") * (F.col("y") + 1) / 2.0) / (F.col("y") * (F.col("n") - F.col("y"))), 6).alias("auc"))


@on_session(""", d AS (SELECT match_id, attacker AS player, sum(dmg) AS v FROM damages GROUP BY 1, 2), k AS (SELECT *, max(v) OVER (PARTITION BY match_id) - v AS behind, row_number() OVER (PARTITION BY match_id ORDER BY v DESC, player) AS nth FROM d) SELECT match_id, player, round(v, 4) AS v, nth AS place, (behind <= 60)::BIGINT AS leads FROM k WHERE nth = 1 OR behind <= 60""")
def leaders(s: Session) -> DataFrame:
    """The best of each session, and those too near to tell apart."""
    w = Window.partitionBy("match_id")
    d = s.damages.groupBy("match_id", F.col("attacker").alias("player")).agg(F.sum("dmg").alias("v"))
    k = d.withColumn("behind", F.max("v").over(w) - F.col("v")).withColumn("place", F.row_number().over(w.orderBy(F.desc("v"), "player")).cast("long"))
    return k.where("place = 1 or behind <= 60").select("match_id", "player", F.round("v", 4).alias("v"), "place", (F.col("behind") <= 60).cast("long").alias("leads"))


@on_session(""", c AS (SELECT match_id, 'kills' AS kind, attacker AS player, count(*)::DOUBLE / 30 AS v FROM kills GROUP BY 1, 3 UNION ALL SELECT match_id, 'damage', attacker, sum(dmg) / 2000 FROM damages GROUP BY 1, 3 UNION ALL SELECT match_id, 'flashes', thrower, sum(duration) / 20 FROM blinds GROUP BY 1, 3), e AS (SELECT match_id, player FROM (SELECT match_id, player, row_number() OVER (PARTITION BY match_id ORDER BY v DESC, kind, player) AS n FROM c) WHERE n = 1)
SELECT match_id, kind, player, round(v, 4) AS v FROM (SELECT c.*, row_number() OVER (PARTITION BY c.match_id ORDER BY v DESC, kind, c.player) AS n FROM c WHERE NOT EXISTS (FROM e WHERE e.match_id = c.match_id AND e.player = c.player)) WHERE n = 1""")
def other_highlight(s: Session) -> DataFrame:
    """The best candidate of several kinds among players other than the session's first."""
    one = lambda df, kind, who, v: df.groupBy("match_id", F.col(who).alias("player")).agg(v.alias("v")).withColumn("kind", F.lit(kind))
    c = one(s.kills, "kills", "attacker", F.count(F.lit(1)) / 30.0).unionByName(one(s.damages, "damage", "attacker", F.sum("dmg") / 2000)).unionByName(one(s.blinds, "flashes", "thrower", F.sum("duration") / 20))
    first = first_by(c, ["match_id"], F.desc("v"), "kind", "player").select("match_id", "player")
    return first_by(c.join(first, ["match_id", "player"], "left_anti"), ["match_id"], F.desc("v"), "kind", "player").select("match_id", "kind", "player", F.round("v", 4).alias("v"))


@on_session(""", q AS (SELECT 100.0::DOUBLE AS px, 250.0::DOUBLE AS py) SELECT event_seq, round(sqrt((x - px) ** 2 + (y - py) ** 2), 4) AS away FROM ticks, q WHERE side = 't' ORDER BY sqrt((x - px) ** 2 + (y - py) ** 2), event_seq LIMIT 10""")
def nearest_to_point(s: Session) -> DataFrame:
    """The ten samples of one side nearest to a point (a top-k report)."""
    away = F.sqrt((F.col("x") - 100.0) * (F.col("x") - 100.0) + (F.col("y") - 250.0) * (F.col("y") - 250.0))
    return s.ticks.where("side = 't'").select("event_seq", away.alias("d")).orderBy("d", "event_seq").limit(10).select("event_seq", F.round("d", 4).alias("away"))


@on_session(""", o AS (SELECT round_num, round(sum(dmg), 4) AS v FROM damages GROUP BY 1), n AS (SELECT round_num, round(sum(least(dmg, 100)), 4) AS v FROM damages WHERE round_num % 5 <> 0 GROUP BY 1) SELECT coalesce(o.round_num, n.round_num) AS round_num, round(abs(coalesce(o.v, 0) - coalesce(n.v, 0)), 3) AS moved FROM o FULL JOIN n USING (round_num) WHERE abs(coalesce(o.v, 0) - coalesce(n.v, 0)) > 0.01""")
def revision_difference(s: Session) -> DataFrame:
    """What a changed definition moves."""
    o = s.damages.groupBy("round_num").agg(F.round(F.sum("dmg"), 4).alias("o"))
    n = s.damages.where("round_num % 5 <> 0").groupBy("round_num").agg(F.round(F.sum(clip(F.col("dmg"), -1e18, 100.0)), 4).alias("n"))
    moved = F.abs(F.coalesce("o", F.lit(0.0)) - F.coalesce("n", F.lit(0.0)))
    return o.join(n, "round_num", "full").where(moved > 0.01).select("round_num", F.round(moved, 3).alias("moved"))


@on_session(""", d AS (SELECT match_id, round_num, sum((attacker_side = 't')::INT * 2 - 1) OVER (PARTITION BY match_id, round_num ORDER BY tick, event_seq ROWS UNBOUNDED PRECEDING) AS lead_t FROM kills) SELECT match_id, round_num, max(lead_t)::BIGINT AS most_ahead, min(lead_t)::BIGINT AS most_behind FROM d GROUP BY 1, 2""")
def worst_deficits(s: Session) -> DataFrame:
    lead = running(ROUND, ["tick", "event_seq"], F.when(F.col("attacker_side") == "t", 1).otherwise(-1))
    return s.kills.select(*ROUND, lead.alias("l")).groupBy(*ROUND).agg(F.max("l").cast("long").alias("most_ahead"), F.min("l").cast("long").alias("most_behind"))


@on_session(""", q AS (SELECT match_id, round_num, player, count(*) AS n FROM ticks GROUP BY 1, 2, 3), b AS (SELECT player, avg(n) AS obs FROM q GROUP BY 1), e AS (SELECT (player % 10 < 5)::INT AS role, avg(n) AS exp_ FROM q GROUP BY 1) SELECT b.player, round(obs / exp_, 4) AS relative FROM b JOIN e ON e.role = (b.player % 10 < 5)::INT""")
def observed_over_expected(s: Session) -> DataFrame:
    """A player's mean over that of the role."""
    q = s.ticks.groupBy(*ROUND, "player").agg(F.count(F.lit(1)).alias("n")).withColumn("role", F.col("player") % 10 < 5)
    return q.groupBy("player", "role").agg(F.avg("n").alias("o")).join(q.groupBy("role").agg(F.avg("n").alias("e")), "role").select("player", F.round(ratio("o", "e"), 4).alias("relative"))
