"""General operators against brute force, on small tables with ties, nulls and repeated rows."""

from __future__ import annotations

import bisect
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundhouse.functions import compat, geometry
from roundhouse.operators import grouped, joins, models, oplog, rates, sequences
from roundhouse.sources import io


def rows_of(seed, n, keys=3, times=40):
    rng = random.Random(seed)
    return [(rng.randrange(keys), rng.randrange(times), i, rng.choice([None, 1.0, 2.0, 3.5, 7.0])) for i in range(n)]


SCHEMA = "k long, t long, q long, v double"


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof(spark, direction, exact, tolerance):
    left, right = rows_of(1, 60), rows_of(2, 40)

    def before(k, t):
        found = [r for r in right if r[0] == k and (r[1] <= t if exact else r[1] < t) and (tolerance is None or t - r[1] <= tolerance)]
        return max(found, key=lambda r: (r[1], r[2]), default=None)

    def after(k, t):
        found = [r for r in right if r[0] == k and (r[1] >= t if exact else r[1] > t) and (tolerance is None or r[1] - t <= tolerance)]
        return min(found, key=lambda r: (r[1], r[2]), default=None)

    def nearest(k, t):
        a, b = before(k, t), after(k, t)
        return a if a and (not b or t - a[1] <= b[1] - t) else b

    want = {"backward": before, "forward": after, "nearest": nearest}[direction]
    out = joins.asof(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"], "t", ["v"], ["q"], direction, exact, tolerance)
    got = {r["q"]: (r["r_t"], r["r_v"]) for r in out.collect()}
    assert got == {r[2]: ((f[1], f[3]) if (f := want(r[0], r[1])) else (None, None)) for r in left}


def test_asof_empty(spark):
    some, none = spark.createDataFrame(rows_of(1, 5), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert joins.asof(none, some, ["k"], "t", ["v"]).count() == 0
    assert [r["r_v"] for r in joins.asof(some, none, ["k"], "t", ["v"]).collect()] == [None] * 5


def test_bucketed_near(spark):
    a, b = rows_of(3, 50), rows_of(4, 50)
    left = spark.createDataFrame(a, SCHEMA).select("k", F.col("t").alias("ta"), F.col("q").alias("qa"))
    right = spark.createDataFrame(b, SCHEMA).select("k", F.col("t").alias("tb"), F.col("q").alias("qb"))
    got = sorted((r["qa"], r["qb"]) for r in joins.bucketed_near(left, right, "ta", "tb", ["k"], 4).collect())
    assert got == sorted((x[2], y[2]) for x in a for y in b if x[0] == y[0] and abs(x[1] - y[1]) <= 4)


def test_trade(spark):
    """A kills B; C, of B's side, kills A in time: a trade for B."""
    kills = spark.createDataFrame([(1, 10, 1, "t", 2, "ct"), (1, 12, 3, "ct", 1, "t"), (1, 30, 4, "ct", 5, "t"), (2, 11, 3, "ct", 1, "t")], "round_num long, tick long, attacker long, attacker_side string, victim long, victim_side string")
    assert [(r["first_victim"], r["then_attacker"]) for r in joins.retaliation(kills, ["round_num"], 5).collect()] == [(2, 3)]
    assert joins.retaliation(kills, ["round_num"], 1).count() == 0


def test_damage_cap(spark):
    hits = spark.createDataFrame([(1, 1, 79.0), (1, 2, 79.0), (2, 1, 30.0)], "k long, q long, d double")
    got = [r["c"] for r in sequences.capped(hits, ["k"], ["q"], "d", 100.0, "c").orderBy("k", "q").collect()]
    assert got == [79.0, 21.0, 30.0]


def test_damage_cap_by_tick(spark):
    """Of several hits of a tick only what the victim had counts; the next tick begins anew."""
    hits = spark.createDataFrame([(1, 1, 60.0, 100.0), (1, 2, 60.0, 100.0), (1, 3, 5.0, 100.0), (2, 4, 30.0, 20.0)], "t long, q long, d double, hp double")
    got = [r["c"] for r in sequences.capped(hits, ["t"], ["q"], "d", F.col("hp"), "c").orderBy("t", "q").collect()]
    assert got == [60.0, 40.0, 0.0, 20.0]


@pytest.mark.parametrize("seed", range(3))
def test_modes_and_matching_by_brute_force(spark, seed):
    rng = random.Random(seed)
    angles = [float(rng.choice([350, 0, 10, 90, 95, 180]) + rng.randint(-8, 8)) % 360.0 for _ in range(60)]
    got = [r["n"] for r in grouped.angular_modes(spark.createDataFrame([("p", a) for a in angles], "k string, yaw double"), ["k"], "yaw").orderBy("mode").collect()]
    left, want = sorted(angles), []
    while left:
        inside = max(([b for b in left if abs((a - b + 180) % 360 - 180) <= 20] for a in left), key=len)
        if len(inside) < 4:
            break
        want.append(len(inside))
        for b in inside:
            left.remove(b)
    assert got == want
    wanted, free = sorted(rng.sample(range(100), 15)), sorted(rng.sample(range(100), 20))
    rows = [("a", w, None) for w in wanted] + [("a", None, h) for h in free]
    got = {r["want"]: r["have"] for r in grouped.greedy_latest(spark.createDataFrame(rows, "k string, want long, have long"), ["k"], "want", "have", 6).collect()}
    expected, left = {}, list(free)
    for w in wanted:
        fit = [h for h in left if w - 6 <= h <= w]
        expected[w] = fit[-1] if fit else None
        if fit:
            left.remove(fit[-1])
    assert got == expected


def test_ranks(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (1, 3, None), (1, 4, 5.0), (2, 5, 1.0), (2, 6, None)], "k long, q long, v double")
    got = {r["q"]: (r["r"], r["a"]) for r in df.withColumn("r", compat.masked_rank(["k"], "v")).withColumn("a", compat.average_rank(["k"], "v")).collect()}
    assert got == {1: (1, 1.5), 2: (1, 1.5), 3: (None, None), 4: (3, 3.0), 5: (1, 1.0), 6: (None, None)}
    first = {r["q"]: r["f"] for r in sequences.alone_first(df, ["k"], "v", "f").collect()}
    assert first == {1: False, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_majority_and_ties(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, None)], "k long, v string")
    assert {r["k"]: r["m"] for r in sequences.majority(df, ["k"], "v", "m").collect()} == {1: "a", 2: None, 3: None}


def test_scalars(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 4.0), (None, 2.0)], "n double, d double")
    got = [tuple(r) for r in df.select(compat.ratio("n", "d"), compat.ratio_or_zero("n", "d"), compat.ramp(F.col("n"), 2, 0)).collect()]
    assert got == [(None, 0.0, 1.0), (0.25, 0.25, 0.5), (None, 0.0, 0.0)]
    one = spark.range(1)
    assert one.select(compat.half_even(F.lit(2.5)), compat.floor_mod(F.lit(-10.0), 360)).first()[:] == (2.0, 350.0)
    assert one.select(geometry.yaw_difference(F.lit(350.0), F.lit(10.0)), geometry.yaw_difference(F.lit(-170.0), F.lit(170.0))).first()[:] == (20.0, 20.0)
    tail = one.select(compat.binomial_tail(F.lit(10), F.lit(3), 0.25)).first()[0]
    assert tail == pytest.approx(sum(math.comb(10, i) * 0.25**i * 0.75 ** (10 - i) for i in range(3, 11)))


def test_exact_mean(spark):
    """The mean of 0.01 and 2.69 is a half at one place, which their sum as doubles misses; no order of a sum changes it."""
    rows = [("a", 0.01), ("a", 2.69), ("b", float("nan")), ("b", 1.0), ("c", None), ("d", 1e300), ("d", 3e300), ("e", None), ("e", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(compat.half_even(compat.exact_mean("v"), 1).alias("m")).collect()}
    assert math.isnan(got.pop("b")) and got == {"a": 1.4, "c": None, "d": 2e300, "e": 2.5}


def test_quantiles(spark):
    values = [5.0, 1.0, 3.0, 2.0, 9.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    points = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = {r["point"]: r["value"] for r in compat.nearest_quantiles(df.union(df.limit(0).selectExpr("cast(null as double)")), [], "v", points).collect()}
    assert got == {i: sorted(values)[round((len(values) - 1) * q)] for i, q in enumerate(points)}
    ref = F.array(*[F.lit(v) for v in sorted(values)])
    got = spark.createDataFrame([(x,) for x in (0.0, 3.0, 9.0, None)], "x double").select(compat.share_at_most(ref, F.col("x"))).collect()
    assert [r[0] for r in got] == [0.0, 0.5, 1.0, 0.0]
    assert bisect.bisect_right(sorted(values), 3.0) / 6 == 0.5


def test_rates_merge(spark):
    specs = (rates.Rate("x", "v > 1", weak_below=3), rates.Rate("y", "v > 2", "v > 1", 3))
    df = spark.createDataFrame([r for r in rows_of(5, 40) if r[3] is not None], SCHEMA)
    whole = rates.finished(rates.rates(df, ["k"], specs), ["k"], specs)
    merged = rates.accumulated(rates.rates(df, ["k", "t"], specs), ["k"], specs)
    assert sorted(whole.collect()) == sorted(merged.collect())


def test_others_median(spark):
    values = {1: 1.0, 2: 4.0, 3: 4.0, 4: 10.0}
    got = {r["q"]: r["m"] for r in rates.others_median(spark.createDataFrame([(0, q, v) for q, v in values.items()] + [(1, 9, 2.0)], "k long, q long, v double"), ["k"], "v", "m").collect()}
    assert got == {**{q: statistics.median([v for p, v in values.items() if p != q]) for q in values}, 9: None}


def test_islands_and_runs(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate("aabbbac")] + [(2, 0, None)], "k long, t long, v string")
    got = [(r["k"], r["v"], r["first_place"], r["last_place"], r["length"]) for r in sequences.segments(df, ["k"], ["t"], "v").orderBy("k", "first_place").collect()]
    assert got == [(1, "a", 1, 2, 2), (1, "b", 3, 5, 3), (1, "a", 6, 6, 1), (1, "c", 7, 7, 1), (2, None, 1, 1, 1)]


# ---- operation logs


def ops(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, op_id string, seq long, author long, kind string, target string, field string, value double, t long")


def test_log_laws(spark):
    rng = random.Random(7)
    kinds = ["create", "set", "set", "remove", "undo", "redo"]
    rows = [(1 + i % 2, f"o{i}", rng.randrange(30), rng.randrange(2), k := rng.choice(kinds), f"o{rng.randrange(60)}" if k in ("undo", "redo") else f"n{rng.randrange(3)}", rng.choice("xy"), float(i), 0) for i in range(60)]
    log = ops(spark, rows)
    a, b = log.where("seq % 3 <> 0"), log.where("seq % 3 <> 1")
    state = lambda df: sorted(map(str, oplog.state(df).collect()))
    whole = state(log)
    assert state(oplog.merged(a, b)) == state(oplog.merged(b, a)) == state(oplog.merged(a, b, a)) == whole
    # by hand
    want = {}
    for doc in (1, 2):
        mine = sorted((r for r in rows if r[0] == doc), key=lambda r: (r[2], r[3], r[1]))
        off = {}
        for r in mine:
            if r[4] in ("undo", "redo"):
                off[(r[5], r[3])] = max(off.get((r[5], r[3]), (-1, "", "")), (r[2], r[1], r[4]))
        live = [r for r in mine if r[4] not in ("undo", "redo") and off.get((r[1], r[3]), ("", "", "redo"))[2] == "redo"]
        for target in {r[5] for r in live}:
            at = lambda r: (r[2], r[3], r[1])
            born = min((at(r) for r in live if r[5] == target and r[4] == "create"), default=None)
            gone = max((at(r) for r in live if r[5] == target and r[4] == "remove"), default=None)
            if born and not (gone and gone >= born):
                for r in live:
                    if r[5] == target and r[4] == "set" and at(r) > born:
                        want[doc, target, r[6]] = r[7]
    assert {(r["doc_id"], r["target"], r["field"]): r["value"] for r in oplog.state(log).collect()} == want


def test_undo_by_another_author_counts_for_nothing(spark):
    log = ops(spark, [(1, "a", 1, 1, "create", "n", None, None, 0), (1, "b", 2, 2, "undo", "a", None, None, 0), (1, "c", 3, 1, "set", "n", "x", 5.0, 0)])
    assert [r["value"] for r in oplog.state(log).collect()] == [5.0]


def test_interpolation(spark):
    points = spark.createDataFrame([(1, 10, 0.0), (1, 20, 10.0)], "k long, t long, v double")
    times = spark.createDataFrame([(1, t) for t in (5, 10, 15, 20, 25)], "k long, t long")
    assert [r["v"] for r in oplog.interpolated(points, times, ["k"], "t", "v").orderBy("t").collect()] == [None, 0.0, 5.0, 10.0, 10.0]


# ---- grouped


def bends(points, tolerance):
    """Times kept of a track, by recursion; points are (time, order, x, y)."""
    track = [min((p for p in points if p[0] == t), key=lambda p: p[1:]) for t in sorted({p[0] for p in points})]

    def between(a, b):
        off = [math.dist(track[i][2:], [u + (track[i][0] - track[a][0]) / (track[b][0] - track[a][0]) * (v - u) for u, v in zip(track[a][2:], track[b][2:], strict=True)]) for i in range(a + 1, b)]
        if not off or max(off) <= tolerance:
            return []
        m = a + 1 + off.index(max(off))
        return [*between(a, m), track[m][0], *between(m, b)]

    return sorted({track[0][0], *between(0, len(track) - 1), track[-1][0]})


@pytest.mark.parametrize("batch", [3, 10_000])
def test_simplified(spark, batch):
    """Tracks of all lengths, of null keys too, some over several batches; of points of one time the first by order counts."""
    rng = random.Random(4)
    rows = [(k, t, i, float(rng.randrange(100)), float(rng.randrange(100))) for k in [None, *range(30)] for i, t in enumerate(rng.choices(range(60), k=rng.choice([1, 2, 3, 5, 40])))]
    rng.shuffle(rows)
    odd = [(1, None, 0, 1.0, 1.0), (2, 7, -1, None, 1.0), (99, None, 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows + odd, "k long, t long, q long, x double, y double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(((r["k"], r["t"]) for r in grouped.simplified(df, ["k"], "t", ["x", "y"], 20.0, ["q"]).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(((k, t) for k in {r[0] for r in rows} for t in bends([r[1:] for r in rows if r[0] == k], 20.0)), key=str)
    assert grouped.simplified(df.limit(0), ["k"], "t", ["x", "y"], 20.0).count() == 0


def test_grouped(spark):
    yaw = spark.createDataFrame([("p", float(x)) for x in (355, 358, 2, 4, 180, 181, 182, 183, 90)], "k string, yaw double")
    got = sorted(((r["yaw"] + 1.0) % 360.0, r["n"]) for r in grouped.angular_modes(yaw, ["k"], "yaw").collect())
    assert [n for _, n in got] == [4, 4] and [y for y, _ in got] == pytest.approx([0.75, 182.5], abs=0.01)
    line = spark.createDataFrame([("a", t, x) for t, x in enumerate([0, 70, 50, 20, 80, 90])], "k string, t long, x long")
    assert [(r["first"], r["last"]) for r in sequences.hysteresis(line, ["k"], ["t"], "x", 60, 30).orderBy("trip").collect()] == [(1, 2), (4, 5)]
    track = spark.createDataFrame([("a", t, float(t if t <= 5 else 10 - t), 0.0) for t in range(11)], "k string, t long, x double, y double")
    assert sorted(r["t"] for r in grouped.simplified(track, ["k"], "t", ["x", "y"], 0.5).collect()) == [0, 5, 10]
    throw = spark.createDataFrame([("a", float(t), 3.0 + 2 * t - t * t) for t in range(5)] + [("b", 1.0, 1.0)], "k string, t double, z double")
    fit = {r["k"]: r for r in models.parabola(throw, ["k"], "t", "z").collect()}
    assert (round(fit["a"]["a"], 6), round(fit["a"]["b"], 6), round(fit["a"]["c"], 6)) == (3.0, 2.0, -1.0) and fit["b"]["a"] is None
    want = spark.createDataFrame([("a", 10, None), ("a", 12, None), ("a", 30, None), ("a", None, 9), ("a", None, 11)], "k string, want long, have long")
    assert [(r["want"], r["have"]) for r in grouped.greedy_latest(want, ["k"], "want", "have", 5).orderBy("want").collect()] == [(10, 9), (12, 11), (30, None)]
    pairs = spark.createDataFrame([(0, 3), (3, 0), (0, 0)], "a long, b long")
    paths = {(r["a"], r["b"]): (r["cost"], r["hops"]) for r in grouped.shortest_paths(pairs, [(0, 1, 1.0), (1, 3, 1.0), (0, 3, 5.0)], "a", "b").collect()}
    assert paths == {(0, 3): (2.0, 2), (3, 0): (None, None), (0, 0): (0.0, 0)}


# ---- models


def test_models(spark):
    rng = random.Random(1)
    data = [(x := rng.gauss(0, 3), y := rng.gauss(1, 1), 2 * x + 0.5 * y, int(x + rng.gauss(0, 0.5) > 0)) for _ in range(300)]
    df = spark.createDataFrame(data, "x double, y double, z double, l int")
    w = models.non_negative(df, ["x", "y"], "z")
    assert w == pytest.approx([2.0, 0.5], abs=1e-6)
    mean, parts = models.principal(df, ["x", "y"], 2)
    assert abs(parts[0][0]) > 0.9 and mean[1] == pytest.approx(sum(r[1] for r in data) / 300)
    coefficients, _ = models.logistic_fit(df, ["x"], "l")
    assert coefficients[0] > 0.5 and models.logistic_fit(df.limit(10), ["x"], "l") == ([0.0], 0.0)
    centres, score = models.clusters(spark.createDataFrame([(float(c * 10 + rng.random()),) for c in range(3) for _ in range(20)], "x double"), ["x"], 3, 3)
    assert sorted(round(c[0] / 10) for c in centres) == [0, 1, 2] and score > 0.9
    z = models.standardised(df, ["x"]).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)
    units = spark.createDataFrame([(g, u) for g in (1, 2) for u in range(7)], "g long, u long")
    draws = models.resamples(units, ["g"], "u", 20, 1)
    assert {r["n"] for r in draws.groupBy("g", "resample").agg(F.sum("multiplicity").alias("n")).collect()} == {7}
    often = models.poisson_resamples(units, ["g", "u"], 300, 1).agg(F.sum("times")).first()[0]
    assert often == pytest.approx(14 * 300, rel=0.05)
    folds = models.left_out(df.withColumn("fold", (F.monotonically_increasing_id() % 3)), ["x", "y"], "z", "fold").collect()
    assert len(folds) == 6 and all(r["error"] < 1e-6 and r["weight"] == pytest.approx({"x": 2.0, "y": 0.5}[r["feature"]], abs=1e-6) for r in folds)


# ---- sources


def test_layers_and_manifest(spark, tmp_path):
    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("match_id", T.LongType())])
    io.save_layer({"a": spark.createDataFrame([(1, 7), (2, 8)], schema)}, str(tmp_path))
    got = io.load_layer(spark, str(tmp_path), {"a": schema, "b": schema}, optional=["b"])
    assert got["a"].where("match_id = 7").count() == 1 and got["b"].count() == 0
    old = spark.createDataFrame([("m1", 1, "x"), ("m2", 2, "x")], "id string, version int, note string")
    new = spark.createDataFrame([("m1", 2, "y"), ("m2", 2, "y"), ("m3", 1, "y")], "id string, version int, note string")
    assert {r["id"]: r["note"] for r in io.upserted(old, new, ["id"], "version").collect()} == {"m1": "y", "m2": "y", "m3": "y"}
    assert [r["id"] for r in io.stale(old, {"version": 2}).collect()] == ["m1"]
    (tmp_path / "t.tsv").write_text("a\tb\n# note\n1\tx\n")
    assert io.read_tsv(spark, str(tmp_path / "t.tsv"), T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])).collect()[0][:] == (1, "x")
    assert io.union_by_name([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2.5, "z")], "a double, b string")]).orderBy("a").collect()[0][:] == (1.0, None)


def test_files(spark, tmp_path):
    for name, text in (("x-p2.dem", "bb"), ("x-p1.dem", "aa"), ("y.dem", "cc"), ("copy.dem", "cc"), ("z.txt", "dd")):
        (tmp_path / name).write_text(text)
    found = io.discovered(spark, str(tmp_path), "*.dem")
    assert found.count() == 3
    assert io.discovered(spark, str(tmp_path), "*.dem", found).count() == 0
    parts = {r["name"]: [p.rsplit("/", 1)[1] for p in r["parts"]] for r in io.grouped_parts(found).collect()}
    assert parts["x"] == ["x-p1.dem", "x-p2.dem"]


def test_payload(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k long, t long, v string")
    assert io.payload(df, ["k"], ["t"]).first()["json"] == '[{"t":1,"v":"a"},{"t":2,"v":"b"}]'
    numbered, names = io.interned(df, "v", "n")
    assert sorted(r["n"] for r in numbered.collect()) == [0, 1] and names.count() == 2
