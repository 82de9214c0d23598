"""Results are whole where a shortcut would lose some."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roundhouse.llm import jaccard, mixing, pieces, postings, quantized, secrets
from roundhouse.llm.components import components


def least_reached(links):
    least = {x: x for p in links for x in p}
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


@pytest.mark.parametrize("seed", range(3))
def test_components_of_chains(spark, seed):
    """A node linked to two centres isn't done: the chain 1-3-4-5-2, alone and among stars and chains of shuffled ids."""
    links = [(1, 3), (3, 4), (4, 5), (5, 2)]
    if seed:
        rng = random.Random(seed)
        ids = rng.sample(range(100, 1000), 250)
        for i in range(0, 200, 5):
            links += list(zip(ids[i : i + 4], ids[i + 1 : i + 5])) if seed == 1 else [(ids[i], x) for x in ids[i + 1 : i + 5]]
        links += list(zip(ids[200:229], ids[201:230])) + [(rng.choice(ids[230:]), rng.choice(ids[230:])) for _ in range(12)]
    links = [p for p in links if p[0] != p[1]]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted(least_reached(links).items())


def test_nearest_counts_keys_once(spark):
    """Replicas and rows that repeat a key take one place: with all lists read, the answers are those of brute force."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, (x[7] * (1.0 + j / 100)).tolist()) for j in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in postings.nearest(df, df.where("vec_id % 20 = 0"), list_rows=40, border=0.5, share=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    ids, y = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    right = 0
    for q in range(0, 1200, 20):
        s = y @ x[q]
        best = {}
        for i, v in zip(ids.tolist(), s.tolist(), strict=True):
            if i != q:
                best[i] = max(best.get(i, -np.inf), v)
        want = sorted(best, key=lambda i: (-best[i], i))[:20]
        assert sorted(r for r, _ in got[q]) == list(range(1, 21))
        right += len(set(want) & {i for _, i in got[q]})
    assert right >= 0.99 * 20 * 60


def test_near_duplicates_across_borders(spark):
    """The default margin loses no pair in few dimensions, where most pairs lie across borders, and counts each once."""
    x = np.random.default_rng(6).normal(size=(1500, 5))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in quantized.near_duplicates(df, lists=1.0).collect()}
    close = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    least = least_reached([*np.argwhere(close).tolist(), *((i, i) for i in range(len(x)))])
    assert got == {i: (int(close[i].sum()), least[i]) for i in range(len(x))}


@pytest.mark.parametrize("n", [2000, 8000])
def test_planted_near_vectors(spark, n):
    """64 dimensions, mostly random directions: every planted pair about the threshold is decided as brute force does, at either size."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    for i in range(0, n // 4, 4):
        x[i + 1 : i + 4] = x[i] + rng.normal(size=(3, 64)) * rng.choice([0.2, 0.32, 0.4, 0.5], size=(3, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in quantized.near_duplicates(df).collect()}
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    close = (x @ x.T >= 0.9) & ~np.eye(n, dtype=bool)
    least = least_reached([*np.argwhere(close).tolist(), *((i, i) for i in range(n))])
    assert close.sum() > n // 4 and got == {i: (int(close[i].sum()), least[i]) for i in range(n)}


def test_lengths_apart(spark):
    """Vectors of several lengths link and are found among their own."""
    rows = [(i, [1.0, 0.0, 0.01 * i]) for i in range(5)] + [(10 + i, [0.0, 1.0 + i]) for i in range(4)] + [(20, [1.0]), (40, [1.0]), (60, []), (61, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in quantized.near_duplicates(df).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, **{10 + i: (3, 10) for i in range(4)}, 20: (1, 20), 40: (1, 20), 60: (0, 60), 61: (0, 61)}
    near = {(r["query_id"], r["rank"]): r["vec_id"] for r in postings.nearest(df, df.where("vec_id in (0, 20, 60)")).collect()}
    assert near == {(0, 1): 1, (0, 2): 2, (0, 3): 3, (0, 4): 4, (20, 1): 40}


def test_texts_of_megabytes(spark):
    """One text of some megabytes among small ones, and columns that clash with the operators' own."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400_000))
    texts = [long, long + " end", "a short text of six words", None]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    odd = df.withColumn("secret_spans", F.lit(1)).withColumn("component", F.lit(2)).withColumn("key", F.lit(3)).withColumn("mix_size", F.lit(4))
    assert [r["mix_size"] for r in mixing.copies(odd).orderBy("doc_id").collect()] == [400_000, 400_001, 6, 0]
    assert [(r["doc_id"], r["component_id"]) for r in jaccard.join(odd).orderBy("doc_id").collect()] == [(0, 0), (1, 0), (2, 2), (3, 3)]
    assert [r["doc_id"] for r in jaccard.one_of_each(odd).orderBy("doc_id").collect()] == [0, 2, 3]
    assert secrets.scan(odd).select(F.size("secret_spans").alias("n")).agg(F.sum("n")).first()[0] == 0
    import public_tokenizers

    got = pieces.encode(odd, pieces.model_bytes(public_tokenizers.path(corpus_pipeline.MODEL))).where("doc_id = 0").select("decoded").first()
    assert got["decoded"] == long


def test_language_stage_drops_what_is_in_no_language(spark):
    """Undetermined texts go, and those of which hardly a part is known; without learnt languages all stay."""
    words = ["the and that with from have this they will would there their".split(), "der die und das nicht mit von sich auch werden haben einer".split()]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(60)), "ed"[i % 2]) for i in range(80)] + [(100, "12345 67890", None), (101, None, None), (102, "\u0437\u0434\u0440\u0430\u0432\u0441\u0442\u0432\u0443\u0439 \u043c\u0438\u0440 " * 20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, df, "none").collect()}
    assert kept == set(range(80))
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unlabelled, "none").count() == len(rows)
