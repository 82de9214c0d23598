"""Joins and searches against brute force, and the pipeline."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roundhouse.llm import jaccard, langid, postings, quantized, queries, secrets
from roundhouse.llm.common import shared_folder, table, written
from roundhouse.llm.components import components


def joined(links, nodes):
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = joined(links, {x for p in links for x in p})
    assert got == {n: c for n, c in want.items() if n in got} and set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- Jaccard


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute(rows):
    """By place in rows: (n_shingles, least key that links reach)."""
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    group = joined(links, range(len(rows)))
    keys = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        keys[group[i]].append(k)
    return [(len(sets[i]), min((k for k in keys[group[i]] if k is not None), default=None)) for i in range(len(rows))]


def near_copies(seed):
    """Groups of near copies with few and many edits, a passage that many share, and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    rows = [None, "", " \n", "one", "One", "one two", "ONE two three four", "one two three four", "x " * 50, "x " * 400, "É é E e ß", "é é e e ß"]
    for _ in range(12):
        text = [word() for _ in range(rng.choice([6, 20, 80, 300]))]
        for _ in range(rng.choice([1, 3, 12])):
            own = list(text)
            for _ in range(rng.choice([0, 1, 2, max(1, len(text) // 25)])):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own + passage * (rng.random() < 0.3)))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", range(3))
def test_jaccard(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}
    assert got == {i: x for (i, _), x in zip(rows, brute(rows), strict=True)}


def test_jaccard_repeated_keys(spark):
    rows = near_copies(9)
    rows += [(None, rows[5][1]), (None, rows[20][1]), (None, None), (2, rows[30][1]), (2, rows[2][1]), (7, "q r s t u v w"), (7, "q r s t u v w"), (7, "q r s t u v w x y z"), (None, "only here by null"), (None, "only here by null")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in jaccard.join(df).select("doc_id", "n_shingles", "component_id").collect())))
    want = brute(rows)
    want = sorted(str((k, n, c if n else k)) for (k, _), (n, c) in zip(rows, want, strict=True))
    assert got == want
    kept = jaccard.one_of_each(df.withColumn("at_key", F.lit(5))).collect()
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    group = joined(links, range(len(rows)))
    assert sum(1 for r in kept if shingles(r["text"])) == len({group[i] for i in range(len(rows)) if sets[i]})
    assert sum(1 for r in kept if not shingles(r["text"])) == sum(1 for s in sets if not s)


def test_jaccard_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_jaccard_on_tables(spark, middle):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, middle, "documents").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op10_jaccard_join(spark, middle).collect()}
    assert got == {i: x for (i, _), x in zip(rows, brute(rows), strict=True)}


# ---- vectors


def clustered(seed, n, dim):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n // 2, 10):
        x[i : i + 10] = x[i] + rng.normal(size=(10, dim)) * rng.choice([0.1, 0.3, 0.45])
    x[n // 2 : n // 2 + 20] = x[3]
    return (x * rng.uniform(0.5, 2.0, size=(n, 1))).astype(np.float32)


ODD = [(1001, None), (1002, []), (1003, [0.0] * 16), (1004, [1.0] * 15 + [None]), (1005, [1.0] * 15 + [float("nan")]), (1006, [float("inf")] * 16), (1007, [1.0] * 3), (None, [1.0] * 16)]


@pytest.mark.parametrize("margin", [0.5, 1.0])
def test_near_duplicates(spark, margin):
    x = clustered(1, 600, 16)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in quantized.near_duplicates(df, margin=margin, lists=0.6).collect()}
    y = np.array([r[1] for r in rows[:600]], np.float32).astype(float)
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    close = (y @ y.T >= 0.9) & ~np.eye(600, dtype=bool)
    group = joined(np.argwhere(close).tolist(), range(600))
    if margin == 1.0:
        assert {i: got[i] for i in range(600)} == {i: (int(close[i].sum()), group[i]) for i in range(600)}
    assert sum(got[i][0] for i in range(600)) >= 0.98 * close.sum()
    assert all(got[i] == (0, i) for i, _ in ODD if i is not None)


def test_near_duplicates_of_several_blocks(spark):
    """A list of more vectors than a block holds, all near each other, and scaled copies."""
    rng = np.random.default_rng(6)
    n = quantized.BLOCK + 300
    x = rng.normal(size=16) + rng.normal(size=(n, 16)) * 0.02
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, (x[0] * 4.0).tolist()), (n + 1, (-x[0]).tolist())]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in quantized.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got.pop(n + 1) == (0, n + 1) and set(got.values()) == {(n, 0)} and len(got) == n + 1


def test_near_duplicates_disk(spark, monkeypatch):
    """What is written and shuffled grows by the rows, not by the lists that vectors in random directions probe."""
    rng = np.random.default_rng(7)
    n, dim = 6000, 32
    df = written(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, dim)))], "vec_id long, embedding array<float>"))
    folder = Path(shared_folder(spark))
    monkeypatch.setattr(quantized, "dropped", lambda df: None)
    before = set(folder.glob("roundhouse-*"))
    assert quantized.near_duplicates(df).count() == n
    made = sum(f.stat().st_size for d in set(folder.glob("roundhouse-*")) - before for f in d.rglob("*.parquet"))
    assert made < 3.5 * n * dim * 4


def test_nearest(spark):
    x = clustered(2, 800, 16)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in postings.nearest(df, df.where("vec_id % 20 = 0"), list_rows=40).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    y = x.astype(float)
    right = 0
    for q in range(0, 800, 20):
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(800), -s))[:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1)) and q not in {v for _, v, _ in found}
        assert [v for _, v, _ in found] == sorted((v for _, v, _ in found), key=lambda v: (-(y[q] * y[v]).sum(), v))
        right += len(set(best.tolist()) & {v for _, v, _ in found})
    assert right >= 0.9 * 20 * 40


def test_vector_cases(spark):
    few = spark.createDataFrame(ODD[:6] + [(20, [1.0, 0.0]), (40, [1.0, 0.0]), (41, [0.0, 1.0])], "vec_id long, embedding array<double>").where("vec_id < 1000 or vec_id < 1003")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in quantized.near_duplicates(few).collect())[:3] == [(20, 1, 20), (40, 1, 20), (41, 0, 41)]
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in postings.nearest(few, few.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()] == [(20, 1, 40), (20, 2, 41), (40, 1, 20), (40, 2, 41)]
    none = few.limit(0)
    assert quantized.near_duplicates(none).count() == 0 and postings.nearest(none, none).count() == 0


def test_recall_on_tables(spark, middle):
    rows = table(spark, middle, "embeddings").orderBy("vec_id").collect()
    y = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["vec_id"] for r in rows])
    got = defaultdict(set)
    for r in queries.op7_nearest_neighbours(spark, middle).collect():
        got[r["query_id"]].add(r["vec_id"])
    right = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = y @ y[i]
        s[i] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]].tolist()
        right += len(got[int(ids[i])] & set(best))
        total += 20
    assert right >= 0.9 * total
    unit = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
    close = (unit @ unit.T >= 0.9) & ~np.eye(len(ids), dtype=bool)
    links = {r["vec_id"]: r["n_links"] for r in queries.op3_embedding_near_dedup(spark, middle).collect()}
    assert {int(i): int(c) for i, c in zip(ids, close.sum(axis=1), strict=True)} == links


# ---- pipeline


def test_pipeline(spark, middle):
    docs = table(spark, middle, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "secret_scan", "mix_sources", "encode"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, middle))
        rows, were = after.collect(), before.collect()
        if name != "encode":
            assert after.columns == docs.columns
        if name == "language_id":
            known = langid.predict(before, langid.fit(before)).where("lang_pred <> 'und'").count()
            assert len(rows) == known
        if name == "near_duplicates":
            want = {c if n else k for (k, _), (n, c) in zip([(r["doc_id"], r["text"]) for r in were], brute([(r["doc_id"], r["text"]) for r in were]), strict=True)}
            assert sorted(r["doc_id"] for r in rows) == sorted(want)
        if name == "secret_scan":
            assert len(rows) == len(were) and not any(secrets.base_spans(r["text"] or "") for r in rows)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "mix_sources":
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in were}
        if name == "encode":
            assert len(rows) == len(were) and all(r["n_tokens"] == len(r["piece_ids"]) for r in rows)
        before = after


def test_pipeline_cases(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (1, "a b c", "en", "s", 5), (None, "a b c", None, None, None), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.withColumn("at_key", F.lit(1)).withColumn("lang_pred", F.lit(2)).withColumn("mix_at", F.lit(3)).withColumn("secret_free", F.lit(4))
    for df in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = written(stage(spark, df, "none"))
            df.collect()
