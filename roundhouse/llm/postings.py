"""Nearest neighbours by balanced posting lists.

Vectors are split in halves again and again, so that each centroid stands for as many. A vector goes to the list of its nearest
centroid and, near a border, to a second one's. Centroids are searched by a graph in memory that links each to its nearest ones.
A query reads the lists whose centroids are at most a ratio farther than the nearest one; that ratio is measured on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .vectors import by_length, drawn, matrix, squared, with_bytes

#: Bytes of vectors that one task compares at a time: as many lists side by side, or part of a longer one. Queries are dealt to blocks.
CELL_BYTES = 8 << 20
BLOCK = 4096
DEGREE, ENTRIES, EXPANDED = 16, 8, 4


@dataclass
class Graph:
    """Centroids, each with its nearest ones (and those it is nearest to) as neighbours."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    def search(self, x: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Distances to the centroids that the graph leads to, infinite for others.

        All vectors walk at once: each expands its nearest centroids that it hasn't yet, until these are farther than its
        least-th nearest and than ratio times its nearest.
        """
        k = len(self.centroids)
        d = np.full((len(x), k), np.inf)
        d[:, self.entries] = np.sqrt(squared(x, self.centroids[self.entries]))
        done = np.zeros((len(x), k), bool)
        norms = (self.centroids**2).sum(axis=1)
        own = (x * x).sum(axis=1)
        rows = np.arange(len(x))
        while len(rows):
            near = d[rows]
            bound = np.maximum(np.partition(near, min(least, k) - 1, axis=1)[:, min(least, k) - 1], ratio * near.min(axis=1))
            open_ = np.where(done[rows], np.inf, near)
            best = np.argpartition(open_, min(EXPANDED, k) - 1, axis=1)[:, :EXPANDED]
            ok = np.take_along_axis(open_, best, axis=1)
            ok = np.isfinite(ok) & (ok <= bound[:, None])
            go = ok.any(axis=1)
            rows, best, ok = rows[go], best[go], ok[go]
            r, at = np.repeat(rows, best.shape[1])[ok.ravel()], best.ravel()[ok.ravel()]
            done[r, at] = True
            r, c = np.repeat(r, self.neighbours.shape[1]), self.neighbours[at].ravel()
            new = np.isinf(d[r, c])
            r, c = r[new], c[new]
            d[r, c] = np.sqrt(np.maximum(0.0, own[r] + norms[c] - 2.0 * np.einsum("ij,ij->i", x[r], self.centroids[c])))
        return d


def balanced(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Centroids of k parts of nearly equal size: each split puts half the vectors on either side, by which of two means is nearer."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < k:
        after = []
        for p in parts:
            if len(p) < 2:
                after.append(p)
                continue
            two = x[rng.choice(p, 2, replace=False)]
            for _ in range(6):
                lean = squared(x[p], two) @ np.array([1.0, -1.0])
                order = p[np.argsort(lean, kind="stable")]
                two = np.stack([x[order[: len(p) // 2]].mean(axis=0), x[order[len(p) // 2 :]].mean(axis=0)])
            after += [order[: len(p) // 2], order[len(p) // 2 :]]
        if len(after) == len(parts):
            break
        parts = after
    return np.stack([x[p].mean(axis=0) for p in parts])


def graph(centroids: np.ndarray) -> Graph:
    """Each centroid's nearest ones, half of the places for those that it is nearest to; entries far apart, so that all parts are reached."""
    k = len(centroids)
    d = squared(centroids, centroids)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : min(DEGREE, max(1, k - 1))]
    back: list[list[int]] = [[] for _ in range(k)]
    for i in range(k):
        for j in near[i, : DEGREE // 2].tolist():
            back[j].append(i)
    width = near.shape[1] + DEGREE // 2
    out = np.zeros((k, width), np.int64)
    for i in range(k):
        own = list(dict.fromkeys([*near[i].tolist(), *sorted(back[i], key=lambda j: d[i, j])]))[:width]
        out[i] = own + [own[0]] * (width - len(own))
    entries = [0]
    while len(entries) < min(ENTRIES, k):
        entries.append(int(squared(centroids, centroids[entries]).min(axis=1).argmax()))
    return Graph(centroids, out, np.array(entries))


def chosen(g: Graph, x: np.ndarray, replicas: int, border: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): each row's nearest list, and further ones within border of its distance, unless one that is chosen is nearer to such a list than the row."""
    d = g.search(x, 1.0 + border, max(8, 2 * replicas))
    order = np.argsort(d, axis=1, kind="stable")[:, : 4 * replicas]
    near = np.take_along_axis(d, order, axis=1)
    apart = np.sqrt(squared(g.centroids, g.centroids))
    take = np.zeros(order.shape, bool)
    take[:, 0] = True
    for j in range(1, order.shape[1]):
        ok = (near[:, j] <= (1.0 + border) * near[:, 0]) & (take.sum(axis=1) < replicas)
        for i in range(j):
            ok &= ~take[:, i] | (apart[order[:, i], order[:, j]] >= near[:, j])
        take[:, j] = ok
    row, j = np.nonzero(take)
    return row, order[row, j]


def measured_ratio(g: Graph, x: np.ndarray, k: int, share: float, replicas: int, border: float, queries: int = 400) -> float:
    """The ratio with which that share of the sample's true neighbours are in lists that are read. x: lifted vectors."""
    lists = np.full((len(x), replicas), -1)
    for i in range(0, len(x), 512):
        row, at = chosen(g, x[i : i + 512], replicas, border)
        lists[i + row, np.arange(len(row)) - np.searchsorted(row, row)] = at
    step = max(1, len(x) // queries)
    asked = np.arange(0, len(x), step)
    found = []
    for i in range(0, len(asked), 50):
        own = asked[i : i + 50]
        q = x[own].copy()
        q[:, -1] = 0.0
        near = q @ x.T
        near[np.arange(len(own)), own] = -np.inf
        true = np.argpartition(-near, min(k, len(x)) - 1, axis=1)[:, :k]
        true = np.where(true == own[:, None], -1, true)
        d = np.sqrt(squared(q, g.centroids))
        there = lists[true]
        far = np.where((there >= 0) & (true >= 0)[:, :, None], np.take_along_axis(d, np.maximum(there, 0).reshape(len(q), -1), axis=1).reshape(there.shape), np.inf).min(axis=2)
        far = far / np.maximum(1e-12, d.min(axis=1))[:, None]
        found.append(far[np.isfinite(far)])
    every = np.concatenate(found)
    return float(np.quantile(every, share)) if len(every) else 1.0


def lifted(x: np.ndarray, norm2: np.ndarray, most: float) -> np.ndarray:
    """One more component brings all vectors to one length; of a query, that has none of it, those of the largest inner product are then the nearest."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - norm2))])


def cells(sizes: dict[int, int], lists: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each list its first cell and how many it is dealt to: neighbouring lists share a cell of about most rows, a longer list has several of its own."""
    first, parts = np.zeros(lists, np.int64), np.ones(lists, np.int64)
    cell = rows = 0
    for at in range(lists):
        n = sizes.get(at, 0)
        if rows and rows + n > most:
            cell, rows = cell + 1, 0
        first[at] = cell
        if n > most:
            parts[at] = -(-n // most)
            cell, rows = cell + int(parts[at]), 0
        else:
            rows += n
    return first, parts


def _best(queries: pd.DataFrame, rows: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    """Of each query the best k keys of a cell, among rows of lists that it reads, by their best inner product, then key."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "score": np.zeros(0)})
    rows = rows.sort_values("key", kind="stable")
    y, x = matrix(list(rows["vec"]), dim), matrix(list(queries["vec"]), dim)
    key, query = rows["key"].to_numpy(np.int64), queries["key"].to_numpy(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # a key's replicas, and rows that repeat it, stand together
    lists, of = np.unique(rows["list"].to_numpy(np.int64), return_inverse=True)
    reads = np.stack([np.isin(lists, np.frombuffer(r, np.int32)) for r in queries["lists"]])
    out = []
    for i in range(0, len(x), 128):
        near = x[i : i + 128] @ y.T
        near[~reads[i : i + 128][:, of] | (query[i : i + 128][:, None] == key[None])] = -np.inf
        best = near if len(starts) == len(key) else np.maximum.reduceat(near, starts, axis=1)
        kth = np.partition(best, -min(k, len(starts)), axis=1)[:, -min(k, len(starts))]
        r, c = np.nonzero(near >= np.where(np.isfinite(kth), kth - 1e-9 * np.abs(kth), np.finfo(float).min)[:, None])
        score = (x[i + r] * y[c]).sum(axis=1)  # in the same order of terms everywhere, so that equal vectors tie
        order = np.lexsort((-score, key[c], r))
        r, c, score = r[order], c[order], score[order]
        first = np.ones(len(r), bool)
        first[1:] = (r[1:] != r[:-1]) | (key[c[1:]] != key[c[:-1]])
        r, c, score = r[first], c[first], score[first]
        order = np.lexsort((key[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append(pd.DataFrame({"query": query[i + r[top]], "key": key[c[top]], "score": score[top]}))
    return pd.concat(out)


def nearest(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, fit_vectors: int = 20_000, list_rows: int = 256, replicas: int = 2, border: float = 0.1, share: float = 0.97) -> DataFrame:
    """(query_id, rank, key, score): of each query its k nearest rows of df other than those with its own key, by inner product in double precision, ties to the least key.

    queries has the columns of df. Vectors that are null, zero or hold null or non-finite components take no part on either side,
    and neither do null keys; a query's candidates are the vectors of its length. Rows that repeat a key count once, with the best score. A query
    that has fewer than k others gets all that are found. Keys are whole numbers.

    The index is fitted on about fit_vectors rows by hash, and holds all rows: lists of about list_rows (as many as the sample
    can tell apart, 16 vectors to a list), longer ones split among tasks. share is the recall that the ratio is chosen for.
    """
    bounded_batches(df.sparkSession)
    asked = dict(by_length(queries, vector))
    found = [_of_length(part, asked[dim], dim, key, vector, k, fit_vectors, list_rows, replicas, border, share) for dim, part in by_length(df, vector) if dim in asked]
    return reduce(DataFrame.unionByName, found or [_none(df.sparkSession, key)])


def _none(spark: SparkSession, key: str) -> DataFrame:
    return spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")


def _of_length(df: DataFrame, queries: DataFrame, dim: int, key: str, vector: str, k: int, fit_vectors: int, list_rows: int, replicas: int, border: float, share: float) -> DataFrame:
    """The same for vectors of one length."""
    spark = df.sparkSession
    rows = written(with_bytes(df.where(F.col(key).isNotNull()), key, vector, dim).where("vec is not null").withColumn("key", F.col("key").cast("long")))
    asked = with_bytes(queries.where(F.col(key).isNotNull()), key, vector, dim).where("vec is not null").withColumn("key", F.col("key").cast("long"))
    state = rows.agg(F.count(F.lit(1)), F.max("norm2")).first()
    n, most = state[0], state[1]
    if not n:
        return _none(spark, key)
    sample = drawn(rows, "key", n, fit_vectors, "postings").orderBy("key", "vec").select("vec", "norm2").collect() or rows.orderBy("key").limit(1).select("vec", "norm2").collect()
    x = lifted(matrix([bytes(r["vec"]) for r in sample], dim), np.array([r["norm2"] for r in sample]), most)
    lists = max(1, min(-(-n // list_rows), len(x) // 16 or 1))
    g = graph(balanced(x, lists))
    ratio = measured_ratio(g, x, k, share, replicas, border)
    shared = spark.sparkContext.broadcast(g)

    def lifted_parts(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            yield part, lifted(matrix(part.column(1).to_pylist(), dim), part.column(2).to_numpy(), most)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, v in lifted_parts(b):
                row, at = chosen(shared.value, v, replicas, border)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *part.take(pa.array(row)).select(["key", "vec"]).columns], ["list", "key", "vec"])

    postings = written(rows.mapInArrow(assign, "list int, key long, vec binary"))
    sizes = {r["list"]: r["n"] for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as lists
    first, parts = cells(sizes, len(g.centroids), max(1, CELL_BYTES // (8 * dim)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, v in lifted_parts(b):
                v[:, -1] = 0.0
                d = shared.value.search(v, ratio, 8)
                row, cell, lists_ = [], [], []
                for i, near in enumerate(d <= ratio * d.min(axis=1)[:, None]):
                    at = np.flatnonzero(near).astype(np.int32)
                    for c in np.unique(np.concatenate([np.arange(first[j], first[j] + parts[j]) for j in at])):
                        row.append(i)
                        cell.append(c)
                        lists_.append(at[(first[at] <= c) & (c < first[at] + parts[at])].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(lists_, pa.binary()), *part.take(pa.array(row, pa.int64())).select(["key", "vec"]).columns], ["cell", "lists", "key", "vec"])

    asks = written(asked.mapInArrow(ask, "cell long, lists binary, key long, vec binary"))
    places = F.broadcast(spark.createDataFrame([(i, int(c), int(n)) for i, (c, n) in enumerate(zip(first, parts, strict=True))], "list int, first long, parts long"))
    blocks = F.broadcast(written(asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))))
    dealt = lambda c: F.pmod(F.xxhash64("key", "vec"), F.col(c))
    left = asks.join(blocks, "cell").select("cell", dealt("blocks").alias("block"), "key", "vec", "lists")
    right = postings.join(places, "list").withColumn("cell", F.col("first") + dealt("parts")).join(blocks, "cell")
    right = right.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "key", "vec", "list")
    found = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(lambda q, r: _best(q, r, dim, k), "query long, key long, score double")
    once = found.groupBy("query", "key").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("key").alias(key), "score")
