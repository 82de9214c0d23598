"""What the vector operators share: reading, samples, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, unit_hash


def by_length(df: DataFrame, vector: str) -> list[tuple[int, DataFrame]]:
    """The rows by the length of their vectors, each length a table of its own, as vectors of different lengths have no angle.

    Null and empty vectors come with the first length (0, if there are no others). Lengths are few: how many a table has is all
    that the driver asks.
    """
    size = F.coalesce(F.size(vector), F.lit(0))
    lengths = sorted(r["d"] for r in df.select(size.alias("d")).where("d > 0").distinct().collect()) or [0]
    if len(lengths) == 1:
        return [(lengths[0], df)]
    return [(d, df.where((size == d) | (size <= 0)) if i == 0 else df.where(size == d)) for i, d in enumerate(lengths)]


def sound(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has dim components, all finite and some not zero; and these vectors, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == dim)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64) if dim else np.zeros(0)
    x = flat.reshape(len(rows), dim)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[ok], x[ok]


def with_bytes(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, vec, norm2): each row's key; its vector's doubles as bytes and squared norm, both null if it isn't sound."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = sound(b.column(1), dim)
            vec, norm2 = [None] * b.num_rows, [None] * b.num_rows
            for i, v, n in zip(rows.tolist(), x, (x * x).sum(axis=1).tolist(), strict=True):
                vec[i], norm2[i] = v.tobytes(), n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vec, pa.binary()), pa.array(norm2, pa.float64())], ["key", "vec", "norm2"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInArrow(run, f"key {kind}, vec binary, norm2 double")


def matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), dim)


def drawn(df: DataFrame, key: str, rows: int, most: int, seed: str) -> DataFrame:
    """About most of the rows, or all if there are fewer, by hash of the key."""
    return df.where(unit_hash(F.col(key), seed) < min(1.0, most / max(1, rows)))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2.0 * (x @ c.T))


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """k-means centroids, from k rows at random; a cluster that loses all keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = np.concatenate([squared(x[i : i + 4096], c).argmin(axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(at, minlength=len(c))
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
    return c
