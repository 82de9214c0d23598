"""Labelled documents, samples of them and calibration, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_labels, sampled_labels


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: str, key: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Texts, labels, weights and random numbers of about per_class labelled documents of either label, in order of their keys' hash.

    The sample goes to the driver, which fits the model. The keys, at most some per_class of either label, are broadcast to find
    their texts. Null texts count as empty.
    """
    keys = sampled_labels(labels, key, label, per_class, seed).select(F.col(key).alias("at_key"), F.col(label).alias("at_label"), F.col("weight").alias("at_weight"))
    found = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(keys), F.col("key") == F.col("at_key"))
    rows = found.select("text", "at_label", "at_weight", F.md5(F.concat(F.lit(seed), F.col("key").cast("string"))).alias("place")).collect()
    rows.sort(key=lambda r: (r["place"], r["text"]))
    return [r["text"] for r in rows], np.array([r["at_label"] for r in rows], int), np.array([r["at_weight"] for r in rows], float), np.array([int(r["place"][:8], 16) for r in rows], int)


#: Bits of a row of key_bits(), as bitmap_construct_agg has them, and bits for each key.
BITMAP, BITS_PER_KEY = 32_768, 16


def only_keys(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """docs without most rows whose key isn't among those of the one-column table keys; a join must follow.

    The hashes of the keys are broadcast as bits, two bytes for each: at most one in sixteen of the other rows stays.
    """
    at_key = keys.columns[0]
    if docs.schema[key].dataType != keys.schema[at_key].dataType:  # equal values of different types have different hashes
        return docs
    rows = max(1, -(-keys.count() * BITS_PER_KEY // BITMAP))
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(rows * BITMAP))
    bit = hashed(F.col(at_key)) % BITMAP
    bits = keys.groupBy(F.floor(hashed(F.col(at_key)) / BITMAP).alias("at_row")).agg(F.bitmap_construct_agg(bit).alias("at_bits"))
    own = hashed(F.col(key)) % BITMAP
    byte = F.conv(F.hex(F.substring(F.col("at_bits"), (F.floor(own / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = docs.join(F.broadcast(bits), F.floor(hashed(F.col(key)) / BITMAP) == F.col("at_row"))
    return found.where(F.getbit(byte, (own % 8).cast("int")) == 1).drop("at_row", "at_bits")


def labelled(docs: DataFrame, labels: DataFrame, label: str, seed: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All labelled documents: text, label and place, a random number by the key's hash. Null texts count as empty.

    Their texts are shuffled to the labels, but hardly any others.
    """
    keys = clean_labels(labels, key, label).select(F.col(key).alias("at_key"), F.col(label).alias("label"))
    place = F.conv(F.md5(F.concat(F.lit(seed), F.col("key").cast("string"))).substr(1, 8), 16, 10).cast("long")
    some = only_keys(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("key").isNotNull()), "key", keys.select("at_key"))
    return some.join(keys.hint("merge"), F.col("key") == F.col("at_key")).select("text", "label", place.alias("place"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights, the intercept last, of a logistic regression by Newton's method. With one label only: its prior, smoothed."""
    sizes = weight[y == 0].sum(), weight[y == 1].sum()
    weight = weight / weight.mean() if len(y) else weight
    return _newton(x.shape[1], len(np.unique(y)), sizes, lambda w: _slopes(x, y, weight, w), ridge, rounds)


def logistic_of(rows: DataFrame, inputs: Sequence[str], label: str, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """logistic() of a table, whose rows weigh the same: each round reads it once, and the driver gets the sums of its partitions."""
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}

    def slopes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
            for b in batches:
                x, y = np.column_stack([b.column(i).to_numpy() for i in range(len(inputs))]), b.column(len(inputs)).to_numpy()
                some = _slopes(x, y, np.ones(len(y)), w)
                g, h = g + some[0], h + some[1]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g, h.ravel()])], pa.list_(pa.float64()))], ["sums"])

        sums = np.sum([r["sums"] for r in rows.select(*inputs, label).mapInArrow(run, "sums array<double>").collect()], axis=0)
        return sums[: len(w)], sums[len(w) :].reshape(len(w), len(w))

    return _newton(len(inputs), len(sizes), (float(sizes.get(0, 0)), float(sizes.get(1, 0))), slopes, ridge, rounds)


def _slopes(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives of the loss at w."""
    a = np.column_stack([x, np.ones(len(x))])
    p = sigmoid(a @ w)
    return a.T @ (weight * (p - y)), (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a


def _newton(inputs: int, labels: int, sizes: tuple[float, float], slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], ridge: float, rounds: int) -> np.ndarray:
    w = np.zeros(inputs + 1)
    if labels < 2:
        w[-1] = np.log((sizes[1] + 0.5) / (sizes[0] + 0.5)) if labels else 0.0
        return w
    pull = np.full(len(w), ridge)
    pull[-1] = 0.0
    for _ in range(rounds):
        g, h = slopes(w)
        step = np.linalg.solve(h + np.diag(pull + 1e-9), g + pull * w)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))
