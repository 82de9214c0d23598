"""Quality classification by naive Bayes support vectors.

A text's features are indicators of hashed n-grams: of its characters, of their classes with runs made one, and of whether each
word repeats the one before. They are scaled by the log of the ratio of their shares in good and in bad texts, brought to unit
length, and weighed by a linear hinge-loss model that dual coordinate descent fits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts
from .labelled import logistic, sample, sigmoid

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FEATURE_BITS = 17
CHARS, CLASSES, REPEATS = (1, 2, 3), (2, 3, 4, 5), (1, 2, 3, 4)


@cache
def classes() -> np.ndarray:
    """A code point's class: upper-case letter, other letter, digit, white space, or itself."""
    out = np.arange(0x110000, dtype=np.uint32) + 16
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = 1 if c.isupper() else 2
        elif c.isdigit():
            out[i] = 3
        elif c.isspace():
            out[i] = 4
    return out


def _grams(code: np.ndarray, n: int, kind: int) -> np.ndarray:
    m = len(code) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    wide = code.astype(np.uint64)
    h = np.full(m, kind * 16 + n, np.uint64)
    for k in range(n):
        h = (h ^ wide[k : k + m]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return ((h * MULTIPLIER) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def text_features(text: str | None, seen: np.ndarray) -> np.ndarray:
    """The places of a whole text's features. seen: 2 ** FEATURE_BITS times False, and left so. A text without any has none."""
    if not text:
        return np.zeros(0, np.int64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[code]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    blank = kind == 4
    start = ~blank
    start[1:] &= blank[:-1]
    first = np.flatnonzero(start)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(64, MULTIPLIER))
        depth = np.arange(len(code)) - np.maximum.accumulate(np.where(start, np.arange(len(code)), 0))
        mixed = np.where(blank, np.uint64(0), (code.astype(np.uint64) + np.uint64(7)) * power[depth % 64])
        words = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, np.uint64)
    again = (words[1:] == words[:-1]).astype(np.uint32)
    for n in CHARS:
        seen[_grams(code, n, 1)] = True
    for n in CLASSES:
        seen[_grams(kind[new], n, 2)] = True
    for n in REPEATS:
        seen[_grams(again, n, 3)] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


@dataclass
class Model:
    ratios: np.ndarray  # of each feature, log of its share in good texts over that in bad ones
    weights: np.ndarray
    bias: float
    slope: np.ndarray  # calibration

    def margin(self, at: np.ndarray) -> float:
        r = self.ratios[at]
        return float(self.weights[at] @ r / max(1e-12, np.sqrt(r @ r))) + self.bias


def descend(rows: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge-loss model, by dual coordinate descent over rows in random order."""
    sign = np.where(y == 1, 1.0, -1.0)
    unit = []
    for at in rows:
        r = ratios[at]
        unit.append(r / max(1e-12, np.sqrt(r @ r)))
    w, b, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    soft = 0.5 / (cost * weight / weight.mean()) if len(rows) else alpha
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i], unit[i]
            g = sign[i] * (w[at] @ x + b) - 1.0 + soft[i] * alpha[i]
            new = max(0.0, alpha[i] - g / (x @ x + 1.0 + soft[i]))
            if (step := (new - alpha[i]) * sign[i]) != 0.0:
                w[at] += step * x
                b += step
                alpha[i] = new
    return w, b


def _trained(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, smooth: float) -> Model:
    size = 1 << FEATURE_BITS
    with_ = np.zeros((2, size))
    for at, c in zip(rows, y, strict=True):
        with_[c, at] += 1.0
    share = (with_ + smooth) / (with_.sum(axis=1, keepdims=True) + smooth * size)
    ratios = np.log(share[1] / share[0])
    w, b = descend(rows, ratios, y, weight)
    return Model(ratios, w, b, np.array([1.0, 0.0]))


def fit_texts(texts: list[str], y: np.ndarray, weight: np.ndarray, fold: np.ndarray, smooth: float = 1.0) -> Model:
    seen = np.zeros(1 << FEATURE_BITS, bool)
    rows = [text_features(t, seen) for t in texts]
    margins = np.zeros(len(rows))
    for k in np.unique(fold):
        use = np.flatnonzero(fold != k)
        some = _trained([rows[i] for i in use], y[use], weight[use], smooth)
        for i in np.flatnonzero(fold == k):
            margins[i] = some.margin(rows[i])
    model = _trained(rows, y, weight, smooth)
    model.slope = logistic(margins[:, None], y, weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_docs: int = 4000, seed: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """A model from about fit_docs labelled documents (half of them good, or all that are), drawn by hash.

    The score is calibrated on margins by models of two thirds of them over the third that such a model hasn't seen.
    """
    texts, y, weight, place = sample(docs, labels, label, fit_docs // 2, seed, key, text)
    return fit_texts(texts, y, weight, place % 3)


SCORE = T.StructType([T.StructField("quality_score", T.DoubleType())])


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with quality_score (0 to 1), from the whole text; null and empty texts get the score of the bias alone.

    All rows stay, repeated ones and those of null keys too, and equal texts have equal scores; other columns pass through, and one
    of the new name is replaced. An empty table gives no rows. A model of no labels gives one score to all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        seen = np.zeros(1 << FEATURE_BITS, bool)

        def work(texts: list[str | None]) -> list[pa.Array]:
            margins = np.array([own.margin(text_features(t, seen)) for t in texts])
            return [pa.array(sigmoid(own.slope[0] * margins + own.slope[1]))]

        return work

    return map_texts(docs, text, SCORE, make, keep_text)
