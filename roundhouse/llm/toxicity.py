"""Toxicity by class-conditional Kneser-Ney models.

Two character models of words, of toxic and of ordinary documents, differ in their counts of the longest contexts only; what
they back off to are continuation counts of both classes together, so that rare expressions get the same likelihood in either.
All words of the whole text count, in order and as often as they come. A document's evidence is the difference of its two
log-likelihoods by length: of the whole, and of what each word's difference has beyond several margins, as a few expressions in
much ordinary text are toxic too. A logistic function of these is fitted on texts that the models haven't seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, dropped, map_texts, parts_of, release_memory, written
from .labelled import labelled, logistic, logistic_of, sigmoid

WORD = re.compile(r"\w+")
START, END = 2, 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words whose ratios a worker remembers before it forgets all, and those whose counts it holds before it gives them on.
REMEMBERED, COUNTED = 300_000, 100_000
#: Parts of the labelled documents; the ratios that calibrate the score come from models that haven't seen a document's part.
FOLDS = 3


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' code points with a start and an end sign; each place's distance from its word's start, and its word."""
    raw = np.frombuffer("".join(f"{chr(START)}{w}{chr(END)}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    begin = np.cumsum(sizes) - sizes
    return raw, np.arange(len(raw)) - np.repeat(begin, sizes), np.repeat(np.arange(len(words)), sizes)


def _hashes(raw: np.ndarray, order: int) -> np.ndarray:
    """The hash of the order characters that end at each place; wrong where these reach over a word's start."""
    h = np.full(len(raw), order, np.uint64)
    for k in range(order - 1, -1, -1):
        h[k:] = (h[k:] ^ raw[: len(raw) - k]) * MULTIPLIER
        h ^= h >> np.uint64(31)
    return h


@dataclass
class Table:
    """Values by hash."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in values, and whether each hash is there."""
        if not len(self.keys):
            return np.zeros(len(h), int), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h


def _table(h: np.ndarray, weights: np.ndarray) -> Table:
    """Sums of the weights (a column for each class) by hash."""
    keys, inverse = np.unique(h, return_inverse=True)
    return Table(keys, np.stack([np.bincount(inverse, w, len(keys)) for w in weights.T], axis=1))


def _discount(counts: np.ndarray) -> float:
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(once / max(1.0, once + 2.0 * twice), 0.1, 0.95))


@dataclass
class Model:
    """order: characters of a context and the one after it. grams and contexts: by order, from 1."""

    order: int
    grams: list[Table] = field(default_factory=list)  # by order: the log-likelihood ratio of a gram's last character
    contexts: list[Table] = field(default_factory=list)  # by length of the context: log of the ratio of the backoff weights
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))

    def word_ratios(self, words: list[str]) -> np.ndarray:
        """Log of toxic over ordinary likelihood of each word."""
        if not words:
            return np.zeros(0)
        raw, depth, word = _padded(words)
        out, done = np.zeros(len(raw)), depth == 0
        for k in range(self.order, 1, -1):
            # the longest context: order - 1 characters, or all since the word's start
            here = np.flatnonzero(~done & ((depth + 1 == k) if k < self.order else (depth + 1 >= k)))
            if not len(here):
                continue
            h = _hashes(raw, k)[here]
            at, there = self.grams[k].find(h)
            out[here[there]] = self.grams[k].values[at[there], 0]
            missing = here[~there]
            if len(missing):  # the character comes from shared counts: only the weights differ
                at, known = self.contexts[k - 1].find(_hashes(raw, k - 1)[missing - 1])
                out[missing[known]] = self.contexts[k - 1].values[at[known], 0]
            done[here] = True
        return np.bincount(word, out, len(words))


#: Margins (log-likelihood) that words are held against.
MARGINS = np.array([1.0, 2.0, 3.0, 4.0, 6.0, 8.0])
N_FEATURES = 2 * len(MARGINS) + 1


def features(ratios: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of a document's words: what their ratios have beyond each margin by the text's length, how many do (a part of one that hardly does), and the whole difference by length."""
    if not len(ratios):
        return np.zeros(N_FEATURES)
    beyond = np.maximum(ratios[:, None] - MARGINS, 0.0)
    length = sizes.sum()
    return np.concatenate([np.log1p(100.0 / length * beyond.sum(axis=0)), np.log1p(np.minimum(beyond, 1.0).sum(axis=0)), [np.clip(ratios.sum() / length, -2.0, 2.0)]])


def sequence(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def featurer(model: Model, remembered: int = REMEMBERED) -> Callable[[Sequence[str | None]], np.ndarray]:
    """A function that gives texts' features, a row each, and remembers the ratios of words."""
    codes: dict[str, int] = {}
    ratios, sizes = np.zeros(0), np.zeros(0)

    def work(texts: Sequence[str | None]) -> np.ndarray:
        nonlocal ratios, sizes
        found = [sequence(t) for t in texts]
        if len(codes) > remembered:
            codes.clear()
            ratios, sizes = np.zeros(0), np.zeros(0)
        if new := list({w for x in found for w in x}.difference(codes)):
            codes.update(zip(new, range(len(codes), len(codes) + len(new)), strict=True))
            ratios = np.concatenate([ratios, model.word_ratios(new)])
            sizes = np.concatenate([sizes, np.fromiter(map(len, new), float, len(new)) + 1.0])
        at = [np.fromiter(map(codes.__getitem__, x), np.int64, len(x)) for x in found]
        return np.stack([features(ratios[a], sizes[a]) for a in at]) if at else np.zeros((0, N_FEATURES))

    return work


def gram_counts(words: Sequence[Counter], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The order characters that end at each place of the words, or all since the word's start, and how often each Counter has them."""
    every = sorted(set().union(*words))
    if not every:
        return np.zeros(0, f"<U{order}"), np.zeros((0, len(words)), np.int64)
    raw, depth, word = _padded(every)
    size = np.minimum(depth + 1, order)
    h = np.zeros(len(raw), np.uint64)
    for k in range(2, order + 1):
        h = np.where(size == k, _hashes(raw, k), h)
    at = np.flatnonzero(depth > 0)
    keys, first, inverse = np.unique(h[at], return_index=True, return_inverse=True)
    counts = np.stack([np.bincount(inverse, np.fromiter((c[w] for w in every), float, len(every))[word[at]], len(keys)) for c in words], axis=1)
    ends = at[first]
    code = np.zeros((len(ends), order), np.uint32)
    for k in range(order):
        there = k < size[ends]
        code[there, k] = raw[ends[there] - size[ends][there] + 1 + k]
    return code.view(f"<U{order}").ravel(), counts.astype(np.int64)


def train(texts: list[str], toxic: np.ndarray, order: int) -> Model:
    """The two models' tables from labelled texts.

    Counts of a class are of its documents that have a word, so that no single document makes an expression.
    """
    return tables(*gram_counts([Counter(w for t, y in zip(texts, toxic, strict=True) if y == c for w in set(sequence(t))) for c in (1, 0)], order), order)


def tables(found: np.ndarray, counts: np.ndarray, order: int) -> Model:
    """The two models' tables from what gram_counts() gives for toxic and for ordinary documents.

    Grams whose context is the longest (order - 1 characters, or all since the word's start) have counts of each class; the
    shorter ones that these back off to count distinct characters before them, in both classes together.
    """
    model = Model(order, [Table(np.zeros(0, np.uint64), np.zeros((0, 1)))] * (order + 1), [Table(np.zeros(0, np.uint64), np.zeros((0, 1)))] * (order + 1))
    some = counts.sum(axis=1) > 0
    found, counts = found[some], counts[some].astype(float)
    if not len(found):
        return model
    left = np.ascontiguousarray(found).view(np.uint32).reshape(-1, order)
    size = (left > 0).sum(axis=1)
    alphabet = float(len(np.unique(left[left > 0])))
    code = np.zeros((order, len(left)), np.uint32)  # the last character last
    for n in range(1, order + 1):
        at = np.flatnonzero(size == n)
        code[order - n :, at] = left[at, :n].T

    def hashed(at: np.ndarray, k: int, before: int = 0) -> np.ndarray:
        """The hash of the k characters that end so many places before the gram's end."""
        h = np.full(len(at), k, np.uint64)
        for j in range(order - before - k, order - before):
            h = (h ^ code[j, at].astype(np.uint64)) * MULTIPLIER
            h ^= h >> np.uint64(31)
        return h

    def contexts_of(at: np.ndarray, k: int) -> np.ndarray:
        return hashed(at, k - 1, 1) if k > 1 else np.zeros(len(at), np.uint64)

    # shared continuation counts: distinct longer grams that end in a gram
    shared: list[tuple[Table, Table, float]] = [(Table(np.zeros(0, np.uint64), np.zeros((0, 1))),) * 2 + (0.0,)]
    for k in range(1, order):
        longer = np.flatnonzero(size > k)
        _, first = np.unique(hashed(longer, k + 1), return_index=True)
        ends = longer[first]
        own = hashed(ends, k)
        grams = _table(own, np.ones((len(ends), 1)))
        firsts = np.unique(own, return_index=True)[1]
        kinds = np.zeros(len(ends))
        kinds[firsts] = 1.0
        shared.append((grams, _table(contexts_of(ends, k), np.column_stack([np.ones(len(ends)), kinds])), _discount(grams.values[:, 0])))

    def backed(at: np.ndarray, k: int) -> np.ndarray:
        """Shared likelihood of each gram's last character, from the k - 1 before it."""
        if k == 0:
            return np.full(len(at), 1.0 / alphabet)
        lower = backed(at, k - 1)
        grams, contexts, d = shared[k]
        place, there = grams.find(hashed(at, k))
        c = np.where(there, grams.values[place, 0] if len(grams.keys) else 0.0, 0.0)
        place, known = contexts.find(contexts_of(at, k))
        total = np.where(known, contexts.values[place, 0], 1.0)
        kinds = np.where(known, contexts.values[place, 1], 0.0)
        return np.where(known, np.maximum(c - d, 0.0) / total + d * kinds / total * lower, lower)

    for k in range(2, order + 1):
        own = np.flatnonzero(size == k)
        if not len(own):
            continue
        keys, first = np.unique(hashed(own, k), return_index=True)
        ends = own[first]
        n = counts[ends]
        context, of = np.unique(contexts_of(ends, k), return_inverse=True)
        totals = np.stack([np.bincount(of, n[:, c], len(context)) for c in (0, 1)], axis=1)
        kinds = np.stack([np.bincount(of, n[:, c] > 0, len(context)) for c in (0, 1)], axis=1)
        d = np.array([_discount(n[:, c]) for c in (0, 1)])
        back = np.where(totals > 0, d * kinds / np.maximum(totals, 1.0), 1.0)
        lower = backed(ends, min(k - 1, order - 1))[:, None]
        p = np.where(totals[of] > 0, np.maximum(n - d, 0.0) / np.maximum(totals[of], 1.0), 0.0) + back[of] * lower
        model.grams[k] = Table(keys, np.log(p[:, :1] / p[:, 1:]))
        model.contexts[k - 1] = Table(context, np.log(back[:, :1] / back[:, 1:]))
    release_memory()
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", order: int = 5, seed: str = "toxicity", key: str = "doc_id", text: str = "text") -> Model:
    """A model from all labelled documents, each whole.

    All of them give the counts. The score is calibrated on ratios from models of two thirds of them each, over the third (by a
    hash of the key) that such a model hasn't seen. Labelled texts are written once and read twice; grams are counted and the
    calibration's sums made on the executors. The driver gets the distinct grams, of order characters at most, with their counts.
    """
    bounded_batches(docs.sparkSession)
    found = written(labelled(docs, labels, label, seed, key, text).select("text", "label", (F.col("place") % FOLDS).cast("int").alias("fold")))
    grams, counts = _counted(found, order)
    by = counts.reshape(-1, FOLDS, 2)
    seen = _featured(found, [tables(grams, by.sum(axis=1) - by[:, f], order) for f in range(FOLDS)])
    model = tables(grams, by.sum(axis=1), order)
    model.weights = logistic_of(seen, [c for c in seen.columns if c != "label"], "label")
    dropped(found)
    dropped(seen)
    return model


def _counted(found: DataFrame, order: int) -> tuple[np.ndarray, np.ndarray]:
    """gram_counts() of all texts, by fold and, within, toxic and ordinary."""
    names = [f"n{i}" for i in range(2 * FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Counter() for _ in names]

        def made() -> pa.RecordBatch:
            grams, counts = gram_counts(words, order)
            for c in words:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(grams.tolist(), pa.string()), *(pa.array(n) for n in counts.T)], ["gram", *names])

        for batch in batches:
            for t, y, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words[2 * f + 1 - y].update(set(sequence(t)))
                if sum(map(len, words)) > COUNTED:
                    yield made()
        yield made()
        release_memory()

    schema = ", ".join(["gram string", *(f"{n} long" for n in names)])
    rows = found.mapInArrow(run, schema).groupBy("gram").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    grams = [np.array(b.column(0).to_pylist(), f"<U{order}") for b in rows.to_batches(10_000)]
    return np.concatenate([np.zeros(0, f"<U{order}"), *grams]), np.stack([rows[n].to_numpy() for n in names], axis=1).astype(np.int64)


def _featured(found: DataFrame, unseen: list[Model]) -> DataFrame:
    """Label and features of each text by the model that hasn't seen its fold, written."""
    shared = found.sparkSession.sparkContext.broadcast(unseen)
    names = [f"x{i}" for i in range(N_FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = [featurer(m, REMEMBERED // FOLDS) for m in shared.value]
        for batch in batches:
            texts, y, fold = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_numpy()
            for start, end in parts_of(texts):
                x = np.zeros((end - start, N_FEATURES))
                for f in range(FOLDS):
                    at = np.flatnonzero(fold[start:end] == f)
                    x[at] = work[f]([texts[start + i] for i in at])
                yield pa.RecordBatch.from_arrays([y.slice(start, end - start), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["label", *names])
        release_memory()

    out = written(found.mapInArrow(run, ", ".join(["label int", *(f"{n} double" for n in names)])))
    shared.destroy()
    return out


def fit_texts(texts: list[str], y: np.ndarray, weight: np.ndarray, fold: np.ndarray, order: int = 5) -> Model:
    """fit() of texts that are at hand, with weights."""
    x = np.zeros((len(texts), N_FEATURES))
    for k in np.unique(fold):
        some = train([t for t, f in zip(texts, fold, strict=True) if f != k], y[fold != k], order)
        x[fold == k] = featurer(some)([t for t, f in zip(texts, fold, strict=True) if f == k])
    model = train(texts, y, order)
    model.weights = logistic(x, y, weight)
    return model


SCORE = T.StructType([T.StructField("toxic_score", T.DoubleType())])


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with toxic_score (0 to 1), from the whole text. Null and empty texts, and those without words, get the score of no evidence.

    All rows stay, repeated ones and those of null keys too, and equal texts have equal scores; other columns pass through, and one
    of the new name is replaced. An empty table gives no rows. A model of no labels gives one score to all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        found = featurer(own)

        def work(texts: list[str | None]) -> list[pa.Array]:
            return [pa.array(sigmoid(found(texts) @ own.weights[:-1] + own.weights[-1]))]

        return work

    return map_texts(docs, text, SCORE, make, keep_text)
