"""Language identification by language-bitmask n-gram filters.

Each language's frequent character n-grams go into a Bloom filter. The filters lie bit-sliced in one table: a place holds one bit
for each language, so that a few lookups and their conjunction give all languages that have an n-gram. A text's hits are counted
for each language, freed of the hits that false positives account for, and the language with most of them is predicted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, map_texts, unit_hash

#: Odd multipliers of the hashes.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
UNKNOWN = "und"
SPACE = 32


@cache
def letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def codes_of(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, with one space for each run of anything but letters, and where each text's begin.

    Every text is framed by spaces; the places are one more than the texts.
    """
    low = [(t or "").lower() for t in texts]
    raw = np.frombuffer((" ".join(["", *low, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum([0, *(len(t) + 1 for t in low)])
    code = np.where(letters()[raw], raw, np.uint32(SPACE))
    blank = code == SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[first] = True
    return code[keep], (np.cumsum(keep) - 1)[first]


def hashes(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that begin at each place, and which of them count: those with spaces at their ends only, not alone."""
    m = max(0, len(code) - n + 1)
    wide = code.astype(np.uint64)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h += wide[k : k + m] * MIX[k]
        h ^= h >> np.uint64(29)
        h *= MIX[4]
    h ^= h >> np.uint64(32)
    letter = code != SPACE
    counts = letter[n // 2 : n // 2 + m].copy()
    for k in range(1, n - 1):
        counts &= letter[k : k + m]
    if n == 2:
        counts = letter[:m] | letter[1 : 1 + m]
    return h, counts


@dataclass
class Filters:
    """Bit-sliced Bloom filters: words[p, s] has bit b for language 64 * s + b."""

    langs: list[str]
    words: np.ndarray
    looks: int
    orders: tuple[int, ...]

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        bits = np.uint64(64 - int(math.log2(len(self.words))))
        for k in range(self.looks):
            yield ((h * MIX[k]) >> bits).astype(np.int64)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each hash the languages that have it, as bits."""
        out = None
        for p in self.places(h):
            out = self.words[p] if out is None else out & self.words[p]
        return out

    def false_rates(self) -> np.ndarray:
        """For each language the share of absent n-grams that its filter has all the same."""
        bits = np.unpackbits(self.words.view(np.uint8), axis=1, bitorder="little")
        return bits.mean(axis=0)[: len(self.langs)] ** self.looks

    def hits(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: hits of each language less the expected false ones, all n-grams, and whether it has a letter."""
        code, first = codes_of(texts)
        hits = np.zeros((len(texts), len(self.langs)))
        total = np.zeros(len(texts))
        lettered = np.diff(np.concatenate([[0], np.cumsum(code != SPACE)])[first]) > 0
        for n in self.orders:
            h, counts = hashes(code, n)
            at = np.flatnonzero(counts)
            ends = np.searchsorted(at, first)
            masks = self.masks(h[at])
            total += np.diff(ends)
            for l in range(len(self.langs)):
                found = np.concatenate([[0], np.cumsum(masks[:, l // 64] >> np.uint64(l % 64) & np.uint64(1))])
                hits[:, l] += np.diff(found[ends])
        rates = self.false_rates()
        return np.maximum(0.0, (hits - total[:, None] * rates) / (1 - rates)), total, lettered

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the share of the text's n-grams that its language has."""
        hits, total, lettered = self.hits(texts)
        best = hits.argmax(axis=1)
        score = np.where(lettered, np.minimum(1.0, hits[np.arange(len(texts)), best] / np.maximum(total, 1)), 0.0)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], score


def _built(langs: list[str], grams: list[np.ndarray], looks: int, bits_per_gram: int, orders: tuple[int, ...]) -> Filters:
    size = 1 << max(10, math.ceil(math.log2(max(1, max(map(len, grams), default=1)) * bits_per_gram)))
    out = Filters(langs, np.zeros((size, max(1, -(-len(langs) // 64))), np.uint64), looks, orders)
    for l, h in enumerate(grams):
        for p in out.places(h):
            out.words[p, l // 64] |= np.uint64(1 << l % 64)
    return out


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", fit_docs: int = 8000, min_share: float = 0.03, orders: tuple[int, ...] = (3, 4), looks: int = 3, bits_per_gram: int = 16, seed: str = "langid") -> Filters:
    """Filters of the languages of rows whose language isn't null.

    A language's filter has the n-grams that are in at least min_share of its documents: so few that the filters stay small
    however large the corpus is. The shares come from a sample by hash of the key of about fit_docs documents in all, as many of
    each language (all of a language that has fewer). Without any language the filters know none, and every text is "und".
    """
    docs = docs.where(F.col(lang).isNotNull()).select(key, text, lang)
    bounded_batches(docs.sparkSession)
    sizes = {r[lang]: r["n"] for r in docs.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return _built([], [], looks, bits_per_gram, orders)
    share = {l: min(1.0, fit_docs / len(langs) / sizes[l]) for l in langs}
    rates = docs.sparkSession.createDataFrame([(l, i, share[l], sizes[l] * share[l] * min_share) for i, l in enumerate(langs)], "at_lang string, at int, rate double, least double")
    drawn = docs.join(F.broadcast(rates), F.col(lang) == F.col("at_lang")).where(unit_hash(F.col(key), seed) < F.col("rate")).select("at", F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, list[np.ndarray]] = {}
            for at, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                code, _ = codes_of([t])
                found.setdefault(at, []).append(np.unique(np.concatenate([h[ok] for h, ok in (hashes(code, n) for n in orders)])))
            for at, sets in found.items():
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), at, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], ["at", "h", "n"])

    counted = drawn.mapInArrow(count, "at int, h long, n long").groupBy("at", "h").agg(F.sum("n").alias("n"))
    kept = counted.join(F.broadcast(rates), "at").where(F.col("n") >= F.col("least")).select("at", "h").toPandas()
    grams = [kept["h"].to_numpy()[kept["at"].to_numpy() == i].astype(np.int64).view(np.uint64) for i in range(len(langs))]
    return _built(langs, grams, looks, bits_per_gram, orders)


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])


def predict(docs: DataFrame, filters: Filters, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and lang_score (0 to 1). Texts that are null or have no letter are "und" with score 0.

    Of languages with equal hits the first in code point order is taken. Whole texts count. All rows stay, repeated ones and those
    of null keys too; other columns pass through, and columns of the new names are replaced. An empty table gives no rows; filters
    of no language make every text undetermined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def make():
        found = shared.value

        def work(texts: list[str | None]) -> list[pa.Array]:
            if not found.langs:
                return [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts)))]
            langs, scores = found.predict(texts)
            return [pa.array(langs, pa.string()), pa.array(scores)]

        return work

    return map_texts(docs, text, PREDICTED, make, keep_text)
