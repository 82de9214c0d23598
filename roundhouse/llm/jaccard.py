"""Exact Jaccard join of word n-gram sets, by rare-first prefixes.

Equal sets are one class. Tokens (n-grams) are put in one order, rare ones first; two sets that are similar enough share a token
in their prefixes, a quarter of each set or so. Tokens of one set only come first of all, and are never moved: a set that has too
few others links with nothing.

What is similar to what is then found in two steps, so that a group of n copies takes some n pairs, not n squared. First every
set is held against one set of each prefix token it has, and links make components. Then pairs that share a prefix token and
are in different components by now are held against each other; others can't change the components. A pair must pass the length,
positional and suffix filters, and is verified once, on whole sets.

Tokens are 64-bit hashes, cut to 22 bits more than the corpus's tokens need to be numbered (48 at least): some in four million
may pass for another one, which makes an order, a prefix or a candidate less apt but no less right; in one pair's intersection
that doesn't matter. Classes are 64-bit hashes of whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, dropped, map_texts, numbered, parts_of, release_memory, unit_hash, written
from .components import components

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
#: Tokens that a task gathers before it sends them on, and that one shard of all tokens has.
GATHERED = 1 << 20
SHARD_TOKENS = 1_500_000
#: Documents that are looked over for very common tokens, and the share of them that makes a token one (some hundred thousand at most).
LOOKED_OVER = 4000
COMMON_SHARE = 0.002
HOT = 0xFFFF
SIGNATURE = 128


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[5]
    h = (h ^ (h >> np.uint64(29))) * MIX[6]
    return h ^ (h >> np.uint64(32))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX[0])


def token_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its width-word n-grams; of fewer words, that of their whole sequence.

    Words are runs of other bytes than space and 9 to 13, with A-Z in lower case.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    byte = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
    blank = (byte == 32) | ((byte >= 9) & (byte <= 13))
    start = ~blank
    start[1:] &= blank[:-1]
    first = np.flatnonzero(start)
    out = [np.zeros(0, np.uint64)] * len(texts)
    if not len(first):
        return out
    place = np.arange(len(byte), dtype=np.int32)
    depth = place - np.maximum.accumulate(np.where(start, place, np.int32(0)))
    depth[blank] = 0
    power = np.cumprod(np.full(int(depth.max()) + 1, MIX[1], np.uint64))
    word = mixed(np.add.reduceat(np.where(blank, np.uint64(0), _BYTES[byte] * power[depth]), first))
    ends = np.cumsum([len(r) + 1 for r in raw])
    upto = np.searchsorted(first, ends).tolist()
    m = max(0, len(word) - width + 1)
    gram = np.zeros(m, np.uint64)
    for k in range(width):
        gram += word[k : k + m] * MIX[k % 5] + np.uint64(k // 5)
    gram = mixed(gram)
    a = 0
    for i, b in enumerate(upto):
        if b - a >= width:
            out[i] = np.unique(gram[a : b - width + 1])
        elif b > a:
            out[i] = mixed((word[a:b] * MIX[np.arange(b - a) % 5]).sum(keepdims=True, dtype=np.uint64) + np.array([b - a], np.uint64) * MIX[5])
        a = b
    return out


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit key of a whole set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n: int, m: int, percent: int) -> int:
    """The overlap that two sets of n and m tokens need: 100 * overlap >= percent * (n + m - overlap)."""
    return -(-percent * (n + m) // (100 + percent))


def least_own(n: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that a set of n tokens needs with any set."""
    return -(-percent * n // 100)


# ---- tokens that several classes have


def _common(docs: DataFrame, text: str, key: str, width: int, rows: int) -> np.ndarray:
    """Sorted tokens that are in a large share of documents, by a look at some; they take a way of their own and are last in the order.

    Which ones do changes no result. Their places among each other go by their counts in all sets, see _ranked.
    """
    some = docs.where(unit_hash(F.col(key), "common") < min(1.0, LOOKED_OVER / max(1, rows))).select(F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            sets = [s for i, j in parts_of(texts) for s in token_sets(texts[i:j], width)]
            h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counted = some.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= max(8, LOOKED_OVER * COMMON_SHARE)).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def _ranked(classes: DataFrame, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """The common tokens, cut and sorted, and the rank of each by the number of all classes that have it, rare ones first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            own = [np.unique(np.frombuffer(x, "<u8") >> np.uint64(cut)) for x in b.column(0).to_pylist() if x]
            h, at = np.unique(np.concatenate([h, *own]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, *(np.ones(len(x), np.int64) for x in own)]), len(h)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    found = classes.select("common").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toPandas()
    h, n = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.lexsort((h, n))
    rank = np.empty(len(h), np.uint32)
    rank[order] = np.arange(len(h))
    by = np.argsort(h)
    return h[by], rank[by]


def _within(common: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(tokens), bool)
    return common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens


def _planes(x: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte plane by byte plane, without the planes that are zero; their number comes first."""
    steps = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    n = 8
    while n > 1 and not planes[n - 1].any():
        n -= 1
    return bytes([n]) + planes[:n].tobytes()


def _numbers(blob: bytes) -> np.ndarray:
    n = blob[0]
    planes = np.zeros((8, (len(blob) - 1) // n), np.uint8)
    planes[:n] = np.frombuffer(blob, np.uint8, offset=1).reshape(n, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _shards(docs: DataFrame, text: str, width: int, common, shards: int, bits: int) -> DataFrame:
    """(shard, tokens, owners, classes): the uncommon tokens of each class, shard by shard of the tokens; a task sends a class once."""
    size = -(-(1 << bits) // shards)

    def send(gathered: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([t for _, t in gathered])
        owner = np.repeat(np.arange(len(gathered), dtype=np.uint32), [len(t) for _, t in gathered])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        classes = np.array([c for c, _ in gathered], np.int64)
        shard = (tokens // np.uint64(size)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=shards + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own, at = np.unique(owner[a:b], return_inverse=True)
            at = at.astype("<u2" if len(own) <= 1 << 16 else "<u4")
            row = [int(shard[a]), _planes(tokens[a:b] - np.uint64(int(shard[a]) * size)), at.tobytes(), classes[own].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], ["shard", "tokens", "owners", "classes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, sent, gathered, n = common.value, set(), [], 0
        cut = np.uint64(64 - bits)
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in parts_of(texts):
                for tokens in token_sets(texts[i:j], width):
                    if len(tokens) and (c := class_of(tokens)) not in sent:
                        sent.add(c)
                        gathered.append((c, np.unique(tokens[~_within(hot, tokens)] >> cut)))
                        n += len(tokens)
                if n >= GATHERED:
                    yield from send(gathered)
                    gathered, n = [], 0
        if n:
            yield from send(gathered)
        del gathered, sent
        release_memory()

    return docs.select(text).mapInArrow(run, "shard int, tokens binary, owners binary, classes binary")


def _shared(shards: DataFrame, size: int, buckets: int) -> DataFrame:
    """(bucket, classes, tokens, counts): what classes of a bucket share of a shard's tokens with other classes, and with how many."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        tokens, owners = [], []
        for t, o, c in zip(group["tokens"], group["owners"], group["classes"], strict=True):
            c = np.frombuffer(c, np.int64)
            tokens.append(_numbers(t))
            owners.append(c[np.frombuffer(o, "<u2" if len(c) <= 1 << 16 else "<u4")])
        base = np.uint64(int(group["shard"].iloc[0]) * size)
        tokens, owners = np.concatenate(tokens), np.concatenate(owners)
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])  # a class that several tasks sent
        tokens, owners = tokens[new], owners[new]
        first = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
        counts = np.diff(np.append(first, len(tokens)))
        per = np.repeat(np.minimum(counts, HOT - 1), counts)
        keep = per > 1
        tokens, owners, per = tokens[keep] + base, owners[keep], per[keep]
        bucket = owners % buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = order[a:b]
            rows.append((int(bucket[at[0]]), owners[at].tobytes(), tokens[at].tobytes(), per[at].astype("<u2").tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "classes", "tokens", "counts"])

    return shards.groupBy("shard").applyInPandas(count, "bucket long, classes binary, tokens binary, counts binary")


def _survivors(classes: DataFrame, shared: DataFrame, percent: int, buckets: int, cut: int, ranked) -> DataFrame:
    """(class, n, alone, tokens, signature) of the classes with enough shared tokens to link; tokens in order, rare ones first.

    alone: its tokens that no other class has, which come before those.
    """

    def gather(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        owners = [np.frombuffer(x, np.int64) for x in parts["classes"]]
        tokens = [np.frombuffer(x, np.uint64) for x in parts["tokens"]]
        counts = [np.frombuffer(x, "<u2").astype(np.uint32) for x in parts["counts"]]
        known, rank = ranked.value
        for c, blob in zip(own["class"], own["common"], strict=True):
            if len(blob):
                hot = np.unique(np.frombuffer(blob, "<u8") >> np.uint64(cut))
                tokens.append(hot)
                owners.append(np.full(len(hot), c, np.int64))
                counts.append(np.uint32(HOT) + rank[np.searchsorted(known, hot)])
        rows = []
        if owners:
            owners, tokens, counts = np.concatenate(owners), np.concatenate(tokens), np.concatenate(counts)
            order = np.lexsort((tokens, counts, owners))
            owners, tokens = owners[order], tokens[order]
            sizes = dict(zip(own["class"].tolist(), own["n"].tolist(), strict=True))
            cuts = np.flatnonzero(np.diff(owners, prepend=~owners[:1], append=~owners[-1:]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                n = sizes[int(owners[a])]
                if b - a >= least_own(n, percent):
                    signature = np.bincount((mixed(tokens[a:b]) >> np.uint64(57)).astype(np.int64), minlength=SIGNATURE)
                    rows.append((int(owners[a]), n, n - (b - a), tokens[a:b].tobytes(), signature.astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["class", "n", "alone", "tokens", "signature"])

    own = classes.withColumn("bucket", F.pmod("class", F.lit(buckets).cast("long"))).groupBy("bucket")
    return own.cogroup(shared.groupBy("bucket")).applyInPandas(gather, "class long, n long, alone long, tokens binary, signature binary")


def _prefixes(survivors: DataFrame, percent: int) -> DataFrame:
    """(token, class, n, place, alone): the prefix tokens that several classes have; place counts from 0 in the whole order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, n, alone, blob in zip(*(x.to_pylist() for x in b.columns), strict=True):
                k = int(n - least_own(n, percent) + 1 - alone)
                tokens = np.frombuffer(blob, "<u8")[: max(0, k)]
                m = len(tokens)
                full = lambda x: pa.array(np.full(m, x, np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), full(c), full(n), pa.array(np.arange(alone, alone + m)), full(alone)], ["token", "class", "n", "place", "alone"])

    return survivors.select("class", "n", "alone", "tokens").mapInArrow(run, "token long, class long, n long, place long, alone long")


# ---- candidates and links


def _may_link(n: Column, m: Column, i: Column, j: Column, percent: int) -> Column:
    """The length and positional filters, for a token at places i of n and j of m. The first token that a linked pair shares passes both."""
    similar = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return similar & ((100 + percent) * F.least(n - i, m - j) >= percent * (n + m))


def _pairs(left: DataFrame, right: DataFrame, percent: int, by_size: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of classes, a below b, from rows of both sides with the same token.

    by_size: sizes are part of the key, as steps of the ratio that two similar sets' sizes have at most; left rows go to their
    step and both beside it, so that a token's sets of other sizes never meet.
    """
    same = F.col("x.token") == F.col("y.token")
    if by_size:
        step = F.floor(F.log("n") / (math.log(100 / percent) + 1e-6))  # a little longer, so that rounding parts no two
        left = left.withColumn("step", F.explode(F.array(step - 1, step, step + 1)))
        right, same = right.withColumn("step", step), same & (F.col("x.step") == F.col("y.step"))
    joined = left.alias("x").join(right.alias("y"), same)
    ok = (F.col("x.class") != F.col("y.class")) & _may_link(F.col("x.n"), F.col("y.n"), F.col("x.place"), F.col("y.place"), percent)
    if "component" in left.columns and "component" in right.columns:
        ok &= F.col("x.component") != F.col("y.component")
    return joined.where(ok).select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def _links(pairs: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar enough: the suffix filter on signatures, then the whole sets."""
    sizes = survivors.select("class", "n", "alone", "signature")
    one = lambda df, c, *cols: df.select(F.col("class").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in cols])
    near = pairs.join(one(sizes, "a", "n", "alone", "signature"), "a").join(one(sizes, "b", "n", "alone", "signature"), "b")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the shared tokens' counts by 128 parts of the hash, the lesser ones sum up to the largest overlap that is possible."""
        for b in batches:
            if not b.num_rows:
                continue
            col = {k: b.column(i) for i, k in enumerate(b.schema.names)}
            n, m = col["a_n"].to_numpy(), col["b_n"].to_numpy()
            x, y = (np.frombuffer(b"".join(col[k].to_pylist()), "<u4").reshape(-1, SIGNATURE).astype(np.int64) for k in ("a_signature", "b_signature"))
            keep = (100 + percent) * np.minimum(x, y).sum(axis=1) >= percent * (n + m)
            yield b.select(["a", "b", "a_n", "b_n"]).filter(pa.array(keep))

    near = near.mapInArrow(sift, "a long, b long, a_n long, b_n long")
    sets = survivors.select("class", "tokens")
    both = near.join(one(sets, "a", "tokens"), "a").join(one(sets, "b", "tokens"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {k: b.column(i).to_pylist() for i, k in enumerate(b.schema.names)}
            keep = []
            for n, m, x, y in zip(col["a_n"], col["b_n"], col["a_tokens"], col["b_tokens"], strict=True):
                overlap = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                keep.append(100 * overlap >= percent * (n + m - overlap))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(verify, "a long, b long")


CLASSED = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("shingle_class", T.LongType()), T.StructField("shingle_common", T.BinaryType())])


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id, component, shingle_class) of each row: sets of width-word shingles link if their Jaccard similarity is percent / 100 or more.

    component_id is the least key that links reach, the row's own included; component is a 64-bit key of the same, and
    shingle_class one of the row's set. Links within a component that aren't needed to tell it are not looked for. Null and empty texts, and texts without words, have no shingles, link with nothing and have their own key and a null component. Rows
    that repeat a key stay rows of their own; null keys are never the least, unless there are no others. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = docs.select("key").count()
    common = spark.sparkContext.broadcast(_common(docs, "text", "key", width, rows))

    def make():
        hot = common.value

        def work(texts: list[str | None]) -> list[pa.Array]:
            sets = token_sets(texts, width)
            own = [s[_within(hot, s)] for s in sets]
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([o.tobytes() for o in own], pa.binary()),
            ]

        return work

    classed = written(map_texts(docs, "text", CLASSED, make, keep_text=False))
    some = classed.where("n_shingles > 0")
    classes = some.groupBy(F.col("shingle_class").alias("class")).agg(F.max("n_shingles").alias("n"), F.max("shingle_common").alias("common"))
    total = some.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(total / SHARD_TOKENS))
    bits = min(64, max(48, math.ceil(math.log2(total + 1)) + 22))
    cut = 64 - bits
    size = -(-(1 << bits) // parts)

    shards = _shards(docs, "text", width, common, parts, bits).repartition(parts, "shard")
    ranked = spark.sparkContext.broadcast(_ranked(classes, cut))
    survivors = written(_survivors(classes, _shared(shards, size, parts), percent, parts, cut, ranked))
    prefixes = written(_prefixes(survivors, percent))

    pivot = F.min_by(F.struct("class", "n", "place"), F.struct(F.col("alone") / F.col("n"), F.col("class")))
    # What is summed by a hot key is written before it is joined back, so that the planner can split the join.
    stars = written(prefixes.groupBy("token").agg(pivot.alias("p"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    pivots = stars.select("token", "p.class", "p.n", "p.place")
    tried = written(_pairs(prefixes, pivots, percent))
    links = written(_links(tried, survivors, percent))
    found = written(components(links))
    placed = prefixes.join(found, prefixes["class"] == found["node"], "left").select("token", "class", "n", "place", F.coalesce("component", "class").alias("component"))
    placed = written(placed)
    by = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("token").agg(F.count(F.lit(1)).alias("different"), F.max_by("component", F.struct("size", "component")).alias("largest")).where("different > 1")
    by = written(by)
    mixed_ = placed.join(by, "token").select(*placed.columns, "largest")
    fewer = mixed_.where("component <> largest").drop("largest")
    across = _pairs(fewer, mixed_.drop("largest"), percent, percent < 100).join(tried, ["a", "b"], "left_anti")
    more = written(_links(written(across), survivors, percent))
    if more.limit(1).count():
        dropped(found)
        found = written(components(links.unionByName(more)))

    labelled = classed.join(found, classed["shingle_class"] == found["node"], "left").select("key", "n_shingles", "shingle_class", F.coalesce("component", "shingle_class").alias("component"))
    labelled = written(labelled)
    for done in (classed, survivors, prefixes, stars, tried, links, placed, by, more, found):
        dropped(done)
    least = written(labelled.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("key").alias("least")))
    return labelled.join(least, "component", "left").select(F.col("key").alias(key), "n_shingles", F.when(F.col("component").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"), "component", "shingle_class")


#: Up to this many keys are broadcast (16 bytes each and as much again); more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each group of linked rows: that of the least key. Rows without shingles all stay, and so do all columns.

    The texts of rows with keys of their own aren't shuffled while the keys to drop are few. Rows that share a key, or have none,
    are told apart by their sets; of such rows of one group one stays, that of the least set, then text.
    """
    docs, named = numbered(docs, key, text)
    found = written(join(docs.select(key, text), key, text, width, percent))
    repeated = written(found.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > 1) | F.col(key).isNull()).select(F.col(key).alias("at_key")))
    others = found.where(F.col("component").isNotNull() & (F.col(key) != F.col("component_id"))).select(F.col(key).alias("at_key")).distinct()
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_KEYS else df
    if not repeated.limit(1).count():
        return named(docs.join(small(written(others)), F.col(key) == F.col("at_key"), "left_anti"))
    at = small(repeated)
    single = docs.join(at, F.col(key).eqNullSafe(F.col("at_key")), "left_anti").join(small(written(others)), F.col(key) == F.col("at_key"), "left_anti")
    several = docs.join(at, F.col(key).eqNullSafe(F.col("at_key")), "left_semi")

    def make():
        return lambda texts: [pa.array([class_of(s) if len(s) else None for s in token_sets(texts, width)], pa.int64())]

    several = map_texts(several, text, T.StructType([T.StructField("at_class", T.LongType())]), make)
    sets = found.where(F.col("component").isNotNull() & F.col(key).eqNullSafe(F.col("component_id"))).select(F.col("shingle_class").alias("own_class"), F.col("component").alias("own_component"), F.col(key).alias("own_key")).distinct()
    kept = several.join(sets, (F.col("at_class") == F.col("own_class")) & F.col(key).eqNullSafe(F.col("own_key")))
    first = F.row_number().over(Window.partitionBy("own_component").orderBy("own_class", text, *[c for c in docs.columns if c != text]))
    kept = kept.withColumn("own_rank", first).where("own_rank = 1").select(*docs.columns)
    return named(single.unionByName(kept).unionByName(several.where("at_class is null").select(*docs.columns)))
