"""Near duplicates of embeddings by product quantisation.

Vectors are brought to unit length; those that are equal are one class. A coarse quantiser deals them to inverted lists; what is
left of a vector in its list is coded subspace by subspace. A vector probes the lists that a neighbour of it may be in; there,
distances come from a table of its products with each subspace's codewords. As the error that coding makes is known of every
vector, no near one is lost by its table distance; those that may be near are held against each other exactly, in double precision.

Lists are written once, as blocks of one row each. Blocks meet in a join that reads them again and again and shuffles nothing, so
that the disk that is taken grows by the rows, however many lists a vector probes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, dropped, written
from .components import components
from .vectors import by_length, centroids, drawn, squared, with_bytes

#: Rows of a list in one block; longer lists have several.
BLOCK = 4096
#: Queries whose tables are made at a time.
AT_ONCE = 128


@dataclass
class Index:
    coarse: np.ndarray
    words: np.ndarray  # (subspaces, codewords, components of a subspace); the dimension is padded with zeros
    share: np.ndarray  # of the sample, in each list

    @property
    def width(self) -> int:
        return self.words.shape[0] * self.words.shape[2]

    def parts(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1]))).reshape(len(x), self.words.shape[0], self.words.shape[2])

    def coded(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the distance of each from what its code says."""
        parts = self.parts(rest)
        codes = np.stack([squared(parts[:, s], w).argmin(axis=1) for s, w in enumerate(self.words)], axis=1).astype(np.uint8)
        said = np.stack([w[codes[:, s]] for s, w in enumerate(self.words)], axis=1)
        return codes, np.sqrt(((parts - said) ** 2).sum(axis=(1, 2)))

    def tables(self, x: np.ndarray) -> np.ndarray:
        """(subspaces, codewords, queries): -2 times the products of queries with the codewords, in single precision."""
        parts = self.parts(x)
        return np.stack([-2.0 * (w @ parts[:, s].T) for s, w in enumerate(self.words)]).astype(np.float32)

    def said(self, codes: np.ndarray, own: int, dim: int) -> np.ndarray:
        """The vectors of one list that their codes say."""
        return np.concatenate([w[codes[:, s]] for s, w in enumerate(self.words)], axis=1)[:, :dim] + self.coarse[own]


def units(blobs: list[bytes], dim: int, kind: type) -> np.ndarray:
    """Vectors from their bytes, brought to unit length in double precision."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, rows: int, lists: float, subspaces: int, seed: int = 1) -> Index:
    """lists times the root of the rows as lists (as many as the sample can tell apart, 10 vectors to a list), and codewords.

    So lists and the rows in each grow alike, and what vectors in random directions probe grows by the root of the rows at most.
    """
    k = max(1, min(math.ceil(lists * math.sqrt(rows)), len(sample) // 10 or 1))
    coarse = centroids(sample, k, seed=seed)
    own = squared(sample, coarse).argmin(axis=1)
    rest = sample - coarse[own]
    subspaces = max(1, min(subspaces, sample.shape[1]))
    size = -(-sample.shape[1] // subspaces)
    index = Index(coarse, np.zeros((-(-sample.shape[1] // size), 1, size)), np.bincount(own, minlength=k) / max(1, len(own)))
    parts = index.parts(rest[:10_000])
    index.words = np.stack([centroids(parts[:, s], min(256, len(parts)), 6, seed + s) for s in range(parts.shape[1])])
    return index


def _placed(classes: DataFrame, index, dim: int, kind: type, rows: int) -> DataFrame:
    """(list, part, class, size, vec) of every class: its own list, and its part of it, by hash, as the sample says that the list has several blocks."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        parts = np.ceil(ix.share * rows / BLOCK).astype(np.int64).clip(1)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                own = squared(units(part.column(2).to_pylist(), dim, kind), ix.coarse).argmin(axis=1)
                dealt = part.column(0).to_numpy() % parts[own]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(dealt.astype(np.int32)), *part.columns], ["list", "part", "class", "size", "vec"])

    return classes.select("class", "size", "vec").mapInArrow(placed, "list int, part int, class long, size long, vec binary")


def _blocks(placed: DataFrame, index, dim: int, kind: type, reach: float) -> DataFrame:
    """(block, list, reach, classes, sizes, vecs, codes, errors): one row for at most BLOCK classes of one list; block is its first class.

    The arrays of its classes are bytes. A class probes each list whose border is within reach, before or after its own; the column
    reach has all lists that any of the block does, its own included. The way between two neighbours in different lists crosses the
    border, so that one of them is within half their distance of it.
    """
    schema = "block long, list int, reach array<int>, classes binary, sizes binary, vecs binary, codes binary, errors binary"

    def block(ix: Index, apart: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        own = rows["list"][0].as_py()
        classes, sizes = rows["class"].to_numpy(), rows["size"].to_numpy()
        blobs = rows["vec"].to_pylist()
        reached, codes, errors = np.arange(len(ix.coarse)) == own, [], []
        for i in range(0, len(blobs), 256):
            x = units(blobs[i : i + 256], dim, kind)
            reached |= _probing(x, ix, own, apart[own], reach).any(axis=0)
            code, error = ix.coded(x - ix.coarse[own])
            codes.append(code.tobytes())
            errors.append(error.tobytes())
        of = lambda v: pa.array([v], pa.binary())
        lists = pa.array([np.flatnonzero(reached).astype(np.int32)], pa.list_(pa.int32()))
        columns = [pa.array(classes[:1]), pa.array([own], pa.int32()), lists, of(classes.tobytes()), of(sizes.tobytes()), of(b"".join(blobs)), of(b"".join(codes)), of(b"".join(errors))]
        return pa.RecordBatch.from_arrays(columns, ["block", "list", "reach", "classes", "sizes", "vecs", "codes", "errors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        apart = np.sqrt(squared(ix.coarse, ix.coarse))
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            held = rows if held is None else pa.concat_tables([held, rows])
            own = held["list"].to_numpy()
            ends = np.append(np.flatnonzero(own[1:] != own[:-1]) + 1, len(own))
            begin = 0
            for end in ends.tolist():
                while end - begin >= BLOCK or (end < len(own) and begin < end):
                    take = min(BLOCK, end - begin)
                    yield block(ix, apart, held.slice(begin, take))
                    begin += take
            held = held.slice(begin)
        if held is not None and held.num_rows:
            yield block(ix, apart, held)

    return placed.repartition("list", "part").sortWithinPartitions("list").mapInArrow(run, schema)


def _probing(x: np.ndarray, ix: Index, own: int, apart: np.ndarray, reach: float, lists: slice | list[int] = slice(None)) -> np.ndarray:
    """(rows, lists): whether rows of the list own probe others; apart are the distances of its centre from theirs."""
    far = squared(x, ix.coarse[lists]) - ((x - ix.coarse[own]) ** 2).sum(axis=1)[:, None]
    return far <= 2.0 * reach * apart[lists] + 1e-9  # more than rounding can take away


@dataclass
class Block:
    """A row of blocks, unpacked."""

    own: int
    classes: np.ndarray
    sizes: np.ndarray
    x: np.ndarray
    codes: np.ndarray  # (subspaces, rows)
    limit: np.ndarray  # the table distance that a near one may have at most, less the squared norm of what the codes say
    tables: np.ndarray | None = None

    @classmethod
    def of(cls, row: list, ix: Index, dim: int, kind: type, least: float) -> Block:
        own, classes, sizes, vecs, codes, errors = row
        classes = np.frombuffer(classes, np.int64)
        codes = np.frombuffer(codes, np.uint8).reshape(len(classes), -1)
        said = ix.said(codes, own, dim)
        # single precision is enough for a threshold that is wide by much more than its error
        limit = (math.sqrt(2.0 - 2.0 * least) + np.frombuffer(errors) + 1e-3) ** 2 - (said * said).sum(axis=1)
        return cls(own, classes, np.frombuffer(sizes, np.int64), units([vecs], dim, kind), np.ascontiguousarray(codes.T.astype(np.intp)), limit.astype(np.float32))


def _near(q: Block, r: Block, queries: np.ndarray, rows: np.ndarray, ix: Index, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in q, in r) of those of some queries and rows that are near each other, some queries at a time."""
    if not len(queries) or not len(rows):
        return
    if q.tables is None:
        q.tables = ix.tables(q.x)
    codes, limit = r.codes[:, rows], r.limit[rows]
    # |x|^2 - 2 x * centre, to which the tables add -2 x * (what the rest's code says)
    base = (1.0 - 2.0 * (q.x @ ix.coarse[r.own])).astype(np.float32)
    for i in range(0, len(queries), AT_ONCE):
        part = queries[i : i + AT_ONCE]
        table = np.ascontiguousarray(q.tables[:, :, part])
        distance = np.take(table[0], codes[0], axis=0, mode="clip")
        looked = np.empty_like(distance)
        for t, code in zip(table[1:], codes[1:], strict=True):
            distance += np.take(t, code, axis=0, out=looked, mode="clip")
        n, m = np.nonzero(distance <= limit[:, None] - base[part])
        m, n = part[m], rows[n]
        if q is r:
            m, n = m[m < n], n[m < n]
        close = np.concatenate([(q.x[m[j : j + 65536]] * r.x[n[j : j + 65536]]).sum(axis=1) for j in range(0, len(m), 65536)]) >= least if len(m) else np.zeros(0, bool)
        if close.any():
            yield m[close], n[close]


def _found(q: Block, r: Block, ix: Index, apart: np.ndarray, reach: float, least: float) -> pa.RecordBatch | None:
    """Links between two blocks, or in one: of each class how many vectors it links with (b null), and edges (a, b) that connect what is linked."""
    every, rows = np.arange(len(q.classes)), np.arange(len(r.classes))
    if q.own == r.own:
        found = [*_near(q, r, every, rows, ix, least)]
    else:  # each pair of which one probes the other's list, once
        asks = _probing(q.x, ix, q.own, apart[q.own], reach, [r.own])[:, 0]
        asked = _probing(r.x, ix, r.own, apart[r.own], reach, [q.own])[:, 0]
        found = [*_near(q, r, every[asks], rows, ix, least), *_near(q, r, every[~asks], rows[asked], ix, least)]
    if not found:
        return None
    m, n = (np.concatenate(x) for x in zip(*found, strict=True))
    node = q.classes if q is r else np.concatenate([q.classes, r.classes])
    size = q.sizes if q is r else np.concatenate([q.sizes, r.sizes])
    v = n if q is r else n + len(q.classes)
    links = np.zeros(len(node), np.int64)
    np.add.at(links, m, size[v])
    np.add.at(links, v, size[m])
    label = node.copy()
    while True:  # the least class that each is connected with here
        low = np.minimum(label[m], label[v])
        if (label[m] == low).all() and (label[v] == low).all():
            break
        np.minimum.at(label, m, low)
        np.minimum.at(label, v, low)
    use, edge = np.flatnonzero(links), np.flatnonzero(node != label)
    a, b = np.concatenate([node[use], node[edge]]), np.concatenate([np.zeros(len(use), np.int64), label[edge]])
    counted = np.arange(len(a)) < len(use)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=counted), pa.array(np.concatenate([links[use], np.zeros(len(edge), np.int64)]))], ["a", "b", "links"])


def _links(blocks: DataFrame, index, dim: int, kind: type, reach: float, least: float) -> DataFrame:
    """(a, b, links) of all pairs of blocks of which one probes the other's list, as of _found().

    The join reads each pair of files again, shuffles nothing and holds one file's rows at a time.
    """
    q, r = (blocks.toDF(*[f"{p}_{c}" for c in blocks.columns]) for p in "qr")
    meet = (F.col("q_block") <= F.col("r_block")) & ((F.col("q_list") == F.col("r_list")) | F.array_contains("q_reach", F.col("r_list")) | F.array_contains("r_reach", F.col("q_list")))
    take = ["block", "list", "classes", "sizes", "vecs", "codes", "errors"]
    pairs = q.hint("shuffle_replicate_nl").join(r, meet).select(*[f"{p}_{c}" for p in "qr" for c in take])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        apart = np.sqrt(squared(ix.coarse, ix.coarse))
        at, q = None, None  # one block meets many in a row
        for b in batches:
            for i in range(b.num_rows):
                row = [c[i].as_py() for c in b.columns]
                if row[0] != at:
                    at, q = row[0], Block.of(row[1:7], ix, dim, kind, least)
                r = q if row[7] == at else Block.of(row[8:], ix, dim, kind, least)
                out = _found(q, r, ix, apart, reach, least)
                if out is not None:
                    yield out

    return pairs.mapInArrow(run, "a long, b long, links long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, margin: float = 0.5, fit_vectors: int = 20_000, lists: float = 0.4, subspaces: int = 8) -> DataFrame:
    """(key, n_links, component_id) of each row: rows link if their vectors' cosine, in double precision, is at least least.

    n_links counts the other rows that a row links with; component_id is the least key that links reach, the row's own included.
    Vectors that are null, zero or hold null or non-finite components link with nothing, and vectors of different lengths don't
    link. Rows that repeat a key stay rows of their own; of null keys none is the least, unless there are no others. Other columns
    play no part, whatever their names. An empty table gives no rows.

    Every pair that is compared is decided exactly, and all rows of a probed list are compared. margin says within how much of
    such a neighbour's distance a list's border is probed, from both sides: from 0.5 on no pair is lost, as one of the two is at
    most half their distance from the border between them. Less can lose pairs. The index is fitted on about fit_vectors vectors
    by hash, and holds all.
    """
    bounded_batches(df.sparkSession)
    found = [_of_length(part, dim, key, vector, least, margin, fit_vectors, lists, subspaces) for dim, part in by_length(df, vector)]
    return reduce(DataFrame.unionByName, found)


def _of_length(df: DataFrame, dim: int, key: str, vector: str, least: float, margin: float, fit_vectors: int, lists: float, subspaces: int) -> DataFrame:
    """The same for vectors of one length."""
    spark = df.sparkSession
    raw = with_bytes(df, key, vector, dim)

    kind = np.float32 if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else np.float64  # vectors are kept as they come

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, cls = [], []
            for v in b.column(1).to_pylist():
                if v is None:
                    vec.append(None)
                    cls.append(None)
                    continue
                x = np.frombuffer(v)
                vec.append(x.astype(kind).tobytes())
                cls.append(int.from_bytes(hashlib.blake2b(units([v], dim, np.float64).tobytes(), digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.int64()), pa.array(vec, pa.binary())], ["key", "class", "vec"])

    of_key = raw.schema["key"].dataType.simpleString()
    all_rows = raw.mapInArrow(classed, f"key {of_key}, class long, vec binary")
    rows = written(all_rows.select("key", "class"))
    classes = written(all_rows.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("size"), F.max("vec").alias("vec")))
    n = classes.count()
    if not n:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    sample = drawn(classes, "class", n, fit_vectors, "quantized").orderBy("class").select("vec").collect()
    if not sample:
        sample = classes.orderBy("class").limit(1).select("vec").collect()
    index = spark.sparkContext.broadcast(fit(units([bytes(r["vec"]) for r in sample], dim, kind), n, lists, subspaces))
    reach = margin * math.sqrt(2.0 - 2.0 * least)
    blocks = written(_blocks(_placed(classes, index, dim, kind, n), index, dim, kind, reach))
    found = written(_links(blocks, index, dim, kind, reach, least))
    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    comps = written(components(found.where("b is not null").select("a", "b").distinct()))
    sizes = classes.select("class", "size").join(counts, "class", "left").join(comps, classes["class"] == comps["node"], "left")
    sizes = sizes.select("class", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component"))
    labelled = written(rows.select("key", "class").join(sizes, "class", "left"))
    for done in (rows, classes, blocks, found, comps):
        dropped(done)
    least_key = written(labelled.where("class is not null").groupBy("component").agg(F.min("key").alias("least")))
    return labelled.join(least_key, "component", "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id")
    )
