"""SentencePiece BPE encoding that keeps the place of every piece in the original bytes, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map knows; each normalised byte remembers
where its prefix began. Pairs are then merged best score first, and each piece's normalised span is projected back through that
alignment. The ids are those of the sentencepiece library; decoding is the library's own.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

SPACE = "▁"
REPLACEMENT = "�"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Chunks whose ids a worker remembers; it forgets all beyond that, so its memory doesn't grow with the vocabulary of the corpus.
REMEMBERED = 150_000


def _fields(blob: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = blob[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, blob[at : at + size]
        at += size


def compiled_map(blob: bytes) -> dict[str, str]:
    """The prefixes of a compiled character map and what they become.

    The blob is the byte length of a double-array trie (little endian), the trie's 32-bit units, and the replacements, each
    ended by a zero byte; a leaf holds where its replacement starts.
    """
    if not blob:
        return {}
    size = struct.unpack("<I", blob[:4])[0]
    unit = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
    texts = blob[4 + size :]
    offset = (unit >> 10) << ((unit & 512) >> 6)
    label = unit & 0x800000FF
    labels = np.arange(1, 256)
    out, open_ = {}, [(int(offset[0]), b"")]
    while open_:
        base, key = open_.pop()
        places = base ^ labels
        there = places < len(unit)
        there[there] = label[places[there]] == labels[there]
        for c, at in zip(labels[there].tolist(), places[there].tolist(), strict=True):
            child = at ^ int(offset[at])
            if unit[at] >> 8 & 1:
                start = int(unit[child]) & 0x7FFFFFFF
                out[(key + bytes([c])).decode("utf-8", "surrogateescape")] = texts[start : texts.index(b"\0", start)].decode()
            open_.append((child, key + bytes([c])))
    return out


class Normalizer:
    """Longest-prefix normalisation with source alignment."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True):
        self.rules = compiled_map(charsmap)
        self.dummy_prefix, self.squeeze, self.escape = dummy_prefix, squeeze, escape
        self.lengths: dict[str, list[int]] = {}
        for key in self.rules:
            self.lengths.setdefault(key[0], []).append(len(key))
        for v in self.lengths.values():
            v.sort(reverse=True)
        self.starts = re.compile("[" + "".join(map(re.escape, self.lengths)) + "]") if self.lengths else None

    def parts(self, text: str) -> Iterator[tuple[str, str]]:
        """The prefixes, one after the other, and what they become; text between rules comes in one part."""
        at = 0
        while self.starts and at < len(text):
            m = self.starts.search(text, at)
            if not m:
                break
            i = m.start()
            n = next((n for n in self.lengths[text[i]] if text[i : i + n] in self.rules), 0)
            if at < i:
                yield text[at:i], text[at:i]
            at = i + (n or 1)
            yield text[i:at], self.rules[text[i:at]] if n else text[i:at]
        if at < len(text):
            yield text[at:], text[at:]

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text; for each of its UTF-8 bytes, and its end, the original byte where its prefix began."""
        if not text:
            return "", np.zeros(1, np.int32)
        if not self.rules and not self.squeeze:
            return self._plain(text)
        out, starts, done = [], [], 0  # normalised characters, each one's source byte
        before = self.squeeze
        for source, target in self.parts(text):
            same = source == target
            for c in target:
                if not (c == " " and before):
                    out.append(c)
                    starts.append(done)
                before = self.squeeze and c == " "
                done += len(c.encode("utf-8", "surrogatepass")) if same else 0
            done += 0 if same else len(source.encode())
        end = done
        while self.squeeze and out and out[-1] == " ":
            out.pop()
            end = starts.pop()
        if not out:
            return "", np.zeros(1, np.int32)
        if self.dummy_prefix:
            out.insert(0, " ")
            starts.insert(0, starts[0])
        norm = "".join(out).replace(" ", SPACE) if self.escape else "".join(out)
        widths = [len(c.encode("utf-8", "surrogatepass")) for c in norm]
        return norm, np.append(np.repeat(np.array(starts, np.int32), widths), np.int32(end))

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        raw = np.frombuffer(text.encode(), np.uint8)
        at = np.arange(len(raw), dtype=np.int32)
        at = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, at, 0))
        if self.escape:
            at = np.repeat(at, np.where(raw == 32, 3, 1))
            text = text.replace(" ", SPACE)
        lead = (SPACE if self.escape else " ") if self.dummy_prefix else ""
        return lead + text, np.concatenate([np.zeros(len(lead.encode()), np.int32), at, np.array([len(raw)], np.int32)])


#: A normaliser's settings (identity, no character map, no dummy prefix, spaces kept), as a field that overrides a model's own.
AS_IT_IS = bytes([3 << 3 | 2, 18, 1 << 3 | 2, 8]) + b"identity" + bytes([2 << 3 | 2, 0, 3 << 3, 0, 4 << 3, 0, 5 << 3, 0])


class Encoder:
    """A BPE model with byte fallback, read from its file's bytes. Models of other kinds, and with user-defined or unused pieces, are refused.

    The library merges pairs, over texts that are normalised here; it gets each chunk that no piece spans the ends of once.
    """

    def __init__(self, blob: bytes):
        import sentencepiece

        pieces, trainer, normal = [], {}, {}
        for k, v in _fields(blob):
            if k == 1:
                piece = dict(_fields(v))
                pieces.append((piece[1].decode(), piece.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                normal = dict(_fields(v))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or not trainer.get(35, 0) or any(t not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, t in pieces):
            raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces can be read")
        self.normalizer = Normalizer(normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)))
        self.merge = sentencepiece.SentencePieceProcessor(model_proto=blob + AS_IT_IS).encode
        self.decode = sentencepiece.SentencePieceProcessor(model_proto=blob).decode
        self.widths = np.array([1 if t == BYTE else len(p.encode()) for p, t in pieces], np.int64)
        self._forget()
        # No piece spans a space after another character, or the side of a character that is in no longer piece.
        longer = [p for p, t in pieces if t == NORMAL and len(p) > 1]
        inner = "".join(re.escape(c) for c in sorted({c for p in longer for c in p} - {SPACE}))
        whole = any(SPACE in p.lstrip(SPACE) for p in longer) or not inner
        self.chunks = re.compile(r"(?s:.+)" if whole else f"{SPACE}*[{inner}]+|{SPACE}+|(?s:.)")

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text its ids, and where each piece begins and ends in the text's UTF-8 bytes.

        Of a character that falls back to byte pieces, the last byte piece has the whole span, and those before it empty ones
        at its start, as the library has it. A piece of the dummy prefix alone is empty too.
        """
        normal = [self.normalizer(t) for t in texts]
        found = [self.chunks.findall(norm) for norm, _ in normal]
        chunks = list(chain.from_iterable(found))
        if len(self.known) > REMEMBERED:
            self._forget()
        if new := list(set(chunks).difference(self.known)):
            merged = self.merge(new, num_threads=1)
            counts = np.fromiter(map(len, merged), np.int64, len(new))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(merged), np.int32, counts.sum())])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        codes = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        counts = self.count[codes]
        upto = np.cumsum(counts)
        ids = self.flat[np.repeat(self.first[codes] - upto + counts, counts) + np.arange(counts.sum())]
        ends = np.concatenate([[0], upto])[np.cumsum([len(x) for x in found])].tolist()
        for (_, source), start, end in zip(normal, [0, *ends], ends, strict=False):
            own = ids[start:end]
            widths = self.widths[own]
            places = np.cumsum(widths)
            yield own, source[places - widths], source[places]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)


_loaded: dict[int, Encoder] = {}


def loaded(blob: bytes) -> Encoder:
    """A model's encoder, made once in a worker."""
    if (key := hash(blob)) not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(blob)
    return _loaded[key]


NEW = T.StructType(
    [
        T.StructField("piece_ids", T.ArrayType(T.IntegerType())),
        T.StructField("piece_begins", T.ArrayType(T.IntegerType())),
        T.StructField("piece_ends", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
        T.StructField("piece_spans_sha256", T.StringType()),
    ]
)


def model_bytes(path: str) -> bytes:
    """A model file that the driver reads; executors get its bytes by broadcast (half a MB for 32,000 pieces)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the columns piece_ids, piece_begins, piece_ends (original byte spans, end exclusive), decoded and piece_spans_sha256 (of all begins, then all ends, as four bytes each, the lowest first).

    A null or empty text has no pieces and decodes to the empty text. Texts are encoded whole, however long. Other columns pass
    through, the text too unless keep_text is false; columns of the new names are replaced. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        encoder = loaded(shared.value)

        def work(texts: list[str | None]) -> list[pa.Array]:
            rows = list(encoder.encode([t or "" for t in texts]))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in rows]))) for k in range(3)]
            decoded = [encoder.decode(r[0].tolist()) if len(r[0]) else "" for r in rows]
            spans = [hashlib.sha256(np.concatenate([r[1], r[2]]).astype("<i4").tobytes()).hexdigest() for r in rows]
            return [*lists, pa.array(decoded, pa.string()), pa.array(spans, pa.string())]

        return work

    return map_texts(docs, text, NEW, make, keep_text)
