"""Secret scans: fixed patterns, and the guess cost of values in credential contexts.

A value that follows a credential's name is cut into words, dates, repeats, keyboard walks and brute-force spans so that the
guesses multiply to the least; a value that takes many guesses even so is a secret, and nothing but the guesses decides. A word
takes as many as its rank: those of the corpus are ranked by how often they come, outside of such values. Spans are in code
points, end exclusive.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, map_texts, written

ASSIGN, ACCESS, HEX, GUESS = "assign", "access", "hex", "guess"
KINDS = (ASSIGN, ACCESS, HEX, GUESS)
SEGMENTS = ("brute", "word", "date", "repeat", "walk", "space")

_either = lambda words: re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)  # noqa: E731  ASCII letters only
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGNED = re.compile(rf"""({_either("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS_ID = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of [0-9a-f] of 16 and more; a shorter run matches nowhere.
HEX_RUN = re.compile(r"[0-9a-f]{16,}")
CONTEXT_NAMES = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
CONTEXT = re.compile(
    rf"""(?<![A-Za-z])(?:{_either("pass(?:word|wd|phrase|code)?|pwd|secret|token|bearer|auth(?:orization)?|credentials?|(?:api|access|private|secret)[_-]?key")})"""
    rf"""["']?\x20*(?::=|=>|[:=]|\x20{_either("is")}\x20)\x20*(?:(?:{_either("bearer|basic|digest")})\x20+)?(?:"([^"\n]+)"|'([^'\n]+)'|([^\x20\x09-\x0D"'<>,;]+))"""
)
#: Words of the corpus that are ranked: the most frequent ones.
RANKED = 30_000

#: Guesses (log10) from which a value in a credential context is a secret.
MIN_GUESSES = 12.0
#: Frequent words of passwords and of text about them, most frequent first.
WORDS = (
    "password the and admin letmein welcome monkey dragon master login hello secret token user test guest root pass changeme "
    "default example sample your you that this with from have not please enter reset forgot required invalid invalidated expired missing "
    "none null true false undefined string value name email account access key public private server client service system "
    "database config setting settings environment variable field input form page file data number date time year month day "
    "love football baseball princess sunshine shadow superman batman trustno iloveyou starwars summer winter spring autumn "
    "january february march april may june july august september october november december monday tuesday wednesday thursday "
    "friday saturday sunday placeholder redacted removed hidden masked here change replace insert todo dummy temp demo"
).split()
#: Rows of a keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LOOKS_LIKE = str.maketrans("@4031!$57", "aaoeiisst")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")


def _neighbours() -> dict[str, set[str]]:
    """Keys that touch, on rows shifted by half a key."""
    out: dict[str, set[str]] = {}
    for r, row in enumerate(KEY_ROWS):
        for i, c in enumerate(row):
            near = {row[j] for j in (i - 1, i + 1) if 0 <= j < len(row)}
            for other, places in ((r - 1, (i, i + 1)), (r + 1, (i - 1, i))):
                if 0 <= other < len(KEY_ROWS):
                    near |= {KEY_ROWS[other][j] for j in places if 0 <= j < len(KEY_ROWS[other])}
            out[c] = near
    return out


NEIGHBOURS = _neighbours()
RANKS = {w: math.log10(i + 2) for i, w in reversed(list(enumerate(WORDS)))}
#: log10 of the guesses that a space between words takes: one way or another of setting them apart.
SPACE = 0.3


def ranks(docs: DataFrame, text: str = "text", most: int = RANKED) -> dict[str, float]:
    """log10 of the ranks of the most frequent words (3 to 24 letters, in lower case) of all texts, values in credential contexts left out.

    Words that are counted once are none; the fixed words keep their ranks where these are better. Words are counted on the
    executors, with partial sums. Counts that are about the same are told together how many words have them (some hundred steps
    of a sixteenth of a doubling), and only words of the steps that most words have room for come to the driver.
    """
    clear = F.regexp_replace(F.lower(text), CONTEXT.pattern, " ")
    words = docs.select(F.explode(F.regexp_extract_all(clear, F.lit(r"(\p{L}{3,})"), F.lit(1))).alias("word")).where(F.length("word") <= 24)
    counts = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("word", "n", F.floor(16 * F.log2("n")).alias("step")))
    room, least = most, math.inf
    for r in sorted(counts.groupBy("step").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["step"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["step"]
    found = sorted(counts.where(F.col("step") >= least).select("word", "n").collect(), key=lambda r: (-r["n"], r["word"])) if least < math.inf else []
    dropped(counts)
    out = {r["word"]: math.log10(i + 2) for i, r in enumerate(found)}
    return out | {w: min(g, out.get(w, g)) for w, g in RANKS.items()}


def brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


class GuessCost:
    """The dynamic programme; words: log10 of a word's rank."""

    def __init__(self, words: dict[str, float] = RANKS):
        self.words = words
        self.lengths = sorted({len(w) for w in words})

    def spans(self, value: str, at: int, low: str, plain: str, runs: list[Sequence[int]], walk: tuple[int, int], step: int) -> Iterable[tuple[int, float, str]]:
        """Spans that begin at a place: (end, log10 of guesses, kind). Runs are taken to their ends."""
        n = len(value)
        yield at + 1, brute(value[at]), "brute"
        for k in self.lengths:
            if at + k > n:
                break
            rank, swapped = self.words.get(low[at : at + k]), self.words.get(plain[at : at + k])
            if rank is not None or swapped is not None:
                yield at + k, (rank if rank is not None else swapped + 0.6) + (0.0 if value[at : at + k].islower() else 0.3), "word"
        if m := DATE.match(value, at):
            yield m.end(), math.log10(36525 if len(m[0]) > 4 else 200), "date"
        for unit, ends in enumerate(runs, 1):
            times = (ends[at] - at) // unit
            if times >= (3 if unit == 1 else 2) and times * unit >= 3:
                yield at + times * unit, unit * brute(value[at]) + math.log10(times), "repeat"
        end, turns = walk
        if end - at >= 4:
            yield end, math.log10(47 * (end - at)) + 0.6 * turns, "walk"
        if value[at] == " " and 0 < at < n - 1:
            yield at + 1, SPACE, "space"
        if step - at >= 4:
            yield step, math.log10(26 * (step - at)), "walk"

    def best(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        """log10 of the least guesses, and the segments of a segmentation that takes so few. Time and memory are linear in the length, some sixty bytes a character."""
        n = len(value)
        low = value.lower() if len(value.lower()) == n else value
        plain = low.translate(LOOKS_LIKE)
        runs = []  # where the repetition of the unit that begins at a place ends
        for unit in range(1, 5):
            ends = array("q", (min(i + unit, n) for i in range(n)))
            for i in range(n - unit - 1, -1, -1):
                if low[i] == low[i + unit]:
                    ends[i] = max(ends[i], ends[i + 1], i + unit + 1)
            runs.append(ends)
        # ends of walks over touching keys, with their turns, and of sequences as in abcd
        walks, turns, steps = array("q", [n]) * n, array("q", [0]) * n, array("q", [n]) * n
        for i in range(n - 2, -1, -1):
            touch = low[i + 1] in NEIGHBOURS.get(low[i], ())
            turn = i + 2 < walks[i + 1] and ord(low[i + 1]) - ord(low[i]) != ord(low[i + 2]) - ord(low[i + 1])
            walks[i], turns[i] = (walks[i + 1], turns[i + 1] + turn) if touch else (i + 1, 0)
            steps[i] = steps[i + 1] if ord(low[i + 1]) - ord(low[i]) == 1 and low[i].isalnum() else i + 1
        cost, back, by = array("d", [math.inf]) * (n + 1), array("q", [0]) * (n + 1), bytearray(n + 1)
        cost[0] = 0.0
        for i in range(n):
            for end, guesses, kind in self.spans(value, i, low, plain, runs, (walks[i], turns[i]), steps[i]):
                if cost[i] + guesses < cost[end]:
                    cost[end], back[end], by[end] = cost[i] + guesses, i, SEGMENTS.index(kind)
        segments, at = [], n
        while at:
            segments.append((back[at], at, SEGMENTS[by[at]]))
            at = back[at]
        return cost[n], segments[::-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed patterns' spans: leftmost, non-overlapping within a kind; a match that is too short is used up all the same."""
    out = []
    low = text.lower()
    if any(x in low for x in ASSIGN_NAMES):
        out += [(m.start(), m.end(), ASSIGN) for m in ASSIGNED.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), ACCESS) for m in ACCESS_ID.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), HEX) for m in HEX_RUN.finditer(text)]
    return out


def guess_spans(text: str, cost: GuessCost, min_guesses: float) -> list[tuple[int, int, str]]:
    """Values in credential contexts that take many guesses. A scheme's name before the value (bearer, basic) and what closes a sentence after a bare one aren't of it."""
    low = text.lower()
    if not any(x in low for x in CONTEXT_NAMES):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(m.lastindex)
        if m.lastindex == 3:
            while end > start and text[end - 1] in ".!?)]}:":
                end -= 1
        if end > start and cost.best(text[start:end])[0] >= min_guesses:
            out.append((start, end, GUESS))
    return out


def all_spans(text: str, cost: GuessCost, min_guesses: float = MIN_GUESSES) -> list[tuple[int, int, str]]:
    """Base spans, and guessed ones that overlap none of them, by start, then kind."""
    base = base_spans(text)
    more = guess_spans(text, cost, min_guesses)
    if base and more:
        base.sort()
        starts, reach = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
        more = [g for g in more if not (i := bisect_left(starts, g[1])) or reach[i - 1] <= g[0]]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


SPANS = T.StructType([T.StructField("secret_spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, text: str = "text", min_guesses: float = MIN_GUESSES, words: dict[str, float] | None = None, keep_text: bool = True) -> DataFrame:
    """docs with secret_spans: an array of (kind, start, end), by start, then kind; empty for null, empty and clean texts.

    Every whole text is scanned. words: log10 of the ranks of words; without them, those of docs are counted. All rows stay,
    repeated ones and those of null keys too; other columns pass through, and a column of the new name is replaced. An empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks(docs, text) if words is None else words)

    def make():
        cost = GuessCost(shared.value)
        return lambda texts: [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in all_spans(t, cost, min_guesses)] if t else [] for t in texts], _ARROW)]

    return map_texts(docs, text, SPANS, make, keep_text)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", min_guesses: float = MIN_GUESSES, words: dict[str, float] | None = None) -> DataFrame:
    """docs with each secret in the text replaced by a mark (overlapping spans by one); all rows and columns stay, null texts too."""
    new = T.StructType([T.StructField("secret_free", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(ranks(docs, text) if words is None else words)

    def cleaned(t: str | None, cost: GuessCost) -> str | None:
        if not t or not (spans := all_spans(t, cost, min_guesses)):
            return t
        out, at = [], 0
        for s, e, _ in spans:
            if s >= at:
                out += [t[at:s], mark]
            at = max(at, e)
        return "".join([*out, t[at:]])

    def make():
        cost = GuessCost(shared.value)
        return lambda texts: [pa.array([cleaned(t, cost) for t in texts], pa.string())]

    done = map_texts(docs, text, new, make, keep_text=False)
    return done.select(*[F.col("secret_free").alias(c) if c == text else F.col(c) for c in docs.columns])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
