"""Periodic runs of words, found by online dyadic square catching.

Words are appended to a stream. At every power of two L, each completed block
of L words that begins at a multiple of L has a catcher: while the words from
L to 2L places behind its own are appended, it compares its block with the
stream's suffix of L words. A hit means that L words repeat at a distance p of
L to 2L - 1; so every word advances one catcher a level, and every period is
caught at one level. Hits of neighbouring catchers at one distance are a
square (two blocks of L words exceed p), and squares that overlap merge into
a run, whose ends are then found word by word.

Suffixes are compared by hashes that double with the level, for all catchers
of a level in one array operation; the ends of runs are compared word by word,
so hash collisions cost time and never a wrong run. Hits inside a run of a
smaller period are its multiples and are left out, so a text of one repeated
word costs as much as any other.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed values of the contract: a run has MIN_LENGTH words and MIN_PERIODS periods at least.
MIN_LENGTH = 6
MIN_PERIODS = 4
#: Words that are held before their streams are searched; a longer text is searched alone.
STREAM_WORDS = 1 << 20
#: Bytes of a long text that are split into words at once.
PIECE_BYTES = 1 << 22
BLANK = re.compile(rb"[\x20\x09-\x0D]")


@dataclass
class _Level:
    """The catchers of blocks of one size."""
    size: int
    done: int = 0                                   # suffixes that begin before this place are compared
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))   # hash of every completed block
    tail: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))    # hashes that the next level still needs
    last: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))         # hits of the last ``size`` suffixes


class SquareCatcher:
    """Runs of a stream of integers, which may be appended one by one or many
    at a time; that changes no result. A run is a longest stretch of smallest
    period p, of ``least`` words and ``periods`` times p at least. Periods up
    to ``longest // periods`` are looked for (``longest`` None: all)."""

    def __init__(self, least: int = MIN_LENGTH, periods: int = MIN_PERIODS, longest: int | None = None):
        if periods < 4:
            raise ValueError("neighbouring catchers are sure to hit in runs of four periods or more only")
        self.least, self.periods, self.longest = least, periods, longest
        self.words, self.levels, self.open = np.zeros(0, np.int64), [], []
        self.found = {}  # (start, period): [start, end, period] of every stretch of squares

    def append(self, words) -> None:
        """Advance the catchers by the new words."""
        words = np.atleast_1d(np.asarray(words, np.int64))
        if not len(words):
            return
        self.words = np.concatenate([self.words, words])
        n = len(self.words)
        self._lengthen(n)
        begin, fresh = n - len(words), _mixed(words.astype(np.uint64))
        k = 0
        while (size := 1 << k) <= n and (self.longest is None or size * self.periods <= self.longest):
            if k == len(self.levels):
                self.levels.append(_Level(size))
            at = self.levels[k]
            if k:  # hashes of this size from the level below, which kept them from at.done on
                below = self.levels[k - 1]
                both = np.concatenate([below.tail, fresh])
                half = size >> 1
                fresh = _mixed(both[:-half] * _FACTOR + both[half:]) if len(both) > half else both[:0]
                begin = at.done
                below.tail = both[len(fresh):]
            self._advance(at, k, begin, fresh, n)
            at.done = begin + len(fresh)
            k += 1
        if self.levels and k == len(self.levels):  # the level above does not exist yet
            top = self.levels[-1]
            top.tail = np.concatenate([top.tail, fresh])

    def _advance(self, at: _Level, k: int, begin: int, fresh: np.ndarray, n: int) -> None:
        """Compare the new suffixes of a level, each with its one live catcher."""
        size, end = at.size, begin + len(fresh)
        first = -(-begin // size) * size
        at.heads = np.concatenate([at.heads, fresh[first - begin::size]])
        low = max(begin, size)
        if low >= end:
            return
        hit = fresh[low - begin:] == at.heads[(np.arange(low, end) >> k) - 1]
        hit = np.concatenate([at.last, hit])
        at.last = hit[-size:]
        if len(hit) <= size:
            return
        square = np.flatnonzero(hit[size:] & hit[:-size]) + (end - len(hit) + size)
        if not len(square):
            return
        catcher = (square >> k) - 1
        left, period = (catcher - 1) * size, square - catcher * size
        starts, ends = self._covers(size)
        if len(starts):  # multiples of the period of a run that holds the whole square
            place = np.searchsorted(starts, left, "right") - 1
            own = (place < 0) | (ends[np.maximum(place, 0)] < square + size)
            left, period = left[own], period[own]
        order = np.lexsort((left, period))
        left, period = left[order], period[order]
        if not len(left):
            return
        cut = np.flatnonzero((np.diff(left) != size) | (np.diff(period) != 0)) + 1
        for a, b in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(left)]]).tolist()):
            self._merge(int(period[a]), int(left[a]), int(left[b - 1]) + 2 * size, size, n)

    def _merge(self, p: int, low: int, high: int, size: int, n: int) -> None:
        """A chain of squares becomes a run, unless it belongs to one already."""
        if any(f[2] == p and f[0] <= low and high + p <= f[1] for f in self.open):
            return
        both = _stretch(self.words, p, low, high, n)
        if both is None:  # hashes collided: each square by itself
            if high - low > 2 * size:
                for a in range(low, high - size, size):
                    self._merge(p, a, a + 2 * size, size, n)
            return
        run = [both[0], both[1] + p, p]
        if (run[0], p) not in self.found:
            self.found[run[0], p] = run
            if run[1] == n:
                self.open.append(run)

    def _lengthen(self, n: int) -> None:
        """Runs that reached the end of the stream go on as far as they can."""
        still = []
        for run in self.open:
            low, high = run[1] - run[2], n - run[2]
            off = np.flatnonzero(self.words[low:high] != self.words[run[1]:n])
            run[1] = run[1] + int(off[0]) if len(off) else n
            if run[1] == n:
                still.append(run)
        self.open = still

    def _covers(self, period: int):
        """Starts of the stretches of smaller periods, and the furthest end up to each."""
        both = np.array(sorted((a, b) for a, b, p in self.found.values() if p < period))
        if not len(both):
            return both, None
        return both[:, 0], np.maximum.accumulate(both[:, 1])

    def runs(self) -> list:
        """(start, length, period) of the runs so far, by start, then period."""
        return sorted((a, b - a, p) for a, b, p in self.found.values() if b - a >= max(self.least, self.periods * p))


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def _stretch(x: np.ndarray, p: int, low: int, high: int, n: int):
    """The longest [low, high) around the given one in which x[i] == x[i + p];
    None where that does not hold in the given one itself."""
    if not np.array_equal(x[low:high], x[low + p:high + p]):
        return None
    step = 64
    while low:
        a = max(0, low - step)
        off = np.flatnonzero(x[a:low] != x[a + p:low + p])
        if len(off):
            low = a + int(off[-1]) + 1
            break
        low, step = a, 2 * step
    step = 64
    while high + p < n:
        b = min(n - p, high + step)
        off = np.flatnonzero(x[high:b] != x[high + p:b + p])
        if len(off):
            high += int(off[0])
            break
        high, step = b, 2 * step
    return low, high


def _pieces(text: bytes):
    """The text in pieces that are cut at blanks, so no word is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        blank = BLANK.search(text, end) if end < len(text) else None
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def word_ids(texts: list) -> list:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text (UTF-8) as integers,
    equal where the words are. ``bytes.split`` cuts at just these characters."""
    known = defaultdict()
    known.default_factory = known.__len__
    out = []
    for text in texts:
        parts = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in (p.split() for p in _pieces(text))]
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    return out


def runs_of(ids: list, least: int = MIN_LENGTH, periods: int = MIN_PERIODS) -> list:
    """Runs of each sequence. Sequences whose lengths have as many binary
    digits follow each other in one stream, parted by integers of their own."""
    out, streams = [[] for _ in ids], defaultdict(list)
    for i, x in enumerate(ids):
        if len(x) >= least:
            streams[len(x).bit_length()].append(i)
    for rows in streams.values():
        catcher = SquareCatcher(least, periods, max(len(ids[i]) for i in rows))
        catcher.append(np.concatenate([y for k, i in enumerate(rows) for y in (ids[i], [-1 - k])]))
        begin = np.cumsum([0] + [len(ids[i]) + 1 for i in rows])
        for start, length, p in catcher.runs():
            k = int(np.searchsorted(begin, start, "right")) - 1
            out[rows[k]].append((start - int(begin[k]), length, p))
    return out


def collapsed(text: bytes, runs: list, n: int) -> bytes:
    """The words joined by a blank, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(b" ".join(p.split()) for p in _pieces(text) if not p.isspace())
    edge = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        edge[start + p] += 1
        edge[start + length] -= 1
    stay, at, parts = np.cumsum(edge[:n]) == 0, 0, []
    for piece in _pieces(text):
        words = piece.split()
        kept = [words[k] for k in np.flatnonzero(stay[at:at + len(words)]).tolist()]
        at += len(words)
        if kept:
            parts.append(b" ".join(kept))
    return b" ".join(parts)


def _runs_task(least: int, periods: int):
    def task(batches):
        for b in batches:
            texts, groups, words = [(t or "").encode() for t in b.column("text_").to_pylist()], [[]], 0
            for i, t in enumerate(texts):  # a text of n bytes has (n + 1) / 2 words at most
                if groups[-1] and words + len(t) // 2 > STREAM_WORDS:
                    groups.append([])
                    words = 0
                groups[-1].append(i)
                words += len(t) // 2
            for rows in filter(None, groups):
                ids = word_ids([texts[i] for i in rows])
                found = runs_of(ids, least, periods)
                text = [collapsed(texts[i], r, len(x)) for i, r, x in zip(rows, found, ids)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id_").take(pa.array(rows)), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([[dict(start=s, length=n, period=p) for s, n, p in r] for r in found],
                              pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                     pa.array([t.decode() for t in text], pa.string())], ["doc_id", "n_words", "runs", "text"])
    return task


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH, periods: int = MIN_PERIODS) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period; by
    start, then period), text (the words joined by one blank, without those
    that a run holds after its first period).

    A run is a stretch of words of smallest period p, ``least`` words and
    ``periods`` times p at least, that no neighbouring word extends. Null and
    empty texts have no words, no runs and an empty text; null and repeated
    ids are kept as they are, equal rows give equal rows, an empty table gives
    an empty one. Texts may be of any length: a text is held once, with eight
    bytes a word for a few arrays, and costs a few array steps a word and
    level. Other columns are not read. No shuffle: every row is found alone."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{text_col}`").alias("text_"))
    kind = rows.schema["id_"].dataType.simpleString()
    return rows.mapInArrow(_runs_task(least, periods), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")
