"""Language identification of whole, also mixed, texts.

The script of a word (by Unicode range) narrows the candidate languages; every
word is scored for each candidate by hashed letter n-grams, and a Viterbi pass
over the words with a penalty for switching labels spans of one language.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, write_table

UNKNOWN = "und"
#: Hash cells of n-grams; the model is this times the number of languages.
CELLS = 1 << 16
#: Log-probability that a change of language costs.
SWITCH = 6.0
#: A language is a candidate for a script that holds this share of the language's own words, whatever the others wrote.
SCRIPT_SHARE = 0.002
#: Most of a word's score that one word can add, so that a rare word does not outweigh a span.
CLIP = 12.0
#: First code points of Unicode ranges, and their scripts ('' is none).
RANGES = (
    (0x0000, ""), (0x0041, "latin"), (0x005B, ""), (0x0061, "latin"), (0x007B, ""), (0x00AA, "latin"), (0x00AB, ""),
    (0x00B5, "greek"), (0x00B6, ""), (0x00BA, "latin"), (0x00BB, ""), (0x00C0, "latin"), (0x00D7, ""), (0x00D8, "latin"), (0x00F7, ""),
    (0x00F8, "latin"), (0x02B9, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"),
    (0xFF3B, ""), (0xFF41, "latin"), (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
_STARTS = [r[0] for r in RANGES]
def _no_letters() -> str:
    """Ranges of the characters that ``\\w`` takes but that are neither letters
    nor digits (fractions, superscripts, Roman numerals), for a character class."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        odd = c <= sys.maxunicode and chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()
        if odd and first is None:
            first = c
        elif not odd and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


#: Runs of letters; the marks that scripts write between letters stay inside a word.
_LETTER = rf"[^\W\d_{_no_letters()}]"
WORD = re.compile(rf"{_LETTER}+(?:[̀-ͯऀ-෿฀-໿က-႟]+{_LETTER}*)*")

#: The same in a text that is ASCII throughout, several times as fast.
ASCII_WORD = re.compile("[a-z]+")


def words_of(text: str) -> list:
    """The words of a text in lower case."""
    text = text.lower()
    return (ASCII_WORD if text.isascii() else WORD).findall(text)


_SCRIPTS = sorted({r[1] for r in RANGES} - {""}) + [""]
_SCRIPT_AT = np.array([_SCRIPTS.index(r[1]) for r in RANGES])


def _points(words: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all words with their borders, word of each, sizes)."""
    joined = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    return points, np.repeat(np.arange(len(words)), size), size


def scripts_of(words: list) -> np.ndarray:
    """Index in _SCRIPTS of the script of each word's first letter that has
    one ('other' if none has)."""
    if not len(words):
        return np.empty(0, np.int64)
    points, own, _ = _points(words)
    found = _SCRIPT_AT[np.searchsorted(_STARTS, points, side="right") - 1]
    out = np.full(len(words), _SCRIPTS.index("other"))
    has = np.flatnonzero(found != len(_SCRIPTS) - 1)[::-1]
    out[own[has]] = found[has]
    return out


def grams(words: list) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash cell) of every 2- to 4-gram of the words with their borders,
    and of every whole word."""
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points, own, size = _points(words)
    old = np.seterr(over="ignore")
    rolled, words_at, cells = points + np.uint64(0x9E3779B97F4A7C15), [], []
    for n in (2, 3, 4):
        rolled = rolled[:len(points) - n + 1] * np.uint64(0x2545F4914F6CDD1D) + points[n - 1:]
        inside = own[:len(rolled)] == own[n - 1:]
        words_at.append(own[:len(rolled)][inside])
        cells.append(rolled[inside])
    start = np.cumsum(size) - size
    place = (np.arange(len(points)) - start[own]).astype(np.uint64)
    mixed = (points + place * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    words_at.append(np.arange(len(words)))
    cells.append(np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), start))
    h = np.concatenate(cells)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    np.seterr(**old)
    return np.concatenate(words_at), (h >> np.uint64(40)).astype(np.int64) % CELLS


class WordMemory:
    """Scores of the words met so far, each computed once (up to ``MOST``
    words; then the memory starts anew)."""

    MOST = 200_000

    def __init__(self, model):
        self.model, self.place, self.table = model, {}, np.zeros((0, len(model.langs)))

    def __call__(self, flat: list) -> np.ndarray:
        if len(self.place) > self.MOST:
            self.place, self.table = {}, self.table[:0]
        new = [w for w in set(flat) if w not in self.place]
        if new:
            n = len(self.place)
            if n + len(new) > len(self.table):
                self.table = np.concatenate([self.table[:n], np.zeros((n + len(new), self.table.shape[1]))])
            self.table[n:n + len(new)] = self.model.word_scores(new)
            self.place.update(zip(new, range(n, n + len(new))))
        return self.table[np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))]


@dataclass
class LanguageModel:
    """Languages in code-point order; log-probabilities of the cells (CELLS x
    languages), the same less their mean; languages allowed for each script."""

    langs: list[str]
    scores: np.ndarray
    scripts: dict[str, np.ndarray]

    def word_scores(self, words: list) -> np.ndarray:
        """(words, languages): mean gram score times a length weight, clipped;
        minus infinity for languages that the word's script excludes. A word
        of a script never seen scores 0 for all."""
        k = len(self.langs)
        if not len(words) or not k:
            return np.zeros((len(words), k))
        own, cell = grams(words)
        size = np.bincount(own, minlength=len(words))
        sums = np.stack([np.bincount(own, weights=self.scores[cell, i], minlength=len(words)) for i in range(k)], axis=1)
        out = np.clip(sums / np.sqrt(size)[:, None], -CLIP, CLIP)
        script = scripts_of(words)
        for i, name in enumerate(_SCRIPTS):
            rows = np.flatnonzero(script == i)
            if name not in self.scripts:
                out[rows] = 0.0
            elif not self.scripts[name].all():
                out[np.ix_(rows, ~self.scripts[name])] = -np.inf
        return out


def viterbi(score: np.ndarray, lens: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word, texts one after the other in ``score``; all
    texts go in step. Ties stay with the label before, then the lowest index."""
    total, k = score.shape
    path = np.zeros(total, np.int64)
    if not total or k < 2:
        return path
    first = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    lens, first = lens[order], first[order]
    lens = lens[:int(np.count_nonzero(lens))]
    first = first[:len(lens)]
    back = np.zeros((total, k), np.min_scalar_type(k - 1))
    rows = np.arange(len(lens))
    best = score[first].copy()
    base = np.where(np.isfinite(best), best, -1e30)
    running = np.searchsorted(-lens, -np.arange(int(lens[0])), side="left").tolist()  # texts of more than t words
    for t in range(1, int(lens[0])):
        live = running[t]
        prev = base[:live]
        top = prev.argmax(axis=1)
        jump = prev[rows[:live], top][:, None] - switch
        stay = prev >= jump
        back[first[:live] + t] = np.where(stay, np.arange(k)[None], top[:, None])
        s = score[first[:live] + t]
        base[:live] = np.where(np.isfinite(s), np.where(stay, prev, jump) + s, -1e30)
    now = base.argmax(axis=1)
    path[first + lens - 1] = now
    for t in range(int(lens[0]) - 1, 0, -1):
        live = running[t]
        now[:live] = back[first[:live] + t, now[:live]]
        path[first[:live] + t - 1] = now[:live]
    return path


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smooth: float = 0.5) -> LanguageModel:
    """Counts of hashed grams and of scripts by language over all rows with a
    text and a language. Tasks add up their own rows and emit at most CELLS
    counts a language, so the driver's share does not grow with the corpus."""
    small_batches(docs.sparkSession)

    def count(batches):
        cells: dict = {}
        scripts: dict = {}
        held: dict = {}

        def empty():
            for lang, words in held.items():
                own, cell = grams(list(words))
                times = np.fromiter(words.values(), np.float64, len(words))
                cells[lang] = cells.get(lang, 0) + np.bincount(cell, weights=times[own], minlength=CELLS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(scripts_of(list(words)), weights=times, minlength=len(_SCRIPTS))
            held.clear()
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > 200_000:
                empty()
        empty()
        for lang, c in cells.items():
            for script, n in [("", c), *((x, np.array([v])) for x, v in zip(_SCRIPTS, scripts[lang]) if v)]:
                nz = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(nz), pa.string()), pa.array(np.full(len(nz), -1) if script else nz, pa.int64()),
                                                  pa.array([script] * len(nz), pa.string()), pa.array(n[nz], pa.float64())],
                                                 names=["lang", "cell", "script", "n"])
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = (rows.mapInArrow(count, "lang string, cell long, script string, n double")
              .groupBy("lang", "cell", "script").agg(F.sum("n").alias("n")))
    counts = write_table(counts, "lang-counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().toLocalIterator())
    place = {x: i for i, x in enumerate(langs)}
    table, seen = np.zeros((CELLS, len(langs))), {}
    for r in counts.toLocalIterator():
        if r.cell < 0:
            seen.setdefault(r.script, np.zeros(len(langs)))[place[r.lang]] += r.n
        else:
            table[r.cell, place[r.lang]] += r.n
    prob = (table + smooth) / (table.sum(axis=0, keepdims=True) + smooth * CELLS)
    logs = np.log(prob)
    scores = logs - logs.mean(axis=1, keepdims=True) if langs else logs
    own = sum(seen.values(), np.zeros(len(langs)))
    return LanguageModel(langs, scores.astype(np.float32), {s: (n > 0) & (n >= SCRIPT_SHARE * own) for s, n in seen.items()})


def label_spans(model: LanguageModel, texts: list, switch: float = SWITCH, memory: WordMemory | None = None) -> list[list[tuple[int, int, str]]]:
    """Per text its spans (first word, word after the last, language)."""
    words = [words_of(t) if t else [] for t in texts]
    flat = [w for ws in words for w in ws]
    lens = np.array([len(w) for w in words], dtype=np.int64)
    path = viterbi((memory or WordMemory(model))(flat), lens, switch) if model.langs else np.zeros(len(flat), np.int64)
    out, at = [], 0
    for n in lens:
        p = path[at:at + n]
        cut = np.r_[0, np.flatnonzero(p[1:] != p[:-1]) + 1, n] if n and model.langs else []
        out.append([(int(a), int(b), model.langs[p[a]]) for a, b in zip(cut[:-1], cut[1:])])
        at += n
    return out


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """Per row: doc_id, lang_pred, score, n_spans, spans (array of struct
    first, last_, lang: word positions, the end not included).

    ``lang_pred`` is the language of most words after the Viterbi pass (ties:
    the first by code point), ``score`` its share of them. Null texts, texts
    without a letter, and any text under a model without languages are
    ``und``, score 0. Rows are judged one by one; a null id is allowed."""
    small_batches(docs.sparkSession)
    # Pickled here, classes by value: a broadcast of the object would need the package on workers.
    share = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches):
        m = cloudpickle.loads(share.value)
        memory = WordMemory(m)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                spans = label_spans(m, part.column(1).to_pylist(), switch, memory)
                pred, score = [], []
                for s in spans:
                    by: dict = {}
                    for a, z, lang in s:
                        by[lang] = by.get(lang, 0) + z - a
                    top = min(by, key=lambda x: (-by[x], x)) if by else UNKNOWN
                    pred.append(top)
                    score.append(by[top] / sum(by.values()) if by else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([len(s) for s in spans], pa.int32()),
                     pa.array([[{"first": a, "last_": z, "lang": x} for a, z, x in s] for s in spans],
                              pa.list_(pa.struct([("first", pa.int32()), ("last_", pa.int32()), ("lang", pa.string())])))],
                    names=["doc_id", "lang_pred", "score", "n_spans", "spans"])
    return (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans int, "
                             "spans array<struct<first:int,last_:int,lang:string>>"))
