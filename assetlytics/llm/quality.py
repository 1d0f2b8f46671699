"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - f(text)); one weight vector over hashed
text features is shared by all grades and the thresholds are ordered. The fit
gives every text an expected grade and the tail probability of the top grade.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

DIM = 1 << 20
#: Most labelled rows that a fit reads (the lowest hashes of doc_id); the fit's memory is bounded by it.
MAX_LABELLED = 9_000
#: Selection: least probability of the top grade.
KEEP_TAIL = 0.7
GRADES = 3


def _features(token: str) -> list[int]:
    """Hashed features of one token: its core's first 4 and 5 letters, and its
    shape (case and surrounding punctuation)."""
    core = token.strip(string.punctuation)
    case = "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l" if core.isalpha() else "o"
    at = token.find(core) if core else 0
    low = core.lower()
    names = (f"s{token[:at]}{case}{token[at + len(core):]}" if core else f"s{token}", f"p{low[:4]}", f"q{low[:5]}")
    return [xxhash.xxh3_64_intdigest(n) % DIM for n in names[:3 if core else 1]]


REPEAT = xxhash.xxh3_64_intdigest("repeat") % DIM


def token_table(texts: list) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """(token codes, tokens per text, distinct tokens, repeats per text). A
    null text has no tokens; a repeat equals the token before it."""
    toks = [t.split() if t else [] for t in texts]
    lens = np.array([len(t) for t in toks], dtype=np.int64)
    flat = np.empty(int(lens.sum()), dtype=object)
    flat[:] = [x for t in toks for x in t]
    codes, distinct = pd.factorize(flat)
    own = np.repeat(np.arange(len(texts)), lens)
    same = np.r_[False, (codes[1:] == codes[:-1]) & (own[1:] == own[:-1])] if len(codes) else np.empty(0, bool)
    return codes, lens, distinct, np.bincount(own[same], minlength=len(texts))


def design_rows(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature ids, values) per text: feature counts over sqrt(tokens)."""
    codes, lens, distinct, repeats = token_table(texts)
    feats = [_features(t) for t in distinct]
    out, at = [], 0
    for n, rep in zip(lens, repeats):
        seen, times = np.unique(codes[at:at + n], return_counts=True)
        at += n
        ids = np.array([f for c in seen for f in feats[c]] + [REPEAT] * int(rep > 0), dtype=np.int64)
        val = np.array([t for c, t in zip(seen, times) for _ in feats[c]] + [rep] * int(rep > 0), dtype=np.float64)
        ids, back = np.unique(ids, return_inverse=True)
        out.append((ids, np.bincount(back, weights=val, minlength=len(ids)) / max(n, 1) ** 0.5))
    return out


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds; ``weights`` has DIM entries."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, f: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k: columns 0 .. grades - 2."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None] - f[:, None], -500, 500)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int = GRADES, steps: int = 300,
                rate: float = 0.1, ridge: float = 3e-5) -> OrdinalModel:
    """Maximum penalised likelihood by full-batch Adam. Thresholds are a first
    value plus positive increments, so they stay ordered. Features of fewer
    than 3 rows keep weight 0. Without rows every weight is 0 and the
    thresholds are even: each text then gets the middle grade."""
    thr = np.linspace(-1.0, 1.0, n_grades - 1)
    w = np.zeros(DIM, dtype=np.float64)
    if not rows:
        return OrdinalModel(w, thr)
    ids = np.concatenate([r[0] for r in rows])
    common = np.bincount(ids, minlength=DIM) >= 3
    keep = common[ids]
    used, back = np.unique(ids[keep], return_inverse=True)
    val = np.concatenate([r[1] for r in rows])[keep].astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])[keep]
    n, d = len(rows), len(used)
    k = n_grades - 1
    beta, a = np.zeros(d), np.r_[thr[:1], np.log(np.diff(thr))]
    state = [np.zeros(d), np.zeros(d), np.zeros(k), np.zeros(k)]
    y = np.asarray(grades)
    hi, lo = np.minimum(y, k - 1), np.maximum(y - 1, 0)
    for step in range(1, steps + 1):
        t = np.cumsum(np.r_[a[:1], np.exp(a[1:])])
        f = np.bincount(row, weights=beta[back] * val, minlength=n)
        up = np.where(y < k, 1 / (1 + np.exp(np.clip(f - t[hi], -500, 500))), 1.0)
        dn = np.where(y > 0, 1 / (1 + np.exp(np.clip(f - t[lo], -500, 500))), 0.0)
        p = np.maximum(up - dn, 1e-12)
        gu, gd = np.where(y < k, up * (1 - up), 0.0) / p, np.where(y > 0, dn * (1 - dn), 0.0) / p
        gf = (gu - gd) / n
        gb = np.bincount(back, weights=gf[row] * val, minlength=d) + ridge * beta
        gt = (np.bincount(lo, weights=gd * (y > 0), minlength=k) - np.bincount(hi, weights=gu * (y < k), minlength=k)) / n
        ga = np.array([gt[j:].sum() for j in range(k)]) * np.r_[1.0, np.exp(a[1:])]
        for x, g, m1, m2 in ((beta, gb, state[0], state[1]), (a, ga, state[2], state[3])):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x -= rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    w[used] = beta
    return OrdinalModel(w, np.cumsum(np.r_[a[:1], np.exp(a[1:])]))


def _score(model: OrdinalModel, texts: list) -> np.ndarray:
    codes, lens, distinct, repeats = token_table(texts)
    per = np.array([model.weights[_features(t)].sum() for t in distinct])
    own = np.repeat(np.arange(len(texts)), lens)
    f = np.bincount(own, weights=per[codes], minlength=len(texts)) if len(codes) else np.zeros(len(texts))
    return (f + model.weights[REPEAT] * repeats) / np.sqrt(np.maximum(lens, 1))


def graded(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) -> doc_id, grade: 0 low quality, 1 well
    formed but toxic, 2 clean. Rows with a null are left out; a doc_id with
    several ratings has the lowest."""
    g = F.col("quality").cast("int") * (2 - F.col("toxic").cast("int"))
    return (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
            .groupBy("doc_id").agg(F.min(g).alias("grade")))


def fit_on_sample(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_labelled: int = MAX_LABELLED) -> OrdinalModel:
    """Fit on at most ``max_labelled`` rated documents, those of the lowest
    hash of doc_id. Only their features reach the driver."""
    small_batches(docs.sparkSession)
    some = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    train = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
             .join(F.broadcast(some), "doc_id").select("text", "grade"))

    def featurise(batches):
        for b in batches:
            rows = design_rows(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(1).cast(pa.int32()), pa.array([r[0].astype("<i4").tobytes() for r in rows], pa.binary()),
                 pa.array([r[1].astype("<f4").tobytes() for r in rows], pa.binary())], names=["grade", "ids", "vals"])
    got = train.mapInArrow(featurise, "grade int, ids binary, vals binary").toLocalIterator()
    rows, grades = [], []
    for r in got:
        rows.append((np.frombuffer(r.ids, "<i4"), np.frombuffer(r.vals, "<f4")))
        grades.append(r.grade)
    order = sorted(range(len(rows)), key=lambda i: (grades[i], bytes(rows[i][0])[:4096], len(rows[i][0])))
    return fit_ordinal([rows[i] for i in order], np.array([grades[i] for i in order]))


def score_quality(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text",
                  keep_tail: float = KEEP_TAIL) -> DataFrame:
    """All columns of ``docs`` kept under ``row_``, and doc_id, expected_grade,
    p_top (tail probability of the top grade) and kept (p_top >= keep_tail).

    One narrow pass, no shuffle. Null and empty texts have no features: their
    score is that of f = 0. Rows are judged one by one, so repeated rows get
    equal results and a null doc_id is allowed."""
    small_batches(docs.sparkSession)
    nz = np.flatnonzero(model.weights)
    share = docs.sparkSession.sparkContext.broadcast((nz, model.weights[nz], model.thresholds))

    @F.pandas_udf("expected_grade double, p_top double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        ids, vals, thr = share.value
        w = np.zeros(DIM)
        w[ids] = vals
        m = OrdinalModel(w, thr)
        tails = np.concatenate([m.tails(_score(m, list(texts.iloc[i:i + 256]))) for i in range(0, len(texts), 256)])
        return pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_top": tails[:, -1]})

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row.alias("row_"), judge(F.col(f"`{text_col}`")).alias("j_"))
    return out.select("doc_id", "row_", F.round("j_.expected_grade", 9).alias("expected_grade"),
                      F.round("j_.p_top", 9).alias("p_top"), (F.col("j_.p_top") >= keep_tail).alias("kept"))
