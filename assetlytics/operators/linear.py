"""Linear models from moments: one scan serves every fold, fraction and alpha.

Features are standardised by the moments of the rows that a fit may see (as a
scaler inside a cross-validated pipeline does), the target is centred. OLS and
ridge solve the standardised Gramian, with one eigen-decomposition for all
alphas; lasso and elastic net go down coordinates on it, each alpha starting
from the one before. Squared errors of any fold follow from its moments; mean
absolute errors take one more pass for all models together.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import ALL, Moments, added, centres, grouped_moments, scaled
from ..functions.quantiles import medians

#: Eigenvalues below this share of the largest count as none.
RANK_TOLERANCE = 1e-10
#: Coordinate descent ends when the optimality conditions hold this exactly.
KKT_TOLERANCE = 1e-9
MAX_SWEEPS = 100_000


@dataclass
class Design:
    """Names and expressions of the features and the target; shift and scale
    of all columns (the target is shifted only)."""
    names: list
    features: list
    target: Column
    shift: np.ndarray
    scale: np.ndarray

    @property
    def columns(self) -> list:
        return [*self.features, self.target]


def design(train: DataFrame, numeric: list[str], categories: list[str], target: Column) -> Design:
    """Numeric columns with their training medians for nulls, a 0/1 column for
    every level that the training rows show (levels in order)."""
    mid = medians(train, list(numeric))
    names, features = list(numeric), [F.coalesce(F.col(c).cast("double"), F.lit(float(mid[c] or 0.0))) for c in numeric]
    if categories:
        pairs = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categories])))
        for r in sorted(pairs.where("v IS NOT NULL").distinct().collect(), key=lambda r: (categories.index(r["c"]), r["v"])):
            names.append(f"{r['c']}_{r['v']}")
            features.append(F.coalesce((F.col(r["c"]) == r["v"]).cast("double"), F.lit(0.0)))
    shift, scale = centres(train, [*features, target])
    return Design(names, features, target, np.array(shift), np.array([*scale[:-1], 1.0]))


@dataclass
class LinearFit:
    """Coefficients over the design's scaled columns."""
    intercept: float
    coef: np.ndarray

    def expression(self, d: Design) -> Column:
        """The prediction as a column expression over the raw columns."""
        out = F.lit(float(self.intercept + d.shift[-1]))
        for c, b, m, s in zip(d.features, self.coef, d.shift, d.scale):
            out = out + F.lit(float(b / s)) * (c - F.lit(float(m)))
        return out


def _standardised(m: Moments):
    """(Z'Z, Z'y, scale, means): features by the deviation within these rows."""
    c = m.centred()
    spread = np.sqrt(np.maximum(np.diag(c)[:-1], 0.0) / max(m.n, 1.0))
    spread = np.where(spread > 1e-12, spread, 1.0)
    return c[:-1, :-1] / np.outer(spread, spread), c[:-1, -1] / spread, spread, m.mean


def _fitted(w: np.ndarray, spread: np.ndarray, mean: np.ndarray) -> LinearFit:
    coef = w / spread
    return LinearFit(float(mean[-1] - coef @ mean[:-1]), coef)


def ridge_path(m: Moments, alphas: list[float]) -> list[LinearFit]:
    """Ridge (alpha on the unscaled squared loss) for every alpha from one
    eigen-decomposition; alpha 0 is least squares of smallest norm."""
    a, b, spread, mean = _standardised(m)
    value, vector = np.linalg.eigh(a)
    rest = vector.T @ b
    keep = value > RANK_TOLERANCE * max(value.max(initial=0.0), 1e-300)
    out = []
    for alpha in alphas:
        w = vector @ np.where(keep | (alpha > 0), rest / np.where(keep | (alpha > 0), value + alpha, 1.0), 0.0)
        out.append(_fitted(w, spread, mean))
    return out


def kkt_residual(a: np.ndarray, b: np.ndarray, w: np.ndarray, l1: float, l2: float) -> float:
    """How far w is from the optimum of w'Aw/2 - b'w + l1 |w| + l2 w'w/2."""
    grad = a @ w + l2 * w - b
    off = np.where(w != 0, np.abs(grad + l1 * np.sign(w)), np.maximum(np.abs(grad) - l1, 0.0))
    return float(off.max(initial=0.0))


def descend(a: np.ndarray, b: np.ndarray, l1: float, l2: float, w: np.ndarray) -> np.ndarray:
    """Coordinate descent on a Gramian from ``w``. The optimality conditions
    decide when it ends; not to reach them is an error, never a worse fit."""
    w, grad = w.copy(), a @ w
    diag = np.diag(a)
    for sweep in range(MAX_SWEEPS):
        for j in range(len(b)):
            if diag[j] + l2 <= 0:
                continue
            pull = b[j] - grad[j] + diag[j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (diag[j] + l2)
            if new != w[j]:
                grad += a[:, j] * (new - w[j])
                w[j] = new
        if sweep % 10 == 9 or sweep < 10:
            grad = a @ w
            if kkt_residual(a, b, w, l1, l2) < KKT_TOLERANCE:
                return w
    raise ArithmeticError(f"coordinate descent did not settle in {MAX_SWEEPS} sweeps")


def lasso_path(m: Moments, alphas: list[float], l1_ratio: float = 1.0) -> list[LinearFit]:
    """Elastic net (lasso at l1_ratio 1) of mean squared loss / 2, for every
    alpha, from the largest down, each starting from the one before."""
    a, b, spread, mean = _standardised(m)
    a, b = a / m.n, b / m.n
    fits, w = {}, np.zeros(len(b))
    for alpha in sorted(set(alphas), reverse=True):
        w = descend(a, b, alpha * l1_ratio, alpha * (1 - l1_ratio), w)
        fits[alpha] = _fitted(w, spread, mean)
    return [fits[alpha] for alpha in alphas]


def fit_path(kind: str, m: Moments, params: list[dict]) -> list[LinearFit]:
    """Fits of one family for a list of parameters."""
    if kind == "ols":
        return [ridge_path(m, [0.0])[0] for _ in params]
    if kind == "ridge":
        return ridge_path(m, [float(p.get("alpha", 1.0)) for p in params])
    if kind not in ("lasso", "enet"):
        raise ValueError(f"{kind!r} is no linear model")
    out = [None] * len(params)
    for ratio in dict.fromkeys(1.0 if kind == "lasso" else float(p.get("l1_ratio", 0.5)) for p in params):
        mine = [i for i, p in enumerate(params) if kind == "lasso" or float(p.get("l1_ratio", 0.5)) == ratio]
        for i, f in zip(mine, lasso_path(m, [float(params[i].get("alpha", 1.0)) for i in mine], ratio)):
            out[i] = f
    return out


def squared_errors(m: Moments, f: LinearFit) -> tuple[float, float]:
    """(sum of squared errors, sum of squares about the mean) of a group's rows."""
    c, v = m.centred(), np.append(-f.coef, 1.0)
    rest = m.mean[-1] - f.intercept - f.coef @ m.mean[:-1]
    return float(v @ c @ v + m.n * rest * rest), float(c[-1, -1])


def r2(m: Moments, f: LinearFit) -> float:
    sse, sst = squared_errors(m, f)
    return 1 - sse / sst if sst else float("nan")


def fold_moments(train: DataFrame, d: Design, fold: str, folds: list) -> dict[int, Moments]:
    got = grouped_moments(train, d.columns, d.shift, d.scale, F.col(fold).cast("string"))
    return {k: got[str(k)] for k in folds if str(k) in got}


def whole(parts: dict) -> Moments:
    out = None
    for m in parts.values():
        out = m if out is None else out + m
    if out is None:
        raise ValueError("no rows to fit on")
    return out


def _absolute_task(p: int, fits: dict):
    def task(batches):
        total = None
        for b in batches:
            x = np.column_stack([b.column(f"x{j}").to_numpy(zero_copy_only=False) for j in range(p)])
            fold = np.array(b.column("fold").to_pylist())
            for k, (intercept, coef) in fits.items():
                part = x[fold == k]
                e = np.abs(part[:, -1:] - np.asarray(intercept) - part[:, :-1] @ np.asarray(coef).T).sum(0)
                total = total or {}
                total[k] = total.get(k, 0.0) + e
        total = total or {}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["fold", "sums"])
    return task


def absolute_errors(train: DataFrame, d: Design, fold: str, fits: dict) -> dict:
    """Sums of absolute errors of each fold's rows under that fold's fits: one
    pass for all models. ``fits``: fold -> list of fits."""
    p = len(d.columns)
    plain = {str(k): ([f.intercept for f in v], [f.coef.tolist() for f in v]) for k, v in fits.items()}
    rows = train.select(F.col(fold).cast("string").alias("fold"), *scaled(d.columns, d.shift, d.scale)).dropna()
    return {int(k): v for k, v in added(rows.mapInArrow(_absolute_task(p, plain), "fold string, sums array<double>"), "fold").items()}


def _mean_std(v: list) -> tuple[float, float]:
    return float(np.mean(v)), float(np.std(v))


def cross_validate(train: DataFrame, d: Design, models: list[tuple[str, dict]], folds: list, fold: str = "fold", mae: bool = True) -> list[dict]:
    """k-fold metrics (mean and population deviation of r2, rmse, mae; mean
    train r2) of many linear models: one scan for the moments of the folds,
    every training set by subtraction, one more scan for the absolute errors."""
    parts = fold_moments(train, d, fold, folds)
    every = whole(parts)
    fits = {k: [None] * len(models) for k in parts}
    for k in parts:
        for kind in dict.fromkeys(m[0] for m in models):
            mine = [i for i, m in enumerate(models) if m[0] == kind]
            for i, f in zip(mine, fit_path(kind, every - parts[k], [models[i][1] for i in mine])):
                fits[k][i] = f
    absolute = absolute_errors(train, d, fold, fits) if mae else None
    out = []
    for i, (kind, params) in enumerate(models):
        score = [r2(parts[k], fits[k][i]) for k in parts]
        rmse = [(squared_errors(parts[k], fits[k][i])[0] / parts[k].n) ** 0.5 for k in parts]
        seen = [r2(every - parts[k], fits[k][i]) for k in parts]
        row = {"kind": kind, "params": params, "fold_r2": dict(zip(parts, score)), "cv_train_r2_mean": float(np.mean(seen))}
        row["cv_r2_mean"], row["cv_r2_std"] = _mean_std(score)
        row["cv_rmse_mean"], row["cv_rmse_std"] = _mean_std(rmse)
        if mae:
            row["cv_mae_mean"], row["cv_mae_std"] = _mean_std([absolute[k][i] / parts[k].n for k in parts])
        out.append(row)
    return out


def learning_curve(train: DataFrame, d: Design, kind: str, params: dict, folds: list, bucket: Column, buckets: int = 10, fold: str = "fold") -> list[dict]:
    """For each fraction i / buckets: fits on the rows of the other folds whose
    ``bucket`` (0 .. buckets - 1) is below i, scored on the whole held-out fold.
    One scan by (fold, bucket); every training set is a prefix sum."""
    key = F.concat_ws(":", F.col(fold).cast("string"), bucket.cast("int").cast("string"))
    got = {tuple(map(int, k.split(":"))): m for k, m in grouped_moments(train, d.columns, d.shift, d.scale, key).items()}
    by_fold = {k: whole({b: m for (f, b), m in got.items() if f == k}) for k in folds}
    rows = []
    for i in range(1, buckets + 1):
        held, seen = [], []
        for k in folds:
            parts = {key: m for key, m in got.items() if key[0] != k and key[1] < i}
            if not parts:  # no row to fit on: no score
                held.append(float("nan"))
                seen.append(float("nan"))
                continue
            used = whole(parts)
            f = fit_path(kind, used, [params])[0]
            held.append(r2(by_fold[k], f))
            seen.append(r2(used, f))
        n = sum(m.n for (_, b), m in got.items() if b < i)
        mean, std = _mean_std(held)
        rows.append({"fraction": i / buckets, "n": int(n), "r2_mean": mean, "r2_std": std, "train_r2_mean": float(np.mean(seen))})
    return rows


def fit(train: DataFrame, d: Design, kind: str, params: dict) -> LinearFit:
    return fit_path(kind, grouped_moments(train, d.columns, d.shift, d.scale)[ALL], [params])[0]


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package
