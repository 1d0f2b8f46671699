"""Outlier flags, caps and influence statistics.

Bounds are learned by one aggregation over all columns (percentiles, means,
stds) and applied as null-preserving ``when`` projections. Influence
statistics never form the n x n hat matrix: X'X and X'y come from one
aggregation ((p+1)^2 sums), the (p+1) x (p+1) inverse is solved on the
driver and inlined as literals, and leverage is a per-row quadratic form.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..functions.quantiles import medians, quantiles


def iqr_bounds(df: DataFrame, cols: list[str], k: float = 1.5) -> dict:
    """Q1 - k*IQR, Q3 + k*IQR per column."""
    out = {}
    for c, (q1, q3) in quantiles(df, cols, [0.25, 0.75]).items():
        if q1 is None:
            continue
        out[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def zscore_bounds(df: DataFrame, cols: list[str], k: float = 3.0, ddof: int = 1) -> dict:
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    r = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
               *[sd(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = r[f"m{i}"], r[f"s{i}"]
        if m is None or s is None:
            continue
        out[c] = (m - k * s, m + k * s)
    return out


def percentile_bounds(df: DataFrame, cols: list[str], lo=0.05, hi=0.95) -> dict:
    return {c: tuple(q) for c, q in quantiles(df, cols, [lo, hi]).items() if q[0] is not None}


def flag_outside(df: DataFrame, bounds: dict, key: str, prefix: str = "out_") -> DataFrame:
    """Boolean flag per column: value < lower or > upper; NULL -> false."""
    return df.select(key, *[F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)).alias(prefix + c)
                            for c, (lo, hi) in bounds.items()])


def outliers_iqr(df: DataFrame, cols: list[str], key: str, k: float = 1.5) -> DataFrame:
    return flag_outside(df, iqr_bounds(df, cols, k), key)


def outliers_zscore(df: DataFrame, cols: list[str], key: str, k: float = 3.0) -> DataFrame:
    """|z| > k with the population std (scipy ``zscore`` default)."""
    return flag_outside(df, zscore_bounds(df, cols, k, ddof=0), key)


def outlier_counts(df: DataFrame, bounds: dict) -> DataFrame:
    """Outlier count and % per column (one aggregation, unpivoted)."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("__n"), *[F.sum(((F.col(c) < lo) | (F.col(c) > hi)).cast("long")).alias(f"c{i}")
                                    for i, (c, (lo, hi)) in enumerate(bounds.items())])
    rows = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n_outliers"),
                     F.round(F.coalesce(F.col(f"c{i}"), F.lit(0)) * 100.0 / F.col("__n"), 4).alias("pct"))
            for i, c in enumerate(bounds)]
    return wide.select(F.inline(F.array(*rows)))


@dataclass
class CapParams:
    method: str
    bounds: dict = field(default_factory=dict)

    def rows(self):
        return [(c, self.method, float(lo), float(hi)) for c, (lo, hi) in self.bounds.items()]

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows(), "column string, method string, lower double, upper double")


def fit_caps(df: DataFrame, cols: list[str], method: str = "winsorize") -> CapParams:
    """winsorize: P5/P95; iqr: Q1-1.5IQR / Q3+1.5IQR; zscore: mean +- 3 std (ddof 1)."""
    if method == "winsorize":
        b = percentile_bounds(df, cols, 0.05, 0.95)
    elif method == "iqr":
        b = iqr_bounds(df, cols, 1.5)
    elif method == "zscore":
        b = zscore_bounds(df, cols, 3.0, ddof=1)
    else:
        raise ValueError(f"unknown cap method {method}")
    return CapParams(method, b)


def apply_caps(df: DataFrame, p: CapParams) -> DataFrame:
    """Null-preserving clip of every learned column (pure projection)."""
    return df.select(*[clip(c, p.bounds[c][0], p.bounds[c][1]).alias(c) if c in p.bounds else F.col(c)
                       for c in df.columns])


def target_cap_rule(df: DataFrame, c: str, k: float = 3.0, min_pct: float = 1.0,
                    max_abs_skew: float = 0.5) -> tuple[DataFrame, dict]:
    """Cap ``c`` at mean +- k*std (ddof 1) unless outlier share (|z| > k with
    population std) < min_pct AND |skew| < max_abs_skew. One stats pass."""
    x = F.col(c).cast("double")
    s = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s1"), F.stddev_pop(x).alias("s0"),
               F.skewness(x).alias("sk"), F.count(x).alias("n")).first()
    n_out = df.where(F.abs(F.try_divide(x - F.lit(s["m"]).cast("double"), F.lit(s["s0"]).cast("double"))) > k).count()
    pct = n_out * 100.0 / max(s["n"], 1)
    if s["m"] is None or s["s1"] is None:  # no value, or one: no spread to cap by
        return df, {"pct_outliers": 0.0, "skew": s["sk"], "applied": False, "lower": None, "upper": None}
    apply = not (pct < min_pct and abs(s["sk"] or 0.0) < max_abs_skew)
    info = {"pct_outliers": pct, "skew": s["sk"], "applied": apply,
            "lower": s["m"] - k * s["s1"], "upper": s["m"] + k * s["s1"]}
    out = df.withColumn(c, clip(c, info["lower"], info["upper"])) if apply else df
    return out, info


def residual_band(df: DataFrame, resid: str, k: float = 2.0) -> DataFrame:
    sd = df.agg(F.stddev_samp(resid).alias("s")).first()["s"]
    return df.withColumn("outside_band", F.abs(F.col(resid)) > F.lit(k * sd))


# ----------------------------------------------------------------- influence
def influence(df: DataFrame, y: str, xs: list[str], key: str, standard: bool = False,
              fill_median: bool = True) -> tuple[DataFrame, dict]:
    """Leverage, Cook's distance and DFFITS of an OLS fit with intercept.
    Default formulas follow the reference (Cook divides by p, DFFITS without
    the studentising factor); ``standard=True`` uses the textbook forms."""
    cols = list(xs)
    med = medians(df, cols + [y]) if fill_median else {}
    r = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"mu_{c}") for c in cols]).first()
    # Columns are centred by their means: same fit, well-conditioned Gramian.
    mu = {c: r[f"mu_{c}"] or 0.0 for c in cols}
    X = [F.lit(1.0)] + [F.coalesce(F.col(c).cast("double"), F.lit(med.get(c))) - F.lit(mu[c])
                        for c in cols]
    Y = F.coalesce(F.col(y).cast("double"), F.lit(med.get(y)))
    k = len(X)
    aggs = [F.sum(X[i] * X[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(X[i] * Y).alias(f"b{i}") for i in range(k)] + [F.count(F.lit(1)).alias("n")]
    r = df.agg(*aggs).first()
    G = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            G[i, j] = G[j, i] = r[f"g{i}_{j}"]
    b = np.array([r[f"b{i}"] for i in range(k)])
    Ginv = np.linalg.pinv(G)
    beta = Ginv @ b
    n, p = r["n"], len(cols)
    yhat = sum((F.lit(float(beta[i])) * X[i] for i in range(k)), F.lit(0.0))
    h = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            if Ginv[i, j] != 0.0:
                h = h + F.lit(float(Ginv[i, j])) * X[i] * X[j]
    base = df.select(key, (Y - yhat).alias("resid"), h.alias("leverage"))
    sse = base.agg(F.sum(F.col("resid") * F.col("resid")).alias("s")).first()["s"]
    mse = sse / (n - p - 1)
    hh, e = F.col("leverage"), F.col("resid")
    denom_p = (p + 1) if standard else p
    cook = F.try_divide(e * e, F.lit(denom_p * mse)) * F.try_divide(hh, F.pow(F.lit(1.0) - hh, 2))
    if standard:
        dff = F.try_divide(e, F.sqrt(F.lit(mse) * (F.lit(1.0) - hh))) * F.sqrt(F.try_divide(hh, F.lit(1.0) - hh))
    else:
        dff = F.try_divide(e * F.sqrt(F.try_divide(hh, F.lit(1.0) - hh)), F.lit(math.sqrt(mse)))
    th = {"leverage": 2.0 * (p + 1) / n, "cooks": 1.0, "dffits": 2.0 * math.sqrt(p / n), "mse": mse, "n": n}
    out = base.select(key, "resid", "leverage", cook.alias("cooks_d"), dff.alias("dffits"))
    out = out.select("*", (F.col("leverage") > th["leverage"]).alias("high_leverage"),
                     (F.col("cooks_d") > th["cooks"]).alias("high_cooks"),
                     (F.abs("dffits") > th["dffits"]).alias("high_dffits"))
    return out, th
