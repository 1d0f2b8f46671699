"""Regression evaluation in SQL aggregates: every metric set is one
aggregation over (y, y_hat) pairs, optionally grouped (per model, scenario,
segment) so many models are scored in the same scan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_, dlit
from ..functions.quantiles import prefix_counts, quantiles
from ..functions.stats import ks_pvalue, norm_inv_cdf, t_sf_two_sided


def fit_line(df: DataFrame, y: str, x) -> tuple[float, float]:
    """Closed-form single-predictor OLS (intercept, slope) from one aggregate."""
    r = df.agg(F.regr_intercept(col_(y), col_(x)).alias("a"), F.regr_slope(col_(y), col_(x)).alias("b")).first()
    return r["a"], r["b"]


def metric_aggs(y, yhat, prefix: str = "", cond: Column | None = None, original: bool = True) -> list[Column]:
    """r2, rmse, mae on the given (log) scale; rmse, mae, MAPE on the
    original scale (expm1); rows outside ``cond`` are ignored."""
    yy, pp = col_(y).cast("double"), col_(yhat).cast("double")
    if cond is not None:
        yy, pp = F.when(cond, yy), F.when(cond, pp)
    e = yy - pp
    n = F.count(e)
    sse = F.sum(e * e)
    sst = F.var_pop(F.when(e.isNotNull(), yy)) * n  # centred: the difference of two large sums has no digits left
    out = [n.alias(f"{prefix}n"), (F.lit(1.0) - F.try_divide(sse, sst)).alias(f"{prefix}r2"),
           F.sqrt(F.try_divide(sse, n)).alias(f"{prefix}rmse_log"), F.avg(F.abs(e)).alias(f"{prefix}mae_log")]
    if original:
        yo, po = F.expm1(yy), F.expm1(pp)
        eo = yo - po
        out += [F.sqrt(F.avg(eo * eo)).alias(f"{prefix}rmse_original"),
                F.avg(F.abs(eo)).alias(f"{prefix}mae_original"),
                (F.avg(F.abs(eo) / F.greatest(F.abs(yo), dlit(2.220446049250313e-16))) * 100).alias(f"{prefix}mape")]
    return out


def regression_metrics(df: DataFrame, y: str, yhat: str, is_train: Column, group: list[str] = ()) -> DataFrame:
    """Train/test metrics and overfitting gaps in one aggregation."""
    aggs = (metric_aggs(y, yhat, "train_", is_train, original=False)
            + metric_aggs(y, yhat, "test_", ~is_train))
    g = df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)
    return g.withColumns({"overfitting_r2": F.col("train_r2") - F.col("test_r2"),
                          "overfitting_rmse": F.col("test_rmse_log") - F.col("train_rmse_log")})


def residual_stats(df: DataFrame, resid: str) -> DataFrame:
    r = F.col(resid).cast("double")
    q = quantiles(df, [resid], [0.25, 0.5, 0.75])[resid]
    return df.agg(F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.min(r).alias("min"),
                  F.max(r).alias("max")).select("*", dlit(q[1]).alias("median"), dlit(q[0]).alias("q25"), dlit(q[2]).alias("q75"))


def jarque_bera(df: DataFrame, resid: str) -> DataFrame:
    """JB = n/6 (S^2 + K^2/4) from population skewness/excess kurtosis over
    all rows; chi-square(2) tail p = exp(-JB/2)."""
    r = F.col(resid).cast("double")
    s = df.agg(F.count(r).alias("n"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt"))
    jb = F.col("n") / 6.0 * (F.pow("skew", 2) + F.pow("kurt", 2) / 4.0)
    return s.select("n", "skew", "kurt", jb.alias("jb"), F.exp(-jb / 2.0).alias("p_value"),
                    (F.exp(-jb / 2.0) > 0.05).alias("is_normal"))


def ks_normal(df: DataFrame, c: str) -> dict:
    """Kolmogorov-Smirnov against a normal with the sample mean and deviation:
    the distributed statistic and its asymptotic p-value."""
    r = ks_statistic(df.select(c), c).first()
    return {"n": int(r["n"]), "statistic": float(r["d"]), "p_value": ks_pvalue(r["d"], r["n"])}


def homoscedasticity(df: DataFrame, yhat: str, resid: str, alpha: float = 0.05) -> DataFrame:
    """Pearson r of prediction and squared residual, its t statistic and
    p-value, and whether it stays above ``alpha``."""
    r = F.corr(F.col(yhat), F.pow(F.col(resid), 2))
    s = df.agg(r.alias("r"), F.count(F.lit(1)).alias("n")).first()
    t = p = None
    if s["r"] is not None and s["n"] > 2 and abs(s["r"]) < 1:
        t = s["r"] * math.sqrt((s["n"] - 2) / (1 - s["r"] ** 2))
        p = t_sf_two_sided(t, s["n"] - 2)
    return df.sparkSession.createDataFrame([(s["r"], s["n"], t, p, None if p is None else p > alpha)],
                                           "r double, n bigint, t_stat double, p_value double, is_homoscedastic boolean")


def prediction_interval(df: DataFrame, y: str, yhat: str, resid_std: float, confidence: float = 0.95) -> DataFrame:
    """yhat +- z*sigma with z = Phi^-1((1+c)/2); coverage of the truth."""
    z = norm_inv_cdf((1 + confidence) / 2)
    m = z * resid_std
    inside = (F.col(y) >= F.col(yhat) - m) & (F.col(y) <= F.col(yhat) + m)
    return df.agg(F.lit(z).alias("z"), F.lit(m).alias("margin"), F.avg(inside.cast("double")).alias("coverage"),
                  F.count(F.lit(1)).alias("n"))


def quantile_bins(df: DataFrame, y: str, inner=(0.25, 0.5, 0.75)) -> Column:
    """``qcut`` bin index: the edges are the minimum, the quantiles and the
    maximum, equal ones dropped; bins are closed on the right, the first on
    both sides, so values up to the second edge are in bin 0."""
    edges = quantiles(df, [y], [0.0, *inner, 1.0])[y]
    if edges[0] is None:
        return F.lit(0)
    upper = F.array(*[dlit(float(e)) for e in sorted(set(edges))[1:-1]]).cast("array<double>")
    return F.size(F.filter(upper, lambda e: e < F.col(y)))


def error_by_quantile(df: DataFrame, y_true: str, y_pred: str, inner=(0.25, 0.5, 0.75)) -> DataFrame:
    """Errors by bin of the truth; rows without a truth are left out, and a
    truth of 0 has no percentage error."""
    df = df.where(F.col(y_true).isNotNull())
    e = F.col(y_true) - F.col(y_pred)
    x = df.select(y_true, y_pred, e.alias("error"), F.abs(e).alias("abs_error"),
                  (F.abs(F.try_divide(e, F.col(y_true))) * 100).alias("pct_error"))
    x = x.withColumn("quantile", quantile_bins(x, y_true, inner))
    return x.groupBy("quantile").agg(
        F.round(F.min(y_true), 4).alias("y_true_min"), F.round(F.max(y_true), 4).alias("y_true_max"),
        F.count(y_true).alias("y_true_count"), F.round(F.avg("error"), 4).alias("error_mean"),
        F.round(F.avg("abs_error"), 4).alias("abs_error_mean"), F.round(F.avg("pct_error"), 4).alias("pct_error_mean"))


def grade_r2(c) -> Column:
    x = col_(c)
    return (F.when(x >= 0.9, "excellent").when(x >= 0.8, "very_good").when(x >= 0.7, "good")
             .when(x >= 0.6, "acceptable").otherwise("insufficient"))


def grade_mape(c) -> Column:
    x = col_(c)
    return F.when(x < 10, "excellent").when(x < 15, "good").when(x < 20, "acceptable").otherwise("to_improve")


def grade_overfit(c) -> Column:
    x = col_(c)
    return F.when(x < 0.05, "none").when(x < 0.10, "slight").otherwise("significant")


def grade_gain(c) -> Column:
    x = col_(c)
    return F.when(x > 0.1, "major").when(x > 0.05, "moderate").otherwise("minor")


# metric -> direction used by the two-model comparison.
COMPARED_METRICS = [("test_r2", "higher"), ("test_rmse_log", "lower"), ("test_mae_log", "lower"),
                    ("test_rmse_original", "lower"), ("test_mape", "lower"), ("overfitting_r2", "lower")]


def compare_models(m1: DataFrame, m2: DataFrame, keys: list[str], name1: str, name2: str,
                   metrics=COMPARED_METRICS) -> DataFrame:
    """Direction-aware winner and % improvement (0 when the base is 0) for
    every metric; both inputs are unpivoted and joined on (keys, metric)."""
    def long(m, tag):
        return m.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(d).alias("direction"),
                                                           F.col(k).cast("double").alias(tag)) for k, d in metrics])))
    j = long(m1, "val1").join(long(m2, "val2").drop("direction"), keys + ["metric"])
    hi = F.col("direction") == "higher"
    v1, v2 = F.col("val1"), F.col("val2")
    better2 = F.when(hi, v2 > v1).otherwise(v2 < v1)
    imp = F.when(v1 == 0, dlit(0.0)).otherwise(F.when(hi, v2 - v1).otherwise(v1 - v2) / F.abs(v1) * 100)
    return j.select(*keys, "metric", "val1", "val2", (v2 - v1).alias("diff"), imp.alias("improvement_pct"),
                    F.when(better2, F.lit(name2)).otherwise(F.lit(name1)).alias("winner"))


def z_value(confidence: float) -> float:
    return norm_inv_cdf((1 + confidence) / 2)


def ks_statistic(df: DataFrame, c: str) -> DataFrame:
    """Kolmogorov-Smirnov D of ``c`` against a normal with the sample mean and
    std: max over distinct values of |F_n - Phi| on both sides of each step,
    from the distributed two-level prefix sums (no global sort)."""
    from ..functions.normal import norm_cdf
    st = df.agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).first()
    pc = prefix_counts(df, {c: c})
    z = (F.col("x") - F.lit(st["m"])) / F.lit(st["s"])
    phi = norm_cdf(z)
    hi = F.col("cum") / F.col("n") - phi
    lo = phi - (F.col("cum") - F.col("cnt")) / F.col("n")
    return pc.agg(F.max("n").cast("bigint").alias("n"), F.max(F.greatest(hi, lo)).alias("d"))
