"""Registered evaluation queries (SURVEY §2.12 M, §2.5 E1/E3/E4, C3, J10, L7,
L13, L16) over deterministic closed-form predictions, so they stay
SQL-checkable: y = ln(1 + emissions_sim); models per scenario are the train
mean and a single-predictor OLS (without the score: on area; with the score:
on the score-adjusted area)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import evaluate as EV
from .common import SQL_TARGET_SIM, SQL_TRAIN, asset, is_train, target_sim
from .registry import query
from .sqlfrag import norm_cdf, t_sf2

SCEN = [("m1_without_score", "mean_baseline", "p0"), ("m1_without_score", "ols", "p1"),
        ("m2_with_score", "mean_baseline", "p0"), ("m2_with_score", "ols", "p2")]


def predictions(spark, sf_dir):
    x2 = F.col("gfa_total") / 1000.0 * (F.lit(1.4) - F.lit(0.008) * F.coalesce(F.col("energy_score"), F.lit(50.0)))
    a = asset(spark, sf_dir).select("asset_id", "neighborhood", is_train().alias("is_train"),
                                    F.log1p(target_sim()).alias("y"), F.col("gfa_total").cast("double").alias("x1"),
                                    x2.alias("x2"))
    r = a.where("is_train").agg(F.avg("y").alias("ybar"),
                                F.regr_intercept("y", "x1").alias("a1"), F.regr_slope("y", "x1").alias("b1"),
                                F.regr_intercept("y", "x2").alias("a2"), F.regr_slope("y", "x2").alias("b2")).first()
    return a.withColumns({"p0": F.lit(r["ybar"]), "p1": F.lit(r["a1"]) + F.lit(r["b1"]) * F.col("x1"),
                          "p2": F.lit(r["a2"]) + F.lit(r["b2"]) * F.col("x2")})


def long_predictions(p):
    arr = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(m).alias("model"), F.col(c).alias("yhat"))
                    for s, m, c in SCEN])
    return p.select("asset_id", "neighborhood", "is_train", "y", F.inline(arr))


def one_prediction(p, scenario, model):
    """The predictions of one scenario and model: a projection, no fan-out."""
    c = next(c for s, m, c in SCEN if (s, m) == (scenario, model))
    return p.select("asset_id", "neighborhood", "is_train", "y", F.col(c).alias("yhat"))


PRED_CTE = f"""
, base AS (SELECT asset_id, neighborhood, {SQL_TRAIN} AS is_train, ln(1 + ({SQL_TARGET_SIM})) AS y,
                  CAST(gfa_total AS DOUBLE) AS x1, gfa_total / 1000.0 * (1.4 - 0.008 * coalesce(energy_score, 50.0)) AS x2
           FROM asset),
f AS (SELECT avg(y) AS ybar, regr_intercept(y, x1) AS a1, regr_slope(y, x1) AS b1,
             regr_intercept(y, x2) AS a2, regr_slope(y, x2) AS b2 FROM base WHERE is_train),
pr AS (SELECT base.*, ybar AS p0, a1 + b1 * x1 AS p1, a2 + b2 * x2 AS p2 FROM base, f),
lg AS ({" UNION ALL ".join(f"SELECT asset_id, neighborhood, is_train, y, '{s}' AS scenario, '{m}' AS model, {c} AS yhat FROM pr"
                           for s, m, c in SCEN)})
"""


def metric_sql(prefix, cond, original=True, y="y", yhat="yhat"):
    e = f"(CASE WHEN {cond} THEN {y} - {yhat} END)"
    yy = f"(CASE WHEN {cond} THEN {y} END)"
    n = f"count({e})"
    sse = f"sum({e} * {e})"
    sst = f"nullif(var_pop(CASE WHEN {e} IS NOT NULL THEN {yy} END) * {n}, 0)"
    out = [f"{n} AS {prefix}n", f"round(1 - {sse} / {sst}, 6) AS {prefix}r2",
           f"round(sqrt({sse} / {n}), 6) AS {prefix}rmse_log", f"round(avg(abs({e})), 6) AS {prefix}mae_log"]
    if original:
        eo = f"(CASE WHEN {cond} THEN (exp({y}) - 1) - (exp({yhat}) - 1) END)"
        yo = f"(exp({y}) - 1)"
        out += [f"round(sqrt(avg({eo} * {eo})), 6) AS {prefix}rmse_original",
                f"round(avg(abs({eo})), 6) AS {prefix}mae_original",
                f"round(avg(abs({eo}) / greatest(abs({yo}), 2.220446049250313e-16)) * 100, 6) AS {prefix}mape"]
    return out


def raw_metric_sql(prefix, cond, original=True):
    return [s.replace("round(", "(").replace(", 6) AS", ") AS") for s in metric_sql(prefix, cond, original)]


R6 = ["train_r2", "train_rmse_log", "train_mae_log", "test_r2", "test_rmse_log", "test_mae_log",
      "test_rmse_original", "test_mae_original", "test_mape", "overfitting_r2", "overfitting_rmse"]


def metrics_cte(name, where, group):
    gsel = ", ".join(group)
    aggs = raw_metric_sql("train_", "is_train", False) + raw_metric_sql("test_", "NOT is_train")
    return (f", {name}_raw AS (SELECT {gsel + ', ' if gsel else ''}{', '.join(aggs)} FROM lg WHERE {where}"
            f"{' GROUP BY ' + gsel if gsel else ''}), "
            f"{name} AS (SELECT {gsel + ', ' if gsel else ''}train_n, test_n, "
            + ", ".join(f"round({c}, 6) AS {c}" for c in R6[:-2])
            + f", round(train_r2 - test_r2, 6) AS overfitting_r2, round(test_rmse_log - train_rmse_log, 6) AS overfitting_rmse"
            f" FROM {name}_raw)")


def _spark_metrics(lg, group, where=None):
    d = lg.where(where) if where is not None else lg
    m = EV.regression_metrics(d, "y", "yhat", F.col("is_train"), group)
    return m.select(*group, "train_n", "test_n", *[F.round(c, 6).alias(c) for c in R6])


@query("regression_metrics", PRED_CTE + metrics_cte("m", "scenario = 'm1_without_score' AND model = 'ols'", [])
       + " SELECT * FROM m")
def q_regression_metrics(spark, sf_dir):
    return _spark_metrics(one_prediction(predictions(spark, sf_dir), "m1_without_score", "ols"), [])


@query("model_mean_baseline", PRED_CTE + metrics_cte("m", "scenario = 'm1_without_score' AND model = 'mean_baseline'", [])
       + " SELECT * FROM m")
def q_model_mean_baseline(spark, sf_dir):
    return _spark_metrics(one_prediction(predictions(spark, sf_dir), "m1_without_score", "mean_baseline"), [])


@query("metrics_by_segment", PRED_CTE + metrics_cte("m", "true", ["scenario", "model", "neighborhood"])
       + " SELECT * FROM m")
def q_metrics_by_segment(spark, sf_dir):
    lg = long_predictions(predictions(spark, sf_dir))
    return _spark_metrics(lg, ["scenario", "model", "neighborhood"])


@query("metric_grade", PRED_CTE + metrics_cte("m", "true", ["scenario", "model", "neighborhood"]) + """
SELECT scenario, model, neighborhood, test_r2,
  CASE WHEN test_r2 >= 0.9 THEN 'excellent' WHEN test_r2 >= 0.8 THEN 'very_good' WHEN test_r2 >= 0.7 THEN 'good'
       WHEN test_r2 >= 0.6 THEN 'acceptable' ELSE 'insufficient' END AS r2_grade,
  CASE WHEN test_mape < 10 THEN 'excellent' WHEN test_mape < 15 THEN 'good' WHEN test_mape < 20 THEN 'acceptable'
       ELSE 'to_improve' END AS mape_grade,
  CASE WHEN overfitting_r2 < 0.05 THEN 'none' WHEN overfitting_r2 < 0.10 THEN 'slight' ELSE 'significant' END AS overfit_grade
FROM m""")
def q_metric_grade(spark, sf_dir):
    m = _spark_metrics(long_predictions(predictions(spark, sf_dir)), ["scenario", "model", "neighborhood"])
    return m.select("scenario", "model", "neighborhood", "test_r2", EV.grade_r2("test_r2").alias("r2_grade"),
                    EV.grade_mape("test_mape").alias("mape_grade"),
                    EV.grade_overfit("overfitting_r2").alias("overfit_grade"))


@query("model_ranking", PRED_CTE + metrics_cte("m", "true", ["scenario", "model"]) + """
SELECT scenario, model, test_r2, CAST(row_number() OVER (ORDER BY test_r2 DESC, scenario, model) AS INTEGER) AS rank FROM m""")
def q_model_ranking(spark, sf_dir):
    m = _spark_metrics(long_predictions(predictions(spark, sf_dir)), ["scenario", "model"])
    # A handful of (scenario, model) rows: the global window is over a tiny table.
    w = Window.orderBy(F.desc("test_r2"), "scenario", "model")
    return m.select("scenario", "model", "test_r2", F.row_number().over(w).alias("rank"))


@query("best_per_scenario", PRED_CTE + metrics_cte("m", "true", ["scenario", "model"]) + """
SELECT scenario, model, test_r2, round(1 - test_mape / 100, 6) AS one_minus_mape FROM
  (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY test_r2 DESC, model) AS rn FROM m) WHERE rn = 1""")
def q_best_per_scenario(spark, sf_dir):
    m = _spark_metrics(long_predictions(predictions(spark, sf_dir)), ["scenario", "model"])
    w = Window.partitionBy("scenario").orderBy(F.desc("test_r2"), "model")
    return (m.withColumn("rn", F.row_number().over(w)).where("rn = 1")
             .select("scenario", "model", "test_r2", F.round(1 - F.col("test_mape") / 100, 6).alias("one_minus_mape")))


def _cmp_sql():
    parts = []
    for k, d in EV.COMPARED_METRICS:
        v1, v2 = "a." + k, "b." + k
        better = f"{v2} > {v1}" if d == "higher" else f"{v2} < {v1}"
        imp = (f"CASE WHEN {v1} = 0 THEN 0.0 ELSE ({v2} - {v1}) / abs({v1}) * 100 END" if d == "higher"
               else f"CASE WHEN {v1} = 0 THEN 0.0 ELSE ({v1} - {v2}) / abs({v1}) * 100 END")
        parts.append(f"SELECT a.neighborhood, '{k}' AS metric, {v1} AS val1, {v2} AS val2, round({v2} - {v1}, 6) AS diff, "
                     f"round({imp}, 6) AS improvement_pct, CASE WHEN {better} THEN 'with_score' ELSE 'without_score' END AS winner "
                     f"FROM m a JOIN m b ON a.neighborhood = b.neighborhood AND a.model = b.model "
                     f"WHERE a.scenario = 'm1_without_score' AND b.scenario = 'm2_with_score' AND a.model = 'ols'")
    return " UNION ALL ".join(parts)


@query("model_compare", PRED_CTE + metrics_cte("m", "true", ["scenario", "model", "neighborhood"]) + _cmp_sql())
def q_model_compare(spark, sf_dir):
    m = _spark_metrics(long_predictions(predictions(spark, sf_dir)), ["scenario", "model", "neighborhood"])
    m = m.where(F.col("model") == "ols")
    m1 = m.where(F.col("scenario") == "m1_without_score")
    m2 = m.where(F.col("scenario") == "m2_with_score")
    out = EV.compare_models(m1, m2, ["neighborhood"], "without_score", "with_score")
    return out.select("neighborhood", "metric", "val1", "val2", F.round("diff", 6).alias("diff"),
                      F.round("improvement_pct", 6).alias("improvement_pct"), "winner")


@query("ablation_compare", PRED_CTE + metrics_cte("m", "true", ["scenario", "model"]) + """
SELECT a.model, a.test_r2 AS r2_without, b.test_r2 AS r2_with, round(b.test_r2 - a.test_r2, 6) AS gain,
       round(CASE WHEN a.test_r2 = 0 THEN 0.0 ELSE (b.test_r2 - a.test_r2) / abs(a.test_r2) * 100 END, 6) AS gain_pct,
       CASE WHEN b.test_r2 - a.test_r2 > 0.1 THEN 'major' WHEN b.test_r2 - a.test_r2 > 0.05 THEN 'moderate' ELSE 'minor' END AS gain_band
FROM m a JOIN m b ON a.model = b.model WHERE a.scenario = 'm1_without_score' AND b.scenario = 'm2_with_score'""")
def q_ablation_compare(spark, sf_dir):
    m = _spark_metrics(long_predictions(predictions(spark, sf_dir)), ["scenario", "model"])
    a = m.where(F.col("scenario") == "m1_without_score").select("model", F.col("test_r2").alias("r2_without"))
    b = m.where(F.col("scenario") == "m2_with_score").select("model", F.col("test_r2").alias("r2_with"))
    g = F.col("r2_with") - F.col("r2_without")
    return a.join(b, "model").select("model", "r2_without", "r2_with", F.round(g, 6).alias("gain"),
                                     F.round(F.when(F.col("r2_without") == 0, 0.0)
                                              .otherwise(g / F.abs("r2_without") * 100), 6).alias("gain_pct"),
                                     EV.grade_gain(g).alias("gain_band"))


@query("residual_stats", PRED_CTE + """
SELECT round(avg(y - p2), 6) AS mean, round(stddev_samp(y - p2), 6) AS std, round(min(y - p2), 6) AS min,
       round(max(y - p2), 6) AS max, round(median(y - p2), 6) AS median, round(quantile_cont(y - p2, 0.25), 6) AS q25,
       round(quantile_cont(y - p2, 0.75), 6) AS q75 FROM pr WHERE NOT is_train""")
def q_residual_stats(spark, sf_dir):
    p = predictions(spark, sf_dir).where(~F.col("is_train")).withColumn("resid", F.col("y") - F.col("p2"))
    return round_doubles(EV.residual_stats(p, "resid"), 6)


@query("normality_jb", PRED_CTE + """
, r AS (SELECT y - p2 AS e FROM pr WHERE NOT is_train), mm AS (SELECT avg(e) AS m, count(*) AS n FROM r),
s AS (SELECT max(n) AS n, avg(power(e - m, 3)) / power(avg(power(e - m, 2)), 1.5) AS skew,
             avg(power(e - m, 4)) / power(avg(power(e - m, 2)), 2) - 3 AS kurt FROM r, mm)
SELECT n, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(n / 6.0 * (skew * skew + kurt * kurt / 4.0), 6) AS jb,
       round(exp(-(n / 6.0 * (skew * skew + kurt * kurt / 4.0)) / 2.0), 6) AS p_value,
       exp(-(n / 6.0 * (skew * skew + kurt * kurt / 4.0)) / 2.0) > 0.05 AS is_normal FROM s""")
def q_normality_jb(spark, sf_dir):
    p = predictions(spark, sf_dir).where(~F.col("is_train")).withColumn("resid", F.col("y") - F.col("p2"))
    return round_doubles(EV.jarque_bera(p, "resid"), 6)


def _ks_cte():
    z = "((x - m) / sd)"
    return PRED_CTE + f"""
, r AS (SELECT y - p2 AS e FROM pr WHERE NOT is_train),
st AS (SELECT avg(e) AS m, stddev_samp(e) AS sd, count(e) AS n FROM r),
v AS (SELECT e AS x, count(*) AS cnt FROM r WHERE e IS NOT NULL GROUP BY 1),
c AS (SELECT x, cnt, sum(cnt) OVER (ORDER BY x) AS cum FROM v),
k AS (SELECT max(n) AS n, max(greatest(cum / CAST(n AS DOUBLE) - {norm_cdf(z)}, {norm_cdf(z)} - (cum - cnt) / CAST(n AS DOUBLE))) AS d FROM c, st)"""


@query("normality_ks", _ks_cte() + """
, p AS (SELECT n, d, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS lam FROM k),
q AS (SELECT n, d, CASE WHEN lam < 1e-3 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 200),
      lambda i: CASE WHEN i % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * i * i * lam * lam))))) END AS p_value FROM p)
SELECT n, round(d, 6) AS statistic, round(p_value, 6) AS p_value, p_value > 0.05 AS is_normal FROM q""")
def q_normality_ks(spark, sf_dir):
    p = predictions(spark, sf_dir).where(~F.col("is_train")).withColumn("resid", F.col("y") - F.col("p2"))
    r = EV.ks_normal(p, "resid")
    out = spark.createDataFrame([(r["n"], r["statistic"], r["p_value"], r["p_value"] > 0.05)], "n bigint, statistic double, p_value double, is_normal boolean")
    return round_doubles(out, 6)


@query("homoscedasticity", PRED_CTE + f"""
, r AS (SELECT corr(p2, (y - p2) * (y - p2)) AS r, count(*) AS n FROM pr WHERE NOT is_train),
t AS (SELECT r, n, r * sqrt((n - 2) / (1 - r * r)) AS t FROM r), p AS (SELECT *, {t_sf2('t', '(n - 2)')} AS p FROM t)
SELECT round(r, 6) AS r, n, round(t, 6) AS t_stat, round(p, 6) AS p_value, p > 0.05 AS is_homoscedastic FROM p""")
def q_homoscedasticity(spark, sf_dir):
    p = predictions(spark, sf_dir).where(~F.col("is_train")).withColumn("resid", F.col("y") - F.col("p2"))
    return round_doubles(EV.homoscedasticity(p, "p2", "resid"), 6)


Z95 = EV.z_value(0.95)


@query("prediction_interval", PRED_CTE + f"""
, s AS (SELECT stddev_samp(y - p2) AS sd FROM pr WHERE is_train)
SELECT round({Z95!r}, 6) AS z, round({Z95!r} * max(sd), 6) AS margin,
       round(avg(CAST(y >= p2 - {Z95!r} * sd AND y <= p2 + {Z95!r} * sd AS DOUBLE)), 6) AS coverage, count(*) AS n
FROM pr, s WHERE NOT is_train""")
def q_prediction_interval(spark, sf_dir):
    p = predictions(spark, sf_dir)
    sd = p.where("is_train").agg(F.stddev_samp(F.col("y") - F.col("p2"))).first()[0]
    return round_doubles(EV.prediction_interval(p.where(~F.col("is_train")), "y", "p2", sd), 6)


@query("error_by_quantile", PRED_CTE + """
, t AS (SELECT exp(y) - 1 AS y_true, exp(p2) - 1 AS y_pred FROM pr WHERE NOT is_train),
q AS (SELECT list_sort(list_distinct(quantile_cont(y_true, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS all_edges FROM t),
e AS (SELECT all_edges[2:len(all_edges) - 1] AS edges FROM q),
b AS (SELECT t.*, len(list_filter(edges, lambda q: q < y_true)) AS quantile FROM t, e WHERE y_true IS NOT NULL)
SELECT CAST(quantile AS INTEGER) AS quantile, round(min(y_true), 4) AS y_true_min, round(max(y_true), 4) AS y_true_max, count(y_true) AS y_true_count,
       round(avg(y_true - y_pred), 4) AS error_mean, round(avg(abs(y_true - y_pred)), 4) AS abs_error_mean,
       round(avg(abs((y_true - y_pred) / nullif(y_true, 0)) * 100), 4) AS pct_error_mean FROM b GROUP BY quantile""")
def q_error_by_quantile(spark, sf_dir):
    p = predictions(spark, sf_dir).where(~F.col("is_train"))
    t = p.select(F.expm1("y").alias("y_true"), F.expm1("p2").alias("y_pred"))
    return EV.error_by_quantile(t, "y_true", "y_pred")


@query("residual_band", PRED_CTE + """
, s AS (SELECT stddev_samp(y - p2) AS sd FROM pr WHERE NOT is_train)
SELECT asset_id, round(y - p2, 6) AS resid, abs(y - p2) > 2 * sd AS outside_band FROM pr, s WHERE NOT is_train""")
def q_residual_band(spark, sf_dir):
    from ..operators.outliers import residual_band
    p = predictions(spark, sf_dir).where(~F.col("is_train")).withColumn("resid", F.col("y") - F.col("p2"))
    out = residual_band(p, "resid")
    return out.select("asset_id", F.round("resid", 6).alias("resid"), "outside_band")


@query("predictions_table", PRED_CTE + """
SELECT asset_id, round(exp(y) - 1, 6) AS y_true, round(exp(p1) - 1, 6) AS pred_m1, round(exp(p2) - 1, 6) AS pred_m2,
       round((exp(y) - 1) - (exp(p1) - 1), 6) AS error_m1, round((exp(y) - 1) - (exp(p2) - 1), 6) AS error_m2,
       round(abs((exp(y) - 1) - (exp(p1) - 1)), 6) AS abs_error_m1, round(abs((exp(y) - 1) - (exp(p2) - 1)), 6) AS abs_error_m2
FROM pr WHERE NOT is_train""")
def q_predictions_table(spark, sf_dir):
    p = predictions(spark, sf_dir).where(~F.col("is_train"))
    yt, p1, p2 = F.expm1("y"), F.expm1("p1"), F.expm1("p2")
    return round_doubles(p.select("asset_id", yt.alias("y_true"), p1.alias("pred_m1"), p2.alias("pred_m2"),
                                  (yt - p1).alias("error_m1"), (yt - p2).alias("error_m2"),
                                  F.abs(yt - p1).alias("abs_error_m1"), F.abs(yt - p2).alias("abs_error_m2")), 6)


@query("optimized_metrics", PRED_CTE + ", m AS (SELECT " + ", ".join(
    metric_sql("train_", "is_train") + metric_sql("test_", "NOT is_train"))
    + " FROM lg WHERE scenario = 'm2_with_score' AND model = 'ols') SELECT * FROM m")
def q_optimized_metrics(spark, sf_dir):
    """Train and test metrics, both on the log and the original scale
    (train MAPE and RMSE included), for the with-score model."""
    d = one_prediction(predictions(spark, sf_dir), "m2_with_score", "ols")
    m = d.agg(*EV.metric_aggs("y", "yhat", "train_", F.col("is_train")),
              *EV.metric_aggs("y", "yhat", "test_", ~F.col("is_train")))
    return round_doubles(m, 6)



@query("ks_statistic", _ks_cte() + " SELECT n, round(d, 6) AS d FROM k")
def q_ks_statistic(spark, sf_dir):
    """KS distance of the test residuals from a fitted normal (statistic only;
    ``normality_ks`` adds the p-value)."""
    p = predictions(spark, sf_dir).where(~F.col("is_train")).withColumn("resid", F.col("y") - F.col("p2"))
    out = EV.ks_statistic(p.select("resid"), "resid")
    return out.select("n", F.round("d", 6).alias("d"))
