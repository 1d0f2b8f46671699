"""Registered linear-model queries (SURVEY §2.11 L1-L3, L7, L10, L11, L15, L17,
N2, A7): fits from moments, with oracles that solve the same systems in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import linear as LN
from ..operators import models as MD
from ..operators import scoring as S
from . import linsql as Q
from .common import N_FOLDS, asset, fold_of, is_train, target_sim
from .registry import query

NUM_M1 = ["gfa_total", "n_floors", "year_built", "acctbal"]
NUM_M2 = NUM_M1 + ["energy_score"]
CAT = ["property_type", "building_type"]
FOLDS = list(range(N_FOLDS))
SCENARIOS = (("m1_without_score", NUM_M1), ("m2_with_score", NUM_M2))
EVAL_COLS = ["train_r2", "test_r2", "train_rmse_log", "test_rmse_log", "train_mae_log", "test_mae_log",
             "test_rmse_original", "test_mae_original", "test_mape", "overfitting_r2", "overfitting_rmse"]
TEXT = ("scenario", "model", "params")


def frames(spark, sf_dir):
    a = asset(spark, sf_dir).withColumns({"y": F.log1p(target_sim()), "fold": fold_of()})
    return a.where(is_train()), a.where(~is_train())


def to_rows(spark, rows, cols):
    schema = ", ".join(f"{c} {'string' if c in TEXT else 'double'}" for c in cols)
    return round_doubles(spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schema), 6)


def _columns(cols):
    return [(c, c not in TEXT) for c in cols]


# ------------------------------------------------------- one fit, two scenarios
def _eval_sql(kind: str, params, label: str) -> str:
    ctes, rows = "", []
    for tag, (scenario, num) in zip("ab", SCENARIOS):
        fit = Q.ridge(tag, num, {"m": params}, f"fit{tag}") if kind == "ridge" else Q.lasso(tag, num, {"m": params}, f"fit{tag}")
        ctes += Q.design(tag, num) + fit + Q.scored(tag, num, f"fit{tag}", f"p{tag}")
        rows.append(Q.evaluated(f"p{tag}", scenario, label))
    cols = _columns(["scenario", "model", *EVAL_COLS])
    return Q.HEAD + ctes + " " + "\nUNION ALL ".join(Q.rounded(r, cols) for r in rows)


def _evaluated(spark, sf_dir, kind: str, params: dict, label: str):
    train, test = frames(spark, sf_dir)
    rows = []
    for scenario, num in SCENARIOS:
        d = LN.design(train, num, CAT, F.col("y"))
        p = LN.fit(train, d, kind, params).expression(d)
        r = MD.evaluation(*[f.select(F.col("y").alias("label"), p.alias("prediction")) for f in (train, test)], label)
        rows.append({**r, "scenario": scenario})
    return to_rows(spark, rows, ["scenario", "model", *EVAL_COLS])


@query("model_ridge", _eval_sql("ridge", 1.0, "Ridge"), raw_sql=True)
def q_model_ridge(spark, sf_dir):
    return _evaluated(spark, sf_dir, "ridge", {"alpha": 1.0}, "Ridge")


@query("model_lasso", _eval_sql("lasso", (1.0, 0.0), "Lasso"), raw_sql=True)
def q_model_lasso(spark, sf_dir):
    return _evaluated(spark, sf_dir, "lasso", {"alpha": 1.0}, "Lasso")


@query("model_elasticnet", _eval_sql("enet", (0.005, 0.005), "ElasticNet"), raw_sql=True)
def q_model_elasticnet(spark, sf_dir):
    return _evaluated(spark, sf_dir, "enet", {"alpha": 0.01, "l1_ratio": 0.5}, "ElasticNet")


# ------------------------------------------------------------ cross-validation
CV_COLS = ["model", "cv_r2_mean", "cv_r2_std", "cv_rmse_mean", "cv_rmse_std", "cv_mae_mean", "cv_mae_std", "cv_train_r2_mean"]
CV_MODELS = {"OLS": ("ols", {}), "Ridge": ("ridge", {"alpha": 1.0}), "Lasso": ("lasso", {"alpha": 0.01}),
             "ElasticNet": ("enet", {"alpha": 0.01, "l1_ratio": 0.5})}
CV_SQL = (Q.HEAD + Q.design("a", NUM_M2) + Q.ridge("a", NUM_M2, {"OLS": 0.0, "Ridge": 1.0}, "rid")
          + Q.lasso("a", NUM_M2, {"Lasso": (0.01, 0.0), "ElasticNet": (0.005, 0.005)}, "las")
          + ", fits AS (SELECT * FROM rid UNION ALL SELECT * FROM las)" + Q.scored("a", NUM_M2, "fits", "p") + Q.folds("p", "s")
          + Q.rounded("""SELECT id AS model, avg(r2) AS cv_r2_mean, stddev_pop(r2) AS cv_r2_std, avg(rmse) AS cv_rmse_mean, stddev_pop(rmse) AS cv_rmse_std,
  avg(mae) AS cv_mae_mean, stddev_pop(mae) AS cv_mae_std, avg(train_r2) AS cv_train_r2_mean FROM s GROUP BY id""", _columns(CV_COLS)))


@query("cv_metrics", CV_SQL, raw_sql=True)
def q_cv_metrics(spark, sf_dir):
    """Five folds of four linear families from one scan of moments and one of errors."""
    train, _ = frames(spark, sf_dir)
    d = LN.design(train, NUM_M2, CAT, F.col("y"))
    rows = LN.cross_validate(train, d, list(CV_MODELS.values()), FOLDS)
    return to_rows(spark, [{**r, "model": name} for name, r in zip(CV_MODELS, rows)], CV_COLS)


def _history_sql(spaces: dict) -> str:
    ctes, parts = "", []
    for kind, alphas in spaces.items():
        ids = {repr(a): (a if kind == "ridge" else (a, 0.0)) for a in alphas}
        ctes += (Q.ridge if kind == "ridge" else Q.lasso)("a", NUM_M2, ids, kind)
        parts.append(f"SELECT '{kind}' AS model, * FROM {kind}")
    fits = f", fits AS (SELECT f, model || ':' || id AS id, coef, b0 FROM ({' UNION ALL '.join(parts)}))"
    return Q.HEAD + Q.design("a", NUM_M2) + ctes + fits + Q.scored("a", NUM_M2, "fits", "p") + Q.folds("p", "s")


def _history(spark, sf_dir, spaces: dict):
    train, _ = frames(spark, sf_dir)
    d = LN.design(train, NUM_M2, CAT, F.col("y"))
    models = [(kind, {"alpha": float(a)}) for kind, alphas in spaces.items() for a in alphas]
    rows = LN.cross_validate(train, d, models, FOLDS, mae=False)
    return [{"model": r["kind"], "params": f"alpha={r['params']['alpha']!r}", "mean_r2": r["cv_r2_mean"], "std_r2": r["cv_r2_std"]} for r in rows]


GRIDS = {k: [float(a) for a in MD.SEARCH_SPACES[f"{k}_grid"]["alpha"]] for k in ("ridge", "lasso")}


@query("grid_search", _history_sql(GRIDS) + """ SELECT split_part(id, ':', 1) AS model, 'alpha=' || split_part(id, ':', 2) AS params,
  round(avg(r2), 6) AS mean_r2, round(stddev_pop(r2), 6) AS std_r2 FROM s GROUP BY id""", raw_sql=True)
def q_grid_search(spark, sf_dir):
    """The ridge and lasso grids, whole: every alpha from the same moments."""
    return to_rows(spark, _history(spark, sf_dir, GRIDS), ["model", "params", "mean_r2", "std_r2"])


WIDE = {"ridge": [float(a) for a in MD.PARAM_GRIDS["Ridge"]["alpha"]]}


@query("search_history", _history_sql(WIDE) + """ SELECT split_part(id, ':', 1) AS model, 'alpha=' || split_part(id, ':', 2) AS params,
  round(avg(r2), 6) AS mean_r2, round(stddev_pop(r2), 6) AS std_r2, row_number() OVER (ORDER BY avg(r2) DESC) AS rank FROM s GROUP BY id""", raw_sql=True)
def q_search_history(spark, sf_dir):
    """The whole ridge grid, ranked by mean score."""
    rows = sorted(_history(spark, sf_dir, WIDE), key=lambda r: -r["mean_r2"])
    schema = "model string, params string, mean_r2 double, std_r2 double, rank bigint"
    return round_doubles(spark.createDataFrame([(*r.values(), i + 1) for i, r in enumerate(rows)], schema), 6)


# -------------------------------------------------------------- learning curve
BUCKET_SQL = "(asset_id * 7919) % 1000 // 100"


def _curve_sql(num: list) -> str:
    """Each fraction's training rows as a design of their own is long; the fits
    are least squares, so any scaling gives the same predictions."""
    p = Q.width(num)
    q = p + 1
    pivot = f"m[k * {q} + k + 1]"
    return Q.HEAD + Q.design("a", num) + f"""
, zb AS MATERIALIZED (SELECT *, {BUCKET_SQL} AS bucket FROM za WHERE tr),
bm AS MATERIALIZED (SELECT fold, bucket, i, j, sum(z[i] * z[j]) AS s FROM zb, range(1, {p + 3}) r(i), range(1, {p + 3}) c(j) GROUP BY ALL),
um AS MATERIALIZED (SELECT f, fr, i, j, sum(s) AS s FROM bm, range({N_FOLDS}) h(f), range(1, 11) g(fr) WHERE fold <> f AND bucket < fr GROUP BY ALL),
uc AS (SELECT x.f, x.fr, x.i, x.j, v.s / u.s AS mean, x.s - v.s * w.s / u.s AS c FROM um x
  JOIN um u ON u.f = x.f AND u.fr = x.fr AND u.i = {p + 2} AND u.j = {p + 2} JOIN um v ON v.f = x.f AND v.fr = x.fr AND v.i = x.i AND v.j = {p + 2}
  JOIN um w ON w.f = x.f AND w.fr = x.fr AND w.i = x.j AND w.j = {p + 2}),
e0 AS (SELECT f, fr, list(c ORDER BY i, j) FILTER (i <= {p} AND j <= {q}) AS m, list(mean ORDER BY i) FILTER (j = 1) AS mean FROM uc GROUP BY ALL),
e1(f, fr, k, m) AS (SELECT f, fr, 0::BIGINT, m FROM e0 UNION ALL SELECT f, fr, k + 1, list_transform(range({p * q}), lambda e:
      CASE WHEN {pivot} < 1e-7 THEN m[e + 1] WHEN e // {q} = k THEN m[e + 1] / {pivot}
           ELSE m[e + 1] - m[e // {q} * {q} + k + 1] * m[k * {q} + e % {q} + 1] / {pivot} END) FROM e1 WHERE k < {p}),
fits AS MATERIALIZED (SELECT f, fr, coef, mean[{p + 1}] - list_dot_product(coef, mean[1:{p}]) AS b0 FROM (
  SELECT f, fr, list_transform(range({p}), lambda i: CASE WHEN e1.m[i * {q} + i + 1] > 0.5 THEN e1.m[i * {q} + {q}] ELSE 0 END) AS coef, mean
  FROM e1 JOIN e0 USING (f, fr) WHERE k = {p})),
s AS (SELECT fr, f, y, fold, bucket, b0 + list_dot_product(coef, z[1:{p}]) AS p FROM zb, fits),
r AS (SELECT fr, f, 1 - sum((y - p) ** 2) FILTER (fold = f) / (var_pop(y) FILTER (fold = f) * count(*) FILTER (fold = f)) AS r2,
  1 - sum((y - p) ** 2) FILTER (fold <> f AND bucket < fr) / (var_pop(y) FILTER (fold <> f AND bucket < fr) * count(*) FILTER (fold <> f AND bucket < fr)) AS train_r2
  FROM s GROUP BY ALL)
SELECT fr / 10.0::DOUBLE AS fraction, (SELECT count(*) FROM zb WHERE bucket < fr) AS n, round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std,
  round(avg(train_r2), 6) AS train_r2_mean FROM r GROUP BY fr"""


@query("learning_curve", _curve_sql(NUM_M2), raw_sql=True)
def q_learning_curve(spark, sf_dir):
    """Ten fractions by five folds from one scan."""
    train, _ = frames(spark, sf_dir)
    d = LN.design(train, NUM_M2, CAT, F.col("y"))
    bucket = F.floor((F.col("asset_id") * 7919) % 1000 / 100)
    rows = LN.learning_curve(train, d, "ols", {}, FOLDS, bucket)
    out = spark.createDataFrame([tuple(r.values()) for r in rows], "fraction double, n bigint, r2_mean double, r2_std double, train_r2_mean double")
    return round_doubles(out, 6)


# --------------------------------------------------------------------- scoring
SCORE_SQL = (Q.HEAD + Q.design("a", NUM_M2) + Q.ridge("a", NUM_M2, {"m": 1.0}, "fit") + Q.scored("a", NUM_M2, "fit", "p")
             + " SELECT asset_id, round(greatest(exp(p) - 1, 0.1), 1) AS prediction, false AS used_fallback FROM p WHERE f = -1 AND NOT tr")


@query("score_model", SCORE_SQL, raw_sql=True)
def q_score_model(spark, sf_dir):
    """Model score of every test building: predict the logarithm, expm1, floor
    0.1, one decimal; buildings that the model cannot score get the heuristic."""
    train, test = frames(spark, sf_dir)
    d = LN.design(train, NUM_M2, CAT, F.col("y"))
    p = LN.fit(train, d, "ridge", {"alpha": 1.0}).expression(d)
    pred = S.with_benchmark(test.withColumn("building_type_ref", S.map_segment("property_type")).withColumn("p", p), "building_type_ref")
    model_score = F.round(F.greatest(F.expm1("p"), F.lit(0.1)), 1)
    fallback = S.heuristic_score("gfa_total", "benchmark", "energy_score")
    return pred.select("asset_id", F.coalesce(model_score, fallback).alias("prediction"), F.col("p").isNull().alias("used_fallback"))
