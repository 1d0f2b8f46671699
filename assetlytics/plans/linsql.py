"""DuckDB SQL of the linear fits, for the oracles of ``q_linear``: Gramians of
the folds, their complements, Gauss-Jordan elimination and coordinate descent
as recursive queries. Names of one design end in its tag."""

from __future__ import annotations

from ..sources.asset import ASSET_SQL
from .common import N_FOLDS, SQL_FOLD, SQL_TARGET_SIM, SQL_TRAIN

# Fixed levels of the two categories of the fixture.
LEVELS = {"property_type": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
          "building_type": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}
HEAD = f"WITH RECURSIVE asset AS ({ASSET_SQL}), base AS MATERIALIZED (SELECT *, ln(1 + {SQL_TARGET_SIM}) AS y, {SQL_FOLD} AS fold, {SQL_TRAIN} AS tr FROM asset)"
SWEEPS = 200


def width(num: list) -> int:
    return len(num) + sum(map(len, LEVELS.values()))


def design(tag: str, num: list) -> str:
    """z{tag}(asset_id, fold, tr, y, z): features scaled by the training rows,
    the target, 1. t{tag}(f, n, mean, a, b, s): moments of the training rows
    outside fold f (-1: of all)."""
    p = width(num)
    raw = [f"coalesce({c}, {c}_m)::DOUBLE" for c in num] + [f"coalesce(({c} = '{v}')::INT, 0)::DOUBLE" for c, vs in LEVELS.items() for v in vs]
    return f"""
, med{tag} AS (SELECT {', '.join(f'median({c}) AS {c}_m' for c in num)} FROM base WHERE tr),
raw{tag} AS MATERIALIZED (SELECT base.*, [{', '.join(raw)}] AS raw FROM base, med{tag}),
sc{tag} AS (SELECT list(mu ORDER BY i) AS mu, list(sd ORDER BY i) AS sd FROM (
  SELECT i, avg(raw[i]) AS mu, coalesce(nullif(stddev_pop(raw[i]), 0), 1) AS sd FROM raw{tag}, range(1, {p + 1}) r(i) WHERE tr GROUP BY i)),
z{tag} AS MATERIALIZED (SELECT asset_id, fold, tr, y,
  list_concat(list_transform(range(1, {p + 1}), lambda i: (raw[i] - mu[i]) / sd[i]), [y, 1.0]) AS z FROM raw{tag}, sc{tag}),
fm{tag} AS MATERIALIZED (SELECT fold, i, j, sum(z[i] * z[j]) AS s FROM z{tag}, range(1, {p + 3}) r(i), range(1, {p + 3}) c(j) WHERE tr GROUP BY ALL),
tm{tag} AS (SELECT f, i, j, sum(s) AS s FROM fm{tag}, range(-1, {N_FOLDS}) h(f) WHERE fold <> f GROUP BY ALL),
ce{tag} AS MATERIALIZED (SELECT g.f, g.i, g.j, u.s AS n, v.s / u.s AS mean, g.s - v.s * w.s / u.s AS c FROM tm{tag} g
  JOIN tm{tag} u ON u.f = g.f AND u.i = {p + 2} AND u.j = {p + 2} JOIN tm{tag} v ON v.f = g.f AND v.i = g.i AND v.j = {p + 2}
  JOIN tm{tag} w ON w.f = g.f AND w.i = g.j AND w.j = {p + 2}),
sd{tag} AS (SELECT f, i, CASE WHEN c / n > 1e-20 THEN sqrt(c / n) ELSE 1 END AS s FROM ce{tag} WHERE i = j),
t{tag} AS MATERIALIZED (SELECT x.f, max(x.n) AS n, list(x.mean ORDER BY x.i) FILTER (x.j = 1) AS mean,
  list(x.c / a.s / b.s ORDER BY x.i, x.j) FILTER (x.i <= {p} AND x.j <= {p}) AS a,
  list(x.c / a.s ORDER BY x.i) FILTER (x.i <= {p} AND x.j = {p + 1}) AS b, list(a.s ORDER BY x.i) FILTER (x.i <= {p} AND x.j = 1) AS s
  FROM ce{tag} x JOIN sd{tag} a ON a.f = x.f AND a.i = x.i JOIN sd{tag} b ON b.f = x.f AND b.i = x.j GROUP BY x.f)"""


def _done(tag: str, p: int, name: str, source: str) -> str:
    """name(f, id, coef, b0) over the scaled features, from ``source``(f, id, w)."""
    return f""", {name} AS MATERIALIZED (SELECT f, id, coef, mean[{p + 1}] - list_dot_product(coef, mean[1:{p}]) AS b0 FROM (
  SELECT x.f, x.id, list_transform(range(1, {p + 1}), lambda i: x.w[i] / t.s[i]) AS coef, t.mean FROM {source} x JOIN t{tag} t USING (f)))"""


def ridge(tag: str, num: list, alphas: dict, name: str) -> str:
    """Fits by elimination; pivots of a collinear column are skipped (its coefficient is 0)."""
    p = width(num)
    q, pivot = p + 1, f"m[k * {p + 1} + k + 1]"
    values = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in alphas.items())
    return f"""
, {name}_0 AS (SELECT f, id, list_transform(range({p * q}), lambda e: CASE WHEN e % {q} = {p} THEN b[e // {q} + 1]
      ELSE a[e // {q} * {p} + e % {q} + 1] + CASE WHEN e // {q} = e % {q} THEN alpha ELSE 0 END END) AS m FROM t{tag}, (VALUES {values}) v(id, alpha)),
{name}_1(f, id, k, m) AS (SELECT f, id, 0::BIGINT, m FROM {name}_0 UNION ALL SELECT f, id, k + 1, list_transform(range({p * q}), lambda e:
      CASE WHEN {pivot} < 1e-7 THEN m[e + 1] WHEN e // {q} = k THEN m[e + 1] / {pivot}
           ELSE m[e + 1] - m[e // {q} * {q} + k + 1] * m[k * {q} + e % {q} + 1] / {pivot} END) FROM {name}_1 WHERE k < {p}),
{name}_2 AS (SELECT f, id, list_transform(range({p}), lambda i: CASE WHEN m[i * {q} + i + 1] > 0.5 THEN m[i * {q} + {q}] ELSE 0 END) AS w
      FROM {name}_1 WHERE k = {p}){_done(tag, p, name, name + '_2')}"""


def lasso(tag: str, num: list, params: dict, name: str) -> str:
    """Fits by coordinate descent, a coordinate a step; params: id -> (l1, l2)."""
    p = width(num)
    values = ", ".join(f"('{k}', {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (a, b) in params.items())
    return f"""
, {name}_0 AS MATERIALIZED (SELECT f, id, l1, l2, list_transform(a, lambda x: x / n) AS a, list_transform(b, lambda x: x / n) AS b
      FROM t{tag}, (VALUES {values}) v(id, l1, l2)),
{name}_1(f, id, k, w) AS (SELECT f, id, 0::BIGINT, list_transform(range({p}), lambda i: 0.0::DOUBLE) FROM {name}_0
  UNION ALL SELECT f, id, k + 1, list_transform(range({p}), lambda i: CASE WHEN i <> k % {p} THEN w[i + 1]
      ELSE coalesce(sign(pull) * greatest(abs(pull) - l1, 0) / nullif(d + l2, 0), 0) END) FROM (
    SELECT f, id, k, w, l1, l2, a[(k % {p}) * {p} + k % {p} + 1] AS d,
           b[k % {p} + 1] - list_dot_product(a[(k % {p}) * {p} + 1 : (k % {p} + 1) * {p}], w) + a[(k % {p}) * {p} + k % {p} + 1] * w[k % {p} + 1] AS pull
    FROM {name}_1 JOIN {name}_0 USING (f, id) WHERE k < {p * SWEEPS})),
{name}_2 AS (SELECT f, id, w FROM {name}_1 WHERE k = {p * SWEEPS}){_done(tag, p, name, name + '_2')}"""


def scored(tag: str, num: list, fits: str, name: str) -> str:
    """name(asset_id, fold, tr, f, id, y, p): every row under every fit."""
    p = width(num)
    return f", {name} AS (SELECT asset_id, fold, tr, f, id, y, b0 + list_dot_product(coef, z[1:{p}]) AS p FROM z{tag}, {fits})"


def folds(rows: str, name: str) -> str:
    """name(id, f, r2, rmse, mae, train_r2) over the folds."""
    def r2(cond):
        return f"1 - sum((y - p) ** 2) FILTER ({cond}) / (var_pop(y) FILTER ({cond}) * count(*) FILTER ({cond}))"
    return f""", {name} AS (SELECT id, f, {r2('fold = f')} AS r2, sqrt(avg((y - p) ** 2) FILTER (fold = f)) AS rmse,
  avg(abs(y - p)) FILTER (fold = f) AS mae, {r2('fold <> f')} AS train_r2 FROM {rows} WHERE tr AND f >= 0 GROUP BY id, f)"""


def evaluated(rows: str, scenario: str, model: str) -> str:
    """One row of train and test metrics, on both scales."""
    def r2(cond):
        return f"1 - sum((y - p) ** 2) FILTER ({cond}) / (var_pop(y) FILTER ({cond}) * count(*) FILTER ({cond}))"
    o = "abs(exp(y) - exp(p))"
    return f"""SELECT '{scenario}' AS scenario, '{model}' AS model, train_r2, test_r2, train_rmse_log, test_rmse_log, train_mae_log, test_mae_log,
  test_rmse_original, test_mae_original, test_mape, train_r2 - test_r2 AS overfitting_r2, test_rmse_log - train_rmse_log AS overfitting_rmse FROM (
  SELECT {r2('tr')} AS train_r2, {r2('NOT tr')} AS test_r2, sqrt(avg((y - p) ** 2) FILTER (tr)) AS train_rmse_log,
    sqrt(avg((y - p) ** 2) FILTER (NOT tr)) AS test_rmse_log, avg(abs(y - p)) FILTER (tr) AS train_mae_log, avg(abs(y - p)) FILTER (NOT tr) AS test_mae_log,
    sqrt(avg({o} * {o}) FILTER (NOT tr)) AS test_rmse_original, avg({o}) FILTER (NOT tr) AS test_mae_original,
    100 * avg({o} / greatest(abs(exp(y) - 1), 2.220446049250313e-16)) FILTER (NOT tr) AS test_mape FROM {rows} WHERE f = -1)"""


def rounded(body: str, cols: list, digits: int = 6) -> str:
    return f"SELECT {', '.join(f'round({c}, {digits}) AS {c}' if n else c for c, n in cols)} FROM ({body})"
