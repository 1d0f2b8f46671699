"""Registered missing-value and outlier queries.

Fits run on the training partition only; transforms apply to the test rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import missing as M
from ..operators import nearest as N
from ..operators import outliers as O
from ..operators import profile as P
from ..sources.asset import ASSET_SQL, NUMERIC_COLUMNS
from .common import SQL_TEST, SQL_TRAIN, asset, is_train
from .registry import query
from .sqlfrag import chi2_sf, t_sf2

FIT_COLS = ["neighborhood_raw", "neighborhood", "city", "property_type", "building_type", "state",
            "latitude", "longitude", "year_built", "n_floors", "gfa_total", "gfa_parking",
            "electricity_kwh", "gas_therms", "steam_kbtu", "energy_score", "acctbal",
            "second_use", "mostly_null", "emissions"]
NUM = set(NUMERIC_COLUMNS)


def _train(spark, sf_dir):
    return asset(spark, sf_dir).where(is_train())


def _test(spark, sf_dir):
    return asset(spark, sf_dir).where(~is_train())


def _stats_cte(cols, medians=False):
    parts = []
    for c in cols:
        num = c in NUM
        mu = f"avg({c})" if num else "CAST(NULL AS DOUBLE)"
        md = f"median({c})" if num else "CAST(NULL AS DOUBLE)"
        mode = ("CAST(NULL AS VARCHAR)" if num else
                f"(SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")
        parts.append(f"SELECT '{c}' AS col, sum(CAST({c} IS NULL AS BIGINT)) * 1.0 / count(*) AS nf, "
                     f"count(DISTINCT {c}) AS nd, {mu} AS mu, {md} AS md, {mode} AS mode, {str(num).upper()} AS num FROM t")
    return f", t AS (SELECT * FROM asset WHERE {SQL_TRAIN}), s AS (" + "\nUNION ALL ".join(parts) + ")"


MISSING_FIT_SQL = _stats_cte(FIT_COLS) + """
, d AS (SELECT col, CASE WHEN nf > 0.7 THEN 'drop_missing' WHEN nd <= 1 THEN 'drop_unique'
          WHEN nf > 0 AND nf < 0.1 THEN (CASE WHEN num THEN 'impute_mean' ELSE 'impute_mode' END) END AS action,
          mu, mode FROM s)
SELECT col AS "column", action, round(CASE WHEN action = 'impute_mean' THEN mu END, 6) AS fill_num,
       CASE WHEN action = 'impute_mode' THEN mode END AS fill_str FROM d WHERE action IS NOT NULL"""


@query("missing_fit", MISSING_FIT_SQL)
def q_missing_fit(spark, sf_dir):
    p = M.fit_missing_simple(_train(spark, sf_dir), FIT_COLS)
    return round_doubles(p.to_frame(spark), 6)


def _transform_sql(kept_fill: dict, drop: list, extra_ctes: str = "") -> str:
    sel = ["asset_id"]
    for c in FIT_COLS:
        if c in drop:
            continue
        if c in kept_fill:
            e = f"coalesce({c}, {kept_fill[c]})"
            if c in NUM:
                e = f"round(CAST({e} AS DOUBLE), 6)" if c not in ("year_built", "n_floors") else e
            sel.append(f"{e} AS {c}")
        else:
            sel.append(f"round({c}, 6) AS {c}" if c in NUM and c not in ("year_built", "n_floors") else c)
    return extra_ctes + f" SELECT {', '.join(sel)} FROM asset WHERE {SQL_TEST}"


@query("missing_transform", _transform_sql(
    {"gas_therms": f"(SELECT avg(gas_therms) FROM asset WHERE {SQL_TRAIN})",
     "acctbal": f"(SELECT avg(acctbal) FROM asset WHERE {SQL_TRAIN})"},
    ["state", "mostly_null"]))
def q_missing_transform(spark, sf_dir):
    p = M.fit_missing_simple(_train(spark, sf_dir), FIT_COLS)
    out = M.transform_missing(_test(spark, sf_dir).select("asset_id", *FIT_COLS), p)
    return round_doubles(out, 6)


MISSING_ADV_SQL = _stats_cte(FIT_COLS) + """
, d AS (SELECT col, CASE WHEN nd <= 1 THEN 'drop_unique' WHEN nf > 0.7 THEN 'drop_missing'
          WHEN nf > 0.1 THEN (CASE WHEN num THEN 'impute_median' ELSE 'impute_mode' END)
          WHEN nf > 0 THEN (CASE WHEN num THEN 'impute_mean' ELSE 'impute_mode' END) END AS action,
          CASE WHEN nf > 0.1 THEN md ELSE mu END AS v, mode FROM s)
SELECT col AS "column", action, round(CASE WHEN action IN ('impute_mean', 'impute_median') THEN v END, 6) AS fill_num,
       CASE WHEN action = 'impute_mode' THEN mode END AS fill_str FROM d WHERE action IS NOT NULL"""


@query("missing_fit_adv", MISSING_ADV_SQL)
def q_missing_fit_adv(spark, sf_dir):
    p = M.fit_missing_advanced(_train(spark, sf_dir), FIT_COLS)
    return round_doubles(p.to_frame(spark), 6)


_T = f"(SELECT * FROM asset WHERE {SQL_TRAIN})"


@query("missing_transform_adv", _transform_sql(
    {"gas_therms": f"(SELECT avg(gas_therms) FROM {_T})",
     "acctbal": f"(SELECT avg(acctbal) FROM {_T})",
     "energy_score": f"(SELECT median(energy_score) FROM {_T})",
     "second_use": f"(SELECT second_use FROM {_T} WHERE second_use IS NOT NULL GROUP BY 1 "
                   f"ORDER BY count(*) DESC, 1 LIMIT 1)"},
    ["state", "mostly_null"]))
def q_missing_transform_adv(spark, sf_dir):
    p = M.fit_missing_advanced(_train(spark, sf_dir), FIT_COLS)
    out = M.transform_missing(_test(spark, sf_dir).select("asset_id", *FIT_COLS), p)
    return round_doubles(out, 6)


def _little_sql(cols):
    pat = " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in cols)
    o = ", ".join(f"avg({c}) AS o{i}, var_samp({c}) AS v{i}" for i, c in enumerate(cols))
    g = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(cols))
    term = " + ".join(f"(CASE WHEN m{i} IS NOT NULL AND v{i} > 0 THEN n * (m{i} - o{i}) * (m{i} - o{i}) / v{i} ELSE 0 END)"
                      for i, _ in enumerate(cols))
    return (f", t AS (SELECT * FROM asset WHERE {SQL_TRAIN}), o AS (SELECT {o} FROM t), "
            f"g AS (SELECT {pat} AS pattern, count(*) AS n, {g} FROM t GROUP BY 1) "
            f"SELECT CASE WHEN count(*) <= 1 THEN 0.0 ELSE round(sum(CASE WHEN n > 1 THEN {term} ELSE 0 END), 4) END AS statistic, "
            f"CAST(greatest(1, (count(*) - 1) * {len(cols)}) AS BIGINT) AS dof, count(*) AS n_patterns FROM g, o")


@query("little_mcar", _little_sql(NUMERIC_COLUMNS))
def q_little_mcar(spark, sf_dir):
    out = M.little_mcar_stats(_train(spark, sf_dir), NUMERIC_COLUMNS)
    return out.select(F.round("statistic", 4).alias("statistic"), "dof", "n_patterns")


TT_PRED = ["gfa_total", "n_floors", "year_built", "acctbal", "emissions"]


@query("mar_ttest", "\nUNION ALL ".join(f"""
SELECT '{p}' AS predictor, n1 AS n_missing, n2 AS n_observed,
       round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t_stat,
       CAST(n1 + n2 - 2 AS BIGINT) AS dof
FROM (SELECT count(CASE WHEN energy_score IS NULL THEN {p} END) AS n1, avg(CASE WHEN energy_score IS NULL THEN {p} END) AS m1,
             var_samp(CASE WHEN energy_score IS NULL THEN {p} END) AS v1,
             count(CASE WHEN energy_score IS NOT NULL THEN {p} END) AS n2, avg(CASE WHEN energy_score IS NOT NULL THEN {p} END) AS m2,
             var_samp(CASE WHEN energy_score IS NOT NULL THEN {p} END) AS v2
      FROM asset WHERE {SQL_TRAIN})""" for p in TT_PRED))
def q_mar_ttest(spark, sf_dir):
    out = M.mar_ttest_stats(_train(spark, sf_dir), "energy_score", TT_PRED)
    return out.withColumn("t_stat", F.round("t_stat", 6))


CHI_CATS = ["property_type", "building_type", "second_use"]


@query("mar_chi2", "\nUNION ALL ".join(f"""
SELECT '{c}' AS predictor, round(sum(
         (o0 - (o0 + o1) * c0 / (c0 + c1)) * (o0 - (o0 + o1) * c0 / (c0 + c1)) / ((o0 + o1) * c0 / (c0 + c1))
       + (o1 - (o0 + o1) * c1 / (c0 + c1)) * (o1 - (o0 + o1) * c1 / (c0 + c1)) / ((o0 + o1) * c1 / (c0 + c1))), 6) AS statistic,
       CAST(max(nr) - 1 AS BIGINT) AS dof
FROM (SELECT {c}, sum(CAST(energy_score IS NULL AS BIGINT)) AS o1, sum(CAST(energy_score IS NOT NULL AS BIGINT)) AS o0
      FROM asset WHERE {SQL_TRAIN} AND {c} IS NOT NULL GROUP BY {c}) ct,
     (SELECT sum(o0) AS c0, sum(o1) AS c1, count(*) AS nr FROM
        (SELECT {c}, sum(CAST(energy_score IS NULL AS BIGINT)) AS o1, sum(CAST(energy_score IS NOT NULL AS BIGINT)) AS o0
         FROM asset WHERE {SQL_TRAIN} AND {c} IS NOT NULL GROUP BY {c})) m""" for c in CHI_CATS))
def q_mar_chi2(spark, sf_dir):
    tr = _train(spark, sf_dir)
    parts = [M.mar_chi2_stats(tr, "energy_score", c).select(
        F.lit(c).alias("predictor"), F.round("statistic", 6).alias("statistic"), "dof") for c in CHI_CATS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


MECH_COLS = ["gas_therms", "energy_score", "acctbal", "second_use"]


def _mechanism_sql(cols: list, cats: list) -> str:
    """Little's statistic over all numbers, then a t or chi-square test of each
    other column against the nulls of one."""
    n = len(NUMERIC_COLUMNS)
    pattern = " || ".join(f"({c} IS NULL)::INT" for c in NUMERIC_COLUMNS)
    term = " + ".join(f"CASE WHEN m{i} IS NOT NULL AND v{i} > 0 THEN n * (m{i} - o{i}) * (m{i} - o{i}) / v{i} ELSE 0 END" for i in range(n))
    head = f""", t AS MATERIALIZED (SELECT * FROM asset WHERE {SQL_TRAIN}),
g AS (SELECT {pattern} AS pat, count(*) AS n, {', '.join(f'avg({c}) AS m{i}' for i, c in enumerate(NUMERIC_COLUMNS))} FROM t GROUP BY 1),
o AS (SELECT {', '.join(f'avg({c}) AS o{i}, var_samp({c}) AS v{i}' for i, c in enumerate(NUMERIC_COLUMNS))} FROM t),
l0 AS (SELECT CASE WHEN count(*) <= 1 THEN 0.0 ELSE sum(CASE WHEN n > 1 THEN {term} ELSE 0 END) END AS stat,
       greatest(1, (count(*) - 1) * {n})::BIGINT AS dof FROM g, o),
l AS MATERIALIZED (SELECT stat, dof, {chi2_sf('stat', 'dof')} AS p FROM l0)"""
    tests = []
    for c in cols:
        for j, x in enumerate(NUMERIC_COLUMNS):
            if x != c:
                miss, seen = f"CASE WHEN {c} IS NULL THEN {x} END", f"CASE WHEN {c} IS NOT NULL THEN {x} END"
                tests.append(f"SELECT '{c}' AS col, {j} AS j, '{x}' AS x, t_p FROM (SELECT CASE WHEN n1 > 0 AND n2 > 0 AND sp > 0 THEN {t_sf2('((m1 - m2) / sqrt(sp * (1.0 / n1 + 1.0 / n2)))', '(n1 + n2 - 2)')} END AS t_p "
                             f"FROM (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS sp FROM (SELECT count({miss}) AS n1, avg({miss}) AS m1, var_samp({miss}) AS v1, "
                             f"count({seen}) AS n2, avg({seen}) AS m2, var_samp({seen}) AS v2 FROM t)))")
        for j, x in enumerate(cats, n):
            tests.append(f"SELECT '{c}', {j}, '{x}', {chi2_sf('stat', 'dof')} FROM (SELECT sum((o0 - e0) ** 2 / e0 + (o1 - e1) ** 2 / e1) AS stat, count(*) - 1 AS dof FROM ("
                         f"SELECT o0, o1, (o0 + o1) * (sum(o0) OVER ()) / (sum(o0 + o1) OVER ()) AS e0, (o0 + o1) * (sum(o1) OVER ()) / (sum(o0 + o1) OVER ()) AS e1 FROM ("
                         f"SELECT {x}, sum(({c} IS NULL)::INT)::DOUBLE AS o1, sum(({c} IS NOT NULL)::INT)::DOUBLE AS o0 FROM t WHERE {x} IS NOT NULL GROUP BY {x})))")
    return head + ", k AS (" + "\nUNION ALL ".join(tests) + f""")
SELECT c AS "column", CASE WHEN p > 0.05 THEN 'MCAR' WHEN list IS NOT NULL THEN 'MAR' ELSE 'MNAR' END AS mechanism, round(stat, 4) AS little_stat, dof AS little_dof,
  round(p, 6) AS little_p, CASE WHEN p > 0.05 THEN '' ELSE coalesce(list, '') END AS significant
FROM l, (SELECT unnest([{', '.join(repr(c) for c in cols)}]) AS c) LEFT JOIN (SELECT col, string_agg(x, ',' ORDER BY j) AS list FROM k WHERE t_p < 0.05 GROUP BY col) ON col = c"""


@query("missing_mechanism", _mechanism_sql(MECH_COLS, ["property_type", "building_type"]))
def q_missing_mechanism(spark, sf_dir):
    """Diagnosis with the Little test over all numeric columns (MAR/MNAR reachable)."""
    from concurrent.futures import ThreadPoolExecutor
    tr = _train(spark, sf_dir)

    def one(c):  # per-column diagnoses are independent jobs: run them concurrently
        num = [x for x in NUMERIC_COLUMNS if x != c]
        d = M.diagnose(tr, c, num, ["property_type", "building_type"], mcar_cols=NUMERIC_COLUMNS)
        return (c, d["mechanism"], round(float(d["little_stat"]), 4), int(d["little_dof"]),
                round(float(d["little_p"]), 6), ",".join(d["significant"]))
    with ThreadPoolExecutor(max_workers=len(MECH_COLS)) as ex:
        rows = list(ex.map(one, MECH_COLS))
    return spark.createDataFrame(rows, "column string, mechanism string, little_stat double, "
                                       "little_dof bigint, little_p double, significant string")


def _alone_sql(c: str) -> str:
    """Little's test on one column: patterns 0 and 1, of which only the first has a mean."""
    stat = (f"(SELECT coalesce(sum(CASE WHEN n > 1 AND m IS NOT NULL AND v > 0 THEN n * (m - o) * (m - o) / v ELSE 0 END), 0) FROM "
            f"(SELECT ({c} IS NULL) AS pat, count(*) AS n, avg({c}) AS m FROM t GROUP BY 1), (SELECT avg({c}) AS o, var_samp({c}) AS v FROM t))")
    dof = f"(SELECT greatest(1, count(DISTINCT {c} IS NULL) - 1) FROM t)"
    if c not in NUM:  # no number to test
        stat, dof = "0.0::DOUBLE", "1"
    return f"SELECT '{c}' AS c, (SELECT sum(({c} IS NULL)::BIGINT) * 100.0 / count(*) FROM t) AS null_pct, {stat} AS stat, {dof} AS dof"


@query("mechanism_summary", f", t AS MATERIALIZED (SELECT * FROM asset WHERE {SQL_TRAIN}), s AS (" + "\nUNION ALL ".join(map(_alone_sql, MECH_COLS)) + f"""),
p AS (SELECT *, {chi2_sf('stat', 'dof')} AS p FROM s)
SELECT c AS "column", round(null_pct, 4) AS null_pct, round(stat, 6) AS statistic, round(p, 6) AS p_value,
       CASE WHEN p > 0.05 THEN 'MCAR' ELSE 'MAR or MNAR' END AS mechanism FROM p""")
def q_mechanism_summary(spark, sf_dir):
    """Null % and Little's test on each column alone. A single column has one
    pattern of observed values, whose mean is the mean of all, so statistic 0
    and p 1 follow, for a categorical column too (it has no numbers to test)."""
    tr = _train(spark, sf_dir)
    prof = {r["column"]: r["null_pct"] for r in P.null_profile(tr, MECH_COLS).collect()}
    rows = []
    for c in MECH_COLS:
        t = M.little_mcar_test(tr, [c]) if c in NUM else {"statistic": 0.0, "p_value": 1.0, "is_mcar": True}
        rows.append((c, float(prof[c]), round(float(t["statistic"]), 6) + 0.0, round(float(t["p_value"]), 6),
                     "MCAR" if t["is_mcar"] else "MAR or MNAR"))
    return spark.createDataFrame(rows, "column string, null_pct double, statistic double, p_value double, mechanism string")


@query("impute_median", f"""
SELECT asset_id, CASE WHEN {SQL_TRAIN} THEN 'train' ELSE 'test' END AS split,
       coalesce(energy_score, (SELECT median(energy_score) FROM asset WHERE {SQL_TRAIN})) AS energy_score
FROM asset""")
def q_impute_median(spark, sf_dir):
    a = asset(spark, sf_dir)
    filled = M.impute_median(a.where(is_train()), a, ["energy_score"])
    return filled.select("asset_id", F.when(is_train(), "train").otherwise("test").alias("split"),
                         "energy_score")


@query("impute_regression", f"""
, r AS (SELECT regr_slope(energy_score, year_built) AS b, regr_intercept(energy_score, year_built) AS a
        FROM asset WHERE {SQL_TRAIN})
SELECT asset_id, round(coalesce(energy_score, a + b * year_built), 6) AS energy_score FROM asset, r WHERE {SQL_TEST}""")
def q_impute_regression(spark, sf_dir):
    out = M.impute_regression(_train(spark, sf_dir), _test(spark, sf_dir), "energy_score", "year_built")
    return out.select("asset_id", F.round("energy_score", 6).alias("energy_score"))


# ------------------------------------------------------------------ outliers
OUT_COLS = ["gfa_total", "n_floors", "emissions", "acctbal", "gas_therms"]


@query("outliers_iqr", ", q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS a{i}, quantile_cont({c}, 0.75) AS b{i}" for i, c in enumerate(OUT_COLS))
    + " FROM asset) SELECT asset_id, " + ", ".join(
    f"coalesce({c} < a{i} - 1.5 * (b{i} - a{i}) OR {c} > b{i} + 1.5 * (b{i} - a{i}), false) AS out_{c}"
    for i, c in enumerate(OUT_COLS)) + " FROM asset, q")
def q_outliers_iqr(spark, sf_dir):
    return O.outliers_iqr(asset(spark, sf_dir), OUT_COLS, "asset_id")


@query("outliers_zscore", ", q AS (SELECT " + ", ".join(
    f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(OUT_COLS))
    + " FROM asset) SELECT asset_id, " + ", ".join(
    f"coalesce({c} < m{i} - 3 * s{i} OR {c} > m{i} + 3 * s{i}, false) AS out_{c}"
    for i, c in enumerate(OUT_COLS)) + " FROM asset, q")
def q_outliers_zscore(spark, sf_dir):
    return O.outliers_zscore(asset(spark, sf_dir), OUT_COLS, "asset_id")


@query("outlier_counts", ", q AS (SELECT count(*) AS n, " + ", ".join(
    f"quantile_cont({c}, 0.25) AS a{i}, quantile_cont({c}, 0.75) AS b{i}" for i, c in enumerate(OUT_COLS))
    + " FROM asset) " + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(coalesce(sum(CAST({c} < a{i} - 1.5 * (b{i} - a{i}) OR {c} > b{i} + 1.5 * (b{i} - a{i}) AS BIGINT)), 0) AS BIGINT) AS n_outliers, "
    f"round(coalesce(sum(CAST({c} < a{i} - 1.5 * (b{i} - a{i}) OR {c} > b{i} + 1.5 * (b{i} - a{i}) AS BIGINT)), 0) * 100.0 / max(n), 4) AS pct FROM asset, q"
    for i, c in enumerate(OUT_COLS)))
def q_outlier_counts(spark, sf_dir):
    a = asset(spark, sf_dir)
    return O.outlier_counts(a, O.iqr_bounds(a, OUT_COLS))


INF_SQL = f"""
, t AS (SELECT asset_id, gfa_total AS x, ln(1 + emissions) AS y FROM asset WHERE {SQL_TRAIN}),
s AS (SELECT count(*) AS n, avg(x) AS mx, sum((x - (SELECT avg(x) FROM t)) * (x - (SELECT avg(x) FROM t))) AS sxx,
             regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t),
r AS (SELECT asset_id, y - (a + b * x) AS e, 1.0 / n + (x - mx) * (x - mx) / sxx AS h, n FROM t, s),
m AS (SELECT sum(e * e) / (max(n) - 2) AS mse FROM r),
f AS (SELECT asset_id, e, h, e * e / mse * h / ((1 - h) * (1 - h)) AS cook, e * sqrt(h / (1 - h)) / sqrt(mse) AS dff, n FROM r, m)
"""


@query("influence_p1", INF_SQL + """
SELECT asset_id, round(e, 8) AS resid, round(h, 8) AS leverage, round(cook, 8) AS cooks_d, round(dff, 8) AS dffits,
       h > 4.0 / n AS high_leverage, cook > 1.0 AS high_cooks, abs(dff) > 2 * sqrt(1.0 / n) AS high_dffits FROM f""")
def q_influence_p1(spark, sf_dir):
    tr = _train(spark, sf_dir).select("asset_id", "gfa_total", F.log1p("emissions").alias("y"))
    out, _ = O.influence(tr, "y", ["gfa_total"], "asset_id", fill_median=False)
    return out.select("asset_id", *[F.round(c, 8).alias(c) for c in ("resid", "leverage", "cooks_d", "dffits")],
                      "high_leverage", "high_cooks", "high_dffits")


@query("influence_union", INF_SQL + """
SELECT count(*) AS n_flagged, round(count(*) * 100.0 / max(n), 4) AS pct_flagged FROM f
WHERE h > 4.0 / n OR cook > 1.0 OR abs(dff) > 2 * sqrt(1.0 / n)""")
def q_influence_union(spark, sf_dir):
    tr = _train(spark, sf_dir).select("asset_id", "gfa_total", F.log1p("emissions").alias("y"))
    out, th = O.influence(tr, "y", ["gfa_total"], "asset_id", fill_median=False)
    ids = (out.where("high_leverage").select("asset_id")
              .unionByName(out.where("high_cooks").select("asset_id"))
              .unionByName(out.where("high_dffits").select("asset_id")).distinct())
    return ids.agg(F.count(F.lit(1)).alias("n_flagged"),
                   F.round(F.count(F.lit(1)) * 100.0 / F.lit(th["n"]), 4).alias("pct_flagged"))


INF_COLS = ["gfa_total", "n_floors", "year_built", "energy_score", "acctbal"]
# The inverse of the 6 x 6 Gramian by Gauss-Jordan elimination of [G | I], a column a step.
INF_MULTI_SQL = f"""WITH RECURSIVE asset AS ({ASSET_SQL}),
t AS (SELECT asset_id, ln(1 + emissions) AS y, {', '.join(INF_COLS)} FROM asset WHERE {SQL_TRAIN}),
c AS (SELECT {', '.join(f'median({c}) AS m{i}, avg({c}) AS u{i}, stddev_pop({c}) AS d{i}' for i, c in enumerate(INF_COLS))} FROM t),
x AS MATERIALIZED (SELECT asset_id, y, [1.0::DOUBLE, {', '.join(f'(coalesce({c}, m{i}) - u{i}) / d{i}' for i, c in enumerate(INF_COLS))}] AS x FROM t, c),
g AS (SELECT i, j, sum(x[i] * x[j]) AS s FROM x, range(1, 7) a(i), range(1, 7) b(j) GROUP BY ALL),
s0 AS (SELECT list(CASE WHEN j <= 6 THEN s ELSE (i = j - 6)::INT::DOUBLE END ORDER BY i, j) AS m
       FROM (SELECT i, j FROM range(1, 7) a(i), range(1, 13) b(j)) LEFT JOIN g USING (i, j)),
s1(k, m) AS (SELECT 0::BIGINT, m FROM s0 UNION ALL SELECT k + 1, list_transform(range(72), lambda e:
      CASE WHEN e // 12 = k THEN m[e + 1] / m[k * 12 + k + 1]
           ELSE m[e + 1] - m[e // 12 * 12 + k + 1] * m[k * 12 + e % 12 + 1] / m[k * 12 + k + 1] END) FROM s1 WHERE k < 6),
v AS (SELECT list_transform(range(6), lambda i: m[i * 12 + 7 : i * 12 + 12]) AS v FROM s1 WHERE k = 6),
w AS (SELECT list_transform(range(1, 7), lambda i: list_dot_product(v[i], b)) AS w, v FROM v,
      (SELECT list(s ORDER BY i) AS b FROM (SELECT i, sum(x[i] * y) AS s FROM x, range(1, 7) a(i) GROUP BY i))),
r AS (SELECT asset_id, y - list_dot_product(w, x) AS e, list_dot_product(list_transform(range(1, 7), lambda i: list_dot_product(v[i], x)), x) AS h FROM x, w),
q AS (SELECT sum(e * e) / (count(*) - 6) AS mse, count(*) AS n FROM r),
f AS (SELECT asset_id, e, h, e * e / (5 * mse) * h / ((1 - h) * (1 - h)) AS cook, e * sqrt(h / (1 - h)) / sqrt(mse) AS dff, n FROM r, q)
SELECT asset_id, round(e, 8) AS resid, round(h, 8) AS leverage, round(cook, 8) AS cooks_d, round(dff, 8) AS dffits,
       h > 12.0 / n AS high_leverage, cook > 1.0 AS high_cooks, abs(dff) > 2 * sqrt(5.0 / n) AS high_dffits FROM f"""


@query("influence_multi", INF_MULTI_SQL, raw_sql=True)
def q_influence_multi(spark, sf_dir):
    tr = _train(spark, sf_dir).withColumn("y", F.log1p("emissions"))
    out, _ = O.influence(tr, "y", INF_COLS, "asset_id")
    return round_doubles(out, 8)


CAP_COLS = ["gfa_total", "n_floors", "acctbal", "gas_therms"]


@query("winsorize", ", q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.05) AS a{i}, quantile_cont({c}, 0.95) AS b{i}" for i, c in enumerate(CAP_COLS))
    + f" FROM asset WHERE {SQL_TRAIN}) SELECT asset_id, " + ", ".join(
    f"round(CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, a{i}), b{i}) END, 6) AS {c}"
    for i, c in enumerate(CAP_COLS)) + f" FROM asset, q WHERE {SQL_TEST}")
def q_winsorize(spark, sf_dir):
    p = O.fit_caps(_train(spark, sf_dir).select(*CAP_COLS), CAP_COLS, "winsorize")
    return round_doubles(O.apply_caps(_test(spark, sf_dir).select("asset_id", *CAP_COLS), p), 6)


@query("outlier_caps", "\nUNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", 'winsorize' AS method, round(quantile_cont({c}, 0.05), 6) AS lower, "
     f"round(quantile_cont({c}, 0.95), 6) AS upper FROM asset WHERE {SQL_TRAIN}" for c in CAP_COLS]
    + [f"SELECT '{c}', 'iqr', round(quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 6), "
       f"round(quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 6) FROM asset WHERE {SQL_TRAIN}"
       for c in CAP_COLS]
    + [f"SELECT '{c}', 'zscore', round(avg({c}) - 3 * stddev_samp({c}), 6), round(avg({c}) + 3 * stddev_samp({c}), 6) "
       f"FROM asset WHERE {SQL_TRAIN}" for c in CAP_COLS]))
def q_outlier_caps(spark, sf_dir):
    tr = _train(spark, sf_dir).select(*CAP_COLS)
    out = None
    for m in ("winsorize", "iqr", "zscore"):
        f = O.fit_caps(tr, CAP_COLS, m).to_frame(spark)
        out = f if out is None else out.unionByName(f)
    return round_doubles(out, 6)


@query("zscore_limits", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(avg({c}) - 3 * stddev_samp({c}), 6) AS lower, round(avg({c}) + 3 * stddev_samp({c}), 6) AS upper "
    f"FROM asset WHERE {SQL_TRAIN}" for c in CAP_COLS))
def q_zscore_limits(spark, sf_dir):
    tr = _train(spark, sf_dir)
    r = tr.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(CAP_COLS)],
               *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(CAP_COLS)])
    rows = [F.struct(F.lit(c).alias("column"), F.round(F.col(f"m{i}"), 6).alias("mean"),
                     F.round(F.col(f"s{i}"), 6).alias("std"),
                     F.round(F.col(f"m{i}") - 3 * F.col(f"s{i}"), 6).alias("lower"),
                     F.round(F.col(f"m{i}") + 3 * F.col(f"s{i}"), 6).alias("upper"))
            for i, c in enumerate(CAP_COLS)]
    return r.select(F.inline(F.array(*rows)))


@query("zscore_cap", ", q AS (SELECT " + ", ".join(
    f"avg({c}) - 3 * stddev_samp({c}) AS a{i}, avg({c}) + 3 * stddev_samp({c}) AS b{i}" for i, c in enumerate(CAP_COLS))
    + f" FROM asset WHERE {SQL_TRAIN}) SELECT asset_id, " + ", ".join(
    f"round(CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, a{i}), b{i}) END, 6) AS {c}"
    for i, c in enumerate(CAP_COLS)) + f" FROM asset, q WHERE {SQL_TEST}")
def q_zscore_cap(spark, sf_dir):
    p = O.fit_caps(_train(spark, sf_dir).select(*CAP_COLS), CAP_COLS, "zscore")
    return round_doubles(O.apply_caps(_test(spark, sf_dir).select("asset_id", *CAP_COLS), p), 6)


@query("target_cap_rule", f"""
, t AS (SELECT ln(1 + gfa_parking) AS x FROM asset WHERE {SQL_TRAIN}),
s AS (SELECT avg(x) AS m, stddev_samp(x) AS s1, stddev_pop(x) AS s0, count(x) AS n FROM t),
k AS (SELECT avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) AS sk FROM t, s),
o AS (SELECT sum(CASE WHEN abs((x - m) / s0) > 3 THEN 1 ELSE 0 END) * 100.0 / max(n) AS pct FROM t, s)
SELECT round(pct, 6) AS pct_outliers, round(sk, 6) AS skew, NOT (pct < 1 AND abs(sk) < 0.5) AS applied,
       round(m - 3 * s1, 6) AS lower, round(m + 3 * s1, 6) AS upper FROM s, k, o""")
def q_target_cap_rule(spark, sf_dir):
    tr = _train(spark, sf_dir).select(F.log1p("gfa_parking").alias("x"))
    _, info = O.target_cap_rule(tr, "x")
    one = tr.agg(F.count(F.lit(1)).alias("_n"))
    return one.select(F.round(F.lit(info["pct_outliers"]), 6).alias("pct_outliers"),
                      F.round(F.lit(info["skew"]), 6).alias("skew"), F.lit(info["applied"]).alias("applied"),
                      F.round(F.lit(info["lower"]), 6).alias("lower"), F.round(F.lit(info["upper"]), 6).alias("upper"))


# ------------------------------------------------------------------- k-NN
KNN_PREDICTORS = ["year_built", "n_floors", "energy_score", "property_type"]

KNN_SQL = """
, lv AS (SELECT property_type, row_number() OVER (ORDER BY property_type) - 1 AS code
         FROM (SELECT DISTINCT property_type FROM asset WHERE property_type IS NOT NULL)),
x AS MATERIALIZED (SELECT asset_id, second_use, year_built::DOUBLE AS a, n_floors::DOUBLE AS b, coalesce(energy_score, -1) AS c, coalesce(code, -1) AS d
      FROM asset LEFT JOIN lv USING (property_type)),
p AS (SELECT a, b, c, d, second_use AS class, count(*) AS n FROM x WHERE second_use IS NOT NULL GROUP BY ALL),
q AS (SELECT DISTINCT a, b, c, d FROM x WHERE second_use IS NULL),
-- the five smallest distances of places reach at least as far as the fifth row
r AS (SELECT q.a, q.b, q.c, q.d, list_max(min((q.a - p.a) ** 2 + (q.b - p.b) ** 2 + (q.c - p.c) ** 2 + (q.d - p.d) ** 2, 5)) AS reach
      FROM q, p GROUP BY ALL),
m AS (SELECT r.a, r.b, r.c, r.d, class, n, (r.a - p.a) ** 2 + (r.b - p.b) ** 2 + (r.c - p.c) ** 2 + (r.d - p.d) ** 2 AS dist
      FROM r, p WHERE (r.a - p.a) ** 2 + (r.b - p.b) ** 2 + (r.c - p.c) ** 2 + (r.d - p.d) ** 2 <= reach),
k AS (SELECT *, sum(n) OVER (PARTITION BY a, b, c, d ORDER BY dist) - sum(n) OVER (PARTITION BY a, b, c, d, dist) AS before FROM m),
v AS (SELECT a, b, c, d, class, sum(n) AS n FROM k WHERE before < 5 GROUP BY ALL),
w AS (SELECT a, b, c, d, arg_min(class, (-n, class)) AS won FROM v GROUP BY ALL)
SELECT asset_id, coalesce(second_use, won) AS second_use FROM x LEFT JOIN w USING (a, b, c, d)"""


@query("knn_impute", KNN_SQL)
def q_knn_impute(spark, sf_dir):
    """Second uses by the vote of the nearest assets that have one, whole table."""
    cols = ["asset_id", "second_use", *KNN_PREDICTORS]
    return N.knn_impute(asset(spark, sf_dir).select(cols), "second_use", KNN_PREDICTORS).select("asset_id", "second_use")


# ------------------------------------------------- nulls that an observed column explains
MAR_CANDS = ["year_built", "n_floors", "gfa_total", "emissions"]
MAR_COLS = [*MAR_CANDS, "score_mar", "use_mar"]
_MAR_SQL = """SELECT asset_id, year_built, n_floors, gfa_total, emissions,
  CASE WHEN year_built >= 1980 THEN NULL ELSE gfa_total / 1000.0 + 2 * n_floors + 0.1 * year_built + asset_id % 7 END AS score_mar,
  CASE WHEN year_built < 1925 THEN NULL ELSE building_type END AS use_mar FROM asset"""


def mar_frame(a):
    """The assets with a number and a category whose nulls depend on the year."""
    year = F.col("year_built")
    score = F.col("gfa_total") / 1000.0 + 2 * F.col("n_floors") + F.lit(0.1) * year + F.col("asset_id") % 7
    return a.select("asset_id", *MAR_CANDS, F.when(year < 1980, score).alias("score_mar"), F.when(year >= 1925, F.col("building_type")).alias("use_mar"))


def _mar_ttests(col: str) -> str:
    def one(j, p):
        miss, seen = f"CASE WHEN {col} IS NULL THEN {p} END", f"CASE WHEN {col} IS NOT NULL THEN {p} END"
        return (f"SELECT {j} AS j, '{p}' AS pred, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t, n1 + n2 - 2 AS dof "
                f"FROM (SELECT count({miss}) AS n1, avg({miss}) AS m1, var_samp({miss}) AS v1, count({seen}) AS n2, avg({seen}) AS m2, var_samp({seen}) AS v2 FROM tr)")
    return "SELECT j, pred FROM (" + " UNION ALL ".join(one(j, p) for j, p in enumerate(MAR_CANDS, 1)) + f") WHERE {t_sf2('t', 'dof')} < 0.05"


MAR_HEAD = f"""WITH RECURSIVE asset AS ({ASSET_SQL}),
f AS MATERIALIZED ({_MAR_SQL}), tr AS MATERIALIZED (SELECT * FROM f WHERE {SQL_TRAIN}),
sig AS MATERIALIZED ({_mar_ttests('score_mar')}), ksig AS MATERIALIZED ({_mar_ttests('use_mar')}),
x AS (SELECT *, [{', '.join(f'{c}::DOUBLE' for c in MAR_CANDS)}, score_mar, 1.0] AS x FROM tr WHERE score_mar IS NOT NULL),
sc AS (SELECT i, avg(x[i]) AS m, stddev_pop(x[i]) AS d FROM x, range(1, 6) r(i) GROUP BY i),
g AS (SELECT a.i, b.i AS j, avg((x[a.i] - a.m) * (x[b.i] - b.m)) / a.d / b.d AS c FROM x, sc a, sc b GROUP BY a.i, b.i, a.d, b.d),
s0 AS (SELECT list(CASE WHEN g.i IN (SELECT j FROM sig) AND (g.j = 5 OR g.j IN (SELECT j FROM sig)) THEN c ELSE 0 END ORDER BY g.i, g.j) AS m FROM g WHERE g.i < 5),
s1(k, m) AS (SELECT 0::BIGINT, m FROM s0 UNION ALL SELECT k + 1, list_transform(range(20), lambda e: CASE WHEN m[k * 5 + k + 1] < 1e-9 THEN m[e + 1]
      WHEN e // 5 = k THEN m[e + 1] / m[k * 5 + k + 1] ELSE m[e + 1] - m[e // 5 * 5 + k + 1] * m[k * 5 + e % 5 + 1] / m[k * 5 + k + 1] END) FROM s1 WHERE k < 4),
w AS MATERIALIZED (SELECT s.pred, s.j, s1.m[(s.j - 1) * 5 + 5] * y.d / a.d AS coef, a.m AS mean, y.m AS ymean, q.med FROM s1, sig s JOIN sc a ON a.i = s.j
      JOIN (SELECT unnest([{', '.join(str(j) for j in range(1, 5))}]) AS j, unnest([{', '.join(f'(SELECT median({c}) FROM tr)::DOUBLE' for c in MAR_CANDS)}]) AS med) q ON q.j = s.j,
      (SELECT * FROM sc WHERE i = 5) y WHERE k = 4),
b0 AS (SELECT max(ymean) - sum(coef * mean) AS b0 FROM w)"""


@query("missing_fit_mar", MAR_HEAD + """
SELECT 'score_mar' AS "column", 'impute_regression' AS action, round(b0, 6) AS fill_num, (SELECT string_agg(pred, ',' ORDER BY pred) FROM sig) AS fill_str FROM b0
UNION ALL SELECT 'score_mar', 'coefficient', round(coef, 6), pred FROM w UNION ALL SELECT 'score_mar', 'predictor_median', round(med, 6), pred FROM w
UNION ALL SELECT 'use_mar', 'impute_knn', NULL, (SELECT string_agg(pred, ',' ORDER BY j) FROM ksig)
UNION ALL SELECT 'use_mar', 'impute_fallback_mode', NULL, (SELECT use_mar FROM tr WHERE use_mar IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
UNION ALL SELECT unnest(['score_mar', 'use_mar']), 'mechanism', NULL, 'MAR'""", raw_sql=True)
def q_missing_fit_mar(spark, sf_dir):
    """The advanced fit where nulls depend on an observed column: regression for
    the number, a vote of the nearest rows for the category."""
    p = _mar_fit(spark, sf_dir)
    return round_doubles(spark.createDataFrame(p.store(), "column string, action string, fill_num double, fill_str string"), 6)


def _mar_fit(spark, sf_dir):
    # Candidates are the columns without nulls; Little's test runs over all numbers.
    return M.fit_missing_advanced(mar_frame(_train(spark, sf_dir)).drop("asset_id"), MAR_COLS, mcar_cols=[*MAR_CANDS, "score_mar"],
                                  max_tested=10, max_kept=5, predictor_null_below=0.2)


_MAR_DIST = " + ".join(f"CASE WHEN {j} IN (SELECT j FROM ksig) THEN (q.{c} - p.{c}) ** 2 ELSE 0 END" for j, c in enumerate(MAR_CANDS, 1))


@query("missing_transform_mar", MAR_HEAD + f"""
, te AS MATERIALIZED (SELECT * FROM f WHERE {SQL_TEST}),
r AS (SELECT q.asset_id, list_max(min({_MAR_DIST}, 5)) AS reach FROM te q, tr p WHERE q.use_mar IS NULL AND p.use_mar IS NOT NULL GROUP BY 1),
v AS (SELECT q.asset_id, p.use_mar, count(*) AS n FROM te q JOIN r USING (asset_id), tr p WHERE p.use_mar IS NOT NULL AND {_MAR_DIST} <= reach GROUP BY ALL),
k AS (SELECT asset_id, arg_min(use_mar, (-n, use_mar)) AS won FROM v GROUP BY 1),
co AS (SELECT {', '.join(f"coalesce(max(coef) FILTER (pred = '{c}'), 0) AS c{j}" for j, c in enumerate(MAR_CANDS))} FROM w)
SELECT asset_id, round(coalesce(score_mar, b0 + {' + '.join(f'c{j} * {c}' for j, c in enumerate(MAR_CANDS))}), 6) AS score_mar, coalesce(use_mar, won) AS use_mar
FROM te LEFT JOIN k USING (asset_id), co, b0""", raw_sql=True)
def q_missing_transform_mar(spark, sf_dir):
    """Test rows filled by the stored parameters, read back from their rows."""
    p = _mar_fit(spark, sf_dir)
    back = M.MissingParams.restored([tuple(r) for r in spark.createDataFrame(p.store(), "c string, a string, n double, s string").collect()], p.reference)
    out = M.transform_missing(mar_frame(_test(spark, sf_dir)), back)
    return out.select("asset_id", F.round("score_mar", 6).alias("score_mar"), "use_mar")
