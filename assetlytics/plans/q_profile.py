"""Registered profiling queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources.asset import NUMERIC_COLUMNS
from .common import SQL_FOLD, SQL_TRAIN, asset, fold_of, is_train
from .registry import query

ALL_COLS = ["asset_id", "neighborhood_raw", "neighborhood", "city", "property_type",
            "building_type", "state", "latitude", "longitude", "year_built", "n_floors",
            "gfa_total", "gfa_parking", "electricity_kwh", "gas_therms", "steam_kbtu",
            "energy_score", "acctbal", "second_use", "mostly_null", "emissions"]
NULLABLE = ["gas_therms", "energy_score", "acctbal", "second_use", "mostly_null"]
CORR_COLS = [c for c in NUMERIC_COLUMNS if c != "asset_id"]
CAT_COLS = ["neighborhood", "property_type", "building_type", "second_use", "mostly_null", "state"]


def _union(parts):
    return "\nUNION ALL ".join(parts)


NULL_SQL = ", np AS (" + _union([
    f"SELECT '{c}' AS \"column\", CAST(sum(CAST({c} IS NULL AS BIGINT)) AS BIGINT) AS null_count, "
    f"round(sum(CAST({c} IS NULL AS BIGINT)) * 100.0 / count(*), 4) AS null_pct FROM asset"
    for c in ALL_COLS]) + ")"


@query("null_profile", NULL_SQL + " SELECT * FROM np ORDER BY null_pct DESC, \"column\"")
def q_null_profile(spark, sf_dir):
    return P.null_profile(asset(spark, sf_dir), ALL_COLS)


@query("null_bands", NULL_SQL + """
SELECT *, CASE WHEN null_pct > 70 THEN 'drop' WHEN null_pct >= 10 THEN 'test'
               WHEN null_pct > 0 THEN 'simple' ELSE 'complete' END AS band FROM np""")
def q_null_bands(spark, sf_dir):
    return P.null_bands(P.null_profile(asset(spark, sf_dir), ALL_COLS))


_PAIRS = [(a, a) for a in ALL_COLS] + list(combinations(ALL_COLS, 2))


@query("co_missing", ", pat AS MATERIALIZED (SELECT " + ", ".join(f"{c} IS NULL AS {c}" for c in ALL_COLS) + ", count(*) AS n FROM asset GROUP BY ALL)\n" + _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(coalesce(sum(n) FILTER (WHERE {a} AND {b}), 0) AS BIGINT) AS both_null FROM pat"
    for a, b in _PAIRS]))
def q_co_missing(spark, sf_dir):
    return P.co_missing(asset(spark, sf_dir), ALL_COLS)


@query("distinct_profile", _union([
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM asset" for c in ALL_COLS]))
def q_distinct_profile(spark, sf_dir):
    return P.distinct_profile(asset(spark, sf_dir), ALL_COLS)


@query("describe_numeric", _union([
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
    f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
    f"round(quantile_cont({c}, 0.75), 6) AS q75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM asset"
    for c in NUMERIC_COLUMNS]))
def q_describe_numeric(spark, sf_dir):
    return P.describe_numeric(asset(spark, sf_dir), NUMERIC_COLUMNS)


_CPAIRS = [(a, a) for a in CORR_COLS] + list(combinations(CORR_COLS, 2))


@query("corr_matrix", _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM asset"
    for a, b in _CPAIRS]))
def q_corr_matrix(spark, sf_dir):
    return P.corr_matrix(asset(spark, sf_dir), CORR_COLS)


@query("corr_pair", "SELECT round(corr(gfa_total, emissions), 6) AS r, count(*) AS n FROM asset")
def q_corr_pair(spark, sf_dir):
    return asset(spark, sf_dir).agg(F.round(F.corr("gfa_total", "emissions"), 6).alias("r"),
                                    F.count(F.lit(1)).alias("n"))


SHAPE_COLS = CORR_COLS


@query("shape_stats", _union([f"""
SELECT '{c}' AS "column",
  round((SELECT avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5)
         FROM asset, (SELECT avg({c}) AS m FROM asset) mm WHERE {c} IS NOT NULL), 6) AS skew,
  round((SELECT avg(power({c} - m, 4)) / power(avg(power({c} - m, 2)), 2) - 3
         FROM asset, (SELECT avg({c}) AS m FROM asset) mm WHERE {c} IS NOT NULL), 6) AS kurt,
  round((SELECT avg({c}) / nullif(median({c}), 0) FROM asset), 6) AS mean_median""" for c in SHAPE_COLS]))
def q_shape_stats(spark, sf_dir):
    return P.shape_stats(asset(spark, sf_dir), SHAPE_COLS)


@query("histogram", """
, mm AS (SELECT min(emissions) AS lo, max(emissions) AS hi FROM asset),
b AS (SELECT least(CAST(floor((emissions - lo) / (hi - lo) * 30) AS INT) + 1, 30) AS bin, lo, hi
      FROM asset, mm WHERE emissions IS NOT NULL)
SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 30), 6) AS bin_lo,
       round(lo + bin * ((hi - lo) / 30), 6) AS bin_hi, count(*) AS n
FROM b GROUP BY bin, lo, hi""")
def q_histogram(spark, sf_dir):
    return P.histogram(asset(spark, sf_dir), "emissions", 30)


@query("boxplot_stats", """
, q AS (SELECT property_type, quantile_cont(emissions, 0.25) AS q1, quantile_cont(emissions, 0.5) AS med,
               quantile_cont(emissions, 0.75) AS q3, count(emissions) AS n FROM asset GROUP BY 1)
SELECT a.property_type, q.n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round(q3 - q1, 6) AS iqr,
       round(min(CASE WHEN emissions >= q1 - 1.5 * (q3 - q1) THEN emissions END), 6) AS whisker_lo,
       round(max(CASE WHEN emissions <= q3 + 1.5 * (q3 - q1) THEN emissions END), 6) AS whisker_hi,
       CAST(sum(CAST(emissions < q1 - 1.5 * (q3 - q1) OR emissions > q3 + 1.5 * (q3 - q1) AS BIGINT)) AS BIGINT) AS n_outliers
FROM asset a JOIN q USING (property_type) WHERE emissions IS NOT NULL
GROUP BY a.property_type, q.n, q1, med, q3""")
def q_boxplot_stats(spark, sf_dir):
    return P.boxplot_stats(asset(spark, sf_dir), "property_type", "emissions")


@query("ecdf", """
, v AS (SELECT emissions, count(*) AS n FROM asset WHERE emissions IS NOT NULL GROUP BY 1)
SELECT emissions, n, CAST(sum(n) OVER (ORDER BY emissions) AS BIGINT) AS cum_n,
       round(sum(n) OVER (ORDER BY emissions) / (SELECT sum(n) FROM v), 6) AS ecdf FROM v""")
def q_ecdf(spark, sf_dir):
    return P.ecdf(asset(spark, sf_dir), "emissions")


def _qq_sql():
    from .sqlfrag import norm_ppf
    return f"""
, v AS (SELECT ln(1 + emissions) AS x FROM asset WHERE emissions IS NOT NULL),
r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM v),
m AS (SELECT x, i, CASE WHEN i = 1 THEN 1.0 - power(0.5, 1.0 / n) WHEN i = n THEN power(0.5, 1.0 / n)
                        ELSE (i - 0.3175) / (n + 0.365) END AS p FROM r)
SELECT CAST(i AS BIGINT) AS rank, round({norm_ppf('p')}, 6) AS theoretical, round(x, 6) AS sample FROM m"""


@query("qq_points", _qq_sql())
def q_qq_points(spark, sf_dir):
    return P.qq_points(asset(spark, sf_dir).select(F.log1p("emissions").alias("log_emissions")),
                       "log_emissions")


@query("mode_profile", _union([f"""
SELECT * FROM (SELECT '{c}' AS "column", coalesce((SELECT CAST({c} AS VARCHAR) FROM asset WHERE {c} IS NOT NULL
   GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1), 'Unknown') AS mode,
   coalesce((SELECT count(*) FROM asset WHERE {c} IS NOT NULL GROUP BY {c}
   ORDER BY count(*) DESC LIMIT 1), 0) AS mode_count)""" for c in CAT_COLS]))
def q_mode_profile(spark, sf_dir):
    return P.mode_profile(asset(spark, sf_dir), CAT_COLS)


PATTERN_COLS = NULLABLE


@query("missing_patterns", "SELECT " + " || ".join(
    f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in PATTERN_COLS)
    + """ AS pattern, count(*) AS n, round(avg(emissions), 6) AS mean_emissions,
    round(avg(gfa_total), 6) AS mean_gfa_total FROM asset GROUP BY 1""")
def q_missing_patterns(spark, sf_dir):
    return P.missing_patterns(asset(spark, sf_dir), PATTERN_COLS, ["emissions", "gfa_total"])


@query("top_extremes", """
, s AS (SELECT avg(ln(1 + emissions)) AS m, stddev_pop(ln(1 + emissions)) AS sd FROM asset)
SELECT asset_id, emissions AS value, round(ln(1 + emissions), 6) AS value_log,
       round(abs((ln(1 + emissions) - m) / sd), 6) AS abs_z, abs((ln(1 + emissions) - m) / sd) > 3 AS is_extreme
FROM asset, s WHERE abs((ln(1 + emissions) - m) / sd) > 3 ORDER BY abs_z DESC, asset_id LIMIT 10""")
def q_top_extremes(spark, sf_dir):
    return P.top_extremes(asset(spark, sf_dir), "emissions", "asset_id", k=10)


@query("kfold_assign", f"""
SELECT {SQL_FOLD} AS fold, count(*) AS n, round(avg(emissions), 4) AS mean_target
FROM asset WHERE {SQL_TRAIN} GROUP BY 1""")
def q_kfold_assign(spark, sf_dir):
    a = asset(spark, sf_dir).where(is_train())
    return a.groupBy(fold_of().alias("fold")).agg(F.count(F.lit(1)).alias("n"),
                                                 F.round(F.avg("emissions"), 4).alias("mean_target"))
