"""Registered feature-engineering and encoding queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import encode as EN
from ..operators import features as FE
from ..operators import missing as M
from ..operators import outliers as O
from ..operators import scoring as SCORING
from ..session import app_id, shared_path
from .common import SQL_TEST, SQL_TRAIN, asset, is_train
from .q_scoring import TYPE_SQL
from .registry import query

RATIO = {"gfa_per_floor": ("gfa_total", "n_floors"), "parking_ratio": ("gfa_parking", "gfa_total")}
INTER = {"size_floors": ("gfa_total", "n_floors"), "age_size": ("building_age", "gfa_total")}
POLY = {"gfa_squared": ("gfa_total", 2), "gfa_sqrt": ("gfa_total", 0.5), "floors_cubed": ("n_floors", 3)}


def _train(spark, sf_dir):
    return asset(spark, sf_dir).where(is_train())


def _test(spark, sf_dir):
    return asset(spark, sf_dir).where(~is_train())


def _ratio_sql(a, b):
    return f"CASE WHEN isinf({a} / ({b} + 1e-6)) OR isnan({a} / ({b} + 1e-6)) THEN NULL ELSE {a} / ({b} + 1e-6) END"


@query("feat_ratio", "SELECT asset_id, " + ", ".join(
    f"round({_ratio_sql(a, b)}, 6) AS {k}" for k, (a, b) in RATIO.items()) + " FROM asset")
def q_feat_ratio(spark, sf_dir):
    a = asset(spark, sf_dir).select("asset_id", "gfa_total", "n_floors", "gfa_parking")
    return round_doubles(FE.ratio_features(a, RATIO).select("asset_id", *RATIO), 6)


@query("feat_interaction", """
SELECT asset_id, round(gfa_total * n_floors, 6) AS size_floors, round(energy_score * gfa_total, 6) AS score_area FROM asset""")
def q_feat_interaction(spark, sf_dir):
    a = asset(spark, sf_dir)
    d = {"size_floors": ("gfa_total", "n_floors"), "score_area": ("energy_score", "gfa_total")}
    return round_doubles(FE.interaction_features(a, d).select("asset_id", *d), 6)


TEMP_SQL = ("CASE WHEN year_built IS NULL THEN NULL ELSE greatest(2016 - year_built, 0) END")


@query("feat_temporal", f"""
SELECT asset_id, {TEMP_SQL} AS building_age, power({TEMP_SQL}, 2) AS building_age_squared,
       coalesce(CAST({TEMP_SQL} > 50 AS INT), 0) AS is_old_building FROM asset""")
def q_feat_temporal(spark, sf_dir):
    a = asset(spark, sf_dir).select("asset_id", "year_built")
    return FE.temporal_features(a, 2016).select("asset_id", "building_age", "building_age_squared",
                                                "is_old_building")


@query("feat_polynomial", """
SELECT asset_id, round(power(gfa_total, 2) / 1e6, 6) AS gfa_squared_m, round(power(greatest(gfa_total, 0), 0.5), 6) AS gfa_sqrt,
       round(power(CAST(n_floors AS DOUBLE), 3), 6) AS floors_cubed FROM asset""")
def q_feat_polynomial(spark, sf_dir):
    a = asset(spark, sf_dir).select("asset_id", "gfa_total", "n_floors")
    out = FE.polynomial_features(a, POLY)
    return out.select("asset_id", F.round(F.col("gfa_squared") / 1e6, 6).alias("gfa_squared_m"),
                      F.round("gfa_sqrt", 6).alias("gfa_sqrt"), F.round("floors_cubed", 6).alias("floors_cubed"))


@query("feat_all", f"""
SELECT asset_id, {", ".join(f"round({_ratio_sql(a, b)}, 6) AS {k}" for k, (a, b) in RATIO.items())},
       {TEMP_SQL} AS building_age, coalesce(CAST({TEMP_SQL} > 50 AS INT), 0) AS is_old_building,
       round(gfa_total * n_floors, 6) AS size_floors, round({TEMP_SQL} * gfa_total, 6) AS age_size,
       round(power(greatest(gfa_total, 0), 0.5), 6) AS gfa_sqrt FROM asset""")
def q_feat_all(spark, sf_dir):
    a = asset(spark, sf_dir).select("asset_id", "gfa_total", "n_floors", "gfa_parking", "year_built")
    out = FE.all_features(a, RATIO, INTER, {"gfa_sqrt": ("gfa_total", 0.5)}, 2016)
    return round_doubles(out.select("asset_id", "gfa_per_floor", "parking_ratio", "building_age",
                                    "is_old_building", "size_floors", "age_size", "gfa_sqrt"), 6)


AGG_GROUPS = ["neighborhood", "property_type"]
TGT = "ln(1 + emissions)"


@query("agg_features_fit", "\nUNION ALL ".join(
    f"SELECT '{g}' AS group_col, {g} AS group_value, round(avg({TGT}), 6) AS mean, round(median({TGT}), 6) AS median, "
    f"round(stddev_samp({TGT}), 6) AS std FROM asset WHERE {SQL_TRAIN} GROUP BY {g}" for g in AGG_GROUPS))
def q_agg_features_fit(spark, sf_dir):
    tr = _train(spark, sf_dir).withColumn("target_log", F.log1p("emissions"))
    p = FE.fit_aggregated_features(tr, "target_log", AGG_GROUPS, ["mean", "median", "std", "count", "bogus"])
    out = None
    for g, t in p.tables.items():
        f = t.select(F.lit(g).alias("group_col"), F.col(g).alias("group_value"),
                     *[F.round(f"{g}_{a}", 6).alias(a) for a in ("mean", "median", "std")])
        out = f if out is None else out.unionByName(f)
    return out


@query("agg_features", f"""
, t AS (SELECT *, {TGT} AS y FROM asset WHERE {SQL_TRAIN}), gm AS (SELECT avg(y) AS g FROM t),
n AS (SELECT neighborhood, avg(y) AS m, median(y) AS md, stddev_samp(y) AS s FROM t GROUP BY 1),
p AS (SELECT property_type, avg(y) AS m, median(y) AS md, stddev_samp(y) AS s FROM t GROUP BY 1)
SELECT a.asset_id, round(coalesce(n.m, g), 6) AS neighborhood_mean, round(coalesce(n.md, g), 6) AS neighborhood_median,
       round(coalesce(n.s, g), 6) AS neighborhood_std, round(coalesce(p.m, g), 6) AS property_type_mean,
       round(coalesce(p.md, g), 6) AS property_type_median, round(coalesce(p.s, g), 6) AS property_type_std
FROM asset a LEFT JOIN n USING (neighborhood) LEFT JOIN p USING (property_type), gm WHERE {SQL_TEST}""")
def q_agg_features(spark, sf_dir):
    tr = _train(spark, sf_dir).withColumn("target_log", F.log1p("emissions"))
    p = FE.fit_aggregated_features(tr, "target_log", AGG_GROUPS)
    out = FE.transform_aggregated_features(_test(spark, sf_dir).select("asset_id", *AGG_GROUPS), p)
    return round_doubles(out.drop(*AGG_GROUPS), 6)


BIN_MAP = {"has_steam": "steam_kbtu", "has_gas": "gas_therms", "has_elec": "electricity_kwh"}


def _bin_sql(k, src):
    mode = (f"(SELECT CAST(v AS INT) FROM (SELECT CAST({src} > 0 AS INT) AS v, count(*) AS n FROM asset "
            f"WHERE {SQL_TRAIN} AND {src} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)")
    return f"coalesce(CAST({src} > 0 AS INT), {mode}) AS {k}"


@query("binary_flags", "SELECT asset_id, " + ", ".join(_bin_sql(k, s) for k, s in BIN_MAP.items())
       + f" FROM asset WHERE {SQL_TEST}")
def q_binary_flags(spark, sf_dir):
    p = FE.fit_binary_flags(_train(spark, sf_dir), BIN_MAP)
    return FE.transform_binary_flags(_test(spark, sf_dir), p, keep=["asset_id"])


ENC_COLS = ["property_type", "building_type", "neighborhood", "second_use"]


def _encode_sql(c):
    few = f"(SELECT count(DISTINCT {c}) FROM asset WHERE {SQL_TRAIN}) <= 10"
    return (f"SELECT '{c}' AS \"column\", 'onehot' AS method, v AS level, rn = 1 AS dropped, CAST(NULL AS DOUBLE) AS encoded "
            f"FROM (SELECT CAST({c} AS VARCHAR) AS v, row_number() OVER (ORDER BY CAST({c} AS VARCHAR)) AS rn "
            f"FROM (SELECT DISTINCT {c} FROM asset WHERE {SQL_TRAIN} AND {c} IS NOT NULL)) WHERE {few} "
            f"UNION ALL SELECT '{c}', 'target', CAST({c} AS VARCHAR), false, round(avg(emissions), 6) "
            f"FROM asset WHERE {SQL_TRAIN} AND NOT {few} GROUP BY {c}")


@query("encode_fit", "\nUNION ALL ".join(f"SELECT * FROM ({_encode_sql(c)})" for c in ENC_COLS))
def q_encode_fit(spark, sf_dir):
    """Levels of one-hot columns and the whole target map of the others."""
    p = EN.fit_encoder(_train(spark, sf_dir), ENC_COLS, "emissions")
    out = spark.createDataFrame([(*r, None) for r in p.rows() if r[1] == "onehot"],
                                "column string, method string, level string, dropped boolean, encoded double")
    for c, t in p.target.items():
        out = out.unionByName(t.select(F.lit(c).alias("column"), F.lit("target").alias("method"), F.col(c).cast("string").alias("level"),
                                       F.lit(False).alias("dropped"), F.round(f"{c}_encoded", 6).alias("encoded")))
    return out


ONEHOT_COLS = ["property_type", "building_type"]
LEVELS = {"property_type": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
          "building_type": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
          "second_use": ["F", "O", "P"]}


def _onehot_sql(c):
    return ", ".join(f"coalesce(CAST(CAST({c} AS VARCHAR) = '{lv}' AS INT), 0) AS \"{c}_{lv}\"" for lv in LEVELS[c][1:])


@query("onehot", "SELECT asset_id, " + ", ".join(_onehot_sql(c) for c in ONEHOT_COLS)
       + f" FROM asset WHERE {SQL_TEST}")
def q_onehot(spark, sf_dir):
    p = EN.fit_encoder(_train(spark, sf_dir), ONEHOT_COLS)
    return EN.transform_encoder(_test(spark, sf_dir).select("asset_id", *ONEHOT_COLS), p)


@query("target_encode_fit", f"""
SELECT neighborhood, round(avg({TGT}), 6) AS neighborhood_encoded, count(*) AS n FROM asset WHERE {SQL_TRAIN} GROUP BY 1""")
def q_target_encode_fit(spark, sf_dir):
    tr = _train(spark, sf_dir).withColumn("target_log", F.log1p("emissions"))
    return tr.groupBy("neighborhood").agg(F.round(F.avg("target_log"), 6).alias("neighborhood_encoded"),
                                          F.count(F.lit(1)).alias("n"))


@query("target_encode", f"""
, t AS (SELECT neighborhood, avg({TGT}) AS m FROM asset WHERE {SQL_TRAIN} GROUP BY 1)
SELECT asset_id, round(coalesce(t.m, (SELECT avg({TGT}) FROM asset WHERE {SQL_TRAIN})), 6) AS neighborhood_encoded
FROM asset a LEFT JOIN t USING (neighborhood) WHERE {SQL_TEST}""")
def q_target_encode(spark, sf_dir):
    tr = _train(spark, sf_dir).withColumn("target_log", F.log1p("emissions"))
    p = EN.fit_encoder(tr, ["neighborhood"], "target_log")
    out = EN.transform_encoder(_test(spark, sf_dir).select("asset_id", "neighborhood"), p)
    return round_doubles(out, 6)


STD_COLS = ["gfa_total", "n_floors", "year_built"]


@query("standardize", ", s AS (SELECT " + ", ".join(
    f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(STD_COLS)) + f" FROM asset WHERE {SQL_TRAIN}) "
    + "SELECT asset_id, " + ", ".join(f"round(({c} - m{i}) / s{i}, 6) AS {c}" for i, c in enumerate(STD_COLS))
    + f" FROM asset, s WHERE {SQL_TEST}")
def q_standardize(spark, sf_dir):
    p = EN.fit_standardize(_train(spark, sf_dir), STD_COLS, ddof=0)
    out = EN.transform_standardize(_test(spark, sf_dir).select("asset_id", *STD_COLS), p)
    return round_doubles(out, 6)


SF_AGE = "(2016 - year_built)"
SF_FL = "greatest(coalesce(n_floors, 1), 1)"


SF_TYPE = "CASE property_type_ref " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in sorted(SCORING.BUILDING_TYPE_BENCHMARKS.items())) + " END"


@query("score_features", f"""
, nm AS (SELECT neighborhood AS nbh, round(avg(emissions), 1) AS mean_co2 FROM asset GROUP BY 1),
a2 AS (SELECT *, {TYPE_SQL} AS property_type_ref FROM asset)
SELECT asset_id, 1 AS n_buildings, CAST(0 AS DOUBLE) AS parking_area, CAST(0 AS DOUBLE) AS steam_kbtu_est, 'Parking' AS second_use_type,
       CAST(0 AS DOUBLE) AS second_use_gfa, CAST(0 AS DOUBLE) AS parking_ratio, 'NonResidential' AS building_class,
       CAST(50 AS DOUBLE) AS neighborhood_std, CAST(80 AS DOUBLE) AS type_std, coalesce(energy_score, 60.0) AS score_or_default,
       gfa_total AS building_gfa, gfa_total AS largest_use_gfa, CAST(power({SF_AGE}, 2) AS DOUBLE) AS age_squared,
       round(coalesce(nm.mean_co2, 115.6), 6) AS neighborhood_mean, CAST(coalesce({SF_TYPE}, 115.6) AS DOUBLE) AS type_mean, round(gfa_total * 10.0, 6) AS est_electricity_kwh, round(gfa_total * 0.5, 6) AS est_gas_therms,
       {SF_AGE} AS building_age, CAST({SF_AGE} > 30 AS INT) AS is_old, round(gfa_total / {SF_FL}, 6) AS gfa_per_floor,
       round(gfa_total * {SF_FL}, 6) AS size_floors, round({SF_AGE} * gfa_total, 6) AS age_size,
       {SF_AGE} * {SF_FL} AS age_floors, round(sqrt(greatest(gfa_total, 0.0)), 6) AS gfa_sqrt,
       round(power({SF_FL}, 2), 6) AS floors_squared FROM a2 LEFT JOIN nm ON a2.neighborhood = nm.nbh""")
def q_score_features(spark, sf_dir):
    a = asset(spark, sf_dir)
    means = a.groupBy("neighborhood").agg(F.round(F.avg("emissions"), 1).alias("avg_co2"))
    own = ["gfa_total", "year_built", "n_floors", "energy_score", "property_type", "neighborhood"]
    rows = a.select("asset_id", *own).withColumn("property_type", SCORING.map_segment("property_type"))
    out = FE.score_features(rows, neighborhood_means=means, type_means=SCORING.BUILDING_TYPE_BENCHMARKS)
    return round_doubles(out.drop(*own), 6)


# ------------------------------------------------------ complete preparation
PREP_IN = ["asset_id", "neighborhood", "property_type", "building_type", "second_use", "state", "mostly_null",
           "year_built", "n_floors", "gfa_total", "gas_therms", "steam_kbtu", "electricity_kwh",
           "energy_score", "acctbal", "target_log"]
PREP_NUM = ["year_built", "n_floors", "gfa_total", "gas_therms", "steam_kbtu", "electricity_kwh",
            "energy_score", "acctbal", "target_log"]


def _prep_frame(df):
    return df.withColumn("target_log", F.log1p("emissions")).select(*PREP_IN)


def fit_complete(train):
    """missing (simple) -> z caps -> binary flags -> encoder, all on the raw train frame."""
    fit_cols = [c for c in train.columns if c != "asset_id"]
    mp = M.fit_missing_simple(train, fit_cols)
    caps = O.fit_caps(train, PREP_NUM, "zscore")
    bp = FE.fit_binary_flags(train, BIN_MAP)
    enc = EN.fit_encoder(train, ENC_COLS, "target_log")
    return mp, caps, bp, enc


def transform_complete(df, mp, caps, bp, enc):
    flags = FE.binary_flag_columns(bp)
    base = df.select(*df.columns, *flags)
    out = M.transform_missing(base, mp)
    out = O.apply_caps(out, caps)
    return EN.transform_encoder(out, enc)


def _prep_sql():
    t = f"(SELECT *, {TGT} AS target_log FROM asset WHERE {SQL_TRAIN})"
    lim = ", ".join(f"avg({c}) - 3 * stddev_samp({c}) AS lo_{c}, avg({c}) + 3 * stddev_samp({c}) AS hi_{c}"
                    for c in PREP_NUM)
    fills = {"gas_therms": "(SELECT avg(gas_therms) FROM tr)", "acctbal": "(SELECT avg(acctbal) FROM tr)"}
    sel = ["x.asset_id"]
    for c in PREP_NUM:
        v = f"coalesce(x.{c}, {fills[c]})" if c in fills else f"x.{c}"
        sel.append(f"round(CASE WHEN {v} IS NULL THEN NULL ELSE least(greatest({v}, lo_{c}), hi_{c}) END, 6) AS {c}")
    for c in ("property_type", "building_type", "second_use"):
        sel += [f"coalesce(CAST(CAST(x.{c} AS VARCHAR) = '{lv}' AS INT), 0) AS \"{c}_{lv}\"" for lv in LEVELS[c][1:]]
    sel.append("round(coalesce(te.m, (SELECT avg(target_log) FROM tr)), 6) AS neighborhood_encoded")
    sel += [_bin_sql(k, f"x.{s}").replace(f"{SQL_TRAIN} AND x.", f"{SQL_TRAIN} AND ").replace(
        f"CAST(x.{s} > 0 AS INT) AS v", f"CAST({s} > 0 AS INT) AS v") for k, s in BIN_MAP.items()]
    return (f", tr AS {t}, lim AS (SELECT {lim} FROM tr), "
            f"te AS (SELECT neighborhood, avg(target_log) AS m FROM tr GROUP BY 1) "
            f"SELECT {', '.join(sel)} FROM (SELECT *, {TGT} AS target_log FROM asset WHERE {SQL_TEST}) x "
            f"LEFT JOIN te ON x.neighborhood = te.neighborhood, lim")


@query("complete_prep", _prep_sql())
def q_complete_prep(spark, sf_dir):
    a = _prep_frame(asset(spark, sf_dir))
    tr = a.where(is_train())
    parts = fit_complete(tr)
    out = transform_complete(a.where(~is_train()), *parts)
    return round_doubles(out.drop("state", "mostly_null"), 6)


@query("params_long", "\nUNION ALL ".join(
    [f"SELECT 'missing' AS stage, '{c}' AS \"column\", 'impute_mean' AS key, round(avg({c}), 6) AS value, CAST(NULL AS VARCHAR) AS text "
     f"FROM asset WHERE {SQL_TRAIN}" for c in ("gas_therms", "acctbal")]
    + [f"SELECT 'missing', 'state', 'drop_unique', NULL, NULL FROM asset WHERE {SQL_TRAIN} HAVING count(DISTINCT state) <= 1",
       f"SELECT 'missing', 'mostly_null', 'drop_missing', NULL, NULL FROM asset WHERE {SQL_TRAIN} "
       "HAVING avg(CAST(mostly_null IS NULL AS DOUBLE)) > 0.7"]
    + [f"SELECT 'caps', '{c}', '{k}', round(avg({c}) {sign} 3 * stddev_samp({c}), 6), 'zscore' FROM asset WHERE {SQL_TRAIN}"
       for c in ("gfa_total", "n_floors") for k, sign in (("lower", "-"), ("upper", "+"))]
    + [f"SELECT 'encoder', 'property_type', CASE WHEN row_number() OVER (ORDER BY property_type) = 1 THEN 'level_dropped' ELSE 'level' END, "
       f"NULL, property_type FROM (SELECT DISTINCT property_type FROM asset WHERE {SQL_TRAIN} AND property_type IS NOT NULL)",
       f"SELECT 'encoder', 'neighborhood', 'target_mean', round(avg({TGT}), 6), neighborhood FROM asset WHERE {SQL_TRAIN} GROUP BY neighborhood",
       f"SELECT 'encoder', NULL, 'global_mean', round(avg({TGT}), 6), NULL FROM asset WHERE {SQL_TRAIN}"]))
def q_params_long(spark, sf_dir):
    """All fitted parameters as one long table, persisted as parquet under the
    shared folder and read back (the on-disk parameter store): fills and drop
    lists, caps, one-hot levels, whole target maps, the global mean. Numbers
    are in ``value``, names in ``text``."""
    tr = _train(spark, sf_dir).withColumn("target_log", F.log1p("emissions"))
    mp = M.fit_missing_simple(tr, ["gas_therms", "acctbal", "state", "mostly_null"])
    caps = O.fit_caps(tr, ["gfa_total", "n_floors"], "zscore")
    enc = EN.fit_encoder(tr, ["neighborhood", "property_type"], "target_log")
    rows = [("missing", c, action, num, text) for c, action, num, text in mp.rows()]
    rows += [("caps", c, k, float(v), caps.method) for c, (lo, hi) in caps.bounds.items() for k, v in (("lower", lo), ("upper", hi))]
    rows += [("encoder", c, "level_dropped" if first else "level", None, lv) for c, m, lv, first in enc.rows() if m == "onehot"]
    rows += [("encoder", None, "global_mean", float(enc.global_mean), None)]
    table = spark.createDataFrame(rows, "stage string, column string, key string, value double, text string")
    for c, t in enc.target.items():
        table = table.unionByName(t.select(F.lit("encoder").alias("stage"), F.lit(c).alias("column"), F.lit("target_mean").alias("key"),
                                           F.col(f"{c}_encoded").alias("value"), F.col(c).cast("string").alias("text")))
    path = shared_path(spark, f"params_{app_id(spark)}_{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}")
    table.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).withColumn("value", F.round("value", 6))
