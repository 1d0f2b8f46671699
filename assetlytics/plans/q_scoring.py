"""Registered scoring and scenario queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import kpi
from ..operators import scenario as SC
from ..operators import scoring as S
from .common import asset
from .registry import query

# ------------------------------------------------------------ oracle fragments
BENCH_CTE = (", bt AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', CAST({v} AS DOUBLE))" for k, v in sorted(S.BUILDING_TYPE_BENCHMARKS.items()))
    + ") v(type_name, benchmark))")
TYPE_SQL = ("CASE property_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SEGMENT_TO_TYPE.items())
            + " ELSE property_type END")
BASE_CTE = BENCH_CTE + f""",
s AS (SELECT a.*, {TYPE_SQL} AS building_type_ref FROM asset a),
sb AS (SELECT s.*, coalesce(b1.benchmark, CAST(150.0 AS DOUBLE)) AS benchmark,
              coalesce(b1.benchmark, CAST(100.0 AS DOUBLE)) AS ref_benchmark
       FROM s LEFT JOIN bt b1 ON s.building_type_ref = b1.type_name)
"""


def factor_sql(s):
    return f"(CASE WHEN {s} IS NULL OR {s} = 0 THEN 1.0 ELSE 1.4 - {s} / 100.0 * 0.8 END)"


def pred_sql(area, bench, score):
    raw = f"greatest(({area} * {bench} * {factor_sql(score)}) / 1000.0 * 0.05, 0.1)"
    return f"(floor({raw} * 100.0 + 0.5) / 100.0)"


PRED = pred_sql("gfa_total", "benchmark", "energy_score")


def scored(spark, sf_dir):
    """Scoring view: asset + reference type + benchmarks (150 default for the
    score, 100 for report references) + heuristic prediction."""
    a = asset(spark, sf_dir).withColumn("building_type_ref", S.map_segment("property_type"))
    a = S.with_benchmark(a, "building_type_ref", S.DEFAULT_BENCHMARK,
                         extra_defaults={"ref_benchmark": S.REPORT_DEFAULT_BENCHMARK})
    return a.withColumn("prediction", S.heuristic_score("gfa_total", "benchmark", "energy_score"))


@query("benchmark_lookup", BASE_CTE + "SELECT asset_id, building_type_ref, benchmark FROM sb")
def q_benchmark_lookup(spark, sf_dir):
    a = asset(spark, sf_dir).select("asset_id", S.map_segment("property_type").alias("building_type_ref"))
    return S.with_benchmark(a, "building_type_ref")


@query("score_heuristic", BASE_CTE + f"SELECT asset_id, {PRED} AS prediction FROM sb")
def q_score_heuristic(spark, sf_dir):
    return scored(spark, sf_dir).select("asset_id", "prediction")


BATCH_PRED = pred_sql("gfa_total", "benchmark", "coalesce(energy_score, 60.0)")


@query("batch_score", BASE_CTE + f"""
SELECT asset_id, building_type_ref, 1980 AS year_built, 1 AS n_floors, {BATCH_PRED} AS prediction FROM sb""")
def q_batch_score(spark, sf_dir):
    up = asset(spark, sf_dir).select("asset_id", "gfa_total", "energy_score",
                                     S.map_segment("property_type").alias("building_type_ref"))
    return S.batch_score(up).select("asset_id", "building_type_ref", "year_built", "n_floors", "prediction")


@query("batch_summary", BASE_CTE + f"""
, p AS (SELECT {BATCH_PRED} AS prediction FROM sb)
SELECT count(*) AS n, round(avg(prediction), 4) AS mean_pred, round(sum(prediction), 4) AS sum_pred,
       round(max(prediction), 4) AS max_pred FROM p""")
def q_batch_summary(spark, sf_dir):
    up = asset(spark, sf_dir).select("gfa_total", "energy_score",
                                     S.map_segment("property_type").alias("building_type_ref"))
    return kpi.batch_summary(S.batch_score(up))


@query("batch_by_type", BASE_CTE + f"""
SELECT building_type_ref, round(sum({BATCH_PRED}), 4) AS sum_pred, count(*) AS n FROM sb GROUP BY 1""")
def q_batch_by_type(spark, sf_dir):
    up = asset(spark, sf_dir).select("gfa_total", "energy_score",
                                     S.map_segment("property_type").alias("building_type_ref"))
    return kpi.batch_by_type(S.batch_score(up), "building_type_ref")


@query("score_defaults", """
SELECT asset_id, gfa_total, energy_score, 'Office' AS building_type_ref, 1980 AS year_built, 1 AS n_floors,
       'Downtown' AS neighborhood, 47.6062 AS latitude, -122.3321 AS longitude FROM asset""")
def q_score_defaults(spark, sf_dir):
    up = asset(spark, sf_dir).select("asset_id", "gfa_total", "energy_score")
    return S.apply_defaults(up)


@query("explain_terms", """
, t AS (SELECT asset_id, unnest([
    {'idx': 0, 'feature': 'floor_area', 'impact': 0.5 * (coalesce(gfa_total, 50000.0) / 50000.0)},
    {'idx': 1, 'feature': 'usage', 'impact': 0.3},
    {'idx': 2, 'feature': 'building_age', 'impact': 0.15 * ((2026 - coalesce(year_built, 1980)) / 50.0)},
    {'idx': 3, 'feature': 'energy_score', 'impact': -0.4 * (coalesce(energy_score, 60.0) / 100.0)},
    {'idx': 4, 'feature': 'location', 'impact': 0.1}]) AS x FROM asset)
SELECT asset_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY abs(x.impact) DESC, x.idx) AS INTEGER) AS rank,
       x.feature AS feature, round(CAST(x.impact AS DOUBLE), 6) AS impact FROM t""")
def q_explain_terms(spark, sf_dir):
    out = S.explain_terms(asset(spark, sf_dir), "asset_id")
    return out.withColumn("impact", F.round("impact", 6))


@query("reliability", BASE_CTE + f"""
SELECT asset_id, {PRED} AS prediction,
  CASE WHEN coalesce(nullif(energy_score, 0), 50.0) > 75 THEN 'high'
       WHEN coalesce(nullif(energy_score, 0), 50.0) < 20 THEN 'low'
       WHEN {PRED} < 50 THEN 'high' WHEN {PRED} > 200 THEN 'medium' ELSE 'high' END AS reliability FROM sb""")
def q_reliability(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("asset_id", "prediction", S.reliability("prediction", "energy_score").alias("reliability"))


@query("score_suggestion", f"""
SELECT asset_id, {TYPE_SQL} AS building_type_ref,
  CASE {TYPE_SQL} {" ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SCORE_SUGGESTIONS.items())} ELSE 70 END AS suggested_score
FROM asset""")
def q_score_suggestion(spark, sf_dir):
    a = asset(spark, sf_dir).select("asset_id", S.map_segment("property_type").alias("building_type_ref"))
    return a.withColumn("suggested_score", S.score_suggestion("building_type_ref"))


@query("recommendations", f"""
, r AS (SELECT asset_id, list_filter([
    CASE WHEN coalesce(nullif(energy_score, 0), 50.0) < 60 THEN 'boost_energy_star' END,
    CASE WHEN contains(coalesce({TYPE_SQL}, 'Office'), 'Office') THEN 'smart_lighting' END,
    CASE WHEN contains(coalesce({TYPE_SQL}, 'Office'), 'Office') THEN 'smart_heating' END,
    CASE WHEN contains(coalesce({TYPE_SQL}, 'Office'), 'Hospital') OR contains(coalesce({TYPE_SQL}, 'Office'), 'Hotel')
         THEN 'efficient_hot_water' END, 'solar_panels', 'insulation'], lambda x: x IS NOT NULL) AS recos FROM asset)
SELECT asset_id, CAST(len(recos) AS INTEGER) AS n_recos, array_to_string(recos, '|') AS recos FROM r""")
def q_recommendations(spark, sf_dir):
    a = asset(spark, sf_dir).withColumn("building_type_ref", S.map_segment("property_type"))
    r = a.select("asset_id", S.recommendations("building_type_ref", "energy_score").alias("recos"))
    return r.select("asset_id", F.size("recos").alias("n_recos"), F.array_join("recos", "|").alias("recos"))


SUBMISSION = "gfa_total AS area, n_floors - 1 AS floors, year_built + 10 AS yr, energy_score * 1.5 - 20 AS score"


@query("validate_rules", f"""
, x AS (SELECT asset_id, {SUBMISSION} FROM asset),
v AS (SELECT asset_id, list_filter([
   CASE WHEN area IS NULL OR area <= 0 THEN 'area_nonpositive' END,
   CASE WHEN area > 10000000 THEN 'area_too_large' END,
   CASE WHEN floors IS NULL OR floors < 1 THEN 'floors_min' END,
   CASE WHEN floors > 200 THEN 'floors_max' END,
   CASE WHEN yr IS NULL OR yr < 1800 THEN 'year_min' END,
   CASE WHEN yr > 2026 THEN 'year_future' END,
   CASE WHEN score IS NOT NULL AND (score < 0 OR score > 100) THEN 'score_range' END], lambda e: e IS NOT NULL) AS vs FROM x)
SELECT asset_id, CAST(len(vs) AS INTEGER) AS n_violations, array_to_string(vs, '|') AS violations, len(vs) = 0 AS valid FROM v""")
def q_validate_rules(spark, sf_dir):
    a = asset(spark, sf_dir).select("asset_id", F.col("gfa_total").alias("area"),
                                    (F.col("n_floors") - 1).alias("floors"), (F.col("year_built") + 10).alias("yr"),
                                    (F.col("energy_score") * 1.5 - 20).alias("score"))
    v = S.validate(a, "area", "floors", "yr", "score")
    return v.select("asset_id", F.size("violations").alias("n_violations"),
                    F.array_join("violations", "|").alias("violations"), "valid")


def _whatif_sql():
    parts = []
    for name, acts, fs in SC.SCENARIOS:
        boost = sum(SC.ACTION_POINTS.get(a, 0) for a in acts)
        base_es = "(CASE WHEN energy_score IS NULL OR energy_score <= 0 THEN 50.0 ELSE energy_score END)"
        fin = f"least({base_es} + {boost}, 100.0)"
        imp = pred_sql("gfa_total", "benchmark", fin)
        imp = f"({imp} * {0.95 if 'hvac' in acts else 1.0} * {0.6 if fs else 1.0})"
        parts.append(f"SELECT asset_id, '{name}' AS scenario, {fin} AS final_es, {PRED} AS val_base, {imp} AS val_improved FROM sb")
    return BASE_CTE + ", w AS (" + " UNION ALL ".join(parts) + """)
SELECT asset_id, scenario, round(final_es, 6) AS final_es, round(val_base, 6) AS val_base, round(val_improved, 6) AS val_improved,
       round(val_base - val_improved, 6) AS savings,
       round(CASE WHEN val_base > 0 THEN (val_base - val_improved) / val_base * 100 ELSE 0.0 END, 6) AS pct_saving FROM w"""


@query("retrofit_whatif", _whatif_sql())
def q_retrofit_whatif(spark, sf_dir):
    return round_doubles(SC.retrofit_whatif(scored(spark, sf_dir), "asset_id"), 6)


@query("sensitivity_curve", BASE_CTE + f"""
, c AS (SELECT asset_id, gfa_total, benchmark, unnest(range(10, 101, 10)) AS score FROM sb)
SELECT asset_id, CAST(score AS INT) AS score, round({pred_sql('gfa_total', 'benchmark', 'score')}, 6) AS prediction FROM c""")
def q_sensitivity_curve(spark, sf_dir):
    return round_doubles(SC.sensitivity_curve(scored(spark, sf_dir), "asset_id"), 6)


REF0 = "(gfa_total * ref_benchmark / 1000.0 * 0.05)"


@query("star_rating", BASE_CTE + f"""
, x AS (SELECT asset_id, {PRED} AS prediction, CASE WHEN {REF0} < 10 THEN {PRED} * 1.1 ELSE {REF0} END AS median_ref FROM sb),
y AS (SELECT *, prediction / median_ref AS ratio,
             CASE WHEN prediction / median_ref < 0.6 THEN 5 WHEN prediction / median_ref < 0.8 THEN 4
                  WHEN prediction / median_ref < 1.0 THEN 3 WHEN prediction / median_ref < 1.3 THEN 2 ELSE 1 END AS stars FROM x),
z AS (SELECT *, median_ref * CASE stars WHEN 1 THEN 1.3 WHEN 2 THEN 1.0 WHEN 3 THEN 0.8 WHEN 4 THEN 0.6 END AS next_target FROM y)
SELECT asset_id, round(prediction, 6) AS prediction, round(median_ref, 6) AS median_ref, round(ratio, 6) AS ratio, stars,
       round(next_target, 6) AS next_target, round(prediction - next_target, 6) AS reduction_needed,
       round(median_ref * 0.6, 6) AS top_perf FROM z""")
def q_star_rating(spark, sf_dir):
    return round_doubles(SC.star_rating(scored(spark, sf_dir), "asset_id", bench="ref_benchmark"), 6)


@query("pathway_2050", BASE_CTE + f"""
, x AS (SELECT asset_id, {PRED} AS p, ref_benchmark * (gfa_total / 1000.0 * 0.05) AS base FROM sb)
SELECT asset_id, round(p, 6) AS prediction, round(base * 0.7, 6) AS target_2030, round(base * 0.4, 6) AS target_2040,
       round(greatest(p - p, 0) + greatest(p - base * 0.7, 0) + greatest(p - base * 0.4, 0) + greatest(p - 0.0, 0), 6) AS excess_total,
       p <= base * 0.7 AS compliant FROM x""")
def q_pathway_2050(spark, sf_dir):
    return round_doubles(SC.pathway_2050(scored(spark, sf_dir), "asset_id", bench="ref_benchmark"), 6)


@query("audit_figures", BASE_CTE + f"""
, x AS (SELECT asset_id, {PRED} AS prediction, CASE WHEN {REF0} < 10 THEN {PRED} * 1.2 ELSE {REF0} END AS median_ref FROM sb),
y AS (SELECT *, (prediction - median_ref) / median_ref * 100 AS gap_pct FROM x)
SELECT asset_id, round(prediction, 6) AS prediction, round(median_ref, 6) AS median_ref, round(gap_pct, 6) AS gap_pct,
       round(prediction * 0.25, 6) AS savings, round(prediction * 0.25 * 100.0, 6) AS financial,
       CASE WHEN gap_pct > 10 THEN 'under_performing' WHEN gap_pct > -10 THEN 'aligned' ELSE 'efficient' END AS status FROM y""")
def q_audit_figures(spark, sf_dir):
    return round_doubles(SC.audit_figures(scored(spark, sf_dir), "asset_id", bench="ref_benchmark"), 6)


@query("baseline_first", """
SELECT user_id, max(CASE WHEN rn = 1 THEN value END) AS baseline, epoch_us(min(ts)) AS first_ts_us, count(*) AS n_events
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY user_id""",
       raw_sql=True)
def q_baseline_first(spark, sf_dir):
    from ..sources.tables import read_table
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])
    out = SC.baseline_first(ev)
    # Microseconds since the epoch of a TIMESTAMP_NTZ: a difference of two NTZ
    # values, independent of the session time zone.
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    first_us = F.timestamp_diff("MICROSECOND", epoch, F.col("first_ts").cast("timestamp_ntz"))
    return out.select("user_id", "baseline", first_us.alias("first_ts_us"), "n_events")


@query("reliability_v2", """
SELECT asset_id, CASE WHEN coalesce(energy_score, 50.0) > 75 THEN 'high' WHEN coalesce(energy_score, 50.0) < 20 THEN 'low'
                      ELSE 'medium' END AS reliability FROM asset""")
def q_reliability_v2(spark, sf_dir):
    return asset(spark, sf_dir).select("asset_id", S.reliability_v2("energy_score").alias("reliability"))


@query("smart_suggestions", f"""
, r AS (SELECT asset_id, list_filter(['check_insulation', 'optimise_hvac',
    CASE WHEN contains(coalesce({TYPE_SQL}, ''), 'Office') THEN 'presence_detectors' END,
    CASE WHEN contains(coalesce({TYPE_SQL}, ''), 'Hospital') OR contains(coalesce({TYPE_SQL}, ''), 'Hotel')
         THEN 'hot_water_management' END], lambda x: x IS NOT NULL) AS s FROM asset)
SELECT asset_id, CAST(len(s) AS INTEGER) AS n_suggestions, array_to_string(s, '|') AS suggestions FROM r""")
def q_smart_suggestions(spark, sf_dir):
    a = asset(spark, sf_dir).withColumn("building_type_ref", S.map_segment("property_type"))
    s = a.select("asset_id", S.smart_suggestions("building_type_ref").alias("s"))
    return s.select("asset_id", F.size("s").alias("n_suggestions"), F.array_join("s", "|").alias("suggestions"))


@query("decarbonisation_plan", BASE_CTE + ", p AS (SELECT asset_id, " + PRED + " AS p FROM sb) " + " UNION ALL ".join(
    f"SELECT asset_id, {i} AS idx, '{c}' AS action, CAST(trunc(p * {share}) AS BIGINT) AS gain_t, '{cost}' AS cost FROM p"
    for i, (c, share, cost) in enumerate(S.DECARBONISATION_ACTIONS)))
def q_decarbonisation_plan(spark, sf_dir):
    return S.decarbonisation_plan(scored(spark, sf_dir), "asset_id")
