"""Registered KPI / group-profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpi
from .common import SQL_TRAIN, asset, is_train
from .registry import query
from .sqlfrag import nbh_clean

NBH_SQL = f"""
, prof AS (
  SELECT {nbh_clean('neighborhood_raw')} AS neighborhood,
         round(avg(latitude), 4) AS lat, round(avg(longitude), 4) AS lon,
         round(avg(emissions), 1) AS avg_co2, count(*) AS count,
         CAST(trunc(avg(gfa_total)) AS BIGINT) AS avg_gfa,
         CAST(trunc(avg(year_built)) AS BIGINT) AS avg_year,
         round(avg(n_floors), 1) AS avg_floors
  FROM asset GROUP BY 1)
"""


@query("neighborhood_profile", NBH_SQL + "SELECT * FROM prof")
def q_neighborhood_profile(spark, sf_dir):
    return kpi.neighborhood_profile(asset(spark, sf_dir))


@query("type_benchmark", """
SELECT property_type, round(avg(emissions), 1) AS avg_co2, count(*) AS n
FROM asset GROUP BY property_type ORDER BY avg_co2 DESC, property_type LIMIT 10""")
def q_type_benchmark(spark, sf_dir):
    return kpi.type_benchmark(asset(spark, sf_dir))


@query("city_kpis", """
SELECT count(*) AS total_buildings, round(avg(emissions), 4) AS mean_co2,
       round(median(emissions), 6) AS median_co2, round(avg(energy_score), 4) AS avg_energy_star
FROM asset""")
def q_city_kpis(spark, sf_dir):
    return kpi.city_kpis(asset(spark, sf_dir))


WEIGHTED_KEYS = ["Nation_1", "Nation_2", "Nation_3", "Nation_4"]


@query("weighted_kpi", NBH_SQL + """
SELECT round(coalesce(sum(avg_co2 * count) / sum(count), 0.0), 4) AS weighted_mean,
       CAST(coalesce(sum(count), 0) AS BIGINT) AS n
FROM prof WHERE neighborhood IN ('Nation_1', 'Nation_2', 'Nation_3', 'Nation_4')""")
def q_weighted_kpi(spark, sf_dir):
    prof = kpi.neighborhood_profile(asset(spark, sf_dir))
    return kpi.weighted_kpi(prof, key_col="neighborhood", keys=WEIGHTED_KEYS)


@query("drift_summary", f"""
, w AS (SELECT avg(emissions) AS e_all, avg(CASE WHEN {SQL_TRAIN} THEN emissions END) AS e_sub,
               avg(energy_score) AS s_all, avg(CASE WHEN {SQL_TRAIN} THEN energy_score END) AS s_sub
        FROM asset),
l AS (SELECT 'emissions' AS "column", e_sub AS ms, e_all AS ma FROM w
      UNION ALL SELECT 'energy_score', s_sub, s_all FROM w)
SELECT "column", round(ms, 4) AS mean_subset, round(ma, 4) AS mean_all,
       round(abs(ma - ms), 4) AS abs_diff, round((ma - ms) / ms * 100, 4) AS pct_diff FROM l""")
def q_drift_summary(spark, sf_dir):
    return kpi.drift_summary(asset(spark, sf_dir), is_train(), ["emissions", "energy_score"])


@query("value_counts", """
SELECT building_type, count(*) AS n FROM asset GROUP BY building_type ORDER BY n DESC, building_type""")
def q_value_counts(spark, sf_dir):
    return kpi.value_counts(asset(spark, sf_dir), "building_type")


@query("avg_by_category", """
SELECT property_type, round(avg(emissions), 4) AS avg_target, count(*) AS n
FROM asset GROUP BY property_type ORDER BY avg_target, property_type""")
def q_avg_by_category(spark, sf_dir):
    return kpi.avg_by_category(asset(spark, sf_dir), "property_type")


@query("flag_prevalence", """
, w AS (SELECT avg(CAST(steam_kbtu > 0 AS DOUBLE)) AS s, avg(CAST(gas_therms > 0 AS DOUBLE)) AS g FROM asset)
SELECT 'has_steam' AS flag, round(s * 100, 4) AS pct FROM w
UNION ALL SELECT 'has_gas', round(g * 100, 4) FROM w""")
def q_flag_prevalence(spark, sf_dir):
    a = asset(spark, sf_dir).select((F.col("steam_kbtu") > 0).cast("int").alias("has_steam"),
                                    (F.col("gas_therms") > 0).cast("int").alias("has_gas"))
    return kpi.flag_prevalence(a, ["has_steam", "has_gas"])


@query("split_balance", f"""
SELECT CASE WHEN {SQL_TRAIN} THEN 'train' ELSE 'test' END AS split, count(*) AS n,
       round(avg(ln(1 + emissions)), 4) AS mean_log_target,
       CAST(sum(CAST(energy_score IS NULL AS INT)) AS BIGINT) AS null_score
FROM asset GROUP BY 1""")
def q_split_balance(spark, sf_dir):
    a = asset(spark, sf_dir).withColumn(
        "split", F.when(is_train(), F.lit("train")).otherwise(F.lit("test")))
    return kpi.split_balance(a)


@query("map_points", NBH_SQL + """
SELECT neighborhood, lat, lon, avg_co2, count FROM prof
WHERE neighborhood IN ('Nation_1', 'Nation_2', 'Nation_3', 'Nation_4')""")
def q_map_points(spark, sf_dir):
    return kpi.map_points(asset(spark, sf_dir), keys=WEIGHTED_KEYS)


@query("map_points_raw", """
SELECT asset_id, latitude, longitude, emissions AS color, greatest(coalesce(emissions, 0.0), 0.0) AS size,
       building_type, year_built, energy_score
FROM asset WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def q_map_points_raw(spark, sf_dir):
    return kpi.raw_points(asset(spark, sf_dir))
