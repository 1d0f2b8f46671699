"""Portfolio KPIs and group profiles (one aggregation per call)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_, dlit, title_case, value_map
from ..functions.quantiles import medians

# Spelling fixes applied after title-casing neighbourhood names.
NEIGHBORHOOD_FIXES = {
    "Delridge Neighborhoods": "Delridge",
    "Magnolia / Queen Anne": "Magnolia / Queen Anne",
}


# Substring rules of the csv-module variant (later rules win).
NEIGHBORHOOD_SUBSTRING_RULES = [("Delridge", "Delridge"), ("Magnolia", "Magnolia / Queen Anne")]


def substring_label(c, rules=None):
    """Title-case, then every rule whose needle occurs replaces the label; a
    later matching rule overrides an earlier one (sequential ``if``s)."""
    x = title_case(c)
    out = x
    for needle, label in (NEIGHBORHOOD_SUBSTRING_RULES if rules is None else rules):
        out = F.when(x.contains(needle), F.lit(label)).otherwise(out)
    return out


def normalise_label(c, mapping: dict | None = None):
    return value_map(title_case(c), NEIGHBORHOOD_FIXES if mapping is None else mapping)


def neighborhood_profile(df: DataFrame, raw_col: str = "neighborhood_raw",
                         lat="latitude", lon="longitude", target="emissions",
                         area="gfa_total", year="year_built", floors="n_floors",
                         mapping: dict | None = None) -> DataFrame:
    """Per normalised neighbourhood: mean position, mean target, count,
    truncated mean area and year, mean floors."""
    return (df.groupBy(normalise_label(raw_col, mapping).alias("neighborhood"))
              .agg(F.round(F.avg(lat), 4).alias("lat"),
                   F.round(F.avg(lon), 4).alias("lon"),
                   F.round(F.avg(target), 1).alias("avg_co2"),
                   F.count(F.lit(1)).alias("count"),
                   F.avg(area).cast("bigint").alias("avg_gfa"),
                   F.avg(year).cast("bigint").alias("avg_year"),
                   F.round(F.avg(floors), 1).alias("avg_floors")))


def type_benchmark(df: DataFrame, type_col="property_type", target="emissions",
                   top: int | None = 10) -> DataFrame:
    """Mean target per type, 1 dp, ranked descending (top-k report)."""
    out = (df.groupBy(type_col)
             .agg(F.round(F.avg(target), 1).alias("avg_co2"),
                  F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("avg_co2"), F.asc(type_col)))
    return out.limit(top) if top else out


def city_kpis(df: DataFrame, target="emissions", score="energy_score") -> DataFrame:
    """Rows, mean and median of target, mean score ignoring nulls."""
    mid = medians(df, [target])[target]
    return df.agg(F.count(F.lit(1)).alias("total_buildings"),
                  F.round(F.avg(target), 4).alias("mean_co2"),
                  F.round(F.lit(mid).cast("double"), 6).alias("median_co2"),
                  F.round(F.avg(score), 4).alias("avg_energy_star"))


def weighted_kpi(group_profile: DataFrame, mean_col="avg_co2", n_col="count",
                 key_col: str | None = None, keys: list | None = None) -> DataFrame:
    """Re-aggregate group means: sum(mean*n)/sum(n); empty selection -> 0."""
    g = group_profile
    if key_col and keys:
        g = g.filter(F.col(key_col).isin(keys))
    return g.agg(F.round(F.coalesce(F.try_divide(F.sum(F.col(mean_col) * F.col(n_col)),
                                                 F.sum(n_col).cast("double")), dlit(0.0)), 4)
                 .alias("weighted_mean"),
                 F.coalesce(F.sum(n_col), F.lit(0)).cast("bigint").alias("n"))


def drift_summary(df: DataFrame, subset, cols: list[str]) -> DataFrame:
    """Subset-vs-whole means and % difference, all in one pass; one row per column."""
    s = col_(subset)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__all"), F.avg(F.when(s, F.col(c))).alias(f"{c}__sub")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__sub").alias("mean_subset"),
                     F.col(f"{c}__all").alias("mean_all")) for c in cols]
    long = wide.select(F.inline(F.array(*rows)))
    return long.select("column", F.round("mean_subset", 4).alias("mean_subset"),
                       F.round("mean_all", 4).alias("mean_all"),
                       F.round(F.abs(F.col("mean_all") - F.col("mean_subset")), 4).alias("abs_diff"),
                       F.round(F.try_divide(F.col("mean_all") - F.col("mean_subset"),
                                            F.col("mean_subset")) * 100, 4).alias("pct_diff"))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(c))


def avg_by_category(df: DataFrame, cat: str, target="emissions") -> DataFrame:
    return (df.groupBy(cat).agg(F.round(F.avg(target), 4).alias("avg_target"),
                                F.count(F.lit(1)).alias("n"))
              .orderBy("avg_target", cat))


def flag_prevalence(df: DataFrame, flags: list[str]) -> DataFrame:
    """% of rows with each binary flag set; one row per flag."""
    wide = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.round(F.col(f) * 100, 4).alias("pct")) for f in flags])))


def split_balance(df: DataFrame, split_col="split", target="emissions", score="energy_score") -> DataFrame:
    return df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.log1p(target)), 4).alias("mean_log_target"),
        F.sum(F.col(score).isNull().cast("int")).cast("bigint").alias("null_score"))


def map_points(df: DataFrame, raw_col="neighborhood_raw", keys: list | None = None) -> DataFrame:
    prof = neighborhood_profile(df, raw_col)
    if keys:
        prof = prof.filter(F.col("neighborhood").isin(keys))
    return prof.select("neighborhood", "lat", "lon", "avg_co2", "count")


def raw_points(df: DataFrame, lat="latitude", lon="longitude", target="emissions",
               hover: tuple = ("building_type", "year_built", "energy_score")) -> DataFrame:
    """Every asset as a point of the map: place, colour (the target), size (the
    target, not below 0) and hover columns. Rows without a place have no point."""
    return (df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
              .select("asset_id", lat, lon, F.col(target).alias("color"),
                      F.greatest(F.coalesce(F.col(target), F.lit(0.0)), F.lit(0.0)).alias("size"), *hover))


def batch_summary(scored: DataFrame, pred="prediction") -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("n"),
                      F.round(F.avg(pred), 4).alias("mean_pred"),
                      F.round(F.sum(pred), 4).alias("sum_pred"),
                      F.round(F.max(pred), 4).alias("max_pred"))


def batch_by_type(scored: DataFrame, type_col="property_type", pred="prediction") -> DataFrame:
    return (scored.groupBy(type_col).agg(F.round(F.sum(pred), 4).alias("sum_pred"),
                                         F.count(F.lit(1)).alias("n"))
                  .orderBy(F.desc("sum_pred")))
