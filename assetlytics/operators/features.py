"""Feature engineering from declarative specs: every builder returns the
input frame plus new ``Column`` expressions (one projection, no UDF)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import floor_at, safe_ratio
from ..functions.joins import checked_broadcast, lookup_join
from ..functions.quantiles import quantile_table
from .profile import numeric_mode


def ratio_features(df: DataFrame, defs: dict) -> DataFrame:
    """name -> (numerator, denominator): a / (b + 1e-6), +-inf -> NULL."""
    new = {k: safe_ratio(a, b) for k, (a, b) in defs.items() if a in df.columns and b in df.columns}
    return df.withColumns(new) if new else df


def interaction_features(df: DataFrame, defs: dict) -> DataFrame:
    new = {k: F.col(a) * F.col(b) for k, (a, b) in defs.items() if a in df.columns and b in df.columns}
    return df.withColumns(new) if new else df


def temporal_features(df: DataFrame, reference_year: int = 2016, year_col: str = "year_built",
                      old_after: int = 50) -> DataFrame:
    """building_age = max(ref - year, 0), its square and an old-building flag."""
    if year_col not in df.columns:
        return df
    age = floor_at(F.lit(reference_year) - F.col(year_col), 0)
    df = df.withColumn("building_age", age)
    return df.withColumns({"building_age_squared": F.pow(F.col("building_age"), 2),
                           "is_old_building": F.coalesce((F.col("building_age") > old_after).cast("int"),
                                                         F.lit(0))})


def polynomial_features(df: DataFrame, defs: dict) -> DataFrame:
    """name -> (source, power); base clipped at 0 when power < 1."""
    new = {}
    for k, (src, pw) in defs.items():
        if src in df.columns:
            base = floor_at(F.col(src).cast("double"), 0.0) if pw < 1 else F.col(src).cast("double")
            new[k] = F.pow(base, F.lit(float(pw)))
    return df.withColumns(new) if new else df


def all_features(df: DataFrame, ratio_defs=None, interaction_defs=None, polynomial_defs=None,
                 reference_year: int = 2016) -> DataFrame:
    """ratio -> temporal -> interaction -> polynomial (later specs may use
    earlier outputs, e.g. an interaction on building_age)."""
    if ratio_defs:
        df = ratio_features(df, ratio_defs)
    df = temporal_features(df, reference_year)
    if interaction_defs:
        df = interaction_features(df, interaction_defs)
    if polynomial_defs:
        df = polynomial_features(df, polynomial_defs)
    return df


# ------------------------------------------------- per-group target statistics
_AGGS = {"mean": F.avg, "median": None, "std": F.stddev_samp}


@dataclass
class GroupStats:
    target: str
    tables: dict = field(default_factory=dict)   # group col -> DataFrame(g, g_mean, ...)
    global_mean: float | None = None


def fit_aggregated_features(df: DataFrame, target: str, group_cols: list[str],
                            aggs: list[str] = ("mean", "median", "std")) -> GroupStats:
    """One groupBy per group column; unknown aggregate names are skipped
    (``count`` is accepted but, as in the reference, not stored)."""
    use = [a for a in aggs if a in _AGGS]
    out = GroupStats(target)
    for g in group_cols:
        if g not in df.columns or not use:
            continue
        x = F.col(target).cast("double")
        t = df.groupBy(g).agg(F.count(F.lit(1)).alias("__n"), *[_AGGS[a](x).alias(f"{g}_{a}") for a in use if _AGGS[a]])
        if "median" in use:
            mid = quantile_table(df, {target: target}, [0.5], [g]).select(F.col(g).alias("__g"), F.col("q0").alias(f"{g}_median"))
            t = t.join(mid, F.col(g).eqNullSafe(F.col("__g")), "left").drop("__g")
        out.tables[g] = t.select(g, *[f"{g}_{a}" for a in use])
    out.global_mean = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
    return out


def transform_aggregated_features(df: DataFrame, p: GroupStats) -> DataFrame:
    """Left lookup join per group column (size-checked broadcast); unknown
    group or NULL statistic -> global mean."""
    for g, t in p.tables.items():
        if g not in df.columns:
            continue
        stats = [c for c in t.columns if c != g]
        df = lookup_join(df, t, g, "left")
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(p.global_mean)) for c in stats})
    return df


# ------------------------------------------------------------ binary flags
def fit_binary_flags(df: DataFrame, mapping: dict) -> dict:
    """flag -> source: mode of (source > 0) over non-null sources (0 on ties /
    no data)."""
    present = {k: v for k, v in mapping.items() if v in df.columns}
    if not present:
        return {}
    flags = df.select(*[F.when(F.col(src).isNull(), F.lit(None)).otherwise((F.col(src) > 0).cast("int"))
                        .alias(k) for k, src in present.items()])
    modes = {r["column"]: int(r["mode"]) for r in numeric_mode(flags, list(present)).collect()}
    return {k: (src, modes.get(k, 0)) for k, src in present.items()}


def binary_flag_columns(params: dict) -> list:
    return [F.coalesce((F.col(src) > 0).cast("int"), F.lit(mode)).alias(k)
            for k, (src, mode) in params.items()]


def transform_binary_flags(df: DataFrame, params: dict, keep: list[str] = ()) -> DataFrame:
    return df.select(*keep, *binary_flag_columns(params))


# ------------------------------------------------------ scoring-time features
# Fixed value: the mean that stands for an unknown neighbourhood or type.
DEFAULT_MEAN = 115.6


def score_features(df: DataFrame, area="gfa_total", year="year_built", floors="n_floors",
                   reference_year: int = 2016, old_after: int = 30, score="energy_score", type_col="property_type",
                   neighborhood="neighborhood", neighborhood_means: DataFrame | None = None, type_means: dict | None = None) -> DataFrame:
    """Derived fields used when scoring a building without metered data. Age is
    counted from the year of the data and not clipped. ``neighborhood_means``
    (neighborhood, avg_co2) is a lookup table, its default row ``DEFAULT_MEAN``."""
    a, y = F.col(area).cast("double"), F.col(year).cast("int")
    fl = F.greatest(F.coalesce(F.col(floors).cast("int"), F.lit(1)), F.lit(1))
    age = F.lit(reference_year) - y
    if neighborhood_means is not None:
        means = neighborhood_means.select(F.col("neighborhood").alias("__nbh"), F.col("avg_co2").cast("double").alias("__mean"))
        df = df.join(checked_broadcast(means), F.col(neighborhood) == F.col("__nbh"), "left").drop("__nbh")
    else:
        df = df.withColumn("__mean", F.lit(None).cast("double"))
    by_type = F.lit(None).cast("double")
    for name, mean in sorted((type_means or {}).items()):
        by_type = F.when(F.col(type_col) == name, F.lit(float(mean))).otherwise(by_type)
    # What a form leaves open.
    fixed = {"n_buildings": 1, "parking_area": 0.0, "steam_kbtu_est": 0.0, "second_use_type": "Parking", "second_use_gfa": 0.0,
             "parking_ratio": 0.0, "building_class": "NonResidential", "neighborhood_std": 50.0, "type_std": 80.0}
    return df.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumns({
        "score_or_default": F.coalesce(F.col(score).cast("double"), F.lit(60.0)),
        "building_gfa": a,
        "largest_use_gfa": a,
        "age_squared": F.pow(age, 2),
        "neighborhood_mean": F.coalesce("__mean", F.lit(DEFAULT_MEAN)),
        "type_mean": F.coalesce(by_type, F.lit(DEFAULT_MEAN)),
        "est_electricity_kwh": a * 10.0,
        "est_gas_therms": a * 0.5,
        "building_age": age,
        "is_old": (age > old_after).cast("int"),
        "gfa_per_floor": a / fl,
        "size_floors": a * fl,
        "age_size": age * a,
        "age_floors": age * fl,
        "gfa_sqrt": F.sqrt(F.greatest(a, F.lit(0.0))),
        "floors_squared": F.pow(fl, 2),
    }).drop("__mean")
