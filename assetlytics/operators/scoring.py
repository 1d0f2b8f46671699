"""Set-at-a-time scoring: heuristic emissions score, explanation terms,
reliability labels, suggestions, recommendations and input validation.
Reference tables are small fixed DataFrames joined with a broadcast hint
(their size is fixed by definition, not by the data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import col_, dlit
from ..sources.uploads import decode_uploads

# Emissions benchmark per building type (tonnes per 1000 sqft
# basis used by the heuristic score).
BUILDING_TYPE_BENCHMARKS = {
    "Hospital": 509.3, "Laboratory": 438.4, "Senior Care Community": 275.0, "Hotel": 256.1,
    "University": 232.6, "Supermarket / Grocery Store": 222.7, "Large Office": 192.3,
    "Restaurant": 188.6, "Medical Office": 173.2, "Other": 145.6, "Mixed Use Property": 135.8,
    "Residence Hall": 101.3, "K-12 School": 89.4, "Retail Store": 87.3, "Distribution Center": 50.4,
    "Warehouse": 42.7, "Worship Facility": 42.3, "Small- and Mid-Sized Office": 40.5,
    "Refrigerated Warehouse": 37.6, "Self-Storage Facility": 24.6, "Low-Rise Multifamily": 19.1,
    "Office": 10.8,
}

# Heuristic score constants.
CO2_CONVERSION_FACTOR = 0.05
ENERGY_STAR_IMPACT_WEIGHT = 0.8
ENERGY_STAR_BASE_FACTOR = 1.4
DEFAULT_BENCHMARK = 150.0
REPORT_DEFAULT_BENCHMARK = 100.0

# Target Energy Star score suggestion per type (default 70).
SCORE_SUGGESTIONS = {
    "Hospital": 78, "Hotel": 65, "Large Office": 82, "Office": 75, "K-12 School": 85,
    "University": 70, "Warehouse": 60, "Retail Store": 68, "Restaurant": 55,
}
DEFAULT_SUGGESTION = 70

# Defaults of an absent scoring field.
SCORING_DEFAULTS = {
    "gfa_total": 50000.0, "building_type_ref": "Office", "year_built": 1980, "n_floors": 1,
    "energy_score": 60.0, "neighborhood": "Downtown", "latitude": 47.6062, "longitude": -122.3321,
}

# The asset fixture's market segments stand in for building types
# (MACHINERY is intentionally unmapped: it exercises the default benchmark).
SEGMENT_TO_TYPE = {"AUTOMOBILE": "Large Office", "BUILDING": "Office", "FURNITURE": "Retail Store",
                   "HOUSEHOLD": "Warehouse"}


def benchmark_table(spark: SparkSession, table: dict | None = None) -> DataFrame:
    t = table or BUILDING_TYPE_BENCHMARKS
    return spark.createDataFrame(sorted(t.items()), "type_name string, benchmark double")


def with_benchmark(df: DataFrame, type_col: str, default: float = DEFAULT_BENCHMARK,
                   table: dict | None = None, out: str = "benchmark", extra_defaults: dict | None = None) -> DataFrame:
    """Left lookup on the fixed benchmark table (22 rows: broadcast) with a
    default; ``extra_defaults`` ({column: default}) derives more columns from
    the same single join."""
    bt = F.broadcast(benchmark_table(df.sparkSession, table).withColumnRenamed("benchmark", "_bench"))
    j = df.join(bt, F.col(type_col) == bt.type_name, "left")
    outs = {out: F.coalesce(F.col("_bench"), F.lit(default))}
    outs.update({k: F.coalesce(F.col("_bench"), F.lit(v)) for k, v in (extra_defaults or {}).items()})
    return j.withColumns(outs).drop("type_name", "_bench")


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: half-up on the binary value, computed
    with the same IEEE operations in any engine (stable across engines)."""
    k = float(10 ** digits)
    return F.floor(x * F.lit(k) + F.lit(0.5)) / F.lit(k)


def map_segment(c="property_type") -> Column:
    m = F.create_map(*[F.lit(x) for kv in SEGMENT_TO_TYPE.items() for x in kv])
    return F.coalesce(m[col_(c)], col_(c))


def score_factor(score) -> Column:
    """1.4 - 0.8*score/100, or 1.0 when the score is NULL or 0 (falsy)."""
    s = col_(score).cast("double")
    return F.when(s.isNull() | (s == 0), dlit(1.0)).otherwise(
        F.lit(ENERGY_STAR_BASE_FACTOR) - s / F.lit(100.0) * F.lit(ENERGY_STAR_IMPACT_WEIGHT))


def heuristic_score(area, bench, score, digits: int | None = 2) -> Column:
    """round(max(area*bench*f/1000*0.05, 0.1), 2)."""
    raw = (col_(area).cast("double") * col_(bench) * score_factor(score)) / F.lit(1000.0) * F.lit(CO2_CONVERSION_FACTOR)
    v = F.greatest(raw, dlit(0.1))
    return round_half_up(v, digits) if digits is not None else v


def score_heuristic(df: DataFrame, type_col="building_type_ref", area="gfa_total",
                    score="energy_score") -> DataFrame:
    b = with_benchmark(df, type_col)
    return b.withColumn("prediction", heuristic_score(area, "benchmark", score))


def apply_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Absent columns take the default; present ones keep their values."""
    d = defaults or SCORING_DEFAULTS
    return df.withColumns({k: F.lit(v) for k, v in d.items() if k not in df.columns})


def batch_score(df: DataFrame, required=("gfa_total", "building_type_ref")) -> DataFrame:
    """Score a whole uploaded table: contract check on required columns,
    defaults for absent ones, NULL score -> 60, one plan (no row loop)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    x = apply_defaults(df).withColumn("energy_score", F.coalesce(F.col("energy_score").cast("double"),
                                                                 F.lit(SCORING_DEFAULTS["energy_score"])))
    return score_heuristic(x)


def score_uploads(uploads: DataFrame, schema: str, required=("gfa_total", "building_type_ref")) -> DataFrame:
    """Encoded uploads (upload_id, contents) scored by the contract and plan of
    ``batch_score``: upload_id, asset_id, problem, prediction; rows with a
    problem have no prediction."""
    rows = decode_uploads(uploads, StructType.fromDDL(schema), list(required))
    scored = batch_score(rows, required)
    return scored.select("upload_id", "asset_id", "problem", F.when(F.col("problem").isNull(), F.col("prediction")).alias("prediction"))


# Labels of the additive explanation terms.
EXPLAIN_TERMS = ["floor_area", "usage", "building_age", "energy_score", "location"]


def explain_terms(df: DataFrame, key: str, area="gfa_total", score="energy_score", year="year_built",
                  reference_year: int = 2026) -> DataFrame:
    """Five weighted terms per row, ranked by |impact| (stable on ties)."""
    a = F.coalesce(col_(area).cast("double"), F.lit(50000.0))
    s = F.coalesce(col_(score).cast("double"), F.lit(60.0))
    y = F.coalesce(col_(year).cast("int"), F.lit(1980))
    impacts = [F.lit(0.5) * (a / 50000.0), F.lit(0.3), F.lit(0.15) * ((F.lit(reference_year) - y) / 50.0),
               F.lit(-0.4) * (s / 100.0), F.lit(0.1)]
    arr = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("feature"), v.cast("double").alias("impact"))
                    for i, (n, v) in enumerate(zip(EXPLAIN_TERMS, impacts))])
    srt = F.array_sort(arr, lambda l, r: F.when(F.abs(l.impact) > F.abs(r.impact), -1)
                       .when(F.abs(l.impact) < F.abs(r.impact), 1)
                       .otherwise(F.when(l.idx < r.idx, -1).when(l.idx > r.idx, 1).otherwise(0)))
    return df.select(key, F.posexplode(srt).alias("pos", "t")).select(
        key, (F.col("pos") + 1).alias("rank"), F.col("t.feature").alias("feature"),
        F.col("t.impact").alias("impact"))


def reliability(pred, score) -> Column:
    """Score (0/NULL -> 50) > 75 -> high, < 20 -> low; else prediction
    < 50 -> high, > 200 -> medium, otherwise high."""
    s = F.when(col_(score).isNull() | (col_(score) == 0), F.lit(50.0)).otherwise(col_(score).cast("double"))
    p = col_(pred)
    return (F.when(s > 75, "high").when(s < 20, "low").when(p < 50, "high")
             .when(p > 200, "medium").otherwise("high"))


def score_suggestion(type_col) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SCORE_SUGGESTIONS.items() for x in kv])
    return F.coalesce(m[col_(type_col)], F.lit(DEFAULT_SUGGESTION))


# Recommendation codes, in the order they are emitted.
RECO_BOOST, RECO_LIGHTING, RECO_HEATING, RECO_HOT_WATER, RECO_SOLAR, RECO_INSULATION = (
    "boost_energy_star", "smart_lighting", "smart_heating", "efficient_hot_water", "solar_panels",
    "insulation")


def recommendations(type_col, score) -> Column:
    """Rule list per building: score (0/NULL -> 50) < 60 -> boost; office ->
    lighting + heating; hospital/hotel -> hot water; always solar + insulation."""
    t = F.coalesce(col_(type_col), F.lit("Office"))
    s = F.when(col_(score).isNull() | (col_(score) == 0), F.lit(50.0)).otherwise(col_(score).cast("double"))
    office = t.contains("Office")
    items = [F.when(s < 60, F.lit(RECO_BOOST)), F.when(office, F.lit(RECO_LIGHTING)),
             F.when(office, F.lit(RECO_HEATING)),
             F.when(t.contains("Hospital") | t.contains("Hotel"), F.lit(RECO_HOT_WATER)),
             F.lit(RECO_SOLAR), F.lit(RECO_INSULATION)]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


# Validation limits.
VALIDATION_RULES = [
    ("area_nonpositive", lambda a, f, y, s: a.isNull() | (a <= 0)),
    ("area_too_large", lambda a, f, y, s: a > 10_000_000),
    ("floors_min", lambda a, f, y, s: f.isNull() | (f < 1)),
    ("floors_max", lambda a, f, y, s: f > 200),
    ("year_min", lambda a, f, y, s: y.isNull() | (y < 1800)),
    ("year_future", lambda a, f, y, s: y > 2026),
    ("score_range", lambda a, f, y, s: s.isNotNull() & ((s < 0) | (s > 100))),
]


def validate(df: DataFrame, area="gfa_total", floors="n_floors", year="year_built", score="energy_score") -> DataFrame:
    """All violated rules as an array<string>; valid iff empty. The
    ``elif`` pairs in the rules are exclusive because their ranges are."""
    a, f, y, s = col_(area), col_(floors), col_(year), col_(score)
    arr = F.filter(F.array(*[F.when(rule(a, f, y, s), F.lit(name)) for name, rule in VALIDATION_RULES]),
                   lambda x: x.isNotNull())
    return df.withColumn("violations", arr).withColumn("valid", F.size("violations") == 0)


def reliability_v2(score) -> Column:
    """Three-level reliability from the score alone (NULL -> 50)."""
    s = F.coalesce(col_(score).cast("double"), F.lit(50.0))
    return F.when(s > 75, "high").when(s < 20, "low").otherwise("medium")


# Suggestion codes, in the order they are emitted.
SUGGESTION_CODES = ("check_insulation", "optimise_hvac", "presence_detectors", "hot_water_management")


def smart_suggestions(type_col) -> Column:
    """Two generic suggestions, plus one for offices and one for hospitals/hotels."""
    t = F.coalesce(col_(type_col), F.lit(""))
    items = [F.lit(SUGGESTION_CODES[0]), F.lit(SUGGESTION_CODES[1]),
             F.when(t.contains("Office"), F.lit(SUGGESTION_CODES[2])),
             F.when(t.contains("Hospital") | t.contains("Hotel"), F.lit(SUGGESTION_CODES[3]))]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


# Decarbonisation actions (code, share of current emissions, cost band).
DECARBONISATION_ACTIONS = [("deep_retrofit", 0.20, "$$$"), ("leds_smart_building", 0.05, "$"),
                           ("solar_panels", 0.15, "$$")]


def decarbonisation_plan(df: DataFrame, key: str, pred="prediction") -> DataFrame:
    """One row per building and action: whole tonnes saved (truncated) and cost band."""
    arr = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(c).alias("action"), F.lit(p).alias("share"),
                             F.lit(cost).alias("cost")) for i, (c, p, cost) in enumerate(DECARBONISATION_ACTIONS)])
    x = df.select(key, col_(pred).cast("double").alias("_p"), F.explode(arr).alias("a"))
    return x.select(key, F.col("a.idx").alias("idx"), F.col("a.action").alias("action"),
                    (F.col("_p") * F.col("a.share")).cast("bigint").alias("gain_t"), F.col("a.cost").alias("cost"))
