"""Scenario operators over scored buildings: retrofit what-if, sensitivity
curve, star rating, 2050 pathway, audit figures, first-prediction baseline.

Scenario fan-out uses ``explode`` over a fixed literal array inside the row's
projection (no join, no cross product); per-building aggregates over the
generated array use the ``aggregate`` higher-order function (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_, dlit
from .scoring import CO2_CONVERSION_FACTOR, heuristic_score

# Energy Star points per retrofit action.
ACTION_POINTS = {"led": 8, "hvac": 15, "windows": 10, "solar": 12, "gtb": 5}
HVAC_TECH_BONUS = 0.95
FUEL_SWITCH_FACTOR = 0.6

# Scenarios evaluated by the registered what-if query.
SCENARIOS = [
    ("led", ["led"], False),
    ("envelope", ["hvac", "windows"], False),
    ("deep", ["led", "hvac", "windows", "solar", "gtb"], False),
    ("hvac_electrify", ["hvac"], True),
]


def retrofit_whatif(df: DataFrame, key: str, bench="benchmark", area="gfa_total", score="energy_score",
                    scenarios=SCENARIOS) -> DataFrame:
    """Per building x scenario: capped new score (base <= 0 or NULL -> 50),
    base and improved heuristic scores, saving and % saving."""
    arr = F.array(*[F.struct(F.lit(n).alias("scenario"),
                             F.lit(sum(ACTION_POINTS.get(a, 0) for a in acts)).alias("boost"),
                             F.lit("hvac" in acts).alias("hvac"), F.lit(fs).alias("fuel_switch"))
                    for n, acts, fs in scenarios])
    s = col_(score).cast("double")
    base_es = F.when(s.isNull() | (s <= 0), dlit(50.0)).otherwise(s)
    x = df.select(key, col_(area).alias("_a"), col_(bench).alias("_b"), s.alias("_s"),
                  base_es.alias("_base_es"), F.explode(arr).alias("sc"))
    final_es = F.least(F.col("_base_es") + F.col("sc.boost"), dlit(100.0))
    val_base = heuristic_score("_a", "_b", "_s")
    improved = (heuristic_score("_a", "_b", final_es)
                * F.when(F.col("sc.hvac"), dlit(HVAC_TECH_BONUS)).otherwise(dlit(1.0))
                * F.when(F.col("sc.fuel_switch"), dlit(FUEL_SWITCH_FACTOR)).otherwise(dlit(1.0)))
    out = x.select(key, F.col("sc.scenario").alias("scenario"), final_es.alias("final_es"),
                   val_base.alias("val_base"), improved.alias("val_improved"))
    sav = F.col("val_base") - F.col("val_improved")
    return out.withColumns({"savings": sav,
                            "pct_saving": F.when(F.col("val_base") > 0, sav / F.col("val_base") * 100)
                                           .otherwise(dlit(0.0))})


def sensitivity_curve(df: DataFrame, key: str, bench="benchmark", area="gfa_total",
                      lo: int = 10, hi: int = 100, step: int = 10, fuel_switch: bool = False) -> DataFrame:
    x = df.select(key, col_(area).alias("_a"), col_(bench).alias("_b"),
                  F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))).alias("score"))
    p = heuristic_score("_a", "_b", "score")
    if fuel_switch:
        p = p * dlit(FUEL_SWITCH_FACTOR)
    return x.select(key, "score", p.alias("prediction"))


def reference_emissions(area, bench) -> Column:
    return col_(area).cast("double") * col_(bench) / F.lit(1000.0) * F.lit(CO2_CONVERSION_FACTOR)


def star_rating(df: DataFrame, key: str, pred="prediction", bench="benchmark", area="gfa_total") -> DataFrame:
    """Ratio to reference (reference < 10 -> 1.1*prediction): <.6 -> 5,
    <.8 -> 4, <1 -> 3, <1.3 -> 2, else 1; reduction to the next star; podium."""
    ref0 = reference_emissions(area, bench)
    p = col_(pred).cast("double")
    ref = F.when(ref0 < 10, p * 1.1).otherwise(ref0)
    x = df.select(key, p.alias("prediction"), ref.alias("median_ref"))
    ratio = F.col("prediction") / F.col("median_ref")
    stars = (F.when(ratio < 0.6, 5).when(ratio < 0.8, 4).when(ratio < 1.0, 3).when(ratio < 1.3, 2).otherwise(1))
    x = x.withColumns({"ratio": ratio, "stars": stars})
    nxt = F.when(F.col("stars") == 1, 1.3).when(F.col("stars") == 2, 1.0).when(F.col("stars") == 3, 0.8) \
           .when(F.col("stars") == 4, 0.6)
    target = F.col("median_ref") * nxt
    return x.withColumns({"next_target": target,
                          "reduction_needed": F.col("prediction") - target,
                          "top_perf": F.col("median_ref") * 0.6})


PATHWAY_YEARS = [2024, 2030, 2040, 2050]


def pathway_2050(df: DataFrame, key: str, pred="prediction", bench="benchmark", area="gfa_total") -> DataFrame:
    """Targets 2024 = now, 2030 = .7 ref, 2040 = .4 ref, 2050 = 0; excess =
    sum of positive business-as-usual gaps; compliant iff now <= 2030 target."""
    base = col_(bench) * (col_(area).cast("double") / 1000.0 * CO2_CONVERSION_FACTOR)
    p = col_(pred).cast("double")
    path = F.array(F.struct(F.lit(2024).alias("year"), p.alias("target")),
                   F.struct(F.lit(2030).alias("year"), (base * 0.7).alias("target")),
                   F.struct(F.lit(2040).alias("year"), (base * 0.4).alias("target")),
                   F.struct(F.lit(2050).alias("year"), dlit(0.0).alias("target")))
    x = df.select(key, p.alias("prediction"), path.alias("path"))
    excess = F.aggregate("path", dlit(0.0),
                         lambda acc, e: acc + F.greatest(F.col("prediction") - e.target, dlit(0.0)))
    t2030 = F.col("path")[1].target
    return x.select(key, "prediction", t2030.alias("target_2030"), F.col("path")[2].target.alias("target_2040"),
                    excess.alias("excess_total"), (F.col("prediction") <= t2030).alias("compliant"))


def audit_figures(df: DataFrame, key: str, pred="prediction", bench="benchmark", area="gfa_total",
                  carbon_cost: float = 100.0) -> DataFrame:
    """Reference (< 10 -> 1.2*prediction), gap %, 25 % saving, its cost
    value and a +-10 % status."""
    ref0 = reference_emissions(area, bench)
    p = col_(pred).cast("double")
    ref = F.when(ref0 < 10, p * 1.2).otherwise(ref0)
    x = df.select(key, p.alias("prediction"), ref.alias("median_ref"))
    gap = (F.col("prediction") - F.col("median_ref")) / F.col("median_ref") * 100
    return x.withColumns({"gap_pct": gap, "savings": F.col("prediction") * 0.25,
                          "financial": F.col("prediction") * 0.25 * carbon_cost,
                          "status": F.when(gap > 10, "under_performing").when(gap > -10, "aligned")
                                     .otherwise("efficient")})


def baseline_first(events: DataFrame, user="user_id", ts="ts", value="value", tiebreak="event_id") -> DataFrame:
    """First value per user in time order (keep-first baseline): a single
    hash aggregation with ``min_by`` (partial aggregation map-side, so a hot
    user never materialises as a group)."""
    order = F.struct(F.col(ts), F.col(tiebreak))
    return events.groupBy(user).agg(F.min_by(value, order).alias("baseline"),
                                    F.min(ts).alias("first_ts"), F.count(F.lit(1)).alias("n_events"))
