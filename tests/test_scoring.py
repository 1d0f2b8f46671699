"""Closed-form golden values of the heuristic score and scenario rules."""

from pyspark.sql import functions as F

from assetlytics.operators import scenario as SC
from assetlytics.operators import scoring as S


def _score(spark, rows):
    df = spark.createDataFrame(rows, "t string, gfa double, es double")
    df = S.with_benchmark(df, "t")
    return [r["p"] for r in df.select(S.heuristic_score("gfa", "benchmark", "es").alias("p")).collect()]


def test_golden_heuristic(spark):
    got = _score(spark, [("Office", 50000.0, 60.0), ("Office", 50000.0, 50.0), ("Office", 50000.0, 90.0),
                         ("Large Office", 500000.0, 75.0)])
    assert got == [24.84, 27.0, 18.36, 3846.0]


def test_null_or_zero_score_is_neutral(spark):
    a, b, c = _score(spark, [("Office", 50000.0, None), ("Office", 50000.0, 0.0), ("Office", 50000.0, 20.0)])
    assert a == b == round(50000 * 10.8 / 1000 * 0.05, 2)
    assert c > a  # score 20 -> factor 1.24 > 1.0


def test_high_score_not_above_base(spark):
    lo, hi = _score(spark, [("Hotel", 80000.0, 20.0), ("Hotel", 80000.0, 95.0)])
    assert hi <= lo


def test_unknown_type_default_benchmark_and_floor(spark):
    (p,) = _score(spark, [("Unknown Type", 1000.0, None)])
    assert p == round(1000 * 150 / 1000 * 0.05, 2)
    (q,) = _score(spark, [("Office", 1.0, 100.0)])
    assert q == 0.1


def test_suggestion_default_70(spark):
    df = spark.createDataFrame([("Hospital",), ("Nope",)], "t string")
    assert [r[0] for r in df.select(S.score_suggestion("t")).collect()] == [78, 70]


def test_star_rating_ladder(spark):
    df = spark.createDataFrame([(1, 50.0, 100000.0, 10.8)], "k int, prediction double, gfa_total double, benchmark double")
    r = SC.star_rating(df, "k").first()
    # reference = 100000 * 10.8 / 1000 * 0.05 = 54 -> ratio 0.926 -> 3 stars
    assert r["stars"] == 3 and abs(r["median_ref"] - 54.0) < 1e-9


def test_recommendations_office(spark):
    df = spark.createDataFrame([("Office", 40.0), ("Hotel", 80.0)], "t string, s double")
    out = [r[0] for r in df.select(S.recommendations("t", "s")).collect()]
    assert out[0] == ["boost_energy_star", "smart_lighting", "smart_heating", "solar_panels", "insulation"]
    assert out[1] == ["efficient_hot_water", "solar_panels", "insulation"]


def test_validation_lists_all_violations(spark):
    df = spark.createDataFrame([(0.0, 0, 2030, 150.0), (1000.0, 3, 1990, None)], "a double, f int, y int, s double")
    rows = S.validate(df, "a", "f", "y", "s").select("violations", "valid").collect()
    assert rows[0]["violations"] == ["area_nonpositive", "floors_min", "year_future", "score_range"]
    assert rows[1]["valid"] and rows[1]["violations"] == []


def test_pathway_excess(spark):
    df = spark.createDataFrame([(1, 100.0, 100000.0, 10.0)], "k int, prediction double, gfa_total double, benchmark double")
    r = SC.pathway_2050(df, "k").first()
    base = 10.0 * (100000 / 1000 * 0.05)  # 50
    assert abs(r["excess_total"] - ((100 - 35) + (100 - 20) + 100)) < 1e-9
    assert r["compliant"] is False and abs(r["target_2030"] - 0.7 * base) < 1e-9
