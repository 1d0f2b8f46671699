"""Invariants of fit/transform operators, splits and helpers."""

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F

from assetlytics.functions import stats as ST
from assetlytics.functions.normal import norm_ppf
from assetlytics.operators import missing as M
from assetlytics.operators import outliers as O
from assetlytics.operators import profile as P
from assetlytics.plans.common import fold_of, is_train


def test_split_and_folds_disjoint_and_stable(asset_df):
    a = asset_df.select("asset_id", is_train().alias("tr"), fold_of().alias("f"))
    n = a.count()
    tr = a.where("tr").count()
    assert 0.75 < tr / n < 0.85
    assert a.where("tr").select("f").distinct().count() == 5
    again = asset_df.select("asset_id", is_train().alias("tr")).where("tr").count()
    assert again == tr


def test_missing_fit_uses_train_only_and_fills(asset_df):
    tr = asset_df.where(is_train())
    te = asset_df.where(~is_train())
    p = M.fit_missing_simple(tr, [c for c in asset_df.columns if c != "asset_id"])
    assert "mostly_null" in p.drop_missing and "state" in p.drop_unique
    mean_train = tr.agg(F.avg("gas_therms")).first()[0]
    assert abs(p.fill["gas_therms"][1] - mean_train) < 1e-9
    out = M.transform_missing(te, p)
    assert out.where(F.col("gas_therms").isNull() | F.col("acctbal").isNull()).count() == 0
    assert "mostly_null" not in out.columns and "state" not in out.columns


def test_caps_hold_and_keep_nulls(asset_df):
    p = O.fit_caps(asset_df, ["gfa_total", "acctbal"], "winsorize")
    out = O.apply_caps(asset_df, p)
    lo, hi = p.bounds["gfa_total"]
    r = out.agg(F.min("gfa_total"), F.max("gfa_total")).first()
    assert r[0] >= lo - 1e-9 and r[1] <= hi + 1e-9
    assert out.where(F.col("acctbal").isNull()).count() == asset_df.where(F.col("acctbal").isNull()).count()


def test_ecdf_matches_bruteforce(asset_df):
    pdf = asset_df.select("emissions").toPandas()
    got = P.ecdf(asset_df, "emissions").toPandas().sort_values("emissions")
    s = pdf["emissions"].sort_values()
    exp = s.groupby(s).size().cumsum() / len(s)
    assert len(got) == len(exp)
    assert max(abs(got["ecdf"].values - exp.values)) < 1e-6


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    r = P.mode_profile(df, ["c"]).first()
    assert r["mode"] == "a" and r["mode_count"] == 2


def test_norm_ppf_accuracy(spark):
    ps = [0.001, 0.02, 0.3, 0.5, 0.77, 0.975, 0.9999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(norm_ppf(F.col("p"))).collect()]
    for p, g in zip(ps, got):
        assert abs(g - NormalDist().inv_cdf(p)) < 1e-6


def test_distribution_tails():
    assert abs(ST.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(ST.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-9
    assert abs(ST.t_sf_two_sided(2.2281388519649385, 10) - 0.05) < 1e-9
    assert abs(ST.t_sf_two_sided(1.959963984540054, 1e7) - 0.05) < 1e-5


def test_influence_matches_closed_form(asset_df):
    tr = asset_df.where(is_train()).select("asset_id", "gfa_total", F.log1p("emissions").alias("y"))
    out, th = O.influence(tr, "y", ["gfa_total"], "asset_id", fill_median=False)
    pdf = tr.toPandas()
    x = pdf["gfa_total"]
    h = 1 / len(x) + (x - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum()
    got = out.toPandas().set_index("asset_id").loc[pdf["asset_id"], "leverage"].values
    assert max(abs(got - h.values)) < 1e-9
    assert abs(th["leverage"] - 4 / len(x)) < 1e-12


def test_little_single_column_is_mcar(asset_df):
    t = M.little_mcar_test(asset_df, ["energy_score"])
    assert t["is_mcar"] and t["p_value"] == 1.0


def test_chi2_yates_on_2x2(spark):
    # 2x2 table [[10, 20], [30, 40]]: scipy's corrected statistic is 0.4464...
    rows = [("a", None)] * 10 + [("a", 1.0)] * 20 + [("b", None)] * 30 + [("b", 1.0)] * 40
    df = spark.createDataFrame(rows, "cat string, v double")
    r = M.mar_chi2_stats(df, "v", "cat").first()
    assert r["dof"] == 1
    assert abs(r["statistic"] - 0.4464285714285714) < 1e-9


def test_qq_points_match_bruteforce(asset_df):
    pdf = asset_df.select(F.log1p("emissions").alias("v")).toPandas()
    got = P.qq_points(asset_df.select(F.log1p("emissions").alias("v")), "v").toPandas()
    got = got.sort_values("rank")
    n = len(pdf)
    xs = pdf["v"].sort_values().values
    i = got["rank"].values.astype(float)
    m = [(1 - 0.5 ** (1 / n)) if r == 1 else (0.5 ** (1 / n)) if r == n else (r - 0.3175) / (n + 0.365) for r in i]
    exp = [NormalDist().inv_cdf(p) for p in m]
    assert len(got) == n
    assert max(abs(got["theoretical"].values - exp)) < 1e-6
    assert max(abs(got["sample"].values - xs)) < 1e-6


def test_checked_broadcast_bound(spark):
    from assetlytics.functions.joins import checked_broadcast
    small = spark.range(10)
    big = spark.range(1000)
    plan_small = small.join(checked_broadcast(small.withColumnRenamed("id", "k"), max_rows=50),
                            F.col("id") == F.col("k"))._jdf.queryExecution().optimizedPlan().toString()
    plan_big = small.join(checked_broadcast(big.withColumnRenamed("id", "k"), max_rows=50),
                          F.col("id") == F.col("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan_small.lower()
    assert "broadcast" not in plan_big.lower()


def test_distinct_le_exact(spark):
    df = spark.createDataFrame([(i % 3, i % 11, None) for i in range(100)], "a int, b int, c string")
    got = M._distinct_le(df, ["a", "b", "c"], 10)
    assert got == {"a": True, "b": False, "c": True}


def test_tolerant_csv_rules(spark, tmp_path):
    from pyspark.sql import types as T
    from assetlytics.sources.files import read_csv_tolerant
    p = tmp_path / "up.csv"
    p.write_text('id,name,area,target\n1,"a,b",10.5,3.0\n2,x,n/a,4.0\n3,y,7.0,\n4,z,1.0,2.0,extra\n5,w,2.0,1.5\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("area", T.DoubleType()), T.StructField("target", T.DoubleType())])
    rows = sorted(tuple(r) for r in read_csv_tolerant(spark, str(p), schema, target="target").collect())
    assert rows == [(1, "a,b", 10.5, 3.0), (3, "y", 7.0, 0.0), (5, "w", 2.0, 1.5)]


def test_asset_tasks_are_bounded_in_rows(spark, tmp_path, monkeypatch):
    from assetlytics.sources import asset as A
    small = "/root/testdata/sf0.001"
    keys = ["spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(k) for k in keys]
    monkeypatch.setattr(A, "_MATERIALIZED", {})
    monkeypatch.setattr(A, "shared_path", lambda *_: str(tmp_path / "asset"))
    monkeypatch.setattr(A, "ROWS_A_TASK", 64)
    view, held = A.asset_view, []
    monkeypatch.setattr(A, "asset_view", lambda *a: held.append([int(spark.conf.get(k)) for k in keys[:2]]) or view(*a))
    got, want = A.materialize_asset(spark, small), view(spark, small)
    rows = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert held == [[-(-rows // 64), A.BYTES_A_TASK]] and rows // 64 > int(before[0])  # more input makes more tasks
    assert got.drop("is_train").exceptAll(want).isEmpty() and got.count() == want.count()
    assert [spark.conf.get(k) for k in keys] == before
