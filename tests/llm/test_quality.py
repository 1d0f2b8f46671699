import numpy as np
from pyspark.sql import functions as F

from assetlytics.llm import quality as Q

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rated = Q.graded(spark.read.parquet(f"{SF}/labels.parquet"))
    test = rated.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    model = Q.fit_on_sample(docs, rated.join(test, "doc_id", "left_anti"))
    assert (np.diff(model.thresholds) > 0).all()
    got = Q.score_quality(docs, model).join(test, "doc_id").select("grade", "kept", "expected_grade").toPandas()
    kept = got.groupby("grade")["kept"].mean()
    assert kept[2] > 0.97 and kept[0] < 0.05 and kept.get(1, 0) < 0.35
    means = got.groupby("grade")["expected_grade"].mean()
    assert means[0] < means.get(1, 1.5) < means[2]


def test_likelihood_orders_three_grades():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        g = int(rng.integers(3))
        ids = np.unique(np.r_[rng.choice([10, 11, 12], 1) + 10 * g, rng.integers(100, 130, 4)])
        rows.append((ids, np.ones(len(ids))))
        grades.append(g)
    m = Q.fit_ordinal(rows, np.array(grades))
    f = np.array([m.weights[i].sum() for i, _ in rows])
    assert ((m.tails(f) > 0.5).sum(axis=1) == np.array(grades)).mean() > 0.95


def test_edge_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "w " * 200_000), (3, "w " * 200_000), (None, "ok text")])
    docs = docs.withColumn("kept", F.lit("own")).withColumn("p_top", F.lit(7)).withColumn("row_", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    rated = Q.graded(labels)
    assert sorted(map(tuple, rated.collect())) == [(1, 2), (2, 0)]
    for ratings in (rated, rated.where("false")):
        out = Q.score_quality(docs, Q.fit_on_sample(docs, ratings))
        assert out.count() == 5 and out.select("row_.*").columns == docs.columns
        assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.countDistinct("p_top").alias("n")).collect()}[3] == 1
    assert Q.score_quality(docs.where("false"), Q.fit_on_sample(docs, rated)).count() == 0
