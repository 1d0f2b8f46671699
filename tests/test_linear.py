import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlytics.functions import moments as MO
from assetlytics.operators import linear as L


@pytest.fixture(scope="module")
def table(spark):
    rnd = np.random.default_rng(3)
    n = 400
    x = rnd.normal(size=(n, 4)) * [1, 1e4, 0.01, 1] + [5, 1e6, 0, 0]
    x[:, 3] = np.round(x[:, 3])
    y = 2 + x @ [0.5, 2e-4, 30, 0] + rnd.normal(size=n)
    rows = [(int(i), *map(float, v), "abc"[i % 3] if i % 7 else None, float(t), i % 5, (i // 5) % 10) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, e double, s string, y double, fold int, bucket int")
    return df.withColumn("a", F.when(F.col("id") % 11 != 3, F.col("a"))).repartition(3), rows


def _plain(table, d):
    """Raw design matrix and target on the driver."""
    rows = table[0].orderBy("id").select(*[f.alias(f"f{i}") for i, f in enumerate(d.features)], "y", "fold", "bucket").toPandas().to_numpy()
    return rows[:, :-3], rows[:, -3], rows[:, -2], rows[:, -1]


def _scaled(x, use):
    mu, sd = x[use].mean(0), x[use].std(0)
    return (x - mu) / np.where(sd > 0, sd, 1)


def test_folds_match_fits_on_rows(table):
    df = table[0]
    d = L.design(df, ["a", "b", "c", "e"], ["s"], F.col("y"))
    assert d.names == ["a", "b", "c", "e", "s_a", "s_b", "s_c"]
    x, y, fold, _ = _plain(table, d)
    models = [("ols", {}), ("ridge", {"alpha": 3.0}), ("lasso", {"alpha": 0.05}), ("enet", {"alpha": 0.1, "l1_ratio": 0.3}), ("ridge", {"alpha": 100.0})]
    got = L.cross_validate(df, d, models, list(range(5)))
    for (kind, params), row in zip(models, got):
        r2, mae = [], []
        for k in range(5):
            use = fold != k
            z = _scaled(x, use)
            zc, yc = z[use], y[use] - y[use].mean()
            if kind == "ols":
                w = np.linalg.lstsq(zc, yc, rcond=1e-8)[0]
            elif kind == "ridge":
                w = np.linalg.solve(zc.T @ zc + params["alpha"] * np.eye(z.shape[1]), zc.T @ yc)
            else:
                w, a, ratio = np.zeros(z.shape[1]), params["alpha"], params.get("l1_ratio", 1.0)
                for _ in range(4000):
                    for j in range(len(w)):
                        rho = zc[:, j] @ (yc - zc @ w + zc[:, j] * w[j]) / len(yc)
                        w[j] = np.sign(rho) * max(abs(rho) - a * ratio, 0) / ((zc[:, j] ** 2).mean() + a * (1 - ratio))
            e = y[~use] - z[~use] @ w - y[use].mean()
            r2.append(1 - (e ** 2).sum() / ((y[~use] - y[~use].mean()) ** 2).sum())
            mae.append(np.abs(e).mean())
        assert row["cv_r2_mean"] == pytest.approx(np.mean(r2), abs=1e-7) and row["cv_r2_std"] == pytest.approx(np.std(r2), abs=1e-7)
        assert row["cv_mae_mean"] == pytest.approx(np.mean(mae), abs=1e-7)


def test_optimality_is_asserted_from_data(table):
    df = table[0]
    d = L.design(df, ["a", "b", "c", "e"], ["s"], F.col("y"))
    m = MO.grouped_moments(df, d.columns, d.shift, d.scale)[MO.ALL]
    a, b, _, _ = L._standardised(m)
    for alpha in (1e-4, 1e-3, 0.01, 0.1, 1.0):
        w = L.descend(a / m.n, b / m.n, alpha, 0.0, np.zeros(len(b)))
        assert L.kkt_residual(a / m.n, b / m.n, w, alpha, 0.0) < 1e-8
    fit = L.lasso_path(m, [0.01])[0]
    sse = df.agg(F.sum(F.pow(F.col("y") - fit.expression(d), 2))).first()[0]
    assert sse == pytest.approx(L.squared_errors(m, fit)[0], rel=1e-9)


def test_learning_curve_is_a_prefix_sum(table):
    df = table[0]
    d = L.design(df, ["a", "b", "c"], [], F.col("y"))
    x, y, fold, bucket = _plain(table, d)
    got = L.learning_curve(df, d, "ols", {}, list(range(5)), F.col("bucket"))
    assert [r["fraction"] for r in got] == [i / 10 for i in range(1, 11)] and got[-1]["n"] == 400
    r2 = []
    for k in range(5):
        use, held = (fold != k) & (bucket < 3), fold == k
        w = np.linalg.lstsq(np.column_stack([np.ones(use.sum()), x[use]]), y[use], rcond=None)[0]
        e = y[held] - np.column_stack([np.ones(held.sum()), x[held]]) @ w
        r2.append(1 - (e ** 2).sum() / ((y[held] - y[held].mean()) ** 2).sum())
    assert got[2]["r2_mean"] == pytest.approx(np.mean(r2), abs=1e-7) and got[2]["n"] == (bucket < 3).sum()


def test_pairwise_correlations(table, spark):
    df = table[0].withColumn("c", F.when(F.col("id") % 3 > 0, F.col("c"))).withColumn("k", F.lit(2.5)).withColumn("none", F.lit(None).cast("double"))
    cols = ["a", "b", "c", "e", "k", "none"]
    got, want = MO.correlations(df, [F.col(c) for c in cols]), df.select(cols).toPandas().astype(float).corr().to_numpy()
    want[4, 4] = np.nan
    assert np.allclose(got, want, equal_nan=True, atol=1e-12)
    assert np.isnan(MO.correlations(df.where("false"), [F.col("a"), F.col("b")])).all()


def test_rows_count_in_several_groups(table):
    df = table[0]
    m = MO.grouped_moments(df, [F.col("b"), F.col("y")], [0, 0], [1, 1], F.array_compact(F.array(F.when(F.col("id") < 100, "low"), F.lit("any"))))
    assert m["low"].n == 100 and m["any"].n == 400
    assert m["any"].total[1] == pytest.approx(df.agg(F.sum("y")).first()[0])
