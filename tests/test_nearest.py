import random

from pyspark.sql import functions as F

from assetlytics.operators import nearest as N


def _brute(rows, refs, d, k):
    """(fill of each row): rows and refs are (coordinates, class)."""
    def code(p, levels):
        return [-1.0 if v is None else float(levels[j].index(v) if isinstance(v, str) and v in levels[j] else -1.0 if isinstance(v, str) else v)
                for j, v in enumerate(p)]
    levels = [sorted({p[j] for p, _ in refs if isinstance(p[j], str)}) for j in range(d)]
    known = [(code(p, levels), c) for p, c in refs if c is not None]
    out = []
    for p, c in rows:
        if c is None and known:
            q = code(p, levels)
            dist = sorted((sum((a - b) ** 2 for a, b in zip(q, x)), c2) for x, c2 in known)
            kth = dist[min(k, len(dist)) - 1][0]
            votes = [c2 for r, c2 in dist if r <= kth]
            c = min(set(votes), key=lambda v: (-votes.count(v), v))
        out.append(c)
    return out


def _frame(spark, rows, names):
    schema = "id long, " + ", ".join(f"{n} {t}" for n, t in names) + ", kind string"
    return spark.createDataFrame([(i, *p, c) for i, (p, c) in enumerate(rows)], schema)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 4)
    rnd = random.Random(4)

    def point():  # a hot place, clusters, far outliers, gaps
        kind = rnd.random()
        if kind < 0.3:
            return (7.0, 7.0, "b")
        scale = rnd.choice([0.01, 1.0, 1000.0, 1e6])
        return tuple(rnd.choice([None, round(rnd.gauss(0, scale), 3), float(rnd.randrange(5))]) for _ in range(2)) + (rnd.choice(["a", "b", "c", None]),)
    rows = [(point(), rnd.choice([None, "u", "v", "w"])) for _ in range(500)]
    df = _frame(spark, rows, [("a", "double"), ("b", "double"), ("s", "string")])
    got = {r.id: r.kind for r in N.knn_impute(df, "kind", ["a", "b", "s"]).collect()}
    assert [got[i] for i in range(len(rows))] == _brute(rows, rows, 3, 5)
    one = {r.id: r.kind for r in N.knn_impute(df, "kind", ["a"], k=3).collect()}
    flat = [((p[0],), c) for p, c in rows]
    assert [one[i] for i in range(len(rows))] == _brute(flat, flat, 1, 3)


def test_other_reference_and_edges(spark):
    names = [("a", "int"), ("s", "string")]
    refs = [((1, "x"), "u"), ((1, "x"), "v"), ((5, "y"), "v"), ((9, None), None)]
    rows = [((1, "x"), None), ((None, "new"), None), ((5, "y"), "kept"), ((8, "y"), None)]
    ref, df = _frame(spark, refs, names), _frame(spark, rows, names)
    got = {r.id: r.kind for r in N.knn_impute(df, "kind", ["a", "s"], k=1, reference=ref).collect()}
    assert [got[i] for i in range(4)] == _brute(rows, refs, 2, 1) == ["u", "u", "kept", "v"]
    far = {r.id: r.kind for r in N.knn_impute(df, "kind", ["a", "s"], k=50, reference=ref).collect()}
    assert far[0] == "v"  # fewer rows than k: all vote
    assert N.knn_impute(df, "kind", []).where("kind IS NULL").count() == 3
    assert N.knn_impute(df, "kind", ["a"], reference=ref.where("kind IS NULL")).where("kind IS NULL").count() == 3
    assert N.knn_impute(df.where("false"), "kind", ["a"], reference=ref).count() == 0
    whole = N.knn_impute(df.withColumn("n", F.lit(1)).withColumn("level", F.lit("l")), "kind", ["a"], reference=ref)
    assert whole.columns == [*df.columns, "n", "level"] and whole.where("kind IS NULL").count() == 0
