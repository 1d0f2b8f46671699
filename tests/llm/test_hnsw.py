import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlytics.llm import hnsw as H


def brute(vectors, least=0.9):
    ids = [i for i, _ in vectors]
    x = np.array([v for _, v in vectors], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= least
    np.fill_diagonal(link, False)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in zip(*np.nonzero(link)):
        p, q = sorted((find(ids[a]), find(ids[b])))
        root[q] = p
    return {i: (int(n), find(i)) for i, n in zip(ids, link.sum(axis=1))}


def clustered(n, seed=0, dim=24):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 15, dim))
    x = centers[rng.integers(len(centers), size=n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.3, 2.0], size=(n, 1))
    x[: n // 3] = centers[0] + rng.normal(size=(n // 3, dim)) * 0.2  # one dense group of a third
    return [(int(i), [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]


@pytest.mark.parametrize("shard_rows", [300, 8192])
def test_against_brute_force(spark, shard_rows):
    rows = clustered(1500)
    rows += [(5000 + i, rows[7][1]) for i in range(40)]  # copies
    want = brute(rows)
    out = H.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=shard_rows).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert len(out) == len(rows)
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(got[i][1] == want[i][1] for i in got) >= 0.99 * len(rows)


def test_sparse_pairs_over_many_shards(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3600, 48))
    x[3000:] = x[:600] + rng.normal(size=(600, 48)) * 0.4  # a pair in six vectors, most in two shards
    rows = [(int(i), [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    want = sum(n for n, _ in brute(rows).values())
    out = H.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=400, beam=1).collect()
    assert want > 600 and 0.98 * want <= sum(r.n_links for r in out) <= want


def test_graph_recall():
    x = H._units(np.random.default_rng(1).normal(size=(3000, 32))).astype(np.float32)
    g = H.Graph.build(x)
    ids, _ = g.search(x[:300], 96)
    true = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, true)]) >= 0.9
    assert len(g.layers) >= 2


def test_blocks_of_a_shard_and_parts_of_a_target(spark, monkeypatch):
    """Several blocks a shard, several shards, and tasks that load more than one graph give the counts of brute force."""
    monkeypatch.setattr(H, "BLOCK_ROWS", 50)
    rows = clustered(400, seed=3, dim=8)
    want = brute(rows)
    for shard_rows in (130, 1000):
        out = H.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=shard_rows).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in out} == want


def test_audit_is_never_empty(spark, monkeypatch):
    """Random vectors have no links, so only planted vectors can tell that a beam of 1 is too small."""
    seen = {}
    old = H.pooled_beams

    def watch(*args):
        seen.update(old(*args))
        return seen
    monkeypatch.setattr(H, "pooled_beams", watch)
    x = np.random.default_rng(11).normal(size=(3000, 48))
    rows = [(int(i), [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = H.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), beam=1).collect()
    assert not sum(n for n, _ in brute(rows).values()) and all(r.n_links == 0 for r in out) and seen[48] > 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == conf


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]),
            (9, [1.0, 0.0]), (10, [0.0, 1.0]), (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1e-30, 0.0]), (13, [3e38, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("copies", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("rep", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in H.near_duplicates(df).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4, 5, 6, 10, 11)} == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11)}
    assert got[7] == (4, 7, True) and all(got[i] == (4, 7, False) for i in (8, 9, 12, 13)) and got[None] == (0, None, True)
    assert H.near_duplicates(df.where("false")).count() == 0
