import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlytics.llm import dartminhash as D

SF = "/root/testdata/sf0.01"


def brute_classes(rows, least=0.8):
    sets = {i: frozenset(e.tolist()) for (i, _), (e, _, _) in zip(rows, D.shingle_sets([t for _, t in rows]))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    where = {}
    for i in sets:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    near = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if both / (len(sets[a]) + len(sets[b]) - both) >= least:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in D.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    els = rng.integers(1, 2 ** 63, 300).astype(np.uint64)
    els.sort()
    wa, wb = rng.gamma(2.0, 2.0, 300), rng.gamma(2.0, 2.0, 300)
    wb[:150] = wa[:150]
    sig = D.dart_signatures([(els, wa), (els, wb)], 2000)
    true = D.weighted_jaccard(els, wa, els, wb)
    assert abs(np.mean(sig[0] == sig[1]) - true) < 4 * (true * (1 - true) / 2000) ** 0.5


def test_signature_does_not_depend_on_the_batch():
    e = np.arange(1, 40, dtype=np.uint64) * np.uint64(977)
    w = np.linspace(0.1, 6, 39)
    alone = D.dart_signatures([(e, w)], 64)[0]
    many = D.dart_signatures([(e[:3], w[:3]), (e, w), (e[:0], w[:0])], 64)
    assert (many[1] == alone).all() and (many[2] == 0).all()


def test_hot_groups_and_chains(docs_of):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(300)]  # exact copies
    for i in range(300, 500):  # near copies of the base, one word each
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(260)]  # links only from one to the next
    rows += [(600 + k, " ".join(chain[k * 10:k * 10 + 200])) for k in range(6)]
    rows += [(700 + k, " ".join(f"u{k}_{i}" for i in range(50))) for k in range(20)]
    got = {r.doc_id: r.class_id for r in D.near_duplicates(docs_of(rows)).collect()}
    assert got == brute_classes(rows)
    assert {got[i] for i in range(500)} == {0} and {got[600 + k] for k in range(6)} == {600}


@pytest.mark.parametrize("weighted", [False, True])
def test_edge_rows(spark, docs_of, weighted):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    docs = docs_of([(1, None), (2, ""), (3, "?!"), (4, "two words"), (5, "Two, words"), (5, "Two, words"), (6, long), (7, long), (None, "two words")])
    docs = docs.withColumn("bands", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("n", F.lit(2))
    got = {r.doc_id: (r.class_id, r.kept) for r in D.near_duplicates(docs, weighted=weighted).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (4, False), 6: (6, True), 7: (6, False), None: (None, True)}
    left = D.deduplicated(docs, weighted=weighted)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 2, 3, 4, 6]
    assert D.near_duplicates(docs.where("false")).count() == 0


def test_repeated_rows_leave_one(docs_of):
    docs = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l")])
    assert sorted(r.doc_id for r in D.deduplicated(docs).collect()) == [1, 2]
