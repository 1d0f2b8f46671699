import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlytics.llm import vectorcodes as V

VECTORS = "vec_id long, embedding array<double>, label int"


def _plain(rows, parts=4, entries=256, rounds=4):
    """The contract in Python integers, on rows (id, vector, label) that all count."""
    ints = [[math.floor(Fraction(x) * 1024) for x in v] for _, v, _ in rows]
    edge = [len(ints[0]) * p // parts for p in range(parts + 1)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1]))[:entries]
    books = [[ints[i][edge[p]:edge[p + 1]] for i in order] for p in range(parts)]

    def near(v, book):
        d = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in book]
        return d.index(min(d)), min(d)
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = {}
            for v in ints:
                part = v[edge[p]:edge[p + 1]]
                held.setdefault(near(part, book)[0], []).append(part)
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(book)]
    out = []
    for (i, _, label), v in zip(rows, ints):
        got = [near(v[edge[p]:edge[p + 1]], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for k, _ in got), sum(d for _, d in got)))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(out, key=str), digest


def _got(out):
    return sorted((tuple(r) for r in out.select("vec_id", "label_", "code", "error").collect()), key=str)


def test_limbs_and_products_are_exact():
    rnd = np.random.default_rng(5)
    for most, d in ((1 << 10, 16), (1 << 24, 16), (1 << 27, 64), (1 << 29, 4)):
        x, c = rnd.integers(-most, most + 1, (40, d)), rnd.integers(-most, most + 1, (9, d))
        assert sum(p.astype(object) * (1 << (9 * k)) for k, p in enumerate([q.astype(np.int64) for q in V.limbs(x, 9)])).tolist() == x.tolist()
        assert V.exact_products(x, c).tolist() == (x.astype(object) @ c.T.astype(object)).tolist()
    # float64 alone would round here: the true distances differ by one
    a, b = np.array([[1 << 29, 1]]), np.array([[0, 0], [0, 1]])
    assert V.nearest(a, b)[0].tolist() == [1]
    assert V.nearest(np.array([[1 << 40, 1]]), b)[0].tolist() == [1]  # beyond int64


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e9, 1e30])
def test_matches_a_plain_version(spark, scale):
    rnd = random.Random(7)
    rows = [(i, [rnd.choice([-1, 1]) * rnd.random() * scale for _ in range(8)], i % 3 if i % 4 else None) for i in range(90)]
    rows += [(i + 200, rows[i][1], 1) for i in range(20)]  # ties and copies
    out, books = V.encode_vectors(spark.createDataFrame(rows, VECTORS).repartition(4), entries=16)
    want, digest = _plain(rows, entries=16)
    assert books.digest() == digest
    assert _got(out) == [r if r[3] < 1 << 63 else (*r[:3], None) for r in want]


def test_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(4, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (4, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (9, [0.0] * 5, None), (9, [-0.0005] * 5, None)]
    bad = [(1, None, 1), (2, [1.0, None, 1.0, 1.0, 1.0], 1), (3, [nan] * 5, 2), (5, [inf] * 5, 2)]
    df = spark.createDataFrame(good + bad, VECTORS).withColumn("code", F.lit("x")).withColumn("label_", F.lit(3)).withColumn("v_", F.lit(0))
    out, books = V.encode_vectors(df)
    want, digest = _plain(good)
    assert _got(out) == want and books.digest() == digest
    odd, _ = V.encode_vectors(spark.createDataFrame([*good, (10, [1.0] * 3, 1), (None, [1.0] * 5, 1), (11, [], 1)], VECTORS))
    got = {r.vec_id: (r.code, r.error) for r in odd.collect()}
    assert got[10] == got[11] == (None, None) and got[None][0] is not None
    none, empty = V.encode_vectors(df.where("false"))
    assert none.count() == 0 and empty.digest() == hashlib.sha256(b"").hexdigest()
    zero, _ = V.encode_vectors(spark.createDataFrame([(1, [], 1)], VECTORS))
    assert _got(zero) == [(1, 1, "00000000", 0)]
    assert V.encode_vectors(spark.createDataFrame(good, VECTORS).drop("label"), label_col=None)[0].count() == 4
