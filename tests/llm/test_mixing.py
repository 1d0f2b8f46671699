import pytest
from pyspark.sql import functions as F

from assetlytics.llm import mixing as M


def test_targets_cap_and_reshare(docs_of):
    rows = [(i, "w " * 100, "a") for i in range(10)] + [(100 + i, "w " * 10, "b") for i in range(5)] + [(200, "w " * 3000, None)]
    out = M.mix_plan(docs_of(rows)).groupBy("source").agg(F.first("source_size").alias("s"), F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    got = {r.source: r for r in out}
    assert got["b"].t == 100.0  # weight 1: stops at twice its size
    assert got["a"].t == 2000.0 and got[None].t == pytest.approx(1.5 * 4050 - 2100)
    assert all(r.k == int(r.t) for r in out)


def test_reruns_and_partitionings_agree(docs_of):
    docs = docs_of([(i, "w " * (i % 7), f"s{i % 3}") for i in range(400)])
    a = sorted(map(tuple, M.mix_plan(docs.repartition(7)).collect()), key=str)
    assert a == sorted(map(tuple, M.mix_plan(docs.repartition(3, "source")).collect()), key=str)
    assert all(0 <= r.taken <= 2 * r.size for r in M.mix_plan(docs).collect())


def test_documents_follow_the_plan(docs_of):
    docs = docs_of([(i, f" a{i}\tb  c\n" * 5, f"s{i % 4}") for i in range(60)]).withColumn("size", F.lit("own")).withColumn("row_", F.lit(1))
    plan = {r.doc_id: r.taken for r in M.mix_plan(docs).collect()}
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(M.word_count(F.col("text"))).alias("n")).collect()}
    assert {k: v for k, v in plan.items() if v} == got


def test_edge_rows(docs_of):
    docs = docs_of([(None, "a b", "x"), (1, None, "x"), (2, "", None), (3, "\x0b  　", "y"), (3, "\x0b  　", "y"), (4, "w " * 50_000, "z")])
    got = {(r.doc_id, r.source): (r.size, r.taken) for r in M.mix_plan(docs).collect()}
    assert got[1, "x"] == (0, 0) and got[2, None] == (0, 0)
    assert got[3, "y"][0] == 2  # other white space counts as characters
    assert M.mix_plan(docs.where("false")).count() == 0
    assert M.mixed_documents(docs.where("false")).count() == 0


def _shuffled_rows(plan):
    """Rows that the exchanges of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled_rows(plan.plan())
    below = plan.children()
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled_rows(below.apply(i)) for i in range(below.size()))


def test_only_the_range_at_the_border_is_shuffled_with_texts(docs_of):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 3}") for i in range(3000)] + [(None, "a b c", "s0"), (7, "w " * 5, "s1"), (7, "w " * 5, "s1")]
    mixed = M.mixed_documents(docs_of(rows).repartition(4))
    got = mixed.collect()
    assert _shuffled_rows(mixed._jdf.queryExecution().executedPlan()) < 400  # a range a source; all rows, twice, before
    words, taken = {}, {}
    for _, t, s in rows:
        words[s] = words.get(s, 0) + len(t.split())
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    total = sum(words.values())
    spare = 1.5 * total - 2 * sum(words[s] for s in ("s0",))  # weights 3, 1, 2: s0 stops at twice its size
    assert taken["s0"] == 2 * words["s0"] and taken["s1"] == int(spare / 3) and taken["s2"] == int(spare * 2 / 3)
