"""run() against its stages done by plain means."""

import importlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from assetlytics.llm import quality, rangecoder

from . import test_dartminhash, test_decontam

SF = "/root/testdata/sf0.01"


def _targets(sizes: dict) -> dict:
    """Words that each source gives: shares by weight, at most twice its size, the excess dealt out again."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, free, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rate > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * rate for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit_on_sample(docs, quality.graded(spark.read.parquet(f"{SF}/labels.parquet")))
    good = {r.doc_id: r for r in docs.collect()}
    score = {i: model.tails(quality._score(model, [r.text]))[0, -1] for i, r in good.items()}
    good = {i: r for i, r in good.items() if score[i] >= quality.KEEP_TAIL}
    classes = test_dartminhash.brute_classes([(i, r.text) for i, r in good.items()])
    good = {i: r for i, r in good.items() if classes[i] == i}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in test_decontam.brute([(i, r.text) for i, r in good.items()], bench)}
    good = {i: r for i, r in good.items() if i not in leaks}
    assert leaks and len(good) < docs.count()

    got = C.run(spark, SF).orderBy("start").collect()
    assert {r.doc_id for r in got} <= set(good)
    tok = Tokenizer.from_file(rangecoder.default_tokenizer())
    full = {i: [*tok.encode(r.text, add_special_tokens=False).ids, 2] for i, r in good.items()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in good.items()}
    start, whole, cut = 0, {}, {}
    for r in got:
        assert r.start == start
        start += r.n_tokens
        ids, source = full[r.doc_id], good[r.doc_id].source
        if r.n_tokens == len(ids):
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            whole[source] = whole.get(source, 0) + size[r.doc_id]
        else:
            assert r.n_tokens < len(ids) and source not in cut  # at most the document on a source's border is cut
            cut[source] = size[r.doc_id]
    sizes = {}
    for i, r in good.items():
        sizes[r.source] = sizes.get(r.source, 0) + size[i]
    for source, target in _targets(sizes).items():
        assert whole.get(source, 0) <= target + 1e-6 and target - 1 - 1e-6 <= whole.get(source, 0) + cut.get(source, 0)


def test_stages_keep_columns_and_survive_odd_tables(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "x y z"), (4, "w " * 30_000)])
    docs = docs.withColumn("n", F.lit(1)).withColumn("row_", F.lit("x")).withColumn("taken", F.lit(1))
    for table in (docs, docs.where("false")):
        out = table
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == docs.columns
            out.collect()
        assert C.STAGES[-1][1](spark, table, SF).count() == table.count()


def test_shape():
    assert [n for n, _ in C.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination",
                                        "mixing sources to target weights", "token-ID binary output"]
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
