import os
import subprocess
import sys
import itertools

import numpy as np
from pyspark.sql import functions as F

from assetlytics.llm import langid as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    got = L.identify(docs, L.fit_languages(docs.where(fold != 2))).join(docs.where(fold == 2).select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    score, lens = rng.normal(size=(11, 3)) * 4, np.array([5, 0, 6])
    score[2, 1] = -np.inf
    got = L.viterbi(score, lens, 2.0)
    for a, n in ((0, 5), (5, 6)):
        def value(p):
            return sum(score[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
        assert abs(value(got[a:a + n]) - max(map(value, itertools.product(range(3), repeat=n)))) < 1e-9


def test_spans_and_scripts(spark, docs_of):
    train = docs_of([(i, "the of and with that was " * 20, "s", "en") for i in range(5)] + [(9, "привет как дела это хорошо " * 20, "s", "ru"),
                    (10, "der die das und nicht mit " * 20, "s", "de"), (11, "some text", "s", None), (12, None, "s", "fr")])
    m = L.fit_languages(train)
    assert m.langs == ["de", "en", "ru"]
    spans = L.label_spans(m, ["the of and with that der die das und nicht mit привет это"])[0]
    assert spans == [(0, 5, "en"), (5, 11, "de"), (11, 13, "ru")]
    assert set(np.flatnonzero(np.isfinite(m.word_scores(["привет"])[0]))) == {2}


def test_rare_language_beside_a_hot_one(docs_of):
    docs = docs_of([(i, "the of and with that was " * 2000, "s", "en") for i in range(40)] + [(90, "ja nie się jest tego oraz " * 40, "s", "pl")])
    m = L.fit_languages(docs)  # 0.05 % of the words
    assert np.isfinite(m.word_scores(["nie"])).all()
    assert {r.doc_id: r.lang_pred for r in L.identify(docs.where("doc_id IN (0, 90)"), m).collect()} == {0: "en", 90: "pl"}


def test_viterbi_of_many_languages():
    score = np.zeros((6, 300))
    score[:3, 299] = score[3:, 200] = 9.0
    assert L.viterbi(score, np.array([6]), 2.0).tolist() == [299] * 3 + [200] * 3


def test_edge_rows(docs_of):
    docs = docs_of([(1, None), (2, "12 !! ٣"), (3, "the of " * 100_000), (None, "the of"), (4, "the of"), (4, "the of"), (5, "漢字")])
    docs = docs.withColumn("spans", F.lit(1)).withColumn("score", F.lit("x"))
    m = L.fit_languages(docs.where("doc_id = 3"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, m).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3] == got[4] == got[None] == ("en", 1.0)
    assert got[5][0] == "en"  # a script of no learned language: any of them, the first
    none = L.fit_languages(docs.where("false"))
    assert {r.lang_pred for r in L.identify(docs, none).collect()} == {"und"}
    assert L.identify(docs.where("false"), m).count() == 0


def test_texts_of_numerals_have_no_language(docs_of):
    rows = [(i, f"the plain words number {i} of this text", None, "en") for i in range(30)]
    model = L.fit_languages(docs_of(rows))
    odd = ["½ ② Ⅷ", "²", "12 34", "¾x" * 2, "٣٤", ""]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs_of(list(enumerate(odd))), model).collect()}
    assert [got[i] for i in (0, 1, 2, 4, 5)] == [("und", 0.0)] * 5 and got[3][0] == "en"


def test_workers_need_no_copy_of_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {repo!r})
from assetlytics.llm import langid
from assetlytics.session import get_spark
spark = get_spark("far", cpus="2", shuffle_partitions=2)
docs = spark.createDataFrame([(i, "some plain words " * 3, "en") for i in range(8)], "doc_id long, text string, lang string")
print("LANGS", {{r.lang_pred for r in langid.identify(docs, langid.fit_languages(docs)).collect()}})
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "LANGS {'en'}" in done.stdout, done.stderr[-2000:]


def test_words_of_ascii_texts_are_the_same_words():
    texts = ["", "It's 3rd_base, O'Neil! \t\n\x0b\x1f a-b c1d", "".join(map(chr, range(128))) * 2, "İı Ḱx straße", "नमस्ते ab", "Kelvin"]
    for t in texts:
        assert L.words_of(t) == L.WORD.findall(t.lower())
