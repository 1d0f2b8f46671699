import random
import re

import numpy as np
from pyspark.sql import functions as F

from assetlytics.llm import runs as R


def _plain(x, least=6, periods=4):
    out = []
    for p in range(1, len(x) // periods + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j - i + p >= max(least, periods * p) and not any(a <= i and j + p <= a + n and p % q == 0 for a, n, q in out):
                out.append((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(out)


def _sequences(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        x = [rnd.randrange(rnd.choice([1, 2, 2, 3, 5, 50])) for _ in range(rnd.randrange(0, 160))]
        for _ in range(rnd.randrange(3) if len(x) > 4 else 0):
            a = rnd.randrange(len(x))
            p = rnd.randrange(1, max(2, (len(x) - a) // 2) + 1)
            for i in range(a, rnd.randrange(a, len(x) + 1)):
                x[i] = x[a + (i - a) % p]
        yield x


def test_runs_of_many_sequences():
    xs = list(_sequences(2500, 1))
    assert R.runs_of([np.array(x, np.int64) for x in xs]) == [_plain(x) for x in xs]
    assert R.runs_of([np.array(x, np.int64) for x in xs[:500]], 9, 5) == [_plain(x, 9, 5) for x in xs[:500]]


def test_words_appended_one_by_one_or_together():
    rnd = random.Random(2)
    for x in _sequences(500, 3):
        catcher, at = R.SquareCatcher(), 0
        while at < len(x):
            step = rnd.choice([1, 1, 2, 7, 40])
            catcher.append(x[at:at + step])
            at += step
            if rnd.random() < 0.2:
                assert catcher.runs() == _plain(x[:at])
        assert catcher.runs() == _plain(x)


def test_collisions_of_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(R, "_mixed", lambda h: h & np.uint64(1))
    for x in _sequences(150, 4):
        assert R.runs_of([np.array(x, np.int64)]) == [_plain(x)]


def test_whole_texts(docs_of):
    rnd = random.Random(5)
    blanks = [" ", "\t", "\n", "\x0b ", "\r\n", "\x0c"]
    texts = [rnd.choice(["", " "]) + "".join(f"w{v}{rnd.choice(['', ' ', 'é'])}" + rnd.choice(blanks) for v in x) for x in _sequences(300, 6)]
    long = "start " + "all the same again " * 60_000 + "end"
    rows = [*enumerate(texts), (1000, long), (1001, "x" * 3_000_000 + " y"), (1002, "　a　b " * 9)]
    out = R.find_runs(docs_of(rows).repartition(3)).collect()
    assert len(out) == len(rows)
    for r in out:
        words = re.findall(r"[^\x20\x09-\x0D]+", dict(rows)[r.doc_id])
        want = [(1, 240_000, 4)] if r.doc_id == 1000 else _plain(words)
        gone = {i for a, n, p in want for i in range(a + p, a + n)}
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(words)
        assert r.text == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_long_texts_are_split_in_pieces(monkeypatch):
    monkeypatch.setattr(R, "PIECE_BYTES", 50)
    text = ("a bb ccc\t" * 200 + "tail " + "z" * 300 + "   ").encode()
    ids = R.word_ids([text])[0]
    assert len(ids) == 602 and R.runs_of([ids]) == [[(0, 600, 3)]]
    assert R.collapsed(text, [(0, 600, 3)], 602) == b"a bb ccc tail " + b"z" * 300
    assert R.collapsed(text, [], 602) == b" ".join(text.split())


def test_edge_rows(docs_of):
    docs = docs_of([(None, "a a a a a a"), (1, None), (1, ""), (2, " \n"), (2, " \n"), (3, "a a a a a"), (4, "a b a b a b a b")])
    docs = docs.withColumn("runs", F.lit(1)).withColumn("text_", F.lit("x")).withColumn("n_words", F.lit(9))
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.text) for r in R.find_runs(docs).collect())
    assert got == [("1", 0, [], ""), ("1", 0, [], ""), ("2", 0, [], ""), ("2", 0, [], ""), ("3", 5, [], "a a a a a"),
                   ("4", 8, [(0, 8, 2)], "a b"), ("None", 6, [(0, 6, 1)], "a")]
    assert R.find_runs(docs.where("false")).count() == 0
