import random
from collections import defaultdict

from pyspark.sql import functions as F

from assetlytics.llm import linededup as D

BLANKS = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def _plain(rows, min_length=10, min_docs=2):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(_key(line)) >= min_length:
                held[_key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [i is not None and len(held[_key(x)]) >= min_docs and i != min(held[_key(x)]) for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)


def test_matches_a_plain_version(docs_of):
    rnd = random.Random(3)
    pool = [f"Line number {k} of the pool" for k in range(40)] + ["short", "", "  ", "ÄÖÜ same LETTERS", "äöü same letters", "Ａ full width line"]
    rows = [(i, "\n".join(rnd.choice(["", " ", "\t"]) + rnd.choice(pool) + rnd.choice(["", "\r", " \x0b"]) for _ in range(rnd.randrange(1, 12)))) for i in range(120)]
    docs = docs_of(rows).repartition(5)
    assert _got(D.dedup_lines(docs)) == _plain(rows)
    assert _got(D.dedup_lines(docs, min_docs=4)) == _plain(rows, min_docs=4)
    assert _got(D.dedup_lines(docs, min_length=3)) == _plain(rows, min_length=3)


def test_hot_line_is_looked_up_and_texts_are_whole(docs_of):
    own = [f"line {k} of the long text" for k in range(20_000)]
    rows = [(i, "A NOTICE that every page carries\nown words of page %d" % i) for i in range(3000)] + [(9000, "\n".join(own * 2)), (9001, own[77] + "\ntail")]
    got = {r.doc_id: r for r in D.dedup_lines(docs_of(rows)).collect()}
    assert got[0].n_dropped == 0 and all(got[i].n_dropped == 1 and got[i].text == f"own words of page {i}" for i in range(1, 3000))
    assert got[9000].n_dropped == 0 and got[9000].n_lines == 40_000  # repeats within one document stay
    assert got[9001].text == "tail"


def test_edge_rows(docs_of):
    line = "the very same line"
    rows = [(5, line), (5, line), (5, line + "\nmore of this one"), (7, line), (None, line), (None, line), (8, None), (9, ""), (10, "\n\n"), (11, line + "\n"), (12, line + "\n\n" + line)]
    docs = docs_of(rows).withColumn("lines_", F.lit(1)).withColumn("h1", F.lit("x")).withColumn("text_", F.lit(0)).withColumn("n_lines", F.lit(2))
    assert _got(D.dedup_lines(docs)) == _plain(rows)
    assert D.dedup_lines(docs.where("false")).count() == 0
    assert _got(D.dedup_lines(docs_of([(1, line)]))) == [(1, line, 1, 0)]


def test_keys_of_ascii_and_other_lines(spark):
    lines = ["", " \t", "PLAIN Ascii LINE \r", "ÄÖÜ and ABC", "İstanbul KELVIN \u212a", "ΣΑΣ Ä", "\xa0NBSP\x85", "\x0b[Z`A]{z}\x0c", "𝔘 Deseret 𐐀 X"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", D.line_key(F.col("line")).alias("k"))
    assert {r.line: r.k for r in df.collect()} == {x: _key(x) for x in lines}


def test_lines_are_hashed_in_one_pass(docs_of):
    docs = docs_of([(i, f"a notice on every page\nown words of page {i}") for i in range(50)])
    out = D.dedup_lines(docs)
    assert sum(r.n_dropped for r in out.collect()) == 49
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "translate" not in plan  # twice before; only the written hashes are read here
