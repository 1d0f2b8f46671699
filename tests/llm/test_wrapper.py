import html
import re

import pytest
from pyspark.sql import functions as F

from assetlytics.llm import wrapper as W

SF = "/root/testdata/sf0.01"


def text(page, wrapper=None):
    return W.main_text(W.parse(page), wrapper)


def test_whole_table_against_markup_rule(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in W.extract(pages).collect()}
    assert len(got) == pages.count()
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = (re.sub(r"<[a-zA-Z/][^>]*>", "", re.sub(r"<br>", " ", b)) for b in re.split(r"</?(?:p|h1)>", inner))
        lines = (" ".join(html.unescape(b).split()) for b in blocks)
        want = "\n".join(x for x in lines if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (want, len(want))


def test_wrapper_expression():
    a = W.form(W.parse("<div><h1>A</h1><p>x</p><p>y</p><hr></div><ul><li>1</li></ul>"))
    b = W.form(W.parse("<div><h1>B</h1><em>new</em><p>x</p></div><ul><li>1</li><li>2</li></ul>"))
    assert W.expression(W.align(a, b)) == (
        f"<div><h1>#PCDATA</> (<em>#{W.zlib.crc32(b'new'):08x}</>)? (<p>#PCDATA</>)+ (<hr></>)?</> <ul>(<li>#PCDATA</>)+</>")
    pairs = W.form(W.parse("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>"))
    assert W.expression(pairs) == "<dl>(<(dt dd)><dt>#PCDATA</> <dd>#PCDATA</></>)+</>"


def test_parts_that_are_no_article():
    page = """<body class="home has-sidebar"><header><a href=/>Site</a></header><nav><li>Menu</nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>One<b>two</b> &lt;3<br>line</p><div class="ad-box">Buy</div>
    <form><input><label>Mail</label></form><ul><li>a<li>b &copy; c</ul><script>var x="</p>";</script><p>last&nbsp;one
    <section id="comments"><p>me too</p></section></article><aside>Side</aside><div class="sidebar">S</div><footer>F</footer></body>"""
    assert text(page) == "Title & more\nOnetwo <3 line\na\nb © c\nlast one"


def test_template_is_learned_without_an_article(spark):
    rows = [(i, "http://h.example/x", f"<body><div>Same on all</div><div><p>Story {i}</p><p>More {i * i}</p></div><div>Bye all</div></body>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in W.extract(pages).collect()} == {i: f"Story {i}\nMore {i * i}" for i in range(12)}


@pytest.mark.parametrize("fan", [2, 64])
def test_rounds_of_merging(spark, monkeypatch, fan):
    monkeypatch.setattr(W, "FAN_IN", fan)
    rows = [(i, "http://hot.example/", f"<article><p>{i}</p>{'<hr>' * (i % 2)}{'<h2>t</h2>' * (i % 3 == 0)}</article>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(20)
    out = W.infer_wrappers(pages).collect()
    assert [(r.host, r.pages) for r in out] == [("hot.example", 40)]


def test_edge_rows(spark):
    long = "<article>" + "<p>word " * 40_000
    rows = [(1, None, None), (2, "", ""), (3, "http://u@A.example:80/p", "no markup < 3 & x"), (3, "http://u@A.example:80/p", "no markup < 3 & x"),
            (None, "nonsense", "<p>id is null"), (4, "http://b.example", long), (5, "http://b.example", "<article><<p>x</p" + "<div>" * 300), (6, "http://b.example", "<!-- <p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit("own")).withColumn("wrapper", F.lit("w"))
    got = {r.page_id: (r.text, r.n_chars) for r in W.extract(pages).collect()}
    assert W.extract(pages).count() == 8
    assert got[1] == got[2] == got[6] == ("", 0) and got[3][0] == "no markup < 3 & x" and got[None][0] == "id is null"
    assert got[4][1] == 5 * 40_000 - 1
    assert W.extract(pages.where("false")).count() == 0
    assert [r.h for r in pages.select(W.host_of(F.col("url")).alias("h")).where("page_id = 3").collect()] == ["a.example"] * 2


def test_text_of_one_page_is_no_template(spark):
    rows = [(i, "http://h.example/x", f"<body><div>Same on all</div><div><p>Story {i}</p>{'<pre>only here</pre>' * (i == 3)}</div></body>") for i in range(12)]
    rows += [(100 + i, "http://copies.example/x", f"<body><div id=n{i}>Head</div><p>The one story</p></body>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in W.extract(pages).collect()}
    assert got == {**{i: f"Story {i}" + "\nonly here" * (i == 3) for i in range(12)}, **{100 + i: "Head\nThe one story" for i in range(8)}}


def test_wrapper_decides_inside_articles(spark):
    def page(i, rare=""):
        return (f"<article class='post comments-open'><h1>Title {i}</h1><div><span>Read more on our</span> <b>site</b></div><p>Story {i} by <em>one of us</em></p>"
                f"<p class=teaser>Members read this first</p><p>More {i * i}</p>{rare}</article>")
    rows = [(i, "http://h.example/x", page(i, "<blockquote>said once</blockquote>" * (i == 3) + "<h3>Sources</h3>" * (i % 4 == 0))) for i in range(24)]
    rows += [(100 + i, "http://copies.example/x", page(7)) for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in W.extract(pages).collect()}
    want = {i: f"Title {i}\nStory {i} by one of us\nMore {i * i}" + "\nsaid once" * (i == 3) + "\nSources" * (i % 4 == 0) for i in range(24)}
    assert {i: got[i] for i in want} == want
    plain = W.main_text(W.parse(page(7)), None)
    assert plain == "Title 7\nRead more on our site\nStory 7 by one of us\nMembers read this first\nMore 49"
    assert {got[100 + i] for i in range(8)} == {plain}
    one = W._merge_all([(1, W.form(W.parse(r[2]))) for r in rows[:24]])[1]
    assert "Read more" not in W.main_text(W.parse(rows[5][2]), one)


def test_repeated_headings_and_answers_stay(spark):
    """A wrapper takes a notice at a place of its own out of the article, and nothing that the article says."""
    def page(i):
        half = "<h2>Method</h2><p>Yes.</p>" if i % 2 else ""
        return (f"<nav>Menu</nav><article><p class=kicker>Read on at the Daily</p><h1>Title {i}</h1><h2>Summary</h2><p>Text {i}</p>{half}<p>More {i * i}</p>"
                f"<ul><li>First</li><li>Point {i}</li></ul><h2>Sources</h2><p>Thank you.</p><div>All rights <b>reserved</b></div></article>")
    rows = [(i, "http://h.example/x", page(i)) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in W.extract(pages).collect()}
    assert got == {i: f"Title {i}\nSummary\nText {i}" + "\nMethod\nYes." * (i % 2) + f"\nMore {i * i}\nFirst\nPoint {i}\nSources\nThank you." for i in range(20)}
    assert "Read on" in W.main_text(W.parse(page(1)), None)
