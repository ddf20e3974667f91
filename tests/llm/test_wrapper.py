import html
import re

import pytest
from pyspark.sql import functions as F

from weekwatch.llm import wrapper as X

SCHEMA = "page_id long, url string, html string"


def text_of(spark, pages, **k):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], SCHEMA)
    return [r.text for r in X.main_text(df, **k).orderBy("page_id").collect()]


def blocks(markup):
    return [(x.label, t) for x, t, _ in X.parse(markup)[1]]


def test_documents_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in X.main_text(pages).collect()}
    raw = pages.collect()
    assert len(got) == len(raw)
    for p in raw:
        article = re.search(r"<article>(.*)</article>", p.html, re.S)[1].replace("<br>", " ")
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[p.page_id].text == "\n\n".join(b for b in want if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("a<br>b", [("#page", "a b")]),
        ("<p>one<p>two</p>three", [("p", "one"), ("p", "two"), ("#page", "three")]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", [("li", "a"), ("li", "b"), ("li", "c")]),
        ("<P CLASS='x y9'>a &lt;b&gt; &amp;&nbsp;c &#x41;", [("p.x y0", "a <b> & c A")]),
        ("1 < 2 <b>x</b> <!-- <p>no</p> -->y", [("#page", "1 < 2 x y")]),
        ("<script>if (a<b) '</p>'</SCRIPT>t<style>p{}</style>", [("#page", "t")]),
        ("<table><tr><td>a<td><p>b<tr><th>c</table>", [("td", "a"), ("p", "b"), ("th", "c")]),
        ("<dl><dt>a<dd>b<dt>c</dl>", [("dt", "a"), ("dd", "b"), ("dt", "c")]),
        ("<div title='a > b'>x</div></nope></p>", [("div", "x")]),
        ("<div title='never closed>x</div>", [("div", "x")]),
        ("<![CDATA[a<b]]><?php x ?>c<", [("#page", "a<bc<")]),
        ("<script>never closed", []), ("", []), ("   \n", []),
    ],
)
def test_markup(markup, want):
    assert blocks(markup) == want


def test_trees_and_matching():
    t = "a(b,c(d,e),f.x y(g))"
    assert X.dump(X.load(t)) == t
    m = X.merge(X.load("a(b,c(d),f)"), X.load("a(c(e,d),g,f)"))
    assert X.dump(m) == "a(b,c(e,d),g,f)"
    assert X.Matching().of(X.load("a(b,c(d,e))"), X.load("a(x,c(e),b)"))[0] == 3
    assert X.align(X.load("a(b,c(d,e))"), X.load("a(c(e))")) == {0: 0, 1: 2, 2: 4}
    assert X.Matching().of(X.load("a"), X.load("b")) == (0, [])


def test_template_texts_of_a_host_go(spark):
    pages = [
        (f"http://h.example/{i}", f"<html><body><div class='top'>Welcome to us</div><div class='c'><p>Story {i} begins.</p><p>Read our rules.</p><p>It ends {i * 7}.</p></div>"
         f"<div class='list'><a href='/'>link {i}</a></div><div class='comments'><p>nice {i}</p></div></body></html>")
        for i in range(14)
    ]
    assert text_of(spark, pages) == [f"Story {i} begins.\n\nIt ends {i * 7}." for i in range(14)]


def test_labels_decide_on_small_hosts(spark):
    page = (
        "<body><header><p>site</p></header><aside>side</aside><div role='navigation'>n</div><main><article><header><h1>T</h1></header><p>body</p>"
        "<form><p>f</p></form><div class='cookie-notice'>c</div><section id='comments'><p>r</p></section><p hidden>h</p><p style='display: none'>h</p></article></main>"
        "<div class='ad-slot'>buy</div><footer>f</footer></body>"
    )
    assert text_of(spark, [("http://a/", page), ("http://b/", "<p>plain page</p>")]) == ["T\n\nbody", "plain page"]


def test_equal_pages_are_no_template(spark):
    assert text_of(spark, [("http://a/", "<article><p>same story</p></article>")] * 15) == ["same story"] * 15


def test_awkward_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "", ""), (3, "no url", "<p>x</p>"), (None, "http://a/", "<p>y</p>"), (5, "http://a/5", deep), (6, "http://a/6", "<p>" + "long text " * 50_000), (6, "http://a/6", "<p>" + "long text " * 50_000), (7, "http://a/7", "<p>(a),b</p><div class='a(b),c'>z</div>")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash")).withColumn("blocks", F.lit(1)).repartition(3)
    got = sorted(((r.page_id, r.url, r.text) for r in X.main_text(df).collect()), key=str)
    long = ("long text " * 50_000).strip()
    want = [(1, None, ""), (2, "", ""), (3, "no url", "x"), (None, "http://a/", "y"), (5, "http://a/5", "deep"), (6, "http://a/6", long), (6, "http://a/6", long), (7, "http://a/7", "(a),b\n\nz")]
    assert got == sorted(want, key=str)
    assert X.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_host_is_merged_in_groups(spark):
    trees = spark.createDataFrame([("h", f"#page(a,b{i},c(d{i % 3}))", i + 1) for i in range(50)] + [("g", "#page", 1)], "host string, tree string, n long")
    out = {r.host: X.load(r.wrapper) for r in X.induce(trees, group=8).collect()}
    assert set(out) == {"h", "g"}
    labels = [x.label for x in X.preorder(out["h"])]
    assert {f"b{i}" for i in range(50)} <= set(labels) and labels.count("a") == 1


def test_a_notice_longer_than_the_article_is_template(spark):
    notice = "All stories of this site may be copied by anyone who names the site and the day. " * 5
    page = lambda i: (f"http://n.example/{i}", f"<html><body><div class='c'><p>Story {i} begins.</p><p>It ends {i * 7}.</p></div><div class='q'><p>{notice}</p></div></body></html>")
    want = [f"Story {i} begins.\n\nIt ends {i * 7}." for i in range(14)]
    assert text_of(spark, [page(i) for i in range(14)]) == want
    # copies of one page are one page: ten rows of two pages are no host of ten
    few = text_of(spark, [page(i % 2) for i in range(12)])
    assert all(notice.strip() in t for t in few)
