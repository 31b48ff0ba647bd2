"""Page extraction on hand-made pages, both ways of doing it, and the error policy of every job."""

import time

import pytest
from pyspark.sql import functions as F

from pagemill.operators import pages

HEAD = """<!DOCTYPE html><html><head><meta charset="utf-8"><title> The, title &amp; more </title>
<meta name="Description" content=" About&nbsp;it "><meta property='og:title' content="OG"><meta name=keywords content=k>
<meta name="twitter:image" content="img/t.png"><link rel="shortcut icon" href="/fav.ico"><link rel=stylesheet href=s.css>
<style>p > a {}</style><script>document.write("</p><h1>no</h1>");</script></head>"""
BODY = """<body><!-- <h1>not me</h1> --><h1> Big <b>News</b>, today </h1>
<p>One&nbsp; two<b>three</b>&amp;lt;</p><noscript>turn it on</noscript><template>tpl</template>
<a href="/x?a=1&amp;b=2"> go <i>there</i> </a><a name="n">no href</a><a href=' ../y '></a><a href="">none</a>
<A HREF=mailto:a@b>mail</A></body></html>"""
PAGE = HEAD + BODY
URL = "http://h.org/d/e/f"

# Pages only the parser gets right.
ODD = {
    "unclosed": ('<a href="/1">one<a href="/2">two</a>', [("onetwo", "http://h.org/2")]),
    "bracket in attribute": ('<a title="a>b" href="/1">x</a>', [("x", "http://h.org/1")]),
    "twice": ('<a href="/1" href="/2">x</a>', [("x", "http://h.org/2")]),
    "loose reference": ('<a href="?a=1&copy=2">&copy 1</a>', [("© 1", "http://h.org/d/e/f?a=1©=2")]),
    "script inside": ('<a href="/1">x<script>y</script></a>', [("xy", "http://h.org/1")]),
    "never closed": ('<a href="/1">x', []),
}


def crawl(spark, *bodies, **columns):
    rows = [(i, URL, b, *[c[i] for c in columns.values()]) for i, b in enumerate(bodies)]
    types = {"status": "INT", "error": "STRING", "url2": "STRING"}
    return spark.createDataFrame(rows, "page_id INT, url STRING, html STRING" + "".join(f", {c} {types[c]}" for c in columns))


def column(df, name):
    return [r[name] for r in df.orderBy("page_id").collect()]


@pytest.mark.parametrize("mode", ["auto", "native", "parser"])
class TestWholePage:
    def test_title_and_h1(self, spark, mode):
        crawled = crawl(spark, PAGE)
        assert column(pages.titles(crawled, mode), "title") == ["The  title & more"]
        assert column(pages.h1s(crawled, mode), "h1") == ["BigNews  today"]

    def test_links(self, spark, mode):
        found = pages.links(crawl(spark, PAGE), mode).orderBy("ord").collect()
        assert [(r.ord, r.text, r.href) for r in found] == [
            (0, "go there", "http://h.org/x?a=1&b=2"), (1, "", "http://h.org/d/y"), (2, "mail", "mailto:a@b")]

    def test_metas(self, spark, mode):
        found = pages.metas(crawl(spark, PAGE), mode).orderBy("ord").collect()
        assert [(r.key, r.value) for r in found] == [
            ("Description", "About it"), ("og:title", "OG"), ("twitter:image", "http://h.org/d/e/img/t.png"),
            ("icon", "http://h.org/fav.ico")]

    def test_texts(self, spark, mode):
        body = "<title>T</title><p>One&nbsp; two<b>three</b>&amp;lt;<!-- c -->x<noscript>off</noscript><style>s</style>"
        crawled = crawl(spark, body)
        assert column(pages.texts(crawled, mode), "texto") == ["TOne twothree<x"]
        made_up = crawl(spark, body.replace("&amp;lt;", "&amp;<b>copy</b>"))  # a reference that joining makes up
        assert column(pages.texts(made_up, mode), "texto") == [None if mode == "native" else "TOne twothree©x"]
        plain = crawl(spark, body.replace("&amp;lt;", "&lt;"))
        assert column(pages.texts(plain, mode), "texto") == ["TOne twothree<x"]
        assert column(pages.spaced_texts(plain, mode), "texto") == ["T One two three < x off"]

    def test_record(self, spark, mode):
        row = pages.clean_records(crawl(spark, PAGE), mode=mode).first()
        assert (row.title, row.h1, row.meta_description) == ("The, title & more", "Big News , today", "About it")
        assert row.texto == "The, title & more Big News , today One two three &lt; go there no href none mail"
        assert pages.clean_records(crawl(spark, PAGE), 8, mode).first().texto == "The, tit"

    def test_fallbacks(self, spark, mode):
        bodies = ["<h1>A <i>b</i></h1>", "<title></title><h1>x</h1>", "<title> </title><h1>x</h1>", "no tags", "", "<TITLE>U</TITLE>"]
        assert column(pages.titles(crawl(spark, *bodies), mode), "title") == ["Ab", "x", "", "", "", "U"]


@pytest.mark.parametrize("name", ODD)
def test_odd_pages_take_the_parser(spark, name):
    body, expected = ODD[name]
    assert column(pages.extract(crawl(spark, body), "links", pages.LINKS, "native"), "links") in ([None], [[]])
    found = pages.links(crawl(spark, body)).orderBy("ord").collect()
    assert [(r.text, r.href) for r in found] == expected


def test_parser_keeps_the_rules_of_the_clean_record(spark):
    bodies = [
        "<title>a<!-- c -->b</title><h1>x</h1>",  # not one string: no title
        "<div><h1>in</div>out",  # closed by the end of its parent
        "<h1>a<script>s</script><template>t</template>b<br>c",
        "<meta name=description><meta name=description content=later>",  # only the first counts
        "<noscript>n<p>m</noscript>a<![CDATA[b]]>",
        "<template><title>tt</title><h1>th</h1></template><h1>later</h1>",  # a template's strings are no text
    ]
    found = pages.clean_records(crawl(spark, *bodies), mode="parser").orderBy("page_id").collect()
    assert [r.title for r in found] == [""] * 5 + ["tt"]
    assert [r.h1 for r in found] == ["x", "in", "a b c", "", "", ""]
    assert [r.meta_description for r in found] == [""] * 6
    assert [r.texto for r in found] == ["a b x", "in out", "a b c", "", "a b", "later"]


def test_error_policy(spark):
    good = "<title>t</title><h1>h</h1><a href=/x>l</a><meta name=og:x content=y>"
    crawled = crawl(spark, good, good, None, "", status=[200, 404, None, 200], error=[None, None, "no route", None])
    assert column(pages.titles(crawled), "title") == ["t", "", "", ""]
    assert column(pages.h1s(crawled), "h1") == ["h", "", "", ""]
    assert [r.page_id for r in pages.links(crawled).collect()] == [0, 1]
    assert [r.page_id for r in pages.metas(crawled).collect()] == [0, 1]
    assert column(pages.texts(crawled), "texto") == ["thl", "thl", "", ""]
    assert column(pages.clean_records(crawled), "texto") == ["t h l", "(error) HTTP 404", "(error) no route", ""]
    assert column(pages.clean_records(crawled.drop("status", "error")), "texto")[2] == "(error) page not fetched"


def test_example_hosts(spark):
    rows = [(0, "https://EXAMPLE.com/x", None), (1, "http://example.org", "<title>own</title>"), (2, "http://sub.example.com", "<title>own</title>")]
    crawled = spark.createDataFrame(rows, "page_id INT, url STRING, html STRING")
    assert column(pages.titles(crawled), "title") == ["Example Domain", "Example Domain", "own"]
    assert column(pages.h1s(crawled), "h1") == ["Example Domain", "Example Domain", ""]


HOSTILE = {
    "unclosed comments": "<!--" * 50_000, "unclosed scripts": "<script>" * 50_000, "open anchors": "<a href=/x>" * 50_000,
    "deep": "<b>" * 100_000 + "x", "deep strings": "<b>x" * 50_000, "ampersands": "&" * 200_000, "loose": "&copy" * 100_000,
    "blanks": " \n" * 200_000, "quotes": "<p title='" * 20_000, "angles": "<" * 20_000, "stray ends": "</b>" * 100_000,
    "one long tag": "<a " + "href=x " * 20_000 + ">x</a>", "templates": "<template>" * 50_000, "h1s": "<h1>" * 30_000,
}


def test_hostile_pages_take_time_in_proportion(spark):
    crawled = crawl(spark, *HOSTILE.values()).repartition(8, "page_id")
    for job in (pages.titles, pages.metas, pages.texts, pages.clean_records, pages.links):
        start = time.monotonic()
        job(crawled).write.format("noop").mode("overwrite").save()
        assert time.monotonic() - start < 30, job


def test_long_pages_do_not_overflow(spark):
    body = "<p>" + "word <b>x</b> &amp; " * 200_000 + "<a href=/x>" + "y" * 1_000_000 + "</a><!--" + "z" * 500_000 + "-->"
    crawled = crawl(spark, body)
    for job in (pages.titles, pages.links, pages.metas, pages.texts, pages.clean_records):
        assert job(crawled, mode="native").count() == 1 or job is pages.metas
    assert pages.texts(crawled, "native").select(F.length("texto")).first()[0] > 2_500_000
    assert pages.links(crawled, "native").count() == 1


def test_many_anchors_in_one_odd_page(spark):
    anchors = "".join(f"<a href=/{i}>t{i}</a>" for i in range(100_000))
    odd = "<p <a>"
    df = spark.createDataFrame([(1, "http://x.y/", odd + anchors), (2, "http://x.y/", None), (3, "http://x.y/", odd), (4, "http://x.y/", "<a href='/z'>z</a>")],
                               "page_id INT, url STRING, html STRING")
    found = pages.links(df)
    assert found.count() == 100_001
    assert found.filter("page_id = 1").agg({"ord": "max"}).first()[0] == 99_999
    assert [tuple(r) for r in found.filter("page_id = 4").collect()] == [(4, "http://x.y/", 0, "z", "http://x.y/z")]


@pytest.mark.parametrize("mode", ["auto", "parser"])
def test_rows_are_those_of_the_arrays(spark, mode):
    odd = ["", None, "<a href=x>1</a><a href='y'>2</a>", "<p <a><a href=q>&lt</a><meta name=og:x content=1><link rel=icon href=f>", "<meta name='Description' content=' d '>"]
    df = spark.createDataFrame([(n, "http://h/", h) for n, h in enumerate(odd * 3)], "page_id INT, url STRING, html STRING")
    for rows, arrays, name, what in ((pages.links, pages.link_rows, "links", pages.LINKS), (pages.metas, pages.meta_rows, "metas", pages.META)):
        one, other = rows(df, mode), arrays(pages.extract(df, name, what, mode))
        assert one.columns == other.columns
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
