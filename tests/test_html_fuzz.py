"""The JVM extraction must give the parser's answer or none, on any page."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import html as native
from pagemill.functions import parser

OPEN = ["<p>", "<div class=a>", "<b>", "<h1>", "<h1 id='x'>", "<a href='/x'>", '<a class="c" href="y?a=1&amp;b=2">', "<a>",
        "<a name=n href = z >", "<title>", "<TITLE lang=en>", "<noscript>", "<template>", "<span\n title=\"q\">", "<li>",
        "<rt>", "<section>", "<A HREF=\"/U\">"]
CLOSE = ["</p>", "</div>", "</b>", "</h1>", "</H1 >", "</a>", "</a >", "</title>", "</noscript>", "</template>", "</span>",
         "</li>", "</rt>", "</section>", "</body>"]
VOID = ["<br>", "<br/>", "<img src=a.png alt=\"x\">", "<meta name=\"description\" content=\"d&eacute;j&agrave; vu\">",
        "<META NAME=Description CONTENT='one two'>", "<meta property=og:title content=\"T &amp; U\">",
        "<meta name=\"twitter:card\" content=\" c \">", "<meta name='keywords' content='k'>", "<meta name=description>",
        "<meta name=\"\" property=\"og:x\" content=\"y\">", "<link rel=icon href=\"f.ico\">",
        "<link rel='SHORTCUT ICON' href=/g.ico>", "<link rel=stylesheet href=s.css>", "<link rel=icon>", "<hr>",
        "<a href=one href=two>"]
BLOCKS = ["<script>var a = '<p>x</p>';</script>", "<SCRIPT src=x></SCRIPT>", "<style>p{}</style>", "<!-- c -->", "<!---->",
          "<!-- <h1>no</h1> -->", "<script>// <!-- \n</script>", "<noscript>off <b>on</b></noscript>",
          "<noscript><script>'</noscript>'</script>on</noscript>", "<noscript><!-- </noscript> -->on</noscript>",
          "<template><style></template></style>t</template>", "<p title=\"<!-- \">", "<a title='<script>' href=q>l</a>",
          "<template><h1>t</h1></template>", "<textarea>t</textarea>", "<!DOCTYPE html>", "<title>Tt, &quot;q&quot;</title>",
          "<h1>One <b>two</b>,\n three</h1>", "<h1> &nbsp;x<!-- y --> z<br>w</h1>", "<a href='/k'> k &lt;l&gt; </a>"]
TEXT = ["word ", " ", "\n\t", "a,b ", "&amp;", "&amp;lt; ", "&copy;", "&copy 2020 ", "&nbsp;", "&#8212;", "&#x1F600;", "&#0;",
        "&#150;", "&nosuch;", "&notit; ", "AT&T ", "&", "&a", "a & b ", "x y", "é", "&apos;", "&amp;copy; ", "&hellip;",
        "&#38;lt; ", "&amp;amp; ", "x=1&lang=2 ", " "]
ODD = ["<", "a < b ", "a<3 ", "<p", "</ p>", "<a href=\"x>y\">", "<!x>", "<?php ?>", "</>", "<script>", "</script>", "<style>", "<!--",
       "-->", "<p title=it's>", "<b/ >", "<h1", "<title/>", "<script/>", "<p title=\"a", "<![CDATA[x]]>", "<x-y z>", "</noscript>"]
TAIL = ["&cop", "&amp", "&#12", "x & y"]

JOBS = ["title", "h1", "links", "meta", "text", "spaced_text", "record"]


def _page(rng: random.Random, odd: float) -> str:
    kinds = [TEXT, TEXT, TEXT, OPEN, CLOSE, VOID, BLOCKS, BLOCKS]
    parts = [rng.choice(ODD if rng.random() < odd else rng.choice(kinds)) for _ in range(rng.randint(0, 14))]
    return "".join(parts) + (rng.choice(TAIL) if rng.random() < 0.05 else "")


def _wellformed(rng: random.Random, depth: int = 0) -> str:
    parts = []
    for _ in range(rng.randint(0, 5)):
        if depth < 4 and rng.random() < 0.4:
            tag = rng.choice(["p", "div", "b", "span", "h1", "a", "section", "em"])
            attrs = ' href="/d/e"' if tag == "a" else rng.choice(["", " id=x", ' class="a b"'])
            parts.append(f"<{tag}{attrs}>{_wellformed(rng, depth + 1)}</{tag}>")
        else:
            parts.append(rng.choice(rng.choice([TEXT[:5] + TEXT[8:11], VOID[:12], BLOCKS])))
    return "".join(parts)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(11)
    texts = [_page(rng, 0.0) for _ in range(4000)] + [_page(rng, 0.1) for _ in range(2000)]
    texts += [_wellformed(rng) for _ in range(4000)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, html STRING").repartition(8).cache()


@pytest.mark.parametrize("job", JOBS)
def test_native_is_exact_or_silent(pages, job):
    found = pages.select(
        "id", "html", getattr(native, job)(F.col("html")).alias("sure"), getattr(parser, job)(F.col("html")).alias("parsed")
    ).collect()
    wrong = [(r.html, r.sure, r.parsed) for r in found if r.sure is not None and r.sure != r.parsed]
    assert not wrong, (len(wrong), wrong[:3])
    assert sum(r.sure is not None for r in found) > len(found) / 4
