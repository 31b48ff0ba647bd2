"""Column functions on hand-made values, against the standard library where it has the same function."""

import datetime
import html
import random
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from pagemill.functions import charset, numbers, prompts, text, urls

NBSP = " "


def apply(spark, function, values, *more):
    """`function` over a column of values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    rows = df.select("i", function(F.col("v"), *more).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


SPACED = ["", " ", "a", " a  b ", f"{NBSP}a{NBSP}{NBSP}b\t", "a\r\nb\x0b\x0cc", " x　", "\x1ca\x1f \x85b", "a​b"]


def test_white_space(spark):
    assert apply(spark, text.collapse, SPACED) == [" ".join(s.split()) for s in SPACED]
    assert apply(spark, text.strip, SPACED) == [s.strip() for s in SPACED]
    assert apply(spark, text.rstrip, SPACED) == [s.rstrip() for s in SPACED]
    assert apply(spark, text.clean_field, ["a,b", " x ,  y ", None]) == ["a b", "x   y", ""]


def test_truncate_counts_code_points(spark):
    for limit, expected in ((3, "a😀b"), (0, "a😀bc"), (-1, "a😀bc"), (99, "a😀bc"), (None, "a😀bc")):
        assert apply(spark, text.truncate, ["a😀bc"], limit) == [expected]


def test_lines(spark):
    values = ["", "a", "a\n", "a\r\nb\rc", "\n\na", "a b\x85c", "a\n\n"]
    assert apply(spark, text.split_lines, values) == [v.splitlines() for v in values]
    assert apply(spark, text.output_lines, ["a  \r\n\r\n  \nb\t\rc", "", "\n"]) == [["a", "", "b", "c"], [], []]


def test_byte_order_mark(spark):
    assert apply(spark, text.strip_bom, ["﻿a", "﻿﻿a", "a﻿"]) == ["a", "a", "a﻿"]


def test_unescape_plain_references(spark):
    names = [f"x&{n};y" for n in text.ENTITIES]
    numbers_ = [f"&#{n};" for n in (32, 126, 160, 999, 8212, 54999)] + ["&#x41;", "&#Xe9;", "&#x2014;", "&#x1F600;", "&#38;lt;"]
    others = ["", "&", "a & b", "&amp;lt;", "&amp;amp;", "&lt;&gt;", "no", "a&é;"]
    values = names + numbers_ + others
    assert apply(spark, text.unescape, values) == [html.unescape(v) for v in values]


def test_odd_references_are_told(spark):
    rng = random.Random(3)
    bits = ["&", "#", "x", "amp", "lt", "copy", ";", " ", "1", "50", "nosuch", "AMP", "not", "in", "&#", "é", "=", "hellip"]
    values = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 6))) for _ in range(4000)]
    odd = apply(spark, lambda c: c.rlike(text.ODD_REFERENCE), values)
    decoded = apply(spark, text.unescape, values)
    wrong = [(v, d) for v, o, d in zip(values, odd, decoded) if not o and d != html.unescape(v)]
    assert not wrong
    assert sum(not o for o in odd) > 500


def test_whole_numbers(spark):
    values = ["91", " 91 ", "+5", "-5", "8.5", "x", "", None, "-000" + "9" * 30, "1e3", f"{NBSP}7", "-0", "000", "+", "+0012"]
    assert apply(spark, numbers.whole, values) == ["91", "91", "5", "-5", None, None, None, None, "-" + "9" * 30, None, "7", "0", "0", None, "12"]


def test_order_of_whole_numbers(spark):
    rng = random.Random(5)
    values = [str(rng.choice([1, -1]) * rng.randrange(10 ** rng.randint(0, 60))) for _ in range(500)] + ["0", "-1", "1"]
    df = spark.createDataFrame([(v,) for v in values], "v STRING")
    assert [r.v for r in df.orderBy(numbers.order_key(F.col("v")), "v").collect()] == sorted(values, key=lambda v: (int(v), v))
    assert df.filter(numbers.order_key(F.col("v")) >= numbers.order_key(F.lit("80"))).count() == sum(int(v) >= 80 for v in values)


def test_dates(spark):
    values = ["2024-10-11", "2024-1-5", " 2024 - 1 - 5 ", "2024-13-01", "2024-02-30", "2024-01", "2024-01-01-01", "", None,
              "20245-1-1", "24-1-1", "2024-001-01", "02024-1-5", "0000-01-01", "a-b-c", "2024--1"]
    found = apply(spark, numbers.to_date, values)
    day = datetime.date
    assert found[:3] == [day(2024, 10, 11), day(2024, 1, 5), day(2024, 1, 5)]
    assert found[3:] == [None] * 7 + [day(24, 1, 1), day(2024, 1, 1), day(2024, 1, 5), None, None, None]


def test_score(spark):
    rows = [(0, 1.0, 5.0, 0.0, 10.0, None), (0, 1.0, 20.0, 0.0, 10.0, None), (0, 1.0, 5.0, 50.0, 10.0, 100.0),
            (1, 1.0, 5.0, 0.0, 10.0, None), (0, 0.5, 5.0, 0.0, 10.0, None), (0, 1.0, 5.0, 0.0, 0.0, None), (0, 1.0, 5.0, 0.0, None, None)]
    df = spark.createDataFrame(rows, "rc INT, correct DOUBLE, time_s DOUBLE, peak_mb DOUBLE, bt DOUBLE, bp DOUBLE")
    found = [r[0] for r in df.select(numbers.score(*[F.col(c) for c in df.columns])).collect()]
    assert found == pytest.approx([0.65, 0.5, 0.75, 0.0, 0.0, 0.5, 0.5])


URLS = ["http://h/p", "HTTPS://User:pw@Host.COM:80/x?y#z", "https://www.web.com", "https://WEB.COM", "http://www.example.com/",
        "https://example.org", "http://sub.example.com", "mailto:a@b", "no url", "", "//h/x", "http://ogp.me", "ftp://wwww.x"]


def test_netloc(spark):
    found = apply(spark, urls.netloc, URLS)
    assert found[:10] == [urlsplit(u).netloc.lower() for u in URLS[:10]]
    assert apply(spark, urls.is_example, URLS)[4:7] == [False, True, False]


def test_domain_key(spark):
    assert apply(spark, urls.domain_key, URLS)[2:5] == ["web.com", "web.com", "example.com"]
    compat = apply(spark, lambda c: urls.domain_key(c, compat=True), URLS)
    assert compat[2:] == [urlsplit(u).netloc.lower().lstrip("www.") for u in URLS[2:10]] + [compat[10], "ogp.me", "x"]


def test_urls_in_text(spark):
    values = ["see HTTP://a/b, http://c;https://d e", f"http://x{NBSP}y", "none", "https://"]
    assert apply(spark, urls.urls_in, values) == [["HTTP://a/b", "http://c", "https://d"], ["http://x"], [], []]


def test_resolve_is_urljoin(spark):
    rng = random.Random(1)
    bases = ["http://h", "http://h/", "http://h/a", "http://h/a/", "http://h/a/b?q=1#f", "https://u:p@H.com:80/x/y/z.html;p?k",
             "http://h//a//b", "http://h/a/../b/", "http://h/;p", "http://h?x=/y"]
    hrefs = ["http://o/p?", "HTTP://o", "https://o/../x", "//h2/y", "/x", "x", "../x", "../../../x", "?z=1", "#k", "mailto:a@b",
             "x/../y?k=/../v", ".", "..", "./", "a//b", "/a//b", "/../..", "x;p", "x;", ";p", "?", "#", "http:foo", "é/ü", "\tx\n",
             "  /y", "/a/.b/..c", "javascript:void(0)", "1:2", "///x"]
    bits = ["a", "b", ".", "..", "/", "/", "?", "#", ";", ":", "x", "http:", "//"]
    hrefs += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(400)]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b STRING, h STRING")
    found = df.select("b", "h", urls.resolve(F.col("b"), F.col("h")).alias("r")).collect()
    assert [r for r in found if r.r != urljoin(r.b, r.h)] == []


def test_cache_key(spark):
    assert apply(spark, urls.url_key, ["a"]) == ["86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"]


ROUTED = {
    "dame el código de estado de http://x": "web_status_codes",
    "DAME LOS CÓDIGOS HTTP": "web_status_codes",
    "http status please, and titles": "web_status_codes",
    "el título principal": "web_h1_texts",
    "encabezados": "web_h1_texts",
    "los enlaces y los títulos": "web_links",
    "hipervínculo": "web_links",
    "api json": "web_json_api",
    "titles": "web_titles_hard",
    "linkspam": "web_titles_hard",
    "": "web_titles_hard",
}


def test_routes(spark):
    assert apply(spark, prompts.route, list(ROUTED)) == list(ROUTED.values())
    asks = ["Límpialo por favor", "LIMPIALO", "texto  limpio", "recórtalo", "trim to 5", "enlaces, clean to text", "enlaces"]
    assert apply(spark, prompts.route_clean, asks) == [
        prompts.CLEAN_JOB if clean else prompts.DEFAULT_JOB for clean in (1, 1, 0, 1, 1, 1, 0)
    ]
    assert apply(spark, prompts.route_all, asks[5:]) == [prompts.CLEAN_JOB, "web_links"]


def test_router_answers(spark):
    assert apply(spark, prompts.route_json, ["enlaces"]) == ['{"skill":"web_links"}']
    answers = ['{"skill":"web_links"}', '{"skill":""}', "{}", "no json", None]
    assert apply(spark, prompts.routed_job, answers) == ["web_links"] + [prompts.DEFAULT_JOB] * 4


def test_limits(spark):
    values = ["300 caracteres", "a 20CARACTER", "caracteres 5", "9 9 caracteres", "99999999999 caracteres", ""]
    assert apply(spark, prompts.limit, values) == [300, 20, None, 9, None, None]


def test_task_specs(spark):
    specs = apply(spark, prompts.task_spec, [" Lista CSV alfabéticamente ascendente ", "csv", "csv descendente por nombre", "hola"])
    assert [s.goal for s in specs][0] == "Lista CSV alfabéticamente ascendente"
    assert [s.constraints for s in specs] == [
        {"sort_by": "name", "order": "asc"}, {"sort_by": "size", "order": "desc"}, {"sort_by": "name", "order": "desc"}, {}]
    assert [s.inputs for s in specs] == [["ruta"]] * 3 + [[]]
    assert specs[3].io_contract == {} and specs[1].io_contract == {"stdout": "lista_csv_ordenados"}
    assert {(s.metric, s.timeout_s) for s in specs} == {("correctness", 30)}


def test_charsets(spark):
    rows = [("á€".encode(), "text/html"), ("á".encode("latin-1"), "text/html; charset=ISO-8859-1"), (b"a\xffb", None),
            ("á€".encode("utf-16"), "x; CHARSET=UTF-16"), ("€".encode("cp1252"), "x; charset=windows-1252"),
            ("á".encode(), "x; charset=nosuch"), (b"a\xff", "x; charset=us-ascii"), (b"", "text/html"), (None, "text/html")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, body BINARY, ct STRING")
    found = df.select("i", charset.decode(F.col("body"), F.col("ct")).alias("t")).orderBy("i").collect()
    assert [r.t for r in found] == ["á€", "á", "a�b", "á€", "€", "á", "a�", "", None]


def test_wide_charsets_stay_in_the_jvm(spark):
    """What is well-formed is decoded without Python, to what Python makes of it; the rest is left to it."""
    rng = random.Random(3)
    rows = []
    for name in ("utf-16", "UTF-16BE", "utf-16-le", "utf_32", "utf-32be", "UTF-32LE", "us-ascii"):
        for _ in range(60):
            text = "".join(rng.choice(["a", "é", "€", "😀", "\ufeff", "\ud7ff", "\ue000", "\n", "\U0010ffff"]) for _ in range(rng.randint(0, 8)))
            body = text.encode(name, errors="ignore")
            if rng.random() < 0.4:
                body = bytes(rng.choice([0, 0xD8, 0xDC, 0xFE, 0xFF, 0x41]) for _ in range(rng.randint(0, 12)))
            rows.append((body, f"text/html; charset={name}", body.decode(name, errors="replace")))
            if name == "utf-16":
                rows += [(text.encode("utf-16-be"), "x; charset=utf-16", text.encode("utf-16-be").decode("utf-16", errors="replace"))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, body BINARY, ct STRING, expected STRING")
    found = df.select("expected", charset.decode(F.col("body"), F.col("ct")).alias("t"), charset._wide(F.col("body"), charset.charset(F.col("ct"))).alias("sure")).collect()
    assert [r.t for r in found] == [r.expected for r in found]
    assert all(r.sure in (None, r.expected) for r in found)
    assert sum(r.sure is not None for r in found) > len(found) / 2
