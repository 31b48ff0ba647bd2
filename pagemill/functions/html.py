"""HTML extraction as JVM regex expressions, exact wherever they answer.

`is_regular` walks the page once with a possessive grammar: text, comments, closed script/style blocks,
well-quoted tags. Only on such pages can a regex be trusted to see what an HTML parser sees. Every
extraction here gives NULL where it is not certain, and the page takes the parser in `functions.parser`.
The tests are strict on purpose: a wrong "no" costs time, a wrong "yes" would cost a right result.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import ODD_REFERENCE, clean_field, collapse, let, strip, unescape

# Meta names kept besides every og: and twitter: one.
META_NAMES = ["description", "og:title", "og:description", "og:image", "twitter:title",
              "twitter:description", "twitter:image"]
META_PREFIXES = ["og:", "twitter:"]
# Elements whose text is never shown.
HIDDEN_TEXT = ["script", "style", "noscript"]
HIDDEN_SPACED = ["script", "style"]
HIDDEN_CLEAN = ["script", "style", "noscript", "template"]

_END = r"(?=[\s/>])"  # after a tag name
_VALUE = r"""(?:"[^"<>]*+"|'[^'<>]*+'|[!-~&&[^"'=<>`]]++)"""
_ATTRIBUTES = rf"(?:\s++[A-Za-z_:@*#.-][\w:.@*#-]*+(?:\s*+=\s*+{_VALUE})?+)*+\s*+"
_ONLY_TEXT = "title|textarea|iframe|noembed|noframes|xmp"
_SPECIAL = f"script|style|noscript|template|plaintext|{_ONLY_TEXT}"
_INLINE = "a|b|i|u|s|em|strong|span|small|sup|sub|code|mark|font|abbr|time"


def _closed(names: str, body: str) -> str:
    """Elements of these names with nothing but `body` inside."""
    return "|".join(rf"<{n}{_END}{_ATTRIBUTES}>{body}</{n}\s*+>" for n in names.split("|"))


def _markup(around: str = "-") -> str:
    """Text, comments and tags; comments and raw text must not seem to end an element `around` them."""
    return "|".join(
        [
            r"[^<]++",
            rf"<!--(?!-?>)(?:[^<-]++|-(?!-)|<(?!/(?:{around})))*+-->",
            r"<!doctype\s[^<>]*+>",
            rf"<(?!(?:{_SPECIAL}){_END})[a-z][\w:.-]*+{_ATTRIBUTES}/?+>",
            rf"</(?!(?:{_SPECIAL}){_END})[a-z][\w:.-]*+\s*+>",
            _closed("script", rf"(?:[^<]++|<(?!/(?:script|{around})))*+"),
            _closed("style", rf"(?:[^<]++|<(?!/(?:style|{around})))*+"),
            _closed(_ONLY_TEXT, "[^<]*+"),
        ]
    )


_BLOCKS = _closed("noscript|template", f"(?:{_markup(around='noscript|template')})*+")
_PAGE = rf"(?i)\A(?:{_markup()}|{_BLOCKS})*+\z"

_TWICE = r"(?i)<(?:a|meta|link)(?=\s)[^>]*?\s(href|name|property|content|rel)\s*+=[^>]*?\s\1\s*+="
_NESTED_ANCHOR = rf"(?i)<a{_END}[^>]*+>(?:[^<]++|<(?!/?a{_END}|!s))*+<(?:a{_END}|!s)"
_PLAIN_H1 = (
    rf"(?i)\A(?:[^<]++|<(?!h1{_END}))*+"
    rf"(?:\z|<h1{_END}[^>]*+>(?:[^<]++|<!>|<br\s*+/?+>|{_closed(_INLINE, '[^<]*+')})*+</h1\s*+>)"
)
_HIDDEN_HEADING = rf"(?i)<template{_END}(?:[^<]++|<(?!/template|h1{_END}|title{_END}))*+<(?:h1|title){_END}"
_RUBY = r"(?i)<r[tp][\s/>]"


def is_regular(page: Column) -> Column:
    """True if tags and references are written so plainly that regexes and a parser agree on them."""
    return page.rlike(_PAGE) & ~page.rlike(ODD_REFERENCE)


def _bare(page: Column) -> Column:
    """The page with comments cut down to `<!>` and script/style blocks to `<!script>`, `<!style>`."""
    return F.regexp_replace(page, rf"(?is)<(?:!--.*?--|(script|style){_END}[^>]*+>.*?</\1\s*+)>", "<!$1>")


def _visible(page: Column, hidden: list[str], between: str) -> Column:
    """Text outside tags, comments and `hidden` elements, pieces separated by `between`, decoded once."""
    block = rf"({'|'.join(hidden)}){_END}[^>]*+>.*?</\1\s*+"
    return unescape(F.regexp_replace(page, rf"(?is)<(?:!--.*?--|{block}|[^>]*+)>", between))


def _first(bare: Column, tag: str) -> Column:
    return F.regexp_extract(bare, rf"(?is)<{tag}{_END}[^>]*+>(.*?)</{tag}\s*+>", 1)


def _all(bare: Column, pattern: str) -> Column:
    return F.regexp_extract_all(bare, F.lit(f"(?is)({pattern})"), F.lit(1))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, references not decoded; empty if it is missing or has no value."""
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"']++)"""
    others = rf"(?:\s++(?!{name}[\s=/>])[^\s/>\"'=]++(?:\s*+=\s*+{value})?+)*+"
    raw = F.regexp_extract(tag, rf"(?i)^<[a-z][\w:.-]*+{others}\s++{name}\s*+=\s*+({value})", 1)
    return F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1\z""", "$2")


def _heading(bare: Column, between: str) -> Column:
    # After each "<" comes the rest of a tag, then text.
    texts = F.transform(F.split(_first(bare, "h1"), "<"), lambda p: F.regexp_replace(p, "^[^>]*+>", ""))
    pieces = F.transform(texts, lambda t: strip(unescape(t)))
    return F.array_join(F.filter(pieces, lambda p: p != ""), between)


def _with_headings(page: Column, use: Callable[[Column], Column]) -> Column:
    """`use(bare page)` where the headings are plain; a page is only cut down once it is known to be regular."""
    plain = lambda bare: F.when(bare.rlike(_PLAIN_H1), use(bare))
    return F.when(is_regular(page) & ~page.rlike(_HIDDEN_HEADING) & ~page.rlike(_RUBY), let(_bare(page), plain))


def title(page: Column) -> Column:
    """Text of `<title>`, or of the first `<h1>` where that is empty; no commas."""

    def chosen(bare: Column) -> Column:
        own = unescape(_first(bare, "title"))
        return clean_field(let(own, lambda t: F.when(t != "", t).otherwise(_heading(bare, ""))))

    return _with_headings(page, chosen)


def h1(page: Column) -> Column:
    """Text of the first `<h1>`, its pieces joined without blanks; no commas."""
    return _with_headings(page, lambda bare: clean_field(_heading(bare, "")))


def links(page: Column) -> Column:
    """Closed anchors with a non-empty href, in page order: ARRAY<STRUCT<text, href>>."""

    def anchors(bare: Column) -> Column:
        found = F.transform(
            _all(bare, rf"<a{_END}[^>]*+>.*?</a\s*+>"),
            lambda a: F.struct(
                strip(unescape(F.regexp_replace(a, r"<[^>]*+>", ""))).alias("text"),
                strip(unescape(_attribute(a, "href"))).alias("href"),
            ),
        )
        return F.filter(found, lambda a: a["href"] != "")

    plain = lambda bare: F.when(~bare.rlike(_NESTED_ANCHOR), anchors(bare))
    return F.when(is_regular(page) & ~page.rlike(_TWICE), let(_bare(page), plain))


def _meta_pair(tag: Column) -> Column:
    is_link = tag.rlike("(?i)^<link")
    name = _attribute(tag, "name")
    key = strip(unescape(F.when(name != "", name).otherwise(_attribute(tag, "property"))))
    wanted = F.lower(key).rlike(f"^(?:{'|'.join(META_PREFIXES)})|^(?:{'|'.join(META_NAMES)})\\z")
    is_icon = F.lower(unescape(_attribute(tag, "rel"))).contains("icon")
    value = F.when(is_link, _attribute(tag, "href")).otherwise(_attribute(tag, "content"))
    return F.struct(
        F.when(is_link, F.when(is_icon, "icon")).when(wanted, key).alias("key"), strip(unescape(value)).alias("value")
    )


def meta(page: Column) -> Column:
    """Wanted meta tags and icons in page order: ARRAY<STRUCT<key, value>>."""
    pairs = F.transform(_all(_bare(page), rf"<(?:meta|link){_END}[^>]*+>"), _meta_pair)
    wanted = F.filter(pairs, lambda m: m["key"].isNotNull() & (m["value"] != ""))
    return F.when(is_regular(page) & ~page.rlike(_TWICE), wanted)


def text(page: Column) -> Column:
    """Visible text, pieces joined without blanks, references decoded twice."""
    return _text(page, HIDDEN_TEXT, "")


def spaced_text(page: Column) -> Column:
    """Text outside script and style, pieces joined with blanks, references decoded twice."""
    return _text(page, HIDDEN_SPACED, " ")


def _text(page: Column, hidden: list[str], between: str) -> Column:
    # Decoding and joining may have made up new references: those too must be plain ones.
    once = let(
        _visible(page, hidden, between),
        lambda seen: F.when(~seen.rlike(ODD_REFERENCE), collapse(unescape(seen))),
    )
    return F.when(is_regular(page), once)


def record(page: Column) -> Column:
    """STRUCT<title, h1, meta_description, texto> of the clean-text job."""

    def fields(bare: Column) -> Column:
        described = F.filter(
            _all(bare, rf"<meta{_END}[^>]*+>"), lambda m: F.lower(unescape(_attribute(m, "name"))) == "description"
        )
        description = strip(unescape(_attribute(F.try_element_at(described, F.lit(1)), "content")))
        return F.struct(
            strip(unescape(_first(bare, "title"))).alias("title"),
            _heading(bare, " ").alias("h1"),
            F.coalesce(description, F.lit("")).alias("meta_description"),
            collapse(_visible(page, HIDDEN_CLEAN, " ")).alias("texto"),
        )

    return F.when(~page.rlike(_TWICE), _with_headings(page, fields))
