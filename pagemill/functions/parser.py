"""Arrow-batched HTML parsing for the pages that regexes cannot be trusted on.

The UDFs get NULL for every other page (see `operators.pages.extract`), so only odd pages cross into Python.
A page is tokenised once by the standard library; each job is a short walk over the tokens.
The module is pickled by value, so executors need not have this package installed.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from html import unescape
from html.parser import HTMLParser
from typing import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import schemas
from pagemill.functions.html import HIDDEN_CLEAN, HIDDEN_SPACED, HIDDEN_TEXT, META_NAMES, META_PREFIXES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without content.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track",
        "wbr"]
# Elements whose strings are not text of the elements around them.
NOT_TEXT = ["script", "style", "template", "rt", "rp"]


class _Tokens(HTMLParser):
    """(kind, name or data, attributes) triples; kind is `open`, `close`, `data`, `cdata` or `break`."""

    def __init__(self, page: str, to_the_end: bool = False):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, dict]] = []
        try:
            self.feed(page)
            # Text cut off inside a reference is held back until `close`. A tag or comment cut off is no
            # text in the HTML standard; the library tries it over and over, in quadratic time.
            if to_the_end and not self.rawdata.startswith("<"):
                self.close()
        except Exception:  # a page the parser gives up on keeps what was read so far
            pass

    def handle_starttag(self, tag, attrs):
        self.found.append(("open", tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.found.append(("close", tag, {}))

    def handle_data(self, data):
        self.found.append(("data", data, {}))

    def handle_comment(self, data):
        self.found.append(("break", "", {}))

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        is_cdata = data.upper().startswith("CDATA[")
        self.found.append(("cdata" if is_cdata else "break", data[6:] if is_cdata else "", {}))


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def _outside(tokens: list, hidden: list[str]) -> Iterator[str]:
    depth = 0
    for kind, value, _ in tokens:
        if kind == "data" and not depth:
            yield value
        elif value in hidden and kind == "open":
            depth += 1
        elif value in hidden and kind == "close":
            depth = max(0, depth - 1)


def _nodes(tokens: list) -> Iterator[tuple[str | None, list, dict, dict]]:
    """(string, open elements, their places by name, {}) for every string, and (NULL, ..., attributes) for
    every element start.

    Open elements are (number, name), outermost first. An end tag closes the nearest open element of its
    name and all inside it. The lists are live: use them before asking for the next node.
    """
    chain: list[tuple[int, str]] = []
    places: dict[str, list[int]] = defaultdict(list)
    text: list[str] = []
    for i, (kind, value, attrs) in enumerate([*tokens, ("break", "", {})]):
        if kind == "data":
            text.append(value)
            continue
        if text:
            yield "".join(text), chain, places, {}
            text = []
        if kind == "cdata":
            yield value, chain, places, {}
        if kind == "open":
            places[value].append(len(chain))
            chain.append((i, value))
            yield None, chain, places, attrs
        if places[value] and (kind == "close" or (kind == "open" and value in VOID)):
            closed = chain[places[value][-1] :]
            del chain[places[value][-1] :]
            for _, name in closed:
                places[name].pop()


def _record(tokens: list) -> dict:
    """First title and h1, first description, and the strings of the clean-text job."""
    first: dict[str, tuple[int, tuple[int, str]]] = {}

    def inside(name: str, chain: list) -> bool:
        place, element = first.get(name, (len(chain), None))
        return place < len(chain) and chain[place] == element

    titles: list[str] = []
    headings: list[str] = []
    shown: list[str] = []
    title_has_children = False
    description = None
    for string, chain, places, attrs in _nodes(tokens):
        if string is None:
            tag = chain[-1][1]
            title_has_children |= inside("title", chain)
            first.setdefault(tag, (len(chain) - 1, chain[-1]))
            if tag == "meta" and description is None and (attrs.get("name") or "").lower() == "description":
                description = (attrs.get("content") or "").strip()
            continue
        if inside("title", chain):
            titles.append(string)
        if not any(places[name] for name in NOT_TEXT):
            if inside("h1", chain):
                headings.append(string.strip())
            if not any(places[name] for name in HIDDEN_CLEAN):
                shown.append(string)
    return {
        "title": titles[0] if len(titles) == 1 and not title_has_children else "",
        "h1": [s for s in headings if s],
        "meta_description": description or "",
        "texto": _squeeze(" ".join(shown)),
    }


def parse_title(page: str) -> str:
    found = _record(_Tokens(page, to_the_end=True).found)
    return _squeeze(found["title"] or "".join(found["h1"])).replace(",", " ")


def parse_h1(page: str) -> str:
    return _squeeze("".join(_record(_Tokens(page, to_the_end=True).found)["h1"])).replace(",", " ")


def parse_record(page: str) -> dict:
    found = _record(_Tokens(page, to_the_end=True).found)
    return found | {"title": found["title"].strip(), "h1": " ".join(found["h1"])}


def each_link(page: str) -> Iterator[tuple[str, str]]:
    """An end tag closes the latest open anchor; strings since the last closed one are its text."""
    href, text = None, []
    for kind, value, attrs in _Tokens(page).found:
        if kind == "data" and href is not None:
            text.append(value)
        elif value == "a" and kind == "open":
            href = (attrs.get("href") or "").strip()
        elif value == "a" and kind == "close" and href is not None:
            if href:
                yield "".join(text).strip(), href
            href, text = None, []


def each_meta(page: str) -> Iterator[tuple[str, str]]:
    for kind, tag, attrs in _Tokens(page).found:
        get = lambda name: attrs.get(name) or ""
        key = value = ""
        if kind == "open" and tag == "meta":
            key, value = (get("name") or get("property")).strip(), get("content").strip()
            if key.lower() not in META_NAMES and not key.lower().startswith(tuple(META_PREFIXES)):
                continue
        elif kind == "open" and tag == "link" and "icon" in get("rel").lower():
            key, value = "icon", get("href").strip()
        if value:
            yield key, value


def parse_links(page: str) -> list[dict]:
    return [{"text": text, "href": href} for text, href in each_link(page)]


def parse_meta(page: str) -> list[dict]:
    return [{"key": key, "value": value} for key, value in each_meta(page)]


def parse_text(page: str) -> str:
    return _squeeze(unescape("".join(_outside(_Tokens(page).found, HIDDEN_TEXT))))


def parse_spaced_text(page: str) -> str:
    return _squeeze(unescape(" ".join(_outside(_Tokens(page).found, HIDDEN_SPACED))))


def _udf(parse: Callable, schema) -> Callable:
    """Arrow UDF over a page column; a NULL page gives NULL, or a struct of NULLs."""

    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([None if page is None else parse(page) for page in pages], dtype=object)

    return F.pandas_udf(run, returnType=schema)


def _record_udf() -> Callable:
    names = schemas.RECORD.names

    def run(pages: pd.Series) -> pd.DataFrame:
        rows = [dict.fromkeys(names) if page is None else parse_record(page) for page in pages]
        return pd.DataFrame(rows, columns=names, dtype=object)

    return F.pandas_udf(run, returnType=schemas.RECORD)


class _LinkRows:
    def eval(self, page: str) -> Iterator[tuple[int | None, str | None, str | None]]:
        if page is None:
            yield None, None, None
        else:
            for place, pair in enumerate(each_link(page)):
                yield place, *pair


class _MetaRows:
    def eval(self, page: str) -> Iterator[tuple[int | None, str | None, str | None]]:
        if page is None:
            yield None, None, None
        else:
            for place, pair in enumerate(each_meta(page)):
                yield place, *pair


#: Table functions: a row for each link or meta of a page, as the parser comes to it; for NULL one row of NULLs.
link_rows = F.udtf(_LinkRows, returnType="_ord int, _one string, _other string", useArrow=True)
meta_rows = F.udtf(_MetaRows, returnType="_ord int, _one string, _other string", useArrow=True)

title = _udf(parse_title, T.StringType())
h1 = _udf(parse_h1, T.StringType())
links = _udf(parse_links, schemas.LINK)
meta = _udf(parse_meta, schemas.META)
text = _udf(parse_text, T.StringType())
spaced_text = _udf(parse_spaced_text, T.StringType())
record = _record_udf()
