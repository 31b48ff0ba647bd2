"""URL columns: network location, domain key, reference resolution, URLs inside text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let

# Hosts that answer without a crawl.
EXAMPLE_HOSTS = ["example.com", "example.org", "example.net"]
EXAMPLE_TITLE = "Example Domain"
EXAMPLE_STATUS = "200"

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*+):"
_OPTIONAL_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*+:)?+"
_SUFFIX = r"(?:\?[^#\x00-\x20]++)?+(?:#[^\x00-\x20]++)?+\z"
_ABSOLUTE = rf"^[a-z][a-z0-9+.-]*+://[^/?#;\x00-\x20]++(?:/[^;?#\x00-\x20]*+)?+{_SUFFIX}"
_ROOTED = rf"^(?:/(?![/.])[^/;?#\x00-\x20]*+)++{_SUFFIX}"
_BEFORE_PATH = rf"{_OPTIONAL_SCHEME}(?://[^/?#]*+)?+"


def netloc(url: Column) -> Column:
    """Lower-cased network location with port and user-info; empty if the URL has none."""
    return F.lower(F.regexp_extract(url, rf"{_SCHEME}//([^/?#]*+)", 2))


def is_example(url: Column) -> Column:
    return netloc(url).isin(EXAMPLE_HOSTS)


def domain_key(url: Column, compat: bool = False) -> Column:
    """Key of the per-domain preferences: the network location without a leading `www.`.

    `compat` strips any leading run of the characters `w` and `.` instead, so `web.com` becomes `eb.com`.
    """
    return F.regexp_replace(netloc(url), r"^[w.]++" if compat else r"^\.*+(?:www\.)?+\.*+", "")


def urls_in(text: Column) -> Column:
    """All http(s) URLs of a text in order, each up to the next white space, comma or semicolon."""
    return F.regexp_extract_all(text, F.lit(r"(?iU)(https?://[^\s,;]++)"), F.lit(1))


def url_key(url: Column) -> Column:
    """Cache key: SHA-1 of the URL's UTF-8 bytes."""
    return F.sha1(url)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of `href` found on the page `base` (an http(s) URL), as urllib's urljoin gives it."""
    origin = F.regexp_extract(base, r"^[a-z][a-z0-9+.-]*+://[^/?#\x00-\x20]++", 0)
    # Nearly all references are absolute already or start at the root: those need no taking apart.
    return (
        F.when(href.rlike(_ABSOLUTE), href)
        .when((origin != "") & href.rlike(_ROOTED), F.concat(origin, href))
        .otherwise(let(_parts(base), lambda b: let(_parts(href), lambda h: _resolve(base, href, b, h))))
    )


def _parts(url: Column) -> Column:
    """STRUCT of the parts of a URL, the parameters of the last segment split off; absent ones are empty."""
    url = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]++", ""), r"[\t\r\n]", "")
    return let(
        url,
        lambda u: F.struct(
            F.lower(F.regexp_extract(u, _SCHEME, 1)).alias("scheme"),
            F.regexp_extract(u, rf"{_OPTIONAL_SCHEME}//([^/?#]*+)", 1).alias("netloc"),
            F.regexp_extract(u, rf"{_BEFORE_PATH}((?:[^?#/]*+/)*+[^/;?#]*+)", 1).alias("path"),
            F.regexp_extract(u, rf"{_BEFORE_PATH}(?:[^?#/]*+/)*+[^/;?#]*+;([^?#]*+)", 1).alias("params"),
            F.regexp_extract(u, r"^[^?#]*+\?([^#]*+)", 1).alias("query"),
            F.regexp_extract(u, r"(?s)^[^#]*+#(.*)", 1).alias("fragment"),
        ),
    )


def _resolve(base: Column, href: Column, b: Column, h: Column) -> Column:
    has_host = h["netloc"] != ""
    same_page = ~has_host & (h["path"] == "") & (h["params"] == "")
    path = F.when(has_host, h["path"]).when(same_page, b["path"]).otherwise(_merge_paths(b["path"], h["path"]))
    joined = _unsplit(
        b["scheme"],
        F.when(has_host, h["netloc"]).otherwise(b["netloc"]),
        path,
        F.when(same_page, b["params"]).otherwise(h["params"]),
        F.when(same_page & (h["query"] == ""), b["query"]).otherwise(h["query"]),
        h["fragment"],
    )
    other_scheme = (h["scheme"] != "") & (h["scheme"] != b["scheme"])
    return F.when(href == "", base).when((base == "") | other_scheme, href).otherwise(joined)


def _merge_paths(base: Column, path: Column) -> Column:
    """A reference's path against the path of its base, dot segments worked off."""
    folder = F.split(F.regexp_replace(base, r"/[^/]*+\z", ""), "/")

    def relative(joined: Column) -> Column:
        inner = F.filter(F.slice(joined, F.lit(2), F.greatest(F.size(joined) - 2, F.lit(0))), lambda s: s != "")
        return F.concat(F.slice(joined, 1, 1), inner, F.slice(joined, -1, 1))

    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(
        let(F.concat(folder, F.split(path, "/")), relative)
    )
    return F.regexp_replace(let(segments, _drop_dots), r"^\z", "/")


def _drop_dots(segments: Column) -> Column:
    def step(done: Column, seg: Column) -> Column:
        parent = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(seg == "..", parent).when(seg == ".", done).otherwise(F.concat(done, F.array(seg)))

    done = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    empty_end = F.when(ends_in_dots, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(done, empty_end), "/")


def _unsplit(
    scheme: Column, netloc: Column, path: Column, params: Column, query: Column, fragment: Column
) -> Column:
    """Parts put together, absent ones without their mark; a path next to a host starts with a slash."""

    def marked(before: str, part: Column, after: str = "") -> Column:
        return F.regexp_replace(part, r"(?s)^(.+)\z", f"{before}$1{after}")

    whole_path = F.concat(path, marked(";", params))
    rooted = F.when(netloc == "", whole_path).otherwise(F.regexp_replace(whole_path, r"^(?=[^/])", "/"))
    return F.concat(
        marked("", scheme, ":"), marked("//", netloc), rooted, marked("?", query), marked("#", fragment)
    )
