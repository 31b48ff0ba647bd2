"""Page extraction jobs over a crawl: one scan, no shuffle, bodies dropped as soon as they are read.

A crawl is a DataFrame with `url` and `html`, optionally `status` and `error`; `html` is NULL where a page
is missing. What a job answers for a missing or failed page is part of the job:

| job                  | missing        | HTTP error            |
|----------------------|----------------|-----------------------|
| titles, h1s          | empty value    | empty value           |
| links, metas         | no row         | the error page's rows |
| texts, spaced_texts  | empty value    | the error page's text |
| clean_records        | `(error) ...`  | `(error) ...`         |
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as native
from pagemill.functions import parser
from pagemill.functions.text import truncate
from pagemill.functions.urls import EXAMPLE_TITLE, is_example, resolve

# Keys whose value is a reference to be resolved against the page.
REFERENCE_KEYS = ["icon", "og:image", "twitter:image"]


@dataclass(frozen=True)
class Extraction:
    """One extraction in both forms; the JVM form answers NULL for pages it is not exact on."""

    native: Callable[[Column], Column]
    parser: Callable[[Column], Column]
    rows: Callable | None = None  # the parser's elements as a table function


TITLE = Extraction(native.title, parser.title)
H1 = Extraction(native.h1, parser.h1)
LINKS = Extraction(native.links, parser.links, parser.link_rows)
META = Extraction(native.meta, parser.meta, parser.meta_rows)
TEXT = Extraction(native.text, parser.text)
SPACED_TEXT = Extraction(native.spaced_text, parser.spaced_text)
RECORD = Extraction(native.record, parser.record)


def extract(pages: DataFrame, name: str, what: Extraction, mode: str = "auto") -> DataFrame:
    """`html` replaced by the extracted column `name`.

    `auto` gives the parser's answer on every page: what the JVM form is certain of stays in the JVM, and
    the UDF is handed NULL for it, so both forms share one scan and only odd pages cross into Python.
    `native` leaves odd pages NULL, `parser` sends every page to Python.
    """
    kept = [c for c in pages.columns if c != "html"]
    body = F.coalesce("html", F.lit(""))
    if mode == "native":
        return pages.select(*kept, what.native(body).alias(name))
    if mode == "parser":
        return pages.select(*kept, what.parser(body).alias(name))
    answer = F.when(F.col("_odd").isNull(), F.col("_sure")).otherwise(what.parser(F.col("_odd")))
    return _split(pages, what).select(*kept, answer.alias(name))


def _split(pages: DataFrame, what: Extraction) -> DataFrame:
    """`html` replaced by `_sure`, the JVM form's answer, and `_odd`, the body where it has none."""
    kept = [c for c in pages.columns if c != "html"]
    body = F.coalesce("html", F.lit(""))
    sure = pages.select(*kept, what.native(body).alias("_sure"), body.alias("_body"))
    return sure.select(*kept, "_sure", F.when(F.col("_sure").isNull(), F.col("_body")).alias("_odd"))


def _rows(pages: DataFrame, what: Extraction, item: str, fields: tuple[str, str], mode: str) -> DataFrame:
    """One row per element of an extraction, in a struct `item` with its place `ord`.

    Odd pages give their rows one by one through a table function, so no page becomes an array in Python; the others
    pass it as NULL and are exploded in the JVM.
    """
    if mode == "native":
        return _exploded(extract(pages, "_found", what, mode), "_found", item)
    kept = [c for c in pages.columns if c != "html"]
    if mode == "parser":
        one_by_one = pages.select(*kept, F.coalesce("html", F.lit("")).alias("_odd")).lateralJoin(what.rows(F.col("_odd").outer()))
        return one_by_one.select(*kept, F.col("_ord").alias("ord"), _element(F.col("_one"), F.col("_other"), fields).alias(item))
    both = _split(pages, what).lateralJoin(what.rows(F.col("_odd").outer()))
    each = both.select(*kept, "_ord", "_one", "_other", F.posexplode_outer("_sure").alias("_pos", "_item"))
    own = F.when(F.col("_ord").isNotNull(), _element(F.col("_one"), F.col("_other"), fields)).otherwise(F.col("_item"))
    return each.select(*kept, F.coalesce("_ord", "_pos").alias("ord"), own.alias(item)).filter(F.col("ord").isNotNull())


def _element(one: Column, other: Column, fields: tuple[str, str]) -> Column:
    return F.struct(one.alias(fields[0]), other.alias(fields[1]))


def failed(pages: DataFrame) -> Column:
    """Page missing or, where the crawl records it, answered with an HTTP error."""
    missing = F.col("html").isNull()
    return missing | (F.coalesce("status", F.lit(0)) >= 400) if "status" in pages.columns else missing


def _field(pages: DataFrame, name: str, what: Extraction, mode: str) -> DataFrame:
    good = pages.withColumn("html", F.when(~(failed(pages) | is_example(F.col("url"))), F.col("html")))
    answer = F.when(is_example(F.col("url")), EXAMPLE_TITLE).otherwise(F.col(name))
    return extract(good, name, what, mode).withColumn(name, answer)


def titles(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """`title` of every page, empty where there is none."""
    return _field(pages, "title", TITLE, mode)


def h1s(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """First `h1` of every page, empty where there is none."""
    return _field(pages, "h1", H1, mode)


def _exploded(found: DataFrame, column: str, item: str) -> DataFrame:
    """One row per element. An inner explode would have Spark infer a size filter, push it below the
    extraction and so work the extraction out twice; this one filters above."""
    kept = [c for c in found.columns if c != column]
    return found.select(*kept, F.posexplode_outer(column).alias("ord", item)).filter(F.col("ord").isNotNull())


def links(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """One row per closed anchor with a href: `ord`, `text` and the absolute `href`."""
    return _resolved_links(_rows(pages, LINKS, "_link", ("text", "href"), mode))


def link_rows(found: DataFrame) -> DataFrame:
    """Rows of an extracted `links` column."""
    return _resolved_links(_exploded(found, "links", "_link"))


def _resolved_links(rows: DataFrame) -> DataFrame:
    href = resolve(F.col("url"), F.col("_link.href"))
    return rows.select("*", "_link.text", href.alias("href")).drop("_link")


def metas(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """One row per wanted meta tag or icon: `ord`, `key`, `value`; references in values made absolute."""
    return _resolved_metas(_rows(pages, META, "_meta", ("key", "value"), mode))


def meta_rows(found: DataFrame) -> DataFrame:
    """Rows of an extracted `metas` column."""
    return _resolved_metas(_exploded(found, "metas", "_meta"))


def _resolved_metas(rows: DataFrame) -> DataFrame:
    key, value = F.col("_meta.key"), F.col("_meta.value")
    absolute = F.when(F.lower(key).isin(REFERENCE_KEYS), resolve(F.col("url"), value)).otherwise(value)
    return rows.select("*", key.alias("key"), absolute.alias("value")).drop("_meta")


def texts(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """`texto`: visible text, pieces joined without blanks."""
    return extract(pages, "texto", TEXT, mode)


def spaced_texts(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """`texto`: text outside script and style, pieces joined with blanks."""
    return extract(pages, "texto", SPACED_TEXT, mode)


def clean_records(pages: DataFrame, limit: Column | int | None = None, mode: str = "auto") -> DataFrame:
    """`title`, `h1`, `meta_description` and `texto` cut to `limit` characters; errors noted in `texto`."""
    bad = failed(pages)
    reasons = [F.col("error")] if "error" in pages.columns else []
    if "status" in pages.columns:
        reasons.append(F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    reason = F.when(bad, F.concat(F.lit("(error) "), F.coalesce(*reasons, F.lit("page not fetched"))))
    marked = pages.withColumn("_error", reason).withColumn("html", F.when(~bad, F.col("html")))
    found = extract(marked, "_record", RECORD, mode)
    return found.select(
        *[c for c in found.columns if not c.startswith("_")],
        "_record.title",
        "_record.h1",
        "_record.meta_description",
        F.coalesce("_error", truncate(F.col("_record.texto"), limit)).alias("texto"),
    )
