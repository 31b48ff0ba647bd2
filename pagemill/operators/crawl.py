"""Crawl tables: URL list to latest page, cache, status, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.charset import decode
from pagemill.functions.urls import EXAMPLE_STATUS, is_example, url_key
from pagemill.operators.lookup import lookup, newest_rows
from pagemill.operators.prefilter import bit_set, may_hold

# Answers worth another try, number of tries after the first, base of the waiting time.
RETRY_STATUSES = [429, 500, 502, 503, 504]
RETRY_TOTAL = 2
BACKOFF_S = 0.3


def fetch(urls: DataFrame, pages: DataFrame, version: str | None, hot_rows: int | None = None) -> DataFrame:
    """Rows of a URL list (`pos`, `url`; order and duplicates kept) with the columns of the latest page; of the one
    page there is of a URL, if there is no `version`.

    Missing pages leave NULLs. Sort by `pos` at the sink if order matters. Call it with extracted columns,
    not with page bodies: then only those are moved.
    """
    return lookup(urls, pages, ["url"], spread="pos", newest=version, hot_rows=hot_rows)


def wanted(urls: DataFrame, pages: DataFrame, version: str) -> DataFrame:
    """Pages that a URL list asks for, the newest of each URL, and by chance a few others: to extract from.

    Told on narrow columns; the pages themselves pass a bit set of fixed size where they are read, so none is
    shuffled, and what an extraction costs goes by the list.
    """
    asked = pages.select("url", version).join(urls.select("url").distinct(), "url", "left_semi")
    newest = asked.groupBy("url").agg(F.max(version).alias(version))
    found = bit_set(newest.select(F.xxhash64("url", version).alias("hash")))
    return pages.filter(may_hold(found, F.xxhash64("url", version)))


def wanted_of_store(urls: DataFrame, store: DataFrame, version: str) -> DataFrame:
    """The newest page of each URL that a list asks for, of a crawl in buckets of `url` (`sources.store.write_crawl`).

    The list is brought to the buckets, where its part of a bucket is hashed and the pages stream past it; pages are
    neither moved nor sorted, and what is extracted from them is still dealt by URL.
    """
    asked = urls.select("url").filter(F.col("url").isNotNull()).distinct()
    return newest_rows(store.join(asked.hint("shuffle_hash"), "url", "left_semi"), ["url"], version)


def with_body_only(fetched: DataFrame, body: str = "html") -> DataFrame:
    """Fetched rows with a non-empty body: what the link and meta jobs look at."""
    return fetched.filter(F.col(body) != "")


def statuses(fetched: DataFrame) -> DataFrame:
    """`status` as text, empty where the page is missing; example hosts always answer."""
    answer = F.when(is_example(F.col("url")), EXAMPLE_STATUS).otherwise(
        F.coalesce(F.col("status").cast("string"), F.lit(""))
    )
    return fetched.withColumn("status", answer)


def retry_queue(crawl: DataFrame) -> DataFrame:
    """Failed tries (`status`, `attempt` counted from 1, optional `method`) to repeat, with the wait before."""
    again = F.col("status").isin(RETRY_STATUSES) & (F.col("attempt") <= RETRY_TOTAL)
    if "method" in crawl.columns:
        again = again & (F.col("method") == "GET")
    return crawl.filter(again).withColumn("wait_s", F.lit(BACKOFF_S) * F.pow(F.lit(2.0), F.col("attempt") - 1))


def cache_split(requests: DataFrame, cache: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Requests (`pos`, `url`) with their cache `key` and whether `cache` (by unique `key`) holds it."""
    keyed = requests.withColumn("key", url_key(F.col("url")))
    held = cache.select("key").withColumn("cached", F.lit(True))
    found = lookup(keyed, held, ["key"], spread="pos", hot_rows=hot_rows)
    return found.withColumn("cached", F.coalesce("cached", F.lit(False)))


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Each URL still to be fetched, once. Copies of a request meet, and then the cache, by one key."""
    keyed = requests.select(url_key(F.col("url")).alias("key"), "url")
    first = keyed.groupBy("key").agg(F.min("url").alias("url"))
    return first.join(cache.select("key"), "key", "left_anti")


def new_pages(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """`key` and `html` of the fetched pages (`pos`, `url`, `html`) that the cache does not hold, the first of each URL.

    Bodies of pages that it holds are dropped before the first of a URL is chosen.
    """
    keyed = fetched.select(url_key(F.col("url")).alias("key"), "pos", "html").filter(F.col("html").isNotNull())
    new = keyed.join(cache.select("key"), "key", "left_anti")
    return new.groupBy("key").agg(F.min_by("html", "pos").alias("html"))


def cache_update(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """Cache with the fetched pages (`pos`, `url`, `html`) that it did not hold yet."""
    return cache.unionByName(new_pages(cache, fetched))


def decoded(crawl: DataFrame) -> DataFrame:
    """`body` bytes and their `content_type` replaced by the text `html`."""
    text = decode(F.col("body"), F.col("content_type"))
    return crawl.withColumn("html", text).drop("body", "content_type")
