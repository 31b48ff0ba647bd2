"""Crawls and caches laid out for what asks them: by buckets of the URL, and by prefixes of the cache key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import url_key
from pagemill.operators.crawl import new_pages

#: Buckets of a crawl table. A list of a few URLs reads a few of them; a list of any length is brought to them.
BUCKETS = 64
#: Leading hexadecimal digits of a cache key that name its partition: 256 partitions.
PREFIX = 2


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below `spark.checkpoint.dir`, or on a local master, where that is unset, a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        place = tempfile.mkdtemp(prefix="pagemill-")
    return f"{place.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


# --- crawls by URL ------------------------------------------------------------------------------------


def write_crawl(crawled: DataFrame, name: str, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The crawl as table `name`, in buckets of `url` sorted by it. Lookups by URL need no shuffle of it.

    Rows are brought together by bucket first, so a bucket is one file, whatever the number of tasks.
    """
    writer = crawled.repartition(buckets, "url").write.bucketBy(buckets, "url").sortBy("url").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return crawled.sparkSession.table(name)


def crawl_of(store: DataFrame, urls: Iterable[str]) -> DataFrame:
    """Rows of a crawl table for URLs that the driver knows: only their buckets are read, and in those, which are
    sorted, only row groups that can hold them."""
    return store.filter(F.col("url").isin(list(dict.fromkeys(urls))))


def url_rows_of(spark: SparkSession, urls: Iterable[str]) -> DataFrame:
    """A URL list (`pos`, `url`) from URLs that the driver knows."""
    return spark.createDataFrame(list(enumerate(urls)), "pos bigint, url string")


# --- caches by key prefix -----------------------------------------------------------------------------


def write_cache(cache: DataFrame, path: str) -> None:
    """A cache (`key`, `html`) in partitions of its keys' first digits; what is there is replaced."""
    _laid_out(cache).write.mode("overwrite").partitionBy("prefix").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """`key`, `html` and `prefix` of a cache."""
    return spark.read.schema("key string, html string, prefix string").parquet(path)


def held_pages(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """`pos`, `url`, `key` and `html` of the requests (`pos`, `url`) that a stored cache holds; partitions that no
    request asks for are not read."""
    keyed = _prefixed(requests.withColumn("key", url_key(F.col("url"))))
    return keyed.join(cache, ["prefix", "key"]).select("pos", "url", "key", "html")


def update_cache(spark: SparkSession, path: str, fetched: DataFrame) -> None:
    """Fetched pages (`pos`, `url`, `html`) that a stored cache does not hold are added, the first of each URL.

    Only partitions that get a page are written again, each as a whole: what they held and the new. Others keep their
    files. The new files replace the old ones when all of them are written.
    """
    cache = read_cache(spark, path)
    new = _prefixed(new_pages(cache, fetched))
    touched = new.select("prefix").distinct()
    kept = cache.join(touched, "prefix", "left_semi").select("key", "html", "prefix")
    rows = kept.unionByName(new.select("key", "html", "prefix"))
    out = rows.repartition("prefix").sortWithinPartitions("prefix", "key").write.mode("overwrite")
    out.option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)


def _prefixed(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("prefix", F.substring("key", 1, PREFIX))


def _laid_out(cache: DataFrame) -> DataFrame:
    return _prefixed(cache.select("key", "html")).repartition("prefix").sortWithinPartitions("prefix", "key")
