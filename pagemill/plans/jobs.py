"""Whole jobs: URL list to table, prompts to results, trials to leaderboard.

Pages that a list does not ask for, and older versions, are left out before extraction; the others are
extracted before anything is shuffled, so joins move titles or texts and never page bodies.
`version` names the column of the crawl that tells a URL's newer page from its older one. `stored` says that the crawl
is a table in buckets of `url`: then pages are found where they are, without a filter of the whole crawl.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.functions import prompts as requests
from pagemill.functions.urls import EXAMPLE_TITLE, is_example
from pagemill.operators import crawl, pages, results, trials
from pagemill.operators.lookup import lookup

NOT_FETCHED = "(error) page not fetched"


def _fetched(
    urls: DataFrame, crawled: DataFrame, version: str, extract: Callable[[DataFrame], DataFrame], stored: bool = False
) -> DataFrame:
    if stored:
        return crawl.fetch(urls, extract(crawl.wanted_of_store(urls, crawled, version)), None)
    return crawl.fetch(urls, extract(crawl.wanted(urls, crawled, version)), version)


def _filled(fetched: DataFrame, name: str, example: str | None = None) -> DataFrame:
    value = F.coalesce(name, F.lit(""))
    if example is not None:
        value = F.when(is_example(F.col("url")), example).otherwise(value)
    return fetched.select("pos", "url", value.alias(name))


def title_job(urls: DataFrame, crawled: DataFrame, version: str, mode: str = "auto", stored: bool = False) -> DataFrame:
    return _filled(_fetched(urls, crawled, version, lambda c: pages.titles(c, mode), stored), "title", EXAMPLE_TITLE)


def h1_job(urls: DataFrame, crawled: DataFrame, version: str, mode: str = "auto", stored: bool = False) -> DataFrame:
    return _filled(_fetched(urls, crawled, version, lambda c: pages.h1s(c, mode), stored), "h1", EXAMPLE_TITLE)


def text_job(urls: DataFrame, crawled: DataFrame, version: str, mode: str = "auto", stored: bool = False) -> DataFrame:
    return _filled(_fetched(urls, crawled, version, lambda c: pages.texts(c, mode), stored), "texto")


def status_job(urls: DataFrame, crawled: DataFrame, version: str) -> DataFrame:
    known = crawled.select("url", version, "status")
    return crawl.statuses(crawl.fetch(urls, known, version)).select("pos", "url", "status")


def link_job(urls: DataFrame, crawled: DataFrame, version: str, mode: str = "auto", stored: bool = False) -> DataFrame:
    found = _fetched(urls, crawled, version, lambda c: pages.extract(c, "links", pages.LINKS, mode), stored)
    return pages.link_rows(found.select("pos", "url", "links"))


def meta_job(urls: DataFrame, crawled: DataFrame, version: str, mode: str = "auto", stored: bool = False) -> DataFrame:
    found = _fetched(urls, crawled, version, lambda c: pages.extract(c, "metas", pages.META, mode), stored)
    return pages.meta_rows(found.select("pos", "url", "metas"))


def _errors_told(fetched: DataFrame) -> DataFrame:
    missing = F.when(F.col("texto").isNull(), NOT_FETCHED)
    return fetched.withColumn("texto", F.coalesce("texto", missing))


def clean_job(
    urls: DataFrame,
    crawled: DataFrame,
    version: str,
    limit: Column | int | None = None,
    mode: str = "auto",
    stored: bool = False,
) -> DataFrame:
    fetched = _errors_told(_fetched(urls, crawled, version, lambda c: pages.clean_records(c, limit, mode), stored))
    return results.five_columns(fetched, "pos")


def plan_of(prompts: DataFrame) -> DataFrame:
    """What is to be done for every prompt: `skill`, `urls`, `limit`; prompts without URLs are left out."""
    asked = prompts.withColumn("skill", requests.route_all(F.col("prompt"))).withColumn(
        "_request", requests.request(F.col("prompt"))
    )
    return asked.select("*", "_request.urls", "_request.limit").drop("_request").filter(F.size("urls") > 0)


def prompt_results(
    prompts: DataFrame, crawled: DataFrame, prefs: DataFrame, version: str, mode: str = "auto"
) -> DataFrame:
    """Five-column results of all prompts (`prompt_id`, `prompt`) that ask for clean text, by `ord`; `texto`
    cut to the domain's limit, else to the prompt's."""
    wanted = plan_of(prompts).filter(F.col("skill") == requests.CLEAN_JOB)
    urls = wanted.select("prompt_id", "limit", F.posexplode("urls").alias("ord", "url"))
    records = pages.clean_records(crawl.wanted(urls, crawled, version), mode=mode)
    fetched = _errors_told(lookup(urls, records, ["url"], F.struct("prompt_id", "ord"), newest=version))
    rows = results.five_columns(fetched, "prompt_id", "ord", "limit")
    return results.limited(rows, prefs, default=F.col("limit"), spread=F.struct("prompt_id", "ord")).drop("limit")


def best_runs(trial_table: DataFrame, strict: bool = False) -> DataFrame:
    """The candidate left standing per task, from a table of trials."""
    return trials.best(trials.aggregate_repeats(trials.scored(trial_table)), strict)


def leaderboard_rows(best: DataFrame, recipes: DataFrame, ts: Column, **settings) -> DataFrame:
    """Leaderboard rows of best runs; `recipes` has one array per task, `settings` the constant fields."""
    metrics = F.struct("correct", "time_s", "peak_mb", "score")
    rows = best.join(recipes, "task", "left").withColumn("best", metrics).withColumn("task_root", F.col("task"))
    for name, value in settings.items():
        rows = rows.withColumn(name, F.lit(value))
    rows = rows.withColumn("ts", ts.cast("double"))
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.LEADERBOARD if f.name not in rows.columns]
    have = [F.col(f.name).cast(f.dataType) for f in schemas.LEADERBOARD if f.name in rows.columns]
    return rows.select(*have, *absent).select(schemas.LEADERBOARD.names)
