"""Registered queries that pass through files: what the writers write from the given tables, read by the readers, and
crawls and caches laid out for lookups. Files go to a new folder of the shared place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.operators import crawl, pages, preferences, records, results, trials
from pagemill.plans import jobs
from pagemill.plans import queries as Q
from pagemill.plans.queries import query
from pagemill.sources import files, sinks, store

# --- readers and writers ------------------------------------------------------------------------------


@query
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' records written as CSV with a header and read as the scored reader does."""
    folder = store.shared_folder(spark, "scored")
    Q._records(spark, sf_dir).select("name", "score", "date").write.option("header", True).csv(folder)
    kept = records.kept_records(files.read_scored_csv(spark, folder))
    return kept.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query
def csv_file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unquoted lines of nations and their suppliers, a file a region: the files there are, by size."""
    folder = store.shared_folder(spark, "listing")
    nations, suppliers = (Q._table(spark, sf_dir, t) for t in ("nation", "supplier"))
    rows = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", "n_name", "s_suppkey")
    line = F.concat_ws(",", "n_name", "s_suppkey")
    by_region = rows.select("n_regionkey", line).repartition("n_regionkey")
    by_region.write.partitionBy("n_regionkey").option("quote", "").option("escapeQuotes", False).option("sep", "\t").csv(folder)
    listed = records.sorted_files(files.list_files(spark, folder, "*.csv", recursive=True))
    return listed.select(F.lower(F.regexp_extract("name", r"\.(\w+)$", 1)).alias("kind"), "size")


@query
def url_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL lists with marks, blanks and invalid bytes, read in each of the three ways."""
    folder = store.shared_folder(spark, "urls")
    n = F.col("page_id")
    bytes_ = [F.col("url").cast("binary"), F.when(n % 5 == 0, F.unhex(F.lit("FF"))).otherwise(F.lit(b""))]
    mark = F.when(n % 4 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.lit(b""))
    line = F.concat(mark, F.lit(b" "), *bytes_, F.lit(b"\t")).cast("string")
    blank = F.when(n % 3 == 0, F.lit(" ")).otherwise("")
    Q._pages(spark, sf_dir).select(F.explode(F.array(line, blank)).alias("value")).write.text(folder)
    ways = {"every mark, ignored": ("ignore", True), "every mark, replaced": ("replace", True), "first mark": ("replace", False)}
    read = [files.read_urls(spark, folder, how, every).select(F.lit(way).alias("way"), "url") for way, (how, every) in ways.items()]
    # Which line is the first of a file is chance: its mark is taken off here.
    url = F.when(F.col("way") == "first mark", F.regexp_replace("url", "^[﻿\\s]+", "")).otherwise(F.col("url"))
    return read[0].unionByName(read[1]).unionByName(read[2]).select("way", url.alias("url"))


@query
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents, a file each, some with a mark."""
    folder = store.shared_folder(spark, "documents")
    suppliers = Q._table(spark, sf_dir, "supplier")
    mark = F.when(F.col("s_suppkey") % 3 == 0, "﻿").otherwise("")
    text = F.concat(mark, F.concat_ws("\n", F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("decimal(12,2)")))
    return files.read_documents(spark, sinks.write_documents(suppliers.select(text), folder), "*.txt").select("text")


@query
def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of seven files, each with its place, however the files are cut."""
    folder = store.shared_folder(spark, "lines")
    orders = Q._table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("g"), "o_orderkey", "o_orderpriority")
    in_order = orders.repartition("g").sortWithinPartitions("g", "o_orderkey")
    in_order.select("g", F.concat_ws("|", "g", "o_orderkey", "o_orderpriority")).write.partitionBy("g").text(folder)
    return files.read_lines(spark, folder).select("pos", "line")


@query
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean records written as the five-column file and read back."""
    folder = store.shared_folder(spark, "results")
    sinks.write_results(pages.clean_records(Q._with_meta(Q._pages(spark, sf_dir))), folder)
    return results.five_columns(files.read_results(spark, folder))


@query
def prefs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits per domain as one preferences file."""
    folder = store.shared_folder(spark, "prefs")
    limits = Q._prefs(spark, sf_dir).select(F.struct("domain", F.struct("limit")).alias("entry"))
    whole = limits.agg(F.map_from_entries(F.collect_list("entry")).alias("domain_overrides"))
    whole.write.json(folder)
    return files.read_prefs(spark, folder)


@query
def trial_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials appended to a log in two runs, and read."""
    folder = store.shared_folder(spark, "trials")
    scored = Q._rounded(trials.scored(Q._trials(spark, sf_dir)), "score")
    metrics = F.struct("correct", "time_s", "peak_mb", "score").alias("metrics")
    for half in (0, 1):
        sinks.append_json(scored.filter(F.col("seq") % 2 == half).select(metrics, "rc"), folder)
    return files.read_trial_log(spark, folder).select("metrics.*", "rc")


@query
def leaderboard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best runs as leaderboard rows, appended and read; the latest run of each task."""
    folder = store.shared_folder(spark, "leaderboard")
    best = trials.best(Q._rounded(trials.aggregate_repeats(Q._scored(spark, sf_dir)), "time_s", "score", "peak_mb"))
    recipes = best.select("task", F.array(F.lit("cache"), F.col("candidate").cast("string")).alias("recipes"))
    for ts in (1.5, 2.5):
        sinks.append_json(jobs.leaderboard_rows(best, recipes, F.lit(ts), backend="local", rounds=int(2 * ts)), folder)
    latest = trials.latest_runs(files.read_leaderboard(spark, folder))
    return latest.select("task_root", "ts", "backend", "rounds", F.array_join("recipes", ",").alias("recipes"), "best.*")


@query
def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as unquoted lines and links as quoted ones, as they stand in the files."""
    folder = store.shared_folder(spark, "rendered")
    crawled = Q._pages(spark, sf_dir)
    sinks.write_lines(pages.titles(crawled), f"{folder}/titles", ["url", "title"], order=["page_id"])
    texts = pages.links(crawled).withColumn("text", F.concat(F.lit('"'), "text", F.lit('", ')))
    sinks.write_csv(texts, f"{folder}/links", ["url", "text", "href"])
    both = [spark.read.text(f"{folder}/{kind}").select(F.lit(kind).alias("kind"), F.col("value").alias("line")) for kind in ("titles", "links")]
    return both[0].unionByName(both[1])


@query
def preview_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second page has results; the others are previewed by their raw output."""
    made = Q._result_lines(spark, sf_dir)
    raw = Q._pages(spark, sf_dir).select(F.col("page_id").alias("file"), F.posexplode(F.array(*[F.lit(f"line {n}") for n in range(5)])).alias("pos", "line"))
    return sinks.preferred_preview(made.filter(F.col("file") % 2 == 0), raw, 2)


@query
def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a body, where every fourth has none and every fifth an empty one."""
    n = F.col("page_id")
    body = F.when(n % 4 == 0, F.lit(None)).when(n % 5 == 0, "").otherwise(F.col("html"))
    found = crawl.with_body_only(Q._pages(spark, sf_dir).withColumn("html", body))
    return found.select("page_id", F.length("html").alias("n_chars"))


# --- nested preferences -------------------------------------------------------------------------------


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A document of preferences per page in two layers: nested, conflicting and absent branches, and some that cannot
    be read."""
    crawled = Q._pages(spark, sf_dir).withColumn("domain", U.domain_key(F.col("url")))
    n = F.col("page_id")

    def named(inner: Column) -> Column:
        """An object of one domain."""
        return F.concat(F.lit('{"domain_overrides":{"'), "domain", F.lit('":'), inner)

    base = F.concat(named(F.concat(F.lit('{"limit":'), n, F.lit(',"by":{"page":'), n, F.lit("}}}"))), F.lit(',"deep":{"x":{"y":{"z":'), n, F.lit('}}},"flags":["a"]}'))
    over = (
        F.when(n % 7 == 6, '{"deep": ')
        .when(n % 5 == 0, F.concat(named(F.concat(F.lit('{"limit":'), n * 10, F.lit("}}}")))))
        .when(n % 5 == 1, F.concat(named(F.lit("7}}"))))
        .when(n % 5 == 2, F.lit('{"deep": {"x": {"y": {"zz": 1}}}, "flags": ["b", {"c": 2}]}'))
        .when(n % 5 == 4, F.lit('{"deep":{"x":[]},"new":{"k":{"v":"é, \\"q\\""}}}'))
    )
    lower = crawled.select("page_id", preferences.document(base).alias("prefs"))
    upper = crawled.select("page_id", over.alias("text")).filter(F.col("text").isNotNull())
    return lower, upper.select("page_id", preferences.document(F.col("text")).alias("prefs"))


@query
def prefs_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = preferences.merged(*_layers(spark, sf_dir), "page_id")

    def at(path: str) -> Column:
        return F.to_json(F.try_variant_get("prefs", path, "variant"))

    return merged.select("page_id", at("$.deep").alias("deep"), at("$.flags").alias("flags"), at("$.new.k").alias("k"))


@query
def prefs_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = preferences.merged(*_layers(spark, sf_dir), "page_id")
    domain = Q._pages(spark, sf_dir).select("page_id", U.netloc(F.col("url")).alias("host"))
    known = merged.join(domain, "page_id").select("page_id", "prefs", F.regexp_replace("host", r"^www\.", ".").alias("host"))
    return known.select("page_id", preferences.domain_limit(F.col("prefs"), F.col("host"), F.lit(-1)).alias("limit"))


# --- stores -------------------------------------------------------------------------------------------


@query
def store_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title job over a crawl in buckets of its URLs."""
    folder = store.shared_folder(spark, "crawl")
    kept = store.write_crawl(Q._versions(Q._pages(spark, sf_dir)), folder.rsplit("/", 1)[1].replace("-", "_"), folder, buckets=16)
    return jobs.title_job(Q._crawl_list(spark, sf_dir), kept, "page_id", stored=True)


@query
def store_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored cache of the pages served over http gets those served over https."""
    folder = store.shared_folder(spark, "cache")
    crawled = Q._pages(spark, sf_dir)
    cache = crawled.filter(F.col("url").startswith("http:")).select(U.url_key(F.col("url")).alias("key"), "html")
    store.write_cache(cache, folder)
    store.update_cache(spark, folder, crawled.select(F.col("page_id").alias("pos"), "url", "html"))
    held = store.held_pages(store.read_cache(spark, folder), Q._crawl_list(spark, sf_dir))
    return held.select("pos", "url", "key", F.length("html").alias("n_chars"))
