"""Plans that must hold at scale: what is read, what is shuffled, what runs in Python."""

import re

import pytest
from pyspark.sql import functions as F

from pagemill.operators import crawl, pages, trials
from pagemill.plans import file_queries, jobs, queries  # noqa: F401
from pagemill.sources import store

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lines(df, word):
    return [line for line in plan(df).splitlines() if word in line]


@pytest.mark.parametrize("name", ["page_titles", "page_h1", "page_links", "page_meta", "page_text", "page_text_spaced", "page_clean",
                                  "csv_kept", "url_parts", "retry_queue", "prompt_route", "prompt_request", "prompt_spec"])
def test_row_jobs_do_not_shuffle(spark, name):
    assert lines(queries.QUERIES[name](spark, SF_DIR), "Exchange") == []


def test_top_records_are_not_sorted_whole(spark):
    df = queries.QUERIES["csv_filter_top"](spark, SF_DIR)
    assert lines(df, "TakeOrderedAndProject") and not lines(df, "Exchange range")


def test_only_odd_bodies_cross_into_python(spark):
    df = queries.QUERIES["page_titles"](spark, SF_DIR)
    (udf,) = lines(df, "ArrowEvalPython")
    assert "_odd" in udf
    below = plan(df).split("ArrowEvalPython")[1].splitlines()[1]
    assert "Project [page_id" in below and "html" not in below.split("Project [")[1].split(",")[1]


def test_extraction_is_planned_once(spark):
    """No size filter with a copy of the extraction below the explode, and odd pages come out of Python as rows."""
    text = plan(queries.QUERIES["page_links"](spark, SF_DIR))
    assert text.count("ArrowEvalPythonUDTF") == 1 and "pythonUDF" not in text
    assert text.count("Generate posexplode(_sure") == 1 and "size(" not in text.split("Generate")[1].split("ArrowEvalPython")[0]


@pytest.mark.parametrize("name", ["crawl_titles", "crawl_h1", "crawl_text", "crawl_links", "crawl_clean", "prompt_results"])
def test_bodies_are_never_shuffled(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if nothing were small
    try:
        df = queries.QUERIES[name](spark, SF_DIR)
        pending = [df._jdf.queryExecution().executedPlan()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = []
    while pending:
        node = pending.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            pending.append(node.initialPlan())
        if "ShuffleExchange" in node.getClass().getSimpleName():
            shuffled.append(node.output().mkString(","))
        pending += [node.children().apply(i) for i in range(node.children().size())]
    assert shuffled
    assert not any("html" in columns or "_body" in columns for columns in shuffled), shuffled


def test_status_job_reads_no_bodies(spark):
    df = queries.QUERIES["page_status"](spark, SF_DIR)
    scans = [line for line in plan(df).splitlines() if "ReadSchema" in line]
    assert any("html" not in scan for scan in scans)
    assert lines(queries.QUERIES["retry_queue"](spark, SF_DIR), "ReadSchema")[0].count("html") == 0


def test_no_job_runs_while_a_query_is_built(spark):
    sc, seen = spark.sparkContext, {}
    for name in ("page_clean_limited", "prompt_results", "crawl_titles", "trial_aggregate", "best_candidate", "prefs_nested"):
        sc.setJobGroup(f"built-{name}", name)
        queries.QUERIES[name](spark, SF_DIR)
        seen[name] = len(sc.statusTracker().getJobIdsForGroup(f"built-{name}"))
        sc.setJobGroup("footers", "footers")
        reads = queries._pages(spark, SF_DIR)  # how many jobs the schema of a table takes
        assert reads.columns
    sc.setJobGroup("schema", "schema")
    queries._table(spark, SF_DIR, "events")
    one = len(sc.statusTracker().getJobIdsForGroup("schema"))
    sc.setJobGroup("tests", "tests")
    reads = {"page_clean_limited": 2, "prompt_results": 3, "crawl_titles": 4, "trial_aggregate": 1, "best_candidate": 1, "prefs_nested": 1}
    assert all(seen[name] <= one * reads[name] for name in seen), (seen, one)


def exchanges(df):
    """What each exchange of the initial plan moves."""
    pending, out = [df._jdf.queryExecution().executedPlan()], []
    while pending:
        node = pending.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            pending.append(node.initialPlan())
        if "ShuffleExchange" in node.getClass().getSimpleName():
            out.append(node.output().mkString(","))
        pending += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_list_jobs_have_few_exchanges(spark):
    for name in ("crawl_titles", "crawl_h1", "crawl_text", "crawl_links", "crawl_meta", "crawl_clean"):
        assert len(lines(queries.QUERIES[name](spark, SF_DIR), "Exchange")) < 30, name


def test_stored_crawls(spark, tmp_path):
    """Lists that the driver knows read some buckets; the crawl side of a job has no exchange below the extraction."""
    crawled = queries._versions(queries._pages(spark, SF_DIR))
    kept = store.write_crawl(crawled, "crawl_of_test", str(tmp_path / "crawl"), buckets=16)
    urls = [r.url for r in crawled.select("url").distinct().orderBy("url").limit(3).collect()]
    listed = store.url_rows_of(spark, [*urls, "http://nowhere", urls[0]])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        asked = store.crawl_of(kept, urls)
        (scan,) = lines(asked, "FileScan")
        count = re.search(r"SelectedBucketsCount: (\d+) out of 16", scan)
        assert count and int(count[1]) <= 3 and "PushedFilters: [In(url" in scan
        job = jobs.title_job(listed, kept, "page_id", mode="native", stored=True)
        moved = exchanges(job)
        assert all("page_id" not in columns and "html" not in columns for columns in moved), moved
        assert "SelectedBucketsCount: 16 out of 16" in plan(job)
        assert not any("html" in columns or "_odd" in columns for columns in exchanges(jobs.title_job(listed, kept, "page_id", stored=True)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    plain = sorted(map(tuple, jobs.title_job(listed, crawled, "page_id").collect()))
    for rows in (kept, asked):
        assert sorted(map(tuple, jobs.title_job(listed, rows, "page_id", stored=True).collect())) == plain
        assert sorted(map(tuple, jobs.title_job(listed, rows, "page_id").collect())) == plain


def test_only_wanted_pages_are_extracted(spark):
    """The restriction stands below the extraction, whatever the size of the list."""
    crawled = queries._pages(spark, SF_DIR)
    one = crawled.limit(1).select(F.col("page_id").alias("pos"), "url")
    text = plan(jobs.title_job(one, crawled, "page_id"))
    below = text[text.index("ArrowEvalPython") :]
    assert "ubquery" in below[: below.index("FileScan")]
    found = crawl.wanted(one, crawled, "page_id")
    assert found.count() < 5


def test_record_scan_reads_needed_columns_only(spark):
    (scan,) = lines(queries.QUERIES["csv_kept"](spark, SF_DIR), "FileScan")
    assert "o_totalprice" in scan and "o_custkey" not in scan


def test_baselines_aggregate_by_hash(spark):
    df = trials.with_baseline(queries._trials(spark, SF_DIR))
    assert lines(df, "SortAggregate") == []


def test_no_cartesian_products(spark):
    for name, build in queries.QUERIES.items():
        text = plan(build(spark, SF_DIR))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_results_are_whole_with_hot_keys(spark):
    """A third of a list on one URL: the same rows, whatever counts as hot."""
    crawled = queries._pages(spark, SF_DIR)
    one = crawled.select("url").first()[0]
    urls = crawled.select((F.col("page_id") * 3).alias("pos"), "url").unionByName(
        crawled.select((F.col("page_id") * 3 + 1).alias("pos"), F.lit(one).alias("url")))
    titles = pages.titles(crawled)
    found = [sorted(tuple(r) for r in crawl.fetch(urls, titles, "page_id", hot).collect()) for hot in (10, 10**9)]
    assert found[0] == found[1] and len(found[0]) == urls.count()
    assert jobs.title_job(urls, crawled, "page_id").count() == urls.count()
