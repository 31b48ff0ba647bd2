"""Crawl, result, comparison and trial operators against brute force or hand-made tables."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from pagemill.operators import compare, crawl, medians, pages, records, results, trials
from pagemill.operators.lookup import lookup
from pagemill.plans import jobs


def rows(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


# --- lookup, crawl ---


@pytest.mark.parametrize("hot_rows", [1, 7, 100, 10**9])
def test_lookup_is_a_left_join_whatever_is_hot(spark, hot_rows):
    rng = random.Random(hot_rows)
    left = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}" if rng.random() < 0.9 else None) for i in range(500)]
    right = {f"k{i}": i for i in range(0, 30, 2)} | {"hot": -1, "unused": 5}
    found = lookup(
        spark.createDataFrame(left, "pos INT, k STRING"),
        spark.createDataFrame(list(right.items()), "k STRING, v INT"), ["k"], spread="pos", hot_rows=hot_rows)
    assert found.columns == ["k", "pos", "v"]
    assert rows(found, "pos", "k", "v") == rows(spark.createDataFrame([(p, k, right.get(k)) for p, k in left], "pos INT, k STRING, v INT"), "pos", "k", "v")


CRAWL = [(1, "http://a", "<title>old</title><a href=/o>o</a>", 200), (2, "http://a", "<title>new</title><a href=/n>n</a>", 200),
         (3, "http://b", "<title>gone</title><a href=/g>g</a>", 404), (4, "http://c", "", 200), (5, "http://unasked", "<title>u</title>", 200)]
LIST = [(10, "http://b"), (11, "http://a"), (12, "http://missing"), (13, "http://a"), (14, "http://c"), (15, "https://example.net/")]


@pytest.fixture
def crawled(spark):
    return spark.createDataFrame(CRAWL, "page_id INT, url STRING, html STRING, status INT")


@pytest.fixture
def urls(spark):
    return spark.createDataFrame(LIST, "pos INT, url STRING")


def test_url_list_jobs(crawled, urls):
    at = [p for p, _ in LIST]
    title = rows(jobs.title_job(urls, crawled, "page_id"), "pos", "title")
    assert title == list(zip(at, ["", "new", "", "new", "", "Example Domain"]))
    assert rows(jobs.h1_job(urls, crawled, "page_id"), "pos", "h1")[-1] == (15, "Example Domain")
    text = rows(jobs.text_job(urls, crawled, "page_id"), "pos", "texto")
    assert text == list(zip(at, ["goneg", "newn", "", "newn", "", ""]))
    status = rows(jobs.status_job(urls, crawled, "page_id"), "pos", "status")
    assert status == list(zip(at, ["404", "200", "", "200", "200", "200"]))
    links = rows(jobs.link_job(urls, crawled, "page_id"), "pos", "text", "href")
    assert links == [(10, "g", "http://b/g"), (11, "n", "http://a/n"), (13, "n", "http://a/n")]
    assert jobs.meta_job(urls, crawled, "page_id").count() == 0
    clean = rows(jobs.clean_job(urls, crawled, "page_id"), "pos", "title", "texto")
    assert clean == list(zip(at, ["", "new", "", "new", "", ""], ["(error) HTTP 404", "new n", jobs.NOT_FETCHED, "new n", "", jobs.NOT_FETCHED]))


def test_pages_with_body(crawled, urls):
    found = crawl.with_body_only(crawl.fetch(urls, crawled, "page_id"))
    assert rows(found, "pos") == [(10,), (11,), (13,)]


def test_cache(spark, urls):
    cache = spark.createDataFrame([("http://b", "old")], "url STRING, html STRING").select(F.sha1("url").alias("key"), "html")
    split = crawl.cache_split(urls, cache, hot_rows=2)
    assert rows(split, "pos", "cached") == [(p, u == "http://b") for p, u in LIST]
    assert rows(crawl.cache_misses(urls, cache), "url") == sorted({(u,) for _, u in LIST if u != "http://b"})
    pages_ = [(2, "http://a", "later"), (1, "http://a", "A"), (3, "http://b", "new"), (4, "http://x", None)]
    fetched = spark.createDataFrame(pages_, "pos INT, url STRING, html STRING")
    updated = crawl.cache_update(cache, fetched)
    assert rows(updated, "html") == [("A",), ("old",)]


def test_retries(spark):
    log = [(s, a, m) for s in (200, 404, 429, 500, 502, 503, 504, 501) for a in (1, 2, 3) for m in ("GET", "POST")]
    found = crawl.retry_queue(spark.createDataFrame(log, "status INT, attempt INT, method STRING"))
    expected = sorted((s, a, 0.3 * 2 ** (a - 1)) for s, a, m in log if s in (429, 500, 502, 503, 504) and a <= 2 and m == "GET")
    assert rows(found, "status", "attempt", "wait_s") == expected


# --- records, results ---


def test_newest_records(spark):
    raw = [("Ana", "91", "2024-10-11"), ("Luis", "77", "2023-07-05"), ("Mar", "85", "2025-01-10"), ("Dani", "60", "2022-03-15"),
           ("Iris", "99", "2025-03-01"), ("Pau", "80", "2024-12-31"), ("Nora", "82", "2024-01-20"), ("Joel", "79", "2025-01-09"),
           ("Bad", "x", "2025-04-01"), ("Late", "90", "2025-13-01"), ("Half", "8.5", "2025-05-01"), ("Short", None, None), ("Date", "90", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(raw)], "pos INT, name STRING, score STRING, date STRING")
    found = [(r.name, r.score) for r in records.newest_records(df, "pos").collect()]
    assert found == [("Iris", "99"), ("Mar", "85"), ("Pau", "80"), ("Ana", "91"), ("Nora", "82")]
    tied = spark.createDataFrame([(2, "b", "90", "2024-1-5"), (1, "a", " 90 ", "2024-01-05")], df.schema)
    assert [r.name for r in records.newest_records(tied, "pos", n=1).collect()] == ["a"]


def test_sorted_files(spark):
    files = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", 1)], "name STRING, size BIGINT")
    order = lambda *a: "".join(r.name for r in records.sorted_files(files, *a).collect())
    assert [order(), order("size", "asc"), order("name", "asc"), order("name", "desc")] == ["cabd", "dabc", "abcd", "dcba"]


RESULT_FILES = {
    "full": ["URL,title,h1,meta_description,texto", 'u1,"t, ""q""",h,m,"x, y"', "", "u2,,,,"],
    "short": [" url,texto", 'u3,"a, b"', "   ", "u4", "u5,"],
    "bare": ["u6,t", "u7,t,h,m,x"],
    "header only": ["url,texto"],
}


def test_results_get_five_columns(spark):
    lines = [(f, i, line) for f, ls in RESULT_FILES.items() for i, line in enumerate(ls)]
    normal = results.normalised(spark.createDataFrame(lines, "file STRING, pos INT, line STRING"))
    by_file = {}
    for f, _, line in rows(normal, "file", "pos", "line"):
        by_file.setdefault(f, []).append(line)
    header = "url,title,h1,meta_description,texto"
    assert by_file["full"] == RESULT_FILES["full"]
    assert by_file["short"] == [header, 'u3,,,,"a, b"', "u4,,,,", "u5,,,,"]
    assert by_file["bare"] == [header, "u6,t", "u7,t,h,m,x"]
    assert by_file["header only"] == [header]
    found = rows(results.rows(normal), "url", "title", "h1", "meta_description", "texto")
    assert found == [("u1", 't, "q"', "h", "m", "x, y"), ("u2", "", "", "", ""), ("u3", "", "", "", "a, b"), ("u4", "", "", "", ""),
                     ("u5", "", "", "", ""), ("u6", "t", "", "", ""), ("u7", "t", "h", "m", "x")]


def test_results_of_several_lines(spark):
    title, text = 'Line one\n\n"two", url,texto', "x\n  \ny"
    quoted = lambda s: '"' + s.replace('"', '""') + '"'
    shapes = {
        "full": ["url,title,h1,meta_description,texto", f"u1,{quoted(title)},h,m,{quoted(text)}", "u2,t,h,m,x"],
        "short": ["url,texto", f"u3,{quoted(text)}", "  ", "u4,z"],
        "bare": [f"u5,{quoted(title)},h,m,{quoted(text)}", "u6,t"],
    }
    lines = [(f, i, line) for f, ls in shapes.items() for i, line in enumerate("\n".join(ls).split("\n"))]
    normal = results.normalised(spark.createDataFrame(lines, "file STRING, pos INT, line STRING"))
    found = rows(results.rows(normal), "url", "title", "texto")
    assert found == [("u1", title, text), ("u2", "t", "x"), ("u3", "", text), ("u4", "", "z"), ("u5", title, text), ("u6", "t", "")]


def test_versions_that_are_unknown_or_equal(spark):
    urls = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "pos INT, url STRING")
    data = [("a", "T", None), ("b", "old", None), ("b", "new", 3), ("b", "older", 2), ("c", "x", 1), ("c", "y", 1), ("d", "z", 9)]
    crawled = spark.createDataFrame(data, "url STRING, title STRING, version INT")
    asked = crawl.wanted(urls, crawled, "version")
    assert {r.title for r in asked.collect()} >= {"T", "new", "x", "y"} and "old" not in {r.title for r in asked.collect()}
    found = rows(crawl.fetch(urls, asked, "version"), "url", "title")
    assert found[:2] == [("a", "T"), ("b", "new")] and len(found) == 3
    assert found == rows(crawl.fetch(urls, crawled.orderBy("title"), "version"), "url", "title")


def test_outputs_of_unknown_files_count_as_wrong(spark):
    side = lambda *rows: spark.createDataFrame(rows, "file STRING, text STRING")
    expected, got = side(("x", "a")), side(("x", "a"), ("y", "b"))
    found = compare.lines_equal(compare.normalised_lines(expected), compare.normalised_lines(got), expected)
    assert rows(found, "file", "correct") == [("x", 1.0), ("y", 0.0)]


def test_limits_by_domain(spark):
    table = spark.createDataFrame([("http://www.ogp.me/x", "a😀cdef"), ("http://OGP.me", "abcdef"), ("http://none", "abcdef"), ("http://zero.x", "abcdef")], "url STRING, texto STRING")
    prefs = spark.createDataFrame([("ogp.me", 3), ("zero.x", 0)], "domain STRING, limit INT")
    again = prefs.unionByName(spark.createDataFrame([("ogp.me", 2)], prefs.schema))  # the highest counts
    for own in (prefs, again):
        assert rows(results.limited(table, own, 5), "url", "texto") == [
            ("http://OGP.me", "abc"), ("http://none", "abcde"), ("http://www.ogp.me/x", "a😀c"), ("http://zero.x", "abcdef")]
    assert ("http://none", "abcdef") in rows(results.limited(table, prefs), "url", "texto")


def test_preferences(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "domain STRING, limit INT")
    over = spark.createDataFrame([("b", 20), ("c", 30), ("a", None)], "domain STRING, limit INT")
    assert rows(results.merged_prefs(base, over), "domain", "limit") == [("a", 1), ("b", 20), ("c", 30)]


def test_five_columns(spark):
    df = spark.createDataFrame([(1, "u", None)], "pos INT, url STRING, h1 STRING")
    assert results.five_columns(df, "pos").collect() == [(1, "u", "", "", "", "")]


def test_prompts_to_results(spark, crawled):
    asked = [(1, "texto limpio de http://a, http://missing 3 caracteres"), (2, "limpialo"), (3, "enlaces de http://a"), (4, "clean to http://a;http://a")]
    prompts = spark.createDataFrame(asked, "prompt_id INT, prompt STRING")
    prefs = spark.createDataFrame([("missing", 7)], "domain STRING, limit INT")
    found = rows(jobs.prompt_results(prompts, crawled, prefs, "page_id"), "prompt_id", "ord", "url", "texto")
    assert found == [(1, 0, "http://a", "new"), (1, 1, "http://missing", "(error)"), (4, 0, "http://a", "new n"), (4, 1, "http://a", "new n")]


# --- comparison ---

OUTPUTS = {
    "equal": ("a\nb", "a\nb"), "trailing": ("a\n\nb", "a  \r\nb\t\n"), "blank kept": ("a\n \nb", "a\nb"), "order": ("a\nb", "b\na"),
    "repeated": ("a\na\nb", "a\nb"), "longer": ("a", "a\nb"), "empty": ("", ""), "one empty": ("a", ""), "differs": ("a\nb\nc", "a\nx\ny"),
}


@pytest.fixture
def outputs(spark):
    make = lambda i: spark.createDataFrame([(k, v[i]) for k, v in OUTPUTS.items()], "file STRING, text STRING")
    return make(0), make(1)


def test_lines_equal(outputs):
    expected, got = outputs
    found = dict(rows(compare.lines_equal(compare.normalised_lines(expected), compare.normalised_lines(got), expected), "file", "correct"))
    assert {k for k, v in found.items() if v == 1.0} == {"equal", "trailing", "empty"} and len(found) == len(OUTPUTS)


def test_line_sets_equal(outputs):
    expected, got = outputs
    found = dict(rows(compare.line_sets_equal(compare.raw_lines(expected), compare.raw_lines(got), expected), "file", "correct"))
    assert {k for k, v in found.items() if v == 1.0} == {"equal", "trailing", "blank kept", "order", "repeated", "empty"}


def test_first_difference(outputs):
    expected, got = outputs
    found = {r.file: tuple(r)[1:] for r in compare.first_difference(compare.raw_lines(expected), compare.raw_lines(got)).collect()}
    brute = {}
    for name, (e, g) in OUTPUTS.items():
        e, g = e.splitlines(), g.splitlines()
        i = next((i for i, (a, b) in enumerate(zip(e, g)) if a != b), None)
        if e != g:
            brute[name] = (None, None, None, len(e), len(g)) if i is None else (i + 1, e[i], g[i], len(e), len(g))
    assert found == brute


# --- trials ---


@pytest.mark.parametrize("hot_rows", [1, 50, 10**9])
def test_grouped_median(spark, hot_rows):
    rng = random.Random(hot_rows)
    data = []
    for g in range(12):
        for _ in range([1, 2, 3, 4, 50, 51, 2000, 3001, 10, 11, 100, 7][g]):
            data.append((g, round(rng.random(), 1 + g % 5), rng.choice([None, float(rng.randint(-5, 5))]) if g != 9 else None))
    found = {r.g: (r.x, r.y) for r in medians.grouped_median(
        spark.createDataFrame(data, "g INT, x DOUBLE, y DOUBLE"), ["g"], ["x", "y"], hot_rows).collect()}
    for g in range(12):
        x = [r[1] for r in data if r[0] == g]
        y = [r[2] for r in data if r[0] == g and r[2] is not None]
        assert found[g] == (pytest.approx(statistics.median(x)), statistics.median(y) if y else None)


def trial_table(spark, data):
    return spark.createDataFrame(data, "task STRING, seq BIGINT, candidate STRING, rc INT, correct DOUBLE, time_s DOUBLE, peak_mb DOUBLE")


def test_scores_against_the_baseline(spark):
    data = [("t", 0, "base", 0, 1.0, 10.0, 0.0), ("t", 1, "a", 0, 1.0, 5.0, 9.0), ("t", 2, "b", 1, 1.0, 5.0, 0.0), ("t", 3, "c", 0, 0.0, 1.0, 0.0),
            ("u", 5, "base", 0, 1.0, 0.0, 100.0), ("u", 6, "a", 0, 1.0, 1.0, 50.0)]
    for hot_rows in (2, 10**6):
        found = rows(trials.scored(trial_table(spark, data), hot_rows), "task", "seq", "correct", "score")
        assert [f[3] for f in found] == pytest.approx([0.5, 0.65, 0.0, 0.0, 0.5, 0.6])
        assert [f[2] for f in found] == [1.0, 1.0, 0.0, 0.0, 1.0, 1.0]


def test_repeats_aggregated(spark):
    data = [("t", 1, "a", 0, 1.0, 4.0, 0.0), ("t", 2, "a", 0, 0.0, 2.0, 8.0), ("t", 3, "a", 1, 1.0, 9.0, 6.0), ("t", 4, "a", 0, 1.0, 1.0, 0.0),
            ("t", 5, "b", 0, 1.0, 3.0, 0.0)]
    scored = trial_table(spark, data).withColumn("score", F.col("time_s") / 10)
    every = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "never")], "task STRING, candidate STRING")
    found = rows(trials.aggregate_repeats(scored, every), "candidate", "correct", "time_s", "peak_mb", "score", "rc", "trials")
    assert found == [("a", 0.0, 3.0, 7.0, pytest.approx(0.3), 0, 4), ("b", 1.0, 3.0, 0.0, pytest.approx(0.3), 0, 1), ("never", 0.0, 9e9, 0.0, 0.0, None, 0)]


@pytest.mark.parametrize("batch_rows", [1, 3, 10_000])
def test_best_is_the_fold(spark, batch_rows):
    rng = random.Random(batch_rows)
    data = [("hot", i, f"c{i}", 2.0 - i // 700, rng.choice([0.1, 0.3, 0.3 + 1 / (i + 1)])) for i in range(3000)]  # over many ranges
    data += [(None, i, f"c{i}", 1.0, rng.choice([0.5, 0.6])) for i in range(50)]
    for t in range(200):
        start = rng.randint(0, 50)
        for i in range(rng.randint(1, 25)):
            data.append((f"t{t}", start + i, f"c{i}", rng.choice([0.0, 0.5, 1.0]), rng.choice([0.0, 0.2, 0.5, 0.6, 0.7])))
    fold = {}
    for task, seq, name, correct, score in data:
        best = fold.get(task)
        if best is None or correct > best[1] or score > best[2]:
            fold[task] = (name, correct, score)
    df = spark.createDataFrame(data, "task STRING, seq BIGINT, candidate STRING, correct DOUBLE, score DOUBLE")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.task: (r.candidate, r.correct, r.score) for r in trials.best(df.repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == fold


def test_best_with_missing_numbers(spark):
    data = [("a", 0, 1.0, None), ("a", 1, None, 0.2), ("b", 0, None, None), ("c", 0, float("nan"), 0.1), ("c", 1, 1.0, 0.1)]
    df = spark.createDataFrame(data, "task STRING, seq BIGINT, correct DOUBLE, score DOUBLE")
    assert sorted((r.task, r.seq) for r in trials.best(df).collect()) == [("a", 1), ("b", 0), ("c", 0)]
    assert trials.best(df.limit(0)).count() == 0


def test_best_prefers_by_order(spark):
    df = spark.createDataFrame([("t", 0, "base", 0.0, 0.6), ("t", 1, "a", 1.0, 0.55)], "task STRING, seq BIGINT, candidate STRING, correct DOUBLE, score DOUBLE")
    assert trials.best(df).first().candidate == "a"
    flaky = spark.createDataFrame([("t", 0, "base", 0.0, 0.0), ("t", 1, "a", 0.0, 0.9)], df.schema)
    assert [trials.best(flaky, strict=s).first().candidate for s in (False, True)] == ["a", "base"]


def test_trials_to_leaderboard(spark):
    data = [("t", 0, "base", 0, 1.0, 10.0, 0.0), ("t", 1, "a", 0, 1.0, 5.0, 0.0), ("t", 2, "a", 0, 1.0, 7.0, 0.0), ("t", 3, "b", 1, 1.0, 1.0, 0.0)]
    best = jobs.best_runs(trial_table(spark, data))
    recipes = spark.createDataFrame([("t", ["x", "y"])], "task STRING, recipes ARRAY<STRING>")
    board = jobs.leaderboard_rows(best, recipes, F.lit(1.5), backend="local", rounds=2)
    row = board.first()
    assert (row.task_root, row.ts, row.backend, row.rounds, row.recipes) == ("t", 1.5, "local", 2, ["x", "y"])
    assert (row.best.correct, row.best.time_s) == (1.0, 6.0) and row.best.score == pytest.approx(0.62)


def test_leaderboard(spark):
    data = [("a", 1.0, ["x"], 0.9), ("a", 2.0, ["y"], 0.5), ("b", 1.0, ["x", "z"], 0.4), ("b", 3.0, ["z"], 0.4)]
    board = spark.createDataFrame([(t, ts, r, (s,)) for t, ts, r, s in data], "task_root STRING, ts DOUBLE, recipes ARRAY<STRING>, best STRUCT<score DOUBLE>")
    assert rows(trials.latest_runs(board), "task_root", "ts") == [("a", 2.0), ("b", 3.0)]
    assert rows(trials.top_runs(board), "task_root", "ts") == [("a", 1.0), ("b", 1.0)]
    assert rows(trials.recipe_wins(board), "recipe", "wins") == [("x", 2), ("z", 1)]


def test_extraction_keeps_other_columns(spark, crawled):
    assert pages.titles(crawled).columns == ["page_id", "url", "status", "title"]
    assert pages.links(crawled).columns == ["page_id", "url", "status", "ord", "text", "href"]


def test_records_go_on_over_blocks(spark, monkeypatch):
    text = ['a,"b', 'c', 'd"', 'e', 'f,"g"', '"h', 'i', 'j', 'k', '"', 'l', '"never closed', 'm,"n"', 'o']
    lines = [(f, k, line) for f in ("x", "y", None) for k, line in enumerate(text if f == "x" else text[:-3])]
    expected = [(0, 'a,"b\nc\nd"'), (3, 'e'), (4, 'f,"g"'), (5, '"h\ni\nj\nk\n"'), (10, 'l')]
    never = [(11, '"never closed'), (12, 'm,"n"'), (13, 'o')]
    table = spark.createDataFrame(lines, "file STRING, pos INT, line STRING")
    for block in (2, 3, 1 << 16):
        monkeypatch.setattr(results, "BLOCK", block)
        found = sorted((str(r[0]), *r[1:]) for r in results.records_of(table).collect())
        assert found == [("None", *r) for r in expected] + [("x", *r) for r in expected + never] + [("y", *r) for r in expected]
        placed = results.places(results.records_of(table))
        assert sorted(placed.filter("file = 'x'").toPandas()["pos"]) == list(range(1, 9))
