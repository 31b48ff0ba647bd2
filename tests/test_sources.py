"""Readers and writers on small files, including the inputs and outputs the jobs were first written for."""

import hashlib
import json
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pagemill.operators import compare, pages, records, results, trials
from pagemill.plans import jobs
from pagemill.plans.file_queries import document_files
from pagemill.sources import files, sinks, store


def lines_of(path):
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text(encoding="utf-8").splitlines()]


def test_listing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a\n" * 100)
    (tmp_path / "b.csv").write_text("b\n" * 10)
    (tmp_path / "c.txt").write_text("c")
    (tmp_path / "D.CSV").write_text("d")
    (tmp_path / "dir.csv").mkdir()
    (tmp_path / "dir.csv" / "e.csv").write_text("eee")
    found = records.sorted_files(files.list_files(spark, str(tmp_path)))
    assert [tuple(r) for r in found.collect()] == [("a.csv", 200), ("b.csv", 20)]
    sinks.write_lines(found, str(tmp_path / "out"), ["name", "size"])
    assert lines_of(tmp_path / "out") == ["a.csv,200", "b.csv,20"]
    deep = files.list_files(spark, str(tmp_path), recursive=True)
    assert {r.name for r in deep.collect()} == {"a.csv", "b.csv", "e.csv"}


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a")
    plan = files.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_scored_csv(spark, tmp_path):
    text = "name,score,date\nAna,91,2024-10-11\nLuis,77,2023-07-05\nMar,85,2025-01-10\nShort\n\"Pau, P\",80,2024-12-31\n"
    (tmp_path / "scores.csv").write_text("﻿" + text, encoding="utf-8")
    df = files.read_scored_csv(spark, str(tmp_path / "scores.csv")).withColumn("pos", F.monotonically_increasing_id())
    found = records.newest_records(df, "pos")
    assert [tuple(r) for r in found.collect()] == [("Mar", "85"), ("Pau, P", "80"), ("Ana", "91")]


def test_url_list(spark, tmp_path):
    raw = "﻿http://a\r\n  \n\n﻿ http://b \nhttp://a\nhttp://c".encode() + b"\xff/x\n"
    (tmp_path / "urls.txt").write_bytes(raw)
    path = str(tmp_path / "urls.txt")

    def urls(**options):
        return [r.url for r in files.read_urls(spark, path, **options).orderBy("pos").collect()]

    assert urls() == ["http://a", "﻿ http://b", "http://a", "http://c�/x"]
    assert urls(invalid="ignore", every_bom=True) == ["http://a", "http://b", "http://a", "http://c/x"]
    missing = str(tmp_path / "none.txt")
    assert files.read_urls(spark, missing, missing_ok=True).count() == 0
    with pytest.raises(AnalysisException):
        files.read_urls(spark, missing)


def test_title_golden(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("﻿https://example.com\nhttps://example.org\nhttps://example.net", encoding="utf-8")
    urls = files.read_urls(spark, str(tmp_path / "urls.txt"))
    crawled = spark.createDataFrame([], "page_id INT, url STRING, html STRING, status INT")
    for job, column, answer in ((jobs.title_job, "title", "Example Domain"), (jobs.h1_job, "h1", "Example Domain"), (jobs.status_job, "status", "200")):
        out = tmp_path / column
        sinks.write_lines(job(urls, crawled, "page_id"), str(out), ["url", column], order=["pos"])
        assert lines_of(out) == [f"https://example.{tld},{answer}" for tld in ("com", "org", "net")]


def test_failed_pages_golden(spark, tmp_path):
    listed = ["https://example.com", "https://httpstat.us/404", "https://httpstat.us/503", "https://httpstat.us/302", "https://expired.badssl.com"]
    urls = spark.createDataFrame(list(enumerate(listed)), "pos INT, url STRING")
    crawled = spark.createDataFrame([(1, listed[1], "<title>no</title>", 404)], "page_id INT, url STRING, html STRING, status INT")
    out = tmp_path / "out"
    sinks.write_lines(jobs.title_job(urls, crawled, "page_id"), str(out), ["url", "title"], order=["pos"])
    assert lines_of(out) == [f"{u}," + ("Example Domain" if i == 0 else "") for i, u in enumerate(listed)]


def test_document_golden(spark, tmp_path):
    (tmp_path / "page.html").write_text("﻿<p>Hola <b>mundo</b></p>", encoding="utf-8")
    document = files.read_documents(spark, str(tmp_path), "page.html").withColumnRenamed("text", "html")
    for mode in ("auto", "native", "parser"):
        assert [tuple(r) for r in pages.spaced_texts(document, mode).collect()] == [("page.html", "Hola mundo")]


def test_numbered_lines(spark, tmp_path):
    expected = {}
    for name, n in (("a.txt", 5000), ("b.txt", 1), ("c.txt", 777)):
        expected[name] = [f"{name} {i} " + "x" * (i % 50) for i in range(n)]
        (tmp_path / name).write_text("\n".join(expected[name]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits per file
    try:
        found = files.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    by_file = {}
    for r in sorted(found, key=lambda r: (r.file, r.pos)):
        by_file.setdefault(r.file.rsplit("/", 1)[1], []).append((r.pos, r.line))
    assert by_file == {name: list(enumerate(lines)) for name, lines in expected.items()}


def test_results_round_trip(spark, tmp_path):
    rows = [(0, "u", 'a "q", b', "", "d", "line\nbreak"), (1, "v", "", "", "", " blanks at the ends\t")]
    df = spark.createDataFrame(rows, "pos INT, url STRING, title STRING, h1 STRING, meta_description STRING, texto STRING")
    sinks.write_results(df, str(tmp_path / "out"), order=["pos"])
    back = results.five_columns(files.read_results(spark, str(tmp_path / "out")))
    assert sorted(tuple(r) for r in back.collect()) == [r[1:] for r in rows]
    sinks.write_csv(df.select("pos", "url", "title"), str(tmp_path / "csv"), ["url", "title"], order=["pos"])
    assert lines_of(tmp_path / "csv") == ['u,"a ""q"", b"', "v,"]


def test_preferences(spark, tmp_path):
    (tmp_path / "prefs.json").write_text('﻿{\n "domain_overrides": {"ogp.me": {"limit": 400}, "x": {}}}', encoding="utf-8")
    (tmp_path / "broken.json").write_text("{ not json")
    assert [tuple(r) for r in files.read_prefs(spark, str(tmp_path / "prefs.json")).collect()] == [("ogp.me", 400)]
    assert files.read_prefs(spark, str(tmp_path / "broken.json")).count() == 0
    assert files.read_prefs(spark, str(tmp_path / "none.json")).count() == 0


def test_logs(spark, tmp_path):
    log = str(tmp_path / "metrics")
    for rc in (0, 1):
        row = spark.createDataFrame([((1.0, 0.5, 0.0, 0.5), rc)], "metrics STRUCT<correct DOUBLE, time_s DOUBLE, peak_mb DOUBLE, score DOUBLE>, rc INT")
        sinks.append_json(row, log)
    assert sorted(r.rc for r in files.read_trial_log(spark, log).collect()) == [0, 1]
    runs = [{"ts": ts, "task_root": "C:\\t", "persistent": True, "cpus": 3.0, "rounds": 5, "recipes": ["x"], "best": {"correct": 1.0, "score": s}}
            for ts, s in ((1.5, 0.7), (2.5, 0.6))]
    (tmp_path / "board.jsonl").write_text("\n".join(map(json.dumps, runs)) + "\n")
    board = files.read_leaderboard(spark, str(tmp_path / "board.jsonl"))
    assert [(r.task_root, r.best.score, r.backend) for r in trials.latest_runs(board).collect()] == [("C:\\t", 0.6, None)]


def test_preview(spark):
    df = lambda *rows: spark.createDataFrame(rows, "file STRING, pos INT, line STRING")
    made = df(*[("a", i, f"r{i}") for i in range(5)])
    raw = df(*[(f, i, f"o{i}") for f in "ab" for i in range(4)])
    assert sorted((r.file, r.line) for r in sinks.preferred_preview(made, raw).collect()) == [
        ("a", "r0"), ("a", "r1"), ("a", "r2"), ("b", "o0"), ("b", "o1"), ("b", "o2")]
    gaps = df(*[("a", i, f"g{i}") for i in (0, 1, 3, 7, 9)])
    assert sorted(r.line for r in sinks.preview(gaps, 3).collect()) == ["g0", "g1", "g3"]


def test_outputs_from_files(spark, tmp_path):
    for side, text in (("expected", "a\nb\n"), ("got", "a  \r\nb")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "t.txt").write_text(text, newline="")
    read = lambda side: files.read_documents(spark, str(tmp_path / side))
    found = compare.lines_equal(compare.normalised_lines(read("expected")), compare.normalised_lines(read("got")))
    assert [tuple(r) for r in found.collect()] == [("t.txt", 1.0)]


def test_cache_update_writes_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "cache")
    old = [(f"http://h/{n}", f"old {n}") for n in range(600)]
    keyed = spark.createDataFrame(old, "url STRING, html STRING").select(F.sha1(F.encode("url", "utf-8")).alias("key"), "html")
    store.write_cache(keyed, path)
    stamps = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "cache").glob("*/*.parquet")}
    before = stamps()
    fetched = [(5, "http://h/3", "changed"), (4, "http://new/1", "second"), (1, "http://new/1", "first"), (2, "http://new/2", None), (3, "http://new/3", "x")]
    update = spark.createDataFrame(fetched, "pos INT, url STRING, html STRING")
    store.update_cache(spark, path, update)
    touched = {hashlib.sha1(u.encode()).hexdigest()[:2] for u in ("http://new/1", "http://new/3")}
    after = stamps()
    changed = {f.parent.name for f in before.keys() ^ after.keys()} | {f.parent.name for f in before if f in after and before[f] != after[f]}
    assert changed == {f"prefix={p}" for p in touched}
    rows = {r.key: r.html for r in store.read_cache(spark, path).collect()}
    expected = {hashlib.sha1(u.encode()).hexdigest(): h for u, h in [*old, ("http://new/1", "first"), ("http://new/3", "x")]}
    assert rows == expected
    again = stamps()
    store.update_cache(spark, path, update)
    assert stamps() == again
    asked = spark.createDataFrame([(0, "http://new/1"), (1, "http://h/9"), (2, "http://none")], "pos INT, url STRING")
    held = store.held_pages(store.read_cache(spark, path), asked)
    assert sorted((r.pos, r.html) for r in held.collect()) == [(0, "first"), (1, "old 9")]


def test_documents_a_file_each_are_written_by_many_tasks(spark, tmp_path):
    keys = spark.range(sinks.FILES_A_TASK + 300, numPartitions=1)
    rows = keys.select(F.col("id").alias("s_suppkey"), F.lit("n").alias("s_name"), F.lit(1.5).alias("s_acctbal"))
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    found = document_files(spark, str(tmp_path))
    assert sorted(r.text for r in found.collect()) == sorted(f"{k}\nn\n1.50\n" for k in range(keys.count()))
    names = [name.rsplit("/", 1)[1] for name in found.inputFiles()]
    assert len(names) == keys.count()
    assert len({re.search(r"\d{5,}", name)[0] for name in names}) > 1


def test_documents_of_any_text_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILES_A_TASK", 2)
    texts = ["same", "same", "", None, "é\nsecond\r\n", " "]
    folders = sinks.write_documents(spark.createDataFrame([(t,) for t in texts], "t string"), f"{tmp_path}/some")
    found = files.read_documents(spark, folders, "*.txt").collect()
    assert sorted(r.text for r in found) == sorted((t or "") + "\n" for t in texts)
    assert len({r.file for r in found}) == len(texts)
    none = sinks.write_documents(spark.createDataFrame([], "t string"), f"{tmp_path}/none")
    assert files.read_documents(spark, none, "*.txt").count() == 0
