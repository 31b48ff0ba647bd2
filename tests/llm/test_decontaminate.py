import re

import pytest

from pagemill.llm import decontaminate as D
from pagemill.llm.queries import QUERIES

ITEMS = [
    (1, "three FOUR five, six seven eight nine ten eleven twelve and so on"),
    (2, "short"),
    (3, None),
    (4, "..."),
    (5, "été über año"),
    (5, "été über año"),
    (6, "word word word word word word word word word word"),
]


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, item_text in items:
        of = words(item_text)
        n = min(len(of), 10)
        windows = {tuple(of[k : k + n]) for k in range(len(of) - n + 1)} if of else set()
        for k in range(len(own) - n + 1):
            if tuple(own[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(own), len(hit), sorted(found)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_brute_force(awkward, items):
    hits = D.hit_count(D.F.col("hits")).alias("n_hit")
    got = D.contamination(awkward, items).select("doc_id", "_text", "n_words", hits, "items").collect()
    texts = {(r.doc_id, r.h): r.text for r in awkward.select("doc_id", "text", D.text_hash(D.F.col("text")).alias("h")).collect()}
    assert len(got) == len(texts)  # repeated rows count as one
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == brute(texts[r.doc_id, r["_text"]], ITEMS)


def test_documents_and_spans(awkward, items):
    kept = D.decontaminated(awkward, items)
    assert kept.columns == awkward.columns
    clean = [r.text for r in awkward.collect() if not brute(r.text, ITEMS)[1]]
    assert sorted(map(str, clean)) == sorted(str(r.text) for r in kept.collect())
    cut = D.decontaminated(awkward, items, remove="spans")
    assert cut.columns == awkward.columns
    texts = [r.text for r in cut.filter("doc_id = 1").collect()]
    assert texts == ["one two"] * 2
    assert cut.count() == awkward.count()
    assert cut.filter("doc_id = 9 and text = ''").count() == 1


def test_empty(awkward, empty, items):
    assert D.contamination(empty, items).count() == 0
    assert D.contamination(awkward, items.limit(0)).filter("size(hits) > 0").count() == 0
    assert D.decontaminated(awkward, items.limit(0)).count() == awkward.count()


def test_a_row_for_each_row(spark, awkward, items, tmp_path):
    rows = [(r.doc_id, r.text) for r in awkward.collect()] * 2 + [(7, "été über año")] * 3
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op9_decontamination"](spark, str(tmp_path)).select("doc_id", "n_words", "n_hit").collect()
    expected = [(i, *brute(text, ITEMS)[:2]) for i, text in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
