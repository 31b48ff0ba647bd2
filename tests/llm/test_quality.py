import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import quality as Q

GOOD, BAD = "the of and river stone green walks slowly home".split(), "buy!!! $$$ CLICK now &&& win FREE ### 100%".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(GOOD if k % 3 else BAD) for _ in range(rng.randrange(5, 60))), int(k % 3 > 0)) for k in range(240)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label int")


def test_held_out(corpus):
    known = corpus.filter("doc_id % 5 <> 0").select("doc_id", "label")
    model = Q.fit(corpus.select("doc_id", "text"), known)
    found = Q.score(corpus.filter("doc_id % 5 = 0"), model).collect()
    assert sum((r.score >= 0.7) == bool(r.label) for r in found) / len(found) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_awkward(corpus, awkward, empty):
    model = Q.fit(corpus.select("doc_id", "text"), corpus.select("doc_id", "label"))
    found = Q.score(awkward, model)
    assert sorted(found.columns) == sorted(awkward.columns)  # `score` replaces the column of that name
    assert found.filter("score is null or isnan(score)").count() == 0 and found.count() == awkward.count()
    assert Q.score(empty, model).count() == 0
    labels = awkward.select("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id") % 2).alias("label"))
    assert Q.score(awkward, Q.fit(awkward, labels)).filter("score between 0 and 1").count() == awkward.count()
    nothing = Q.fit(awkward, labels.limit(0))
    assert {r.score for r in Q.score(awkward, nothing).collect()} == {0.5}


def test_pieces_pool_like_wholes(monkeypatch):
    words = Q.word_vectors(Q.index_vectors(), np.zeros((Q.BUCKETS, Q.DIMS)), np.zeros(Q.BUCKETS))
    texts = pa.array(["a bb ccc dd!! " * 300, None, "", "x", "été 12 " * 100])
    whole = Q.pooled(texts, words)
    assert np.isfinite(whole).all() and not whole[1, : Q.DIMS].any()
    for k in range(len(texts)):
        assert np.allclose(Q.pooled(texts.slice(k, 1), words)[0], whole[k])


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=20_000) * 2
    labels = (rng.random(20_000) < 1 / (1 + np.exp(-raw))).astype(float)
    assert abs(Q.temperature(raw * 3, labels) - 3) < 0.3


def test_tokens_are_not_cut(monkeypatch):
    words = Q.word_vectors(Q.index_vectors(), np.zeros((Q.BUCKETS, Q.DIMS)), np.zeros(Q.BUCKETS))
    texts = ["some text " * 777, "words of 12345 été " * 15_000, None, "words " * 50_000, "", "x" * 600_000, "y" * 300_000 + " end", "last words"]
    whole = Q.pooled(pa.array(texts), words)
    for k in range(len(texts)):  # whatever stands beside it
        assert np.array_equal(Q.pooled(pa.array(texts[k : k + 1]), words)[0], whole[k])
        assert np.array_equal(Q.pooled(pa.array(["a" * 1001, *texts[k:]]), words)[1], whole[k])
    tokens = np.expm1(whole[:, Q.DIMS + 1]).round().tolist()
    assert tokens == [1554, 60_000, 0, 50_000, 0, 1, 2, 2]
    index, found = Q.index_vectors(), []
    for size in (1 << 20, 97):
        monkeypatch.setattr(Q, "CHUNK_BYTES", size)
        sums, counts = np.zeros((Q.BUCKETS, Q.DIMS), np.float32), np.zeros(Q.BUCKETS, np.float32)
        Q.neighbour_sums(pa.array(["one two! 3 " * 100, "x", None, "four five six " * 90]), index, sums, counts)
        found.append((sums, counts))
    assert all(np.array_equal(a, b) for a, b in zip(*found, strict=True))
