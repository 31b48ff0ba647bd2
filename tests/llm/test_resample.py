import math
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import resample as R
from tests.llm.test_lexical_search import words


def features(text):
    w = words(text)
    return [zlib.crc32(x) % R.BUCKETS for x in w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)]], len(w)


def brute(documents, target, percent, min_words):
    own, wanted = Counter(), Counter()
    for _, t in documents:
        own.update(features(t)[0])
    for t in target:
        wanted.update(features(t)[0])
    s, t = sum(own.values()), sum(wanted.values())
    out, able = [], []
    for n, (i, text) in enumerate(documents):
        found, n_words = features(text)
        gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + R.BUCKETS) / ((own[b] + 1) * (t + R.BUCKETS)))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if n_words >= min_words:
            able.append((-score, i is None, i or 0, n))
    for rank, (*_, n) in enumerate(sorted(able)[: percent * len(able) // 100]):
        out[n][4] = rank + 1
    return sorted(map(tuple, out), key=repr)


def answers(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(9)
    known = ["Été", "b", "c-d", "e7", "ff" * 40, "g", "日本", "I"]
    rows = [(int(i), " ".join(rng.choice(known, rng.integers(0, 60)))) for i in rng.permutation(200)]
    return rows + rows[:20] + [(None, rows[0][1])] * 3


@pytest.mark.parametrize("percent", [1, 25, 100])
def test_against_brute_force(spark, awkward, prose, percent):
    target = ["été b e7", None, "", "I g g"]
    texts = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    documents = spark.createDataFrame([(*r, 1, 2, 3) for r in prose], "doc_id bigint, text string, score int, _down int, rank int").repartition(3)
    assert answers(R.resampled(documents, texts, percent)) == brute(prose, target, percent, 20)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert answers(R.resampled(awkward, texts, percent, min_words=3)) == brute(rows, target, percent, 3)


def test_pieces_change_nothing(spark, prose, monkeypatch):
    whole = R.word_pieces
    texts = spark.createDataFrame(prose, "doc_id bigint, text string").toArrow()["text"].combine_chunks()

    def totals():
        out = np.zeros((len(texts), R.BUCKETS), np.int64)
        for _, of, at in R.feature_pieces(texts):
            np.add.at(out, (of, at), 1)
        return out

    expected = totals()
    monkeypatch.setattr(R, "word_pieces", lambda t: whole(t, 11))
    assert (totals() == expected).all()
    assert [Counter(features(t.as_py())[0]) for t in texts] == [Counter({b: n for b, n in enumerate(row.tolist()) if n}) for row in expected]


def test_empty(spark, awkward, empty):
    assert R.resampled(empty, awkward).count() == 0
    got = answers(R.resampled(awkward, empty))
    assert got == brute([(r["doc_id"], r["text"]) for r in awkward.collect()], [], 25, 20)


@pytest.mark.parametrize("kind", ["spread", "two", "one", "steps"])
def test_cutoff_by_brackets(spark, kind):
    n = 30_000
    value = {"spread": F.xxhash64("id"), "two": F.col("id") % 2, "one": F.lit(7), "steps": F.floor(F.sqrt("id"))}[kind]
    rows = spark.range(n).select(value.cast("bigint").alias("v"))
    held = sorted(r[0] for r in rows.collect())
    for place in (1, 2, 7_499, 15_000, 15_001, n - 1, n):
        found = held[place - 1]
        assert R.nth(rows, "v", place, n, sorted_rows=50) == (found, held.index(found))
