import math
import re
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import lexical_search as L
from pagemill.llm.terms import Best, word_pieces

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(documents, items, k):
    lists = [(i, words(t)) for i, t in documents]
    lists = [(i, w) for i, w in lists if w]
    n_all, length = len(lists), sum(len(w) for _, w in lists)
    df = Counter(t for _, w in lists for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, w in lists:
            tf, score = Counter(w), 0
            m = 100 - 50 + 50 * len(w) * n_all // length
            for t in terms & set(tf):
                weight = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
                score += weight * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "one TWO three"), (2, None), (3, " ... "), (4, "año 日本語 été"), (5, "word"), (5, "short and other"), (None, "one été"), (6, "absent"), (7, "x" * 30_000)]


@pytest.mark.parametrize("group_terms", [1, 3, 1 << 16])
def test_against_brute_force(spark, awkward, group_terms):
    items = spark.createDataFrame([(*r, 1, 2) for r in ITEMS], "item_id bigint, text string, term int, part int")
    got = L.search(awkward, items, k=3, group_terms=group_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    documents = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(documents, ITEMS, 3)


def test_ties_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(L, "BLOCK_ENTRIES", 64)
    monkeypatch.setattr(L, "BLOCK_DOCUMENTS", 16)
    rng = np.random.default_rng(3)
    documents = [(int(i), " ".join(rng.choice(["a", "b", "c", "d", "e", "f"], 3))) for i in rng.permutation(300)]
    items = [(k, " ".join(rng.choice(["a", "b", "c", "d", "e", "f"], 2))) for k in range(9)]
    block = L.item_blocks([np.arange(3), np.arange(200), np.array([5])], np.ones(200, np.int64))
    assert [(b.first, b.last) for b in block] == [(0, 1), (1, 2), (2, 3)]
    df = spark.createDataFrame(documents, "doc_id bigint, text string").repartition(3)
    got = L.search(df, spark.createDataFrame(items, "item_id bigint, text string"), k=7)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(documents, items, 7)


def test_empty(spark, awkward, empty):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert L.search(empty, items).count() == 0
    assert L.search(awkward, items.limit(0)).count() == 0
    assert L.search(awkward, spark.createDataFrame([(2, None)], "item_id bigint, text string")).columns == ["item_id", "rank", "doc_id", "score"]


def test_products_beyond_53_bits():
    items = np.full((2, 5), 4e9)
    documents = np.full((5, 3), 999_999.0)
    assert (L.exact_product(items, documents) == 5 * 4_000_000_000 * 999_999).all()
    assert L.exact_product(np.zeros((2, 0)), np.zeros((0, 3))).shape == (2, 3)


def test_lengths_beyond_64_bits():
    n, documents = np.array([1, 10**9]), 10**12
    assert L.lengths(n, documents, 10**15).tolist() == [50, 50 + 50 * 10**21 // 10**15]


@pytest.mark.parametrize("most", [1, 3, 7, 1 << 20])
def test_word_pieces(awkward, most):
    texts = awkward.toArrow()["text"].combine_chunks()
    if most < 7:
        texts = texts.filter(np.array([len(t or "") < 2000 for t in texts.to_pylist()]))
    got = [(r, w) for rows, found in word_pieces(texts, most) for r, w in zip(rows.tolist(), found.to_pylist(), strict=True)]
    assert got == [(r, w) for r, t in enumerate(texts.to_pylist()) for w in words(t)]


def test_best_keeps_ties():
    best = Best(2, 2, np.array([1, 1]))
    for asker, ids, scores in [([0, 0, 0], [5, 9, 7], [3, 3, 3]), ([0, 1], [1, 1], [3, 8])]:
        best.add(*map(np.array, (asker, ids, scores)))
    assert [x.tolist() for x in best.settle()] == [[0, 0, 1], [1, 5, 1], [3, 3, 8]]
    assert best.bound.tolist() == [3, 1]
