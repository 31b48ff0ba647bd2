import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import topk_products as T


def brute(rows, k, step=5):
    kept = sorted({(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(1024 * x) for x in v)})
    found = {}
    for i, v in kept:
        if i % step == 0:
            for j, w in kept:
                if j != i and len(v) == len(w):
                    score = sum(a * b for a, b in zip(v, w, strict=True))
                    found.setdefault(i, []).append((-min(max(score, -(1 << 63)), (1 << 63) - 1), j))
    return sorted((i, r + 1, j, -s) for i, x in found.items() for r, (s, j) in enumerate(sorted(x)[:k]))


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, False) for r in rows], "vec_id bigint, embedding array<double>, piece int, bucket int, asks boolean")


def vectors(n=300, dims=8, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=dims) * math.exp(spread * rng.normal())).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2005, []), (2006, []), (2010, [0.0] * dims), (2015, [float("nan")] * dims), (2020, [None] * dims), (None, [1.0] * dims)]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), rows[0], rows[0], (3005, [math.inf] + [1.0] * dims), (5, rows[7][1])]
    return rows


def answers(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("spread", "piece_bytes", "block_bytes"), [(1.0, 1 << 25, 1 << 24), (0.0, 3000, 1000), (2.0, 5000, 900)])
def test_exact(spark, monkeypatch, spread, piece_bytes, block_bytes):
    monkeypatch.setattr(T, "RUN_ROWS", 16)
    monkeypatch.setattr(T, "ASKERS", 8)
    rows = vectors(spread=spread)
    got = T.top_products(table(spark, rows), F.col("vec_id") % 5 == 0, k=4, piece_bytes=piece_bytes, block_bytes=block_bytes)
    assert answers(got) == brute(rows, 4)


def test_huge_components(spark):
    rows = [(0, [1e300, -1.0]), (5, [3e12, 7.0]), (6, [-3e12, 1e10]), (10, [2.0, 1e306]), (7, [1.5, 2.5]), (15, [1e6, 1e7]), (8, [4e6, -1e7])]
    assert answers(T.top_products(table(spark, rows), F.col("vec_id") % 5 == 0, k=3)) == brute(rows, 3)


def test_all_negative_and_few(spark):
    rows = [(i, [1.0 if i % 2 else -1.0] * 3) for i in range(6)]
    assert answers(T.top_products(table(spark, rows), F.col("vec_id") == 0, k=10)) == [r for r in brute(rows, 10) if r[0] == 0]


def test_empty(spark):
    assert T.top_products(table(spark, vectors()).limit(0), F.lit(True)).count() == 0
    assert T.top_products(table(spark, vectors()), F.lit(None).cast("boolean")).count() == 0


def test_coordinates_prune_and_lose_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 32))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True) / 6
    rows = np.floor(1024 * (np.repeat(centres, 100, axis=0) + 0.05 * rng.normal(size=(2000, 32))))
    asking = rows[::50]
    length = np.linalg.norm(rows, axis=1)
    calls = []
    real = T.by_coordinates

    def counted(*args):
        calls.append(real(*args))
        return calls[-1]

    monkeypatch.setattr(T, "by_coordinates", counted)
    monkeypatch.setattr(T, "RUN_ROWS", 250)
    ids = np.arange(2000)
    asker, found, score = T.search(ids, rows, length, ids[::50], asking, length[::50], np.full(40, T.LEAST), 5)
    exact = asking.astype(np.int64) @ rows.astype(np.int64).T
    exact[np.arange(40), ids[::50]] = T.LEAST
    for q in range(40):
        order = np.lexsort((ids, ~exact[q]))[:5]
        assert found[asker == q].tolist() == order.tolist() and score[asker == q].tolist() == exact[q][order].tolist()
    assert any(c is not None for c in calls)
