import math

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import ann_vptree as A


def brute(rows, k):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = []
    for i, v in rows:
        if i % 5:
            continue
        found = []
        for j, w in rows:
            if j != i and len(w) == len(v):
                dot = a = b = 0.0
                for x, y in zip(v, w, strict=True):
                    dot, a, b = dot + x * y, a + x * x, b + y * y
                found.append((-(dot / (math.sqrt(a) * math.sqrt(b))), j))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def vectors(n=300, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(1000 + i, [x * 2 for x in rows[5][1]]) for i in range(10)]
    rows += [(2000, None), (2005, []), (2010, [0.0] * dims), (2015, [float("nan")] * dims), (2020, [None] * dims), (None, [1.0] * dims)]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), rows[0], rows[0], (3005, [math.inf] + [1.0] * (dims - 1)), (3010, [1e200] * dims)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, dims int, shard int")


def test_exact(spark):
    rows = [r for r in vectors() if r[0] != 3010]
    got = A.nearest(table(spark, rows), F.col("vec_id") % 5 == 0, k=5, shard_rows=100)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_relaxed_recall_and_fewer_candidates(spark):
    rows = vectors(400, 16, 2)[:400]
    exact = {tuple(r)[:1] + tuple(r)[2:3] for r in A.nearest(table(spark, rows), F.col("vec_id") % 5 == 0).collect()}
    loose = {tuple(r)[:1] + tuple(r)[2:3] for r in A.nearest(table(spark, rows), F.col("vec_id") % 5 == 0, relax=1.2).collect()}
    assert len(exact & loose) / len(exact) >= 0.9
    few = A.nearest(table(spark, rows[:3]), F.col("vec_id") == 0, k=5)
    assert few.count() == 2


def test_empty(spark):
    assert A.nearest(table(spark, vectors()).limit(0), F.lit(True)).count() == 0
    assert A.nearest(table(spark, vectors()), F.lit(False)).count() == 0


def test_queries_are_sent_where_something_may_be_near(spark):
    """Clustered vectors: most shards are left out, and the answers stay exact; more relaxed, recall is measured."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    rows = [(int(i), (centres[i % 30] + 0.05 * rng.normal(size=24)).tolist()) for i in range(1500)]
    found = A.nearest(table(spark, rows), F.col("vec_id") % 5 == 0, k=5, shard_rows=40)
    assert sorted(map(tuple, found.collect())) == brute(rows, 5)
    known = A.pivots(A.usable(table(spark, rows)), 40)
    units = A.unit(np.array([v for _, v in rows]))
    numbers, far = known.distances(24, units)
    home = far.argmin(axis=1)
    radius = np.array([far[home == p, p].max(initial=0) for p in range(len(numbers))])
    beat = np.sort(A.distances(units[:200], units), axis=1)[:, 6]
    assert len(numbers) == 38 and (far[:200] - radius <= beat[:, None]).mean() < 0.3


def test_recall_of_the_given_vectors(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pairs = [{(r.query_id, r.vec_id) for r in A.nearest(given, F.col("vec_id") % 50 == 0, relax=x, shard_rows=250).collect()} for x in (1.0, 1.15)]
    assert len(pairs[0]) == 200 and len(pairs[0] & pairs[1]) / 200 >= 0.9


def test_a_hot_vector_has_several_shards(spark):
    rng = np.random.default_rng(6)
    same = rng.normal(size=6).tolist()
    rows = [(i, same) for i in range(120)] + [(200 + i, rng.normal(size=6).tolist()) for i in range(100)]
    got = A.nearest(table(spark, rows), F.col("vec_id") % 5 == 0, k=5, shard_rows=20)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)
