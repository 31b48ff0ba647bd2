"""Stages of the pipeline, each on what the one before it kept, and awkward tables through all of them."""

import hashlib

import corpus_pipeline as P
from pagemill.llm.common import table, written

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        assert docs.filter("n_chars <> length(text)").isEmpty()
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[2] == counts[3] > 0.7 * counts[0]
    kept = {r.doc_id: r.text for r in docs.collect()}
    last = {r.doc_id: r for r in P.STAGES[-1][1](spark, docs, SF_DIR).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()} == {i: r.decoded_sha256 for i, r in last.items()}
    assert all(len(r.ids) == r.n_tokens for r in last.values())
    assert sorted(r.doc_id for r in P.run(spark, SF_DIR).collect()) == sorted(last)


def test_awkward(spark, awkward, empty):
    """Every stage on a table with every name that the code uses: columns come through unchanged."""
    more = ["*", "'s' as source", "length(text) as n_chars"]
    benchmark = table(spark, SF_DIR, "benchmark")
    assert benchmark.count()
    for docs in (awkward, empty):
        docs = docs.selectExpr(*more)
        own = [c for c in docs.columns if c not in ("text", "n_chars")]
        given = {tuple(map(str, (r[c] for c in own))) for r in docs.collect()}
        for name, stage in P.STAGES[:-1]:
            out = written(stage(spark, docs, SF_DIR), name)
            assert out.columns == docs.columns, name
            assert {tuple(map(str, (r[c] for c in own))) for r in out.collect()} <= given, name
            if name != "language":  # this one drops texts that are no language
                docs = out
        tokens = P.STAGES[-1][1](spark, docs, SF_DIR)
        assert tokens.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256"] and tokens.count() == docs.count()


def test_texts_that_share_an_id_stay(spark):
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(1, text), (2, text + " more"), (2, "another text of the same id"), (3, "x y z"), (3, "one text of id three")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = dict(P.STAGES)["near_copies"](spark, docs, SF_DIR).collect()
    assert sorted(map(tuple, kept)) == sorted(rows[k] for k in (0, 2, 3, 4))
