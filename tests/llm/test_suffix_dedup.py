import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from pagemill.llm import suffix_dedup as S
from pagemill.llm.common import Sums, powers
from pagemill.llm.queries import QUERIES

LENGTH = 40


def brute(rows, keep, length=LENGTH):
    """Removed spans of each row, by looking at every string."""
    places = defaultdict(list)
    data = [(t or "").encode() for _, t in rows]
    for k, b in enumerate(data):
        for at in range(len(b) - length + 1):
            places[b[at : at + length]].append((k, at))
    out = []
    rank = lambda k: (rows[k][0] is not None, rows[k][0] or 0)
    for k, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - length + 1):
            same = places[b[at : at + length]]
            if keep == "none":
                hit = len(same) > 1
            else:
                hit = any((rank(j), x) < (rank(k), at) for j, x in same)
            if hit:
                gone[at : at + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).tolist()
        out.append((rows[k][0], len(b), edges, bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""))
    return sorted(map(repr, out))


def texts(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(20, 150))) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("xyzw 日") for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(0, 8))]
        rows.append((k, "".join(parts)))
    rows += [(100 + k, rows[3][1]) for k in range(5)]
    rows += [(200, "q" * 500), (201, "qr" * 200), (202, "q" * LENGTH), (203, "q" * (LENGTH - 1)), (204, None), (205, "")]
    return rows


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("contexts", [2, S.CONTEXTS])
def test_brute_force(spark, monkeypatch, keep, contexts):
    monkeypatch.setattr(S.removed_spans, "__defaults__", (LENGTH, keep, contexts))
    rows = texts(contexts)
    found = S.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), LENGTH, keep)
    assert sorted(repr((r.doc_id, r.n_bytes, r.spans, bytes(r.kept))) for r in found.collect()) == brute(rows, keep)


def test_suffix_ranks():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 300, dtype=np.uint8)
    for depth in (16, 23, 40):
        rank = S.suffix_ranks(data, depth)
        own = [bytes(data[k : k + depth]) for k in range(len(data) - depth + 1)]
        assert sorted(range(len(own)), key=lambda k: own[k]) == sorted(range(len(own)), key=lambda k: rank[k])
        assert all((own[a] == own[a + 1]) == (rank[a] == rank[a + 1]) for a in range(len(own) - 1))


def test_matches():
    rank = np.array([1, 0, 1, 2, 1, 0])
    place = np.array([5, 3, 2, 1, 9, 3])
    assert S.has_match(rank, place, earlier=True).tolist() == [True, False, False, False, True, False]
    assert S.has_match(rank, place, earlier=False).tolist() == [True, False, True, False, True, False]


def test_previous_factors():
    """Nearest smaller places and factors against plain searches, of places in any order and with ties."""
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 50, 400):
        rank, place = rng.integers(0, 5, n), rng.integers(0, max(1, n // 2), n)
        order = np.argsort(rank, kind="stable")
        begins = np.append(True, rank[order][1:] != rank[order][:-1])[:n]
        p, r = place[order], rank[order]
        before = [max((j for j in range(i) if r[j] == r[i] and p[j] < p[i]), default=-1) for i in range(n)]
        after = [min((j for j in range(i + 1, n) if r[j] == r[i] and p[j] < p[i]), default=-1) for i in range(n)]
        assert S.smaller_before(p, begins).tolist() == before
        assert S.smaller_after(p, begins).tolist() == after
        factor, match = S.previous_factors(rank, place, 40)
        least = [any(rank[j] == rank[i] and place[j] < place[i] for j in range(n)) for i in range(n)]
        assert (factor == 40).tolist() == least and set(factor.tolist()) <= {0, 40}
        assert all(rank[m] == rank[i] and place[m] < place[i] for i, m in enumerate(match.tolist()) if m >= 0)
        other = [any(rank[j] == rank[i] and place[j] != place[i] for j in range(n)) for i in range(n)]
        assert S.has_match(rank, place, earlier=True).tolist() == least and S.has_match(rank, place, earlier=False).tolist() == other


def test_long_texts_come_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 9000, dtype=np.uint8)
    starts = np.array([0, 10, 10, 5000, 9000])
    sizes = S.Sizes(64)

    def found():
        return {(int(a), int(c), int(r), int(p)) for part in S.anchors(data, starts, sizes) for a, c, r, p in zip(*part, strict=True)}

    whole = found()
    monkeypatch.setattr(S, "PIECE_BYTES", 700)
    assert {x[0:1] + x[2:] for x in found()} == {x[0:1] + x[2:] for x in whole}
    assert found() == whole


def test_pipeline_form(spark, awkward, empty):
    out = S.without_repeats(awkward, LENGTH)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    by_id = defaultdict(list)
    for r in out.collect():
        by_id[r.doc_id].append(r.text)
    # Of a run of one letter only the first byte has no earlier string over it. Null ids come first: theirs is the first copy of the text, and those of document 1 go.
    assert by_id[None].count("one two three four five six seven eight nine ten eleven twelve") == 1 and None in by_id[None]
    assert by_id[1] == ["", ""] and by_id[3] == [None]
    assert by_id[2][0].startswith("ONE") and by_id[7] == ["x"]
    assert S.without_repeats(empty, LENGTH).count() == 0 and S.deduplicated(empty, LENGTH).count() == 0


def test_registered_query_against_brute_force(spark):
    """Every string of 400 bytes of the smallest data set."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    expected = []
    for i, n_bytes, edges, kept in map(eval, brute(rows, "none", 400)):
        expected.append((i, n_bytes, sum(edges[1::2]) - sum(edges[::2]), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    got = QUERIES["op1_suffix_dedup"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(expected)


@pytest.mark.parametrize("length", [1024, 4096])
def test_strings_that_fool_sums_modulo_powers_of_two(spark, length):
    """Two documents that share their first and last bytes but for the middle, which a plain sum cannot tell apart."""
    one, other = "a", "b"
    while len(one) < length:
        one, other = one + other, other + one
    rng = random.Random(1)
    same = "".join(rng.choice("xyz") for _ in range(30))
    rows = [(1, same + one + same), (2, same + other + same)]
    for keep in ("none", "first"):
        found = S.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), LENGTH, keep)
        assert sorted(repr((r.doc_id, r.n_bytes, r.spans, bytes(r.kept))) for r in found.collect()) == brute(rows, keep)
    data = np.frombuffer((one + other).encode(), np.uint8)
    sums = Sums(S._OF_BYTE[data])
    halves = sums.of(np.array([0, length]), np.array([length, 2 * length]))
    plain = sums.plain
    assert halves[0] != halves[1] and plain[length : length + 1] * powers(2 * length + 1)[0][length] == plain[2 * length :] - plain[length]


def test_planted_passages(spark):
    """Passages of over 50 words in two documents each: those of 400 bytes go, shorter ones stay, and so do other documents."""
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, most)))
    prose = lambda n, most: " ".join(word(most) for _ in range(n))
    long, short = [prose(60, 14) for _ in range(12)], [prose(51, 8) for _ in range(12)]
    assert min(map(len, long)) >= 400 > max(map(len, short)) + 2
    rows = [(k, f"{prose(80, 9)} {p} {prose(80, 9)}") for k, p in enumerate([*long, *long, *short, *short])]
    rows += [(100 + k, prose(200, 9)) for k in range(24)]
    found = {r.doc_id: r.spans for r in S.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), 400).collect()}
    for k, text in rows:
        if k >= 24:
            assert found[k] == []
        else:
            first = text.index(long[k % 12])
            assert found[k][0] <= first and found[k][-1] >= first + len(long[k % 12]) and len(found[k]) == 2
