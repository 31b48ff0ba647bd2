import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pagemill.llm import ngram_join as N
from pagemill.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, percent=75):
    """doc_id -> (n_shingles, component) by all pairs; a row's text counts on its own."""
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append((i, frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()))
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            one, other = sets[a][1], sets[b][1]
            both = len(one & other)
            if both and 100 * both >= percent * (len(one) + len(other) - both):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    named = {root: min((i for i in ids if i is not None), default=None) for root, ids in least.items()}
    return sorted(map(repr, ((i, len(s), i if not s else named[find(k)]) for k, (i, s) in enumerate(sets))))


def check(spark, rows, percent=75):
    got = N.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), percent)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, percent)


def near_copies(seed, n, sizes=(1, 400)):
    rng = random.Random(seed)
    rows = []
    for base in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(*sizes))]
        for copy in range(rng.randrange(1, 12)):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 25 + 1)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], ["new", f"x{rng.randrange(50)}"], [f"y{rng.randrange(9)}"]])
                own = own or ["z"]
            rows.append((base * 100 + copy, " ".join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    check(spark, near_copies(seed, 45))


def test_small_sets_and_chains(spark):
    """Short texts around every bound, and chains that only links between neighbours hold together."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))) for k in range(150)]
    chain = [f"c{k}" for k in range(120)]
    rows += [(1000 + k, " ".join(chain[k : k + 60])) for k in range(0, 60, 5)]
    check(spark, rows)


def test_group_without_a_hub(spark):
    """Variants of a text that is not there itself: many pairs are just alike, others just not."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(60):
        own = list(words)
        for at in rng.sample(range(150), 3):
            own[at] = f"own{k}-{at}"
        rows.append((k, " ".join(own)))
    check(spark, rows)


def test_other_similarity(spark):
    check(spark, near_copies(9, 25, (5, 120)), percent=60)


def test_too_few_segments(spark):
    """With hardly any segments all sets take the way by single shingles."""
    plan = N.Partition(75, most_segments=1)
    keys = [N.set_keys(np.sort(np.random.default_rng(k).integers(0, 2**64, 60, dtype=np.uint64)), plan) for k in range(3)]
    assert all(any(use == N.SHORT for _, _, use in k) for k in keys)
    rows = near_copies(4, 12, (20, 90))
    got = N.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), plan=plan)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)


def thue_morse(length):
    one, other = "a", "b"
    while len(one) < length:
        one, other = one + other, other + one
    return one, other


@pytest.mark.parametrize("length", [1024, 4096])
def test_words_that_fool_sums_modulo_powers_of_two(spark, length):
    rows = [*enumerate(thue_morse(length)), (2, "c " + thue_morse(length)[0]), (3, thue_morse(length)[1])]
    check(spark, rows)
    assert len({r.component_id for r in N.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}) == 3


def test_long_near_copies_are_compared_once(spark):
    """Texts of 3,000 words in two groups, not near enough to each other: each pair across is given once; others that
    share a passage only are not given at all."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    other = [w if rng.random() < 0.94 else f"o{k}" for k, w in enumerate(base)]  # some 0.6 alike
    rows = []
    for g, words in enumerate((base, other)):
        for copy in range(6):
            own = list(words)
            for at in rng.sample(range(3000), 15):
                own[at] = f"x{g}-{copy}-{at}"
            rows.append((g * 100 + copy, " ".join(own)))
    for k in range(5):
        rows.append((1000 + k, " ".join(base[:400] + [f"f{k}-{n}" for n in range(2600)])))
    check(spark, rows)


def bucket_rows(sets, keys_of):
    rows = []
    for name, (hashes, root) in enumerate(sets):
        rows += [(0, 0, int(k), name, len(hashes), True, root, *N.sketch(hashes).tolist()) for k in keys_of(name)]
    rows.sort()
    import pyarrow as pa

    names = ["place", "part", "key", "name", "size", "asks", "root", *N.SKETCH]
    return pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], pa.bool_() if n == "asks" else pa.int64()) for k, n in enumerate(names)})


def test_a_place_gives_a_pair_once():
    rng = np.random.default_rng(2)
    one = np.sort(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    near = one.copy()
    near[:100] = rng.integers(0, 2**64, 100, dtype=np.uint64)
    batch = bucket_rows([(one, 1), (np.sort(near), 2), (one, 1)], lambda name: range(50))
    told: set = set()
    bounds = [*range(0, len(batch) + 1, 3)]
    found, place = N._told(batch, bounds, 75, None, told)
    assert sorted(zip(found["u"].to_pylist(), found["v"].to_pylist(), strict=True)) == [(0, 1), (1, 2)] and place == 0
    assert len(N._told(batch, bounds, 75, place, told)[0]) == 0
    small = np.sort(rng.integers(0, 2**64, 300, dtype=np.uint64))
    far = np.sort(np.concatenate([small[:150], rng.integers(0, 2**64, 150, dtype=np.uint64)]))
    assert len(N._told(bucket_rows([(small, 1), (far, 2)], lambda name: range(5)), [0, 2, 4, 6, 8, 10], 75, None, set())[0]) == 0


def test_hot_buckets_come_in_parts(spark, monkeypatch):
    """A bucket's rows in parts, a set's buckets in several places: the same groups (both are told on the driver)."""
    monkeypatch.setattr(N, "BUCKET_ROWS", 3)
    monkeypatch.setattr(N, "PLACE_ROWS", 7)
    check(spark, near_copies(1, 30))


def test_awkward(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = N.groups(awkward)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)
    assert N.groups(empty).count() == 0
    kept = N.one_of_each(awkward)
    assert kept.columns == awkward.columns
    # Rows without an id stay, and so does one row of each other id that is the least of its group.
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 9, None, None]))


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(50)] + [(100, 100 + k) for k in range(1, 80)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    parent = {k: k for e in edges for k in e}
    for _ in range(len(parent)):
        for u, v in edges:
            parent[u] = parent[v] = min(parent[u], parent[v])
    assert got == {k: p for k, p in parent.items() if k != p}


def test_one_of_each_group(spark, awkward, empty):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long), (2, long + " more"), (2, "another text of two"), (3, long.upper()), (3, "a third text, linked with nothing"), (4, "a third text, linked with nothing")]
    rows += [(5, None), (5, ""), (5, ""), (6, "same same"), (6, "same same"), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [tuple(r) for r in N.one_of_each_group(docs).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, [rows[k] for k in (0, 2, 4, 6, 7, 9, 11)]))
    kept = N.one_of_each_group(awkward)
    assert kept.columns == awkward.columns
    ids = [1, 3, 4, 5, 6, 7, 8, 9, 9, None, None]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, ids))
    assert N.one_of_each_group(empty).count() == 0
