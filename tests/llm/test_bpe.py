import random

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import functions as F

from pagemill.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference():
    words = bpe.vocabulary(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def test_round_trip(awkward):
    out = bpe.decode(bpe.encode(awkward, RANKS, public_tokenizers.PATTERN), RANKS)
    assert out.columns == [*awkward.columns, "decoded"]  # `ids` replaces the column of that name
    own = reference()
    for r in out.collect():
        assert r.ids == own.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_empty_table(empty):
    assert bpe.decode(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_null_ids(spark):
    out = bpe.decode(spark.range(1).select(F.lit(None).cast("array<int>").alias("ids")), RANKS).first()
    assert bytes(out.decoded) == b""


def test_random_texts_in_any_blocks():
    rng = random.Random(5)
    kinds = ["abAB'saretl ", "aaab", "0123 .,!?-\n\t", "éüñ日本語😀 \x85 \xa0"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(0, 200))) for _ in range(400)] + ["a" * 3000, "ab" * 2000]
    own, split = reference(), regex.compile(public_tokenizers.PATTERN)
    expected = [own.encode_ordinary(t) for t in texts]
    for size in (1, 7, len(texts)):
        flat, bounds = bpe.Vocabulary(bpe.vocabulary(RANKS).ranks).encode([texts[k : k + size] for k in range(0, len(texts), size)], split)
        assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == expected


def test_merges_that_bring_up_a_lower_rank():
    """A vocabulary in which a merge makes way for one of a lower rank, as the one-piece rule does it."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"ab": 400, b"cab": 350, b"xa": 410}
    words = bpe.Vocabulary(ranks)
    assert words.unsettling
    own = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    pieces = ["".join(rng.choice("abcx") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    pieces = [p for p in pieces if p.encode() not in ranks]
    got = [np.frombuffer(x, np.int32).tolist() for x in words.replay([p.encode() for p in pieces])]
    assert got == [own.encode_ordinary(p) for p in pieces]
