import io
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemill.llm import token_store as S
from pagemill.llm.common import string_bytes

TOKENS = public_tokenizers.path("byte_bpe_50k.json")


def test_against_the_library(awkward):
    kind = Tokenizer.from_file(TOKENS)
    rows = sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    expected, start = [], 0
    for r in rows:
        ids = [*kind.encode(r.text or "", add_special_tokens=False).ids, 2]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in S.ids_crc32(S.round_trip(awkward, TOKENS, 2)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_empty(empty):
    assert S.round_trip(empty, TOKENS, 2).count() == 0


@pytest.mark.parametrize("n", [1, 2, S.LANE - 1, S.LANE, S.LANE + 1, 6 * S.LANE + 5])
@pytest.mark.parametrize("most", [0, 1, 50_000, 2**32 - 1])
def test_blocks(n, most):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, most, n, dtype=np.uint64, endpoint=True).astype(np.uint32)
    ids[n // 2 :] = np.resize(ids[:7], n - n // 2)
    packed = S.encode_block(ids)
    assert (S.decode_block(io.BytesIO(packed)) == ids).all()


def test_repeated_text_is_small():
    assert len(S.encode_block(np.tile(np.arange(300, dtype=np.uint32), 50))) < 15_000 * 4 / 8


def test_damage_is_found():
    packed = bytearray(S.encode_block(np.arange(5000, dtype=np.uint32)))
    packed[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        S.decode_block(io.BytesIO(bytes(packed)))
    out = io.BytesIO()
    S.write_file(out, [(np.array([1]), np.array([3]), np.array([5, 6, 7], np.uint32))])
    damaged = bytearray(out.getvalue())
    damaged[-9] ^= 1
    with pytest.raises(ValueError, match="footer"):
        list(S.read_file(io.BytesIO(bytes(damaged)), len(damaged)))


def test_files_of_several_blocks(monkeypatch):
    monkeypatch.setattr(S, "LANES", 3)
    monkeypatch.setattr(S, "BLOCK", 3 * S.LANE)
    rng = np.random.default_rng(1)
    sizes = [1, 3 * S.LANE, 0, 7 * S.LANE + 1, 5]
    documents = [rng.zipf(1.3, n).clip(max=70_000).astype(np.uint32) for n in sizes]
    out = io.BytesIO()
    batches = [(np.array([k]), np.array([n]), ids) for k, (n, ids) in enumerate(zip(sizes, documents, strict=True))]
    assert S.write_file(out, batches) == (len(sizes), sum(sizes))
    got = list(S.read_file(out, len(out.getvalue())))
    assert [k for k, _ in got] == list(range(len(sizes)))
    assert all((a == b).all() and len(a) == len(b) for (_, a), b in zip(got, documents, strict=True))


def test_as_many_different_ids_as_a_block_may_hold():
    ids = np.random.default_rng(2).permutation(S.BLOCK).astype(np.uint32)[: S.BLOCK]
    assert (S.decode_block(io.BytesIO(S.encode_block(ids))) == ids).all()


def test_texts_take_fewer_bits_than_their_entropy():
    kind = Tokenizer.from_file(TOKENS)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = np.array([i for t in texts for i in [*kind.encode(t or "", add_special_tokens=False).ids, 2]], np.uint32)
    odds = np.unique(ids, return_counts=True)[1] / len(ids)
    packed = S.encode_block(ids)
    assert 8 * len(packed) / len(ids) < -(odds * np.log2(odds)).sum()
    assert len(packed) < len(zlib.compress(ids.astype("<u2").tobytes(), 9))
    assert (S.decode_block(io.BytesIO(packed)) == ids).all()


def test_quick_split_is_the_same():
    plain = [chr(c) for c in range(0x250) if not S.NOT_PLAIN.search(chr(c))]
    split = S.library(TOKENS).split
    for a, b in itertools.product(plain, repeat=2):
        text = f"{a}{b} {a} {b}{a}  {b}"
        assert S.PLAIN_PIECES.findall(text) == split.findall(text), text


def test_pieces_of_whole_columns():
    kind = S.library(TOKENS)
    plain = [chr(c) for c in range(S.LATIN) if not S.NOT_PLAIN.search(chr(c))]
    odd = ["\x1f", "\u00b2", "\u0250", "\u2028", "\U0001f600", "<|endoftext|>"]
    rng = np.random.default_rng(3)
    few = ["'", "s", "l", "r", "e", "v", "m", "S", " ", "  ", "\n", "\t", "\u00a0", "\u00e9", "1", "_", "!", "\x00"]
    texts = ["".join(rng.choice(few, n)) for n in rng.integers(0, 12, 20_000)]
    texts += ["".join(rng.choice(plain, n)) for n in rng.integers(0, 40, 300)]
    texts += ["".join(rng.choice([*few, *odd], n)) for n in rng.integers(0, 12, 3000)]
    texts += ["", "'", "'l", "'ll", "a'", "x" * 5000, "\n" * 300, "it's'll 're\n've", *odd]
    rng.shuffle(texts)
    rows = [None, *texts, None, "\u00e9", ""]
    found, bounds = kind.encode_column(pa.array(rows, pa.string()))
    expected = [x.ids for x in kind.kind.encode_batch([t or "" for t in rows], add_special_tokens=False)]
    assert [found[a:b].tolist() for a, b in itertools.pairwise(bounds.tolist())] == expected
    data, starts = string_bytes(pa.array([t for t in texts if not S.NOT_PLAIN.search(t)]))
    assert len(S.piece_starts(data, S.kinds(data), starts)) == sum(len(kind.split.findall(t)) for t in texts if not S.NOT_PLAIN.search(t))


def test_new_pieces_are_encoded_together(monkeypatch):
    kind, calls = S.Library(TOKENS), []
    monkeypatch.setattr(kind, "_ids_alone", lambda pieces, f=kind._ids_alone: calls.append(len(pieces)) or f(pieces))
    kind.encode_column(pa.array([" ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(600)) + "\n\n"]))
    assert sum(calls) <= 1  # the line feeds


def test_pieces_of_the_last_group_are_kept(monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 50)
    kind, met = S.Library(TOKENS), []
    monkeypatch.setattr(kind, "_ids_in_lines", lambda pieces, f=kind._ids_in_lines: met.append(len(pieces)) or f(pieces))
    words = [" " + "".join(x) for x in itertools.product("abcdefgh", repeat=3)]
    groups = ["".join(words[:100]), "".join(words[50:150]), "".join(words[:60]), "", "a\n\nb"]
    for text in groups:
        found, bounds = kind.encode_column(pa.array([text, None]))
        assert found.tolist() == kind.kind.encode(text, add_special_tokens=False).ids and bounds.tolist() == [0, len(found), len(found)]
    assert met == [100, 50, 50, 0, 2]


def test_fewer_than_seven_bits_an_id():
    kind = S.library(TOKENS)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    ids = kind.encode_column(texts)[0].astype(np.uint32)
    packed = S.encode_block(ids)
    assert 8 * len(packed) < 7 * len(ids)
    assert (S.decode_block(io.BytesIO(packed)) == ids).all()


def test_carries_go_up_to_the_first_word():
    """Ids whose shares lie at the upper end of the interval, then any others: words before them take carries."""
    rng = np.random.default_rng(4)
    for seed in range(6):
        coder, bits = S.Encoder(50, 46, 400), 46
        steps = []
        for _ in range(100):
            size = np.where(rng.random(50) < 0.7, (1 << bits) - rng.integers(1, 50, 50), rng.integers(1, 1 << rng.integers(1, bits), 50))
            first = (1 << bits) - size - np.where(rng.random(50) < 0.9, 0, rng.integers(0, (1 << bits) - size + 1))
            steps.append((first, size))
            coder.narrow(first, size)
        decoder = S.Decoder(*coder.finish(), bits)
        for first, size in steps:
            place = decoder.place()
            assert ((place >= first) & (place < first + size)).all(), seed
            decoder.narrow(first, size)
