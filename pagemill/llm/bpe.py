"""Byte-level byte pair encoding by merge replay over a block of texts at a time, and its decoding.

A block's distinct pieces (matches of the split pattern) are laid end to end, an inverted index tells for each merge
where in them its pair stands, and the merges are applied in rank order, each to all its places; only the two
neighbours of a place are looked at again. A task keeps the pieces it has met, up to a bound, so that a piece costs
one replay. Results are those of encoding every piece alone, whatever the blocks.

The pieces of a whole corpus grow with it (names, numbers, junk) and cannot be sent to every task, so the corpus is
replayed block by block; nothing is shuffled, and a lost task is simply run again.

A null text is encoded as an empty one: no ids. Rows are not compared with each other, so repeated rows, ties and
extra columns change nothing. The output columns replace columns of the same names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, islice
from sys import byteorder

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import slices

#: Text whose pieces are looked up together, and of a block of it that is split at a time.
GROUP_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
#: How many pieces a task remembers from one group to the next.
REMEMBERED = 1 << 16
#: Pieces that are replayed together: some 100 MB of index.
REPLAY_BYTES = 1 << 20
NONE = 1 << 40


class Numbers(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class PieceIds:
    """The ids of texts by those of their pieces, of which each is looked up once."""

    def __init__(self) -> None:
        self.forget()

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, as 32-bit integers."""
        raise NotImplementedError

    def forget(self) -> None:
        self.number = Numbers()
        self.flat, self.upto = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def meet(self) -> None:
        """Learns the ids of the pieces that were numbered since."""
        ids = self.ids_of(list(islice(self.number, len(self.upto) - 1, None)))
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.int32)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(sizes)])

    def encode(self, texts: Iterable[list[str | None]], split: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin (one more for the end). The texts come in
        blocks, of which the pieces' numbers are kept."""
        if len(self.number) > REMEMBERED:
            self.forget()
        numbered = []  # the pieces' numbers and how many each text has
        for block in texts:
            found = [split.findall(t) if t else [] for t in block]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            numbered.append((np.fromiter(map(self.number.__getitem__, chain.from_iterable(found)), np.int32, int(counts.sum())), counts))
        self.meet()
        flat, bounds, upto = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        for piece, counts in numbered:
            sizes = (self.upto[1:] - self.upto[:-1])[piece]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat.append(self.flat[np.repeat(self.upto[piece] - ends[:-1], sizes) + np.arange(ends[-1])])
            bounds.append(upto + ends[np.cumsum(counts)])
            upto += int(ends[-1])
        return np.concatenate(flat), np.concatenate(bounds)


class Vocabulary(PieceIds):
    """Token bytes by rank, and the merges they are made by."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
        if (self.of_byte < 0).any():
            raise ValueError("a byte-level vocabulary has a token for each byte")
        super().__init__()
        # All pairs of tokens that make a token, not only the pair it was first made of.
        pairs = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None:
                    pairs.append((left << 32 | right, rank))
        self.codes, self.makes = np.array(sorted(pairs), np.int64).reshape(-1, 2).T.copy()
        # Tokens whose making can give rise to a merge of a lower rank than their own.
        halves = np.concatenate([self.codes >> 32, self.codes & 0xFFFFFFFF])
        self.unsettling = set(halves[halves > np.concatenate([self.makes, self.makes])].tolist())

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens that neighbours make, NONE where none."""
        if not len(self.codes):
            return np.full(len(left), NONE)
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.makes[at], NONE)

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of all pieces (32-bit integers), by applying every merge in rank order to all of them."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        token = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(token)
        if not n:
            return [b""] * len(pieces)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        # Neighbours of a place in its piece; -1 stands before the first and after the last.
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        makes = np.full(n, NONE)  # by a place and the one after it
        index: dict[int, list[np.ndarray]] = {}
        pending: list[int] = []

        def look(places: np.ndarray) -> None:
            """Enters into the index what the places make with those after them."""
            other = after[places]
            makes[places] = np.where(other >= 0, self.merges(token[places], token[other]), NONE)
            places = places[makes[places] < NONE]
            if len(places):
                rank = makes[places]
                order = np.argsort(rank, kind="stable")
                places, rank = places[order], rank[order]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                bounds = [0, *cuts.tolist(), len(rank)]
                for first, last in zip(bounds, bounds[1:], strict=False):
                    put(int(rank[first]), places[first:last])

        def put(rank: int, places: np.ndarray) -> None:
            if rank not in index:
                index[rank] = []
                heappush(pending, rank)
            index[rank].append(places)

        look(np.arange(n))
        while pending:
            rank = heappop(pending)
            held = index.pop(rank)
            places = np.unique(np.concatenate(held) if len(held) > 1 else held[0])
            places = places[makes[places] == rank]
            if not len(places):
                continue
            if rank in self.unsettling:  # the first of each piece; what follows from it may have to go before the others
                first = np.concatenate([[True], piece[places[1:]] != piece[places[:-1]]])
                if not first.all():
                    put(rank, places[~first])
                    places = places[first]
            elif len(places) > 1 and (overlap := after[places[:-1]] == places[1:]).any():  # every other one of a run
                at = np.arange(len(places))
                starts = np.concatenate([[True], ~overlap])
                places = places[(at - np.maximum.accumulate(np.where(starts, at, 0))) % 2 == 0]
            other = after[places]
            beyond = after[other]
            token[places], token[other], makes[other], after[places] = rank, -1, NONE, beyond
            before[beyond[beyond >= 0]] = places[beyond >= 0]
            left = before[places]
            look(np.concatenate([places, left[left >= 0]]))
        alive = token >= 0
        flat = token[alive].astype(np.int32).tobytes()
        upto = 4 * np.cumsum(alive)
        bounds = [0, *np.where(ends > 0, upto[ends - 1], 0).tolist()]
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """By merge replay; a piece that is a token needs none."""
        raw = [p.encode() for p in pieces]
        whole = [self.ranks.get(b, -1) for b in raw]
        rest = [b for b, t in zip(raw, whole, strict=True) if t < 0]
        parts = slices(np.fromiter(map(len, rest), np.int64, len(rest)), REPLAY_BYTES)
        merged = chain.from_iterable(self.replay(rest[a:b]) for a, b in parts)
        return [next(merged) if t < 0 else t.to_bytes(4, byteorder) for t in whole]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})


def encode(documents: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Documents with their token `ids`. `ranks` is a rank file that every executor can open."""

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, split = vocabulary(ranks), regex.compile(pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
            lists = [pa.array([], pa.list_(pa.int32()))]
            for first, last in slices(sizes, GROUP_BYTES):
                parts = slices(sizes[first:last], BLOCK_BYTES)
                flat, bounds = words.encode((batch.slice(first + a, b - a).to_pylist() for a, b in parts), split)
                lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())))
            yield pa.concat_arrays(lists)
            pa.default_memory_pool().release_unused()  # workers live on, for other batches and tasks

    return documents.withColumn(ids, encoded(F.col(text)))


def decode(documents: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Documents with the bytes that their `ids` stand for; null ids have none."""

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = vocabulary(ranks).bytes_of.__getitem__
        for batch in batches:
            batch = batch.fill_null([])
            starts = batch.offsets.to_numpy()
            texts = []
            for a, b in slices(np.diff(starts), BLOCK_BYTES // 4):
                tokens = list(map(token, batch.values.slice(starts[a], starts[b] - starts[a]).to_numpy().tolist()))
                bounds = (starts[a : b + 1] - starts[a]).tolist()
                texts += [b"".join(tokens[c:d]) for c, d in zip(bounds, bounds[1:], strict=False)]
            yield pa.array(texts, pa.binary())
            pa.default_memory_pool().release_unused()

    return documents.withColumn(out, decoded(F.col(ids)))
