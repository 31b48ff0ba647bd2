"""Token ids in a compressed binary format: id predictions of orders 0 to 2 before a range coder, in checksummed blocks.

A file holds the ids of some documents in ascending order of doc_id. They are cut into blocks of up to two million ids;
each starts with fresh models, has a checksum, and can be read alone. An id is coded by its share after the two ids before
it (order 2); if it is new there, by the share of all new ones and its own after the one before it (order 1), and if it is
new there too, by its share of all ids (order 0). What share new ids have is learned for each kind of context. Shares are
whole numbers, and what is computed in floating point is computed number by number, so that every machine reads what
another one wrote.

The ids of a block run in lanes, one after another in each, that are coded in step and share the models, so every
operation is a numpy operation over lanes. The models learn between runs of steps, from all lanes at once: a run's shares
are looked up together when it is written, and from tables of slots when it is read. A task holds one block, whatever the
size of its file.

    file    MAGIC, blocks, footer (zlib: ids, sizes of documents), footer size and checksum (u32, u32)
    block   numbers of ids and of different ids, sizes of head and words, checksum of both (five u32); head (zlib: gaps
            between the different ids, words of each lane); the lanes' 16-bit words

Null and empty texts have the end id alone. Rows that share an id stand one after another, ordered by text; null ids
come first. Columns beyond the named ones are not looked at. Every attempt of a task writes a file of its own, and only
the names in the table that Spark commits count.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from pagemill.llm.bpe import GROUP_BYTES
from pagemill.llm.common import give_back, shared_folder, slices, string_bytes, written

MAGIC = b"PMTOK3\0\0"
#: Lanes of a block, and the ids of a lane; smaller blocks have fewer lanes.
LANES, LANE = 2048, 1024
BLOCK = LANES * LANE
BLOCK_HEAD = struct.Struct("<IIIII")
BATCH_PIECES = 250
#: How many pieces a task remembers from one group of texts to the next; beyond, only those of the last group.
REMEMBERED = 1 << 19
#: A line feed, as byte-level vocabularies write it.
LINE_FEED = "\u010a"
#: Coders put out words of 16 bits while fewer than the lower 48 of an interval are in use.
WORD, BELOW = np.uint64(16), np.uint64(48)
LEAST = np.uint64(1 << 48)
#: The shares of order 2 add up to 2 ** BITS2, those of order 1 to 2 ** BITS1, and all three orders have SHARE_BITS.
BITS2, BITS1, SHARE_BITS = 12, 14, 46
#: Kinds of contexts: 64 levels of how often one occurred, 16 of how many different ids came after it.
KINDS = 64 * 16
#: Slots of a row of shares, at least: so many for each id, and as many as the context occurred, up to SURE.
SLOTS, SURE = 2, 64
#: Ids below this are numbered by a table, others by sorting.
TABLE_IDS = 1 << 22
NO_DOC = -(1 << 63)
#: Fixed value: how a byte-level tokenizer splits a text.
BYTE_LEVEL_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same in the classes of the quicker module, and the characters of which that one may think otherwise: controls,
#: numbers that are no digits, and all after Latin.
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile(r"[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")
#: Classes of characters up to the end of Latin.
LETTER, DIGIT, OTHER, BLANK, ODD = range(5)
LATIN = 0x250


def _kind(c: str) -> int:
    if NOT_PLAIN.match(c):
        return ODD
    return LETTER if re.match(r"[^\W\d_]", c) else DIGIT if re.match(r"\d", c) else BLANK if re.match(r"\s", c) else OTHER


KINDS_OF = np.array([_kind(chr(c)) for c in range(LATIN)] + [ODD] * (0x800 - LATIN), np.uint8)
KIND_OF_BYTE = np.concatenate([KINDS_OF[:128], np.full(128, ODD, np.uint8)])


def kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    kind = KIND_OF_BYTE[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    if len(lead):
        kind[lead] = kind[lead + 1] = KINDS_OF[(data[lead] & 31).astype(np.int64) << 6 | data[lead + 1] & 63]
    return kind


def piece_starts(data: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts without odd characters begin: the matches of BYTE_LEVEL_PIECES."""
    edge = np.zeros(len(data) + 3, bool)
    edge[starts] = True
    edge[len(data) :] = True
    begin = edge.copy()
    begin[1 : len(data)] |= kind[1:] != kind[:-1]
    turn = np.flatnonzero(begin[1 : len(data)] & (kind[:-1] == BLANK)) + 1
    turn = turn[~edge[turn]]
    before = data[turn - 1]
    begin[turn - 1 - (before >= 128)] = True  # the last of several blanks stands alone
    begin[turn[before == 32]] = False  # or goes with what follows, if it is a space
    quote = np.flatnonzero(data == 39)
    quote = quote[begin[quote] & ~edge[quote + 1]]
    if len(quote):
        one, two = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)
        long &= ~edge[quote + 2]
        begin[quote[short | long] + 1] = False
        begin[quote[short] + 2] = True
        begin[quote[long] + 3] = True
    return np.flatnonzero(begin[: len(data)])


def levels(x: np.ndarray) -> np.ndarray:
    """Whole numbers up to 2 ** 31 by size: below 8 as they are, then two levels for each doubling."""
    part, power = np.frexp(x.astype(np.float64))
    return np.where(x < 8, x, 2 * power + (part >= 0.75)).astype(np.int64)


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    return first, np.diff(np.append(first, len(ordered)))


class Order:
    """What has followed contexts: a row for each, of the ids after it, ascending, with their shares of `2 ** bits`.

    A row's first share, `escape`, is that of all other ids: how often what followed such a context was new, by how often
    it had occurred and how many different ids were after it, as told by leaving out each occurrence in turn. A row is cut
    into slots, so many that each id has one, and `slots` holds the entry of each. Row 0 is that of unknown contexts,
    entry 0 that of escapes.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, names: int, bits: int):
        """`keys` (context * names + id) ascending."""
        context = keys // names
        first, sizes = runs(context)
        self.context = np.append(-1, context[first])
        self.bits, rows = bits, len(self.context)
        row = np.repeat(np.arange(1, rows, dtype=np.int32), sizes)
        sizes = np.append(0, sizes)

        def of_rows(values: np.ndarray) -> np.ndarray:
            return np.bincount(row, values, rows).astype(np.int64)

        def kind(n: np.ndarray, different: np.ndarray) -> np.ndarray:
            return levels(n) * 16 + 15 * different // np.maximum(n, 1)

        self.n, once = of_rows(counts), of_rows(counts == 1)
        again = self.n > 1
        new = np.bincount(kind(self.n[again] - 1, sizes[again] - 1), once[again], KINDS)
        old = np.bincount(kind(self.n[again] - 1, sizes[again]), (self.n - once)[again], KINDS)
        odds = ((new + 0.5) / (new + old + 1))[kind(self.n, sizes)]
        power = np.minimum(np.frexp(np.maximum(SLOTS * sizes, np.minimum(self.n, SURE)).astype(np.float64))[1], bits).astype(np.int64)
        power[0] = 0
        whole = 1 << power
        # Ids of less than two slots of a row too long go with the others.
        kept = counts * whole[row] >= 2 * self.n[row]
        kept |= (SLOTS * sizes < whole)[row]
        if not kept.all():
            odds += (1 - odds) * (1 - of_rows(np.where(kept, counts, 0)) / np.maximum(self.n, 1))
            counts, row = counts[kept], row[kept]
            sizes = np.bincount(row, minlength=rows)
        self.entry_of = np.where(kept, np.cumsum(kept), 0).astype(np.int32)  # by key
        ids = (keys[kept] - self.context[row] * names).astype(np.int64)
        weight = 2 * counts - 1
        free = whole - sizes - np.clip((odds * whole).astype(np.int64), 1, whole - sizes)
        share = 1 + (weight * (free / np.maximum(of_rows(weight), 1))[row]).astype(np.int64)
        ends = np.append(0, np.cumsum(share))
        base = ends[np.append(0, np.cumsum(sizes))]
        escape = whole - np.diff(base)
        scale = bits - power
        begin = ends[:-1] - base[row] + escape[row]
        # Entries: id, where the share begins, its size.
        self.entries = np.append(0, ids << 32 | begin << scale[row] << 16 | share << scale[row])
        self.escape = escape << scale
        self.laid = np.append(0, sizes), share, escape, whole, scale

    def lay(self) -> None:
        """Makes the slots, for reading."""
        sizes, share, escape, whole, scale = self.laid
        # What escapes comes first in each row.
        begins = np.cumsum(sizes)[:-1] + np.arange(len(escape))
        many, held = np.empty(len(escape) + len(share), np.int64), np.zeros(len(escape) + len(share), np.int64)
        mine = np.ones(len(many), bool)
        mine[begins] = False
        held[mine], many[mine], many[begins] = self.entries[1:], share, escape
        self.slots = np.repeat(held, many)
        self.rows = (np.cumsum(whole) - whole) << 8 | scale  # a row's first slot, and how far places are shifted
        del self.laid

    def at(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The entries that hold these places of rows."""
        of_row = self.rows.take(row)
        return self.slots.take((of_row >> 8) + (place >> (of_row & 255)))


class Models:
    """The adaptive state of a block, shared by its lanes: all that was in the steps up to the last time they learned.

    An id that followed the last two has its share of those (order 2). Others have a share of what escapes there, by the
    numbers of different ids before the last one with which they followed it (order 1), and those that never did a share
    of what escapes there too, by the numbers of different ids that they followed (order 0). Ids are numbered by their
    place among the block's ids; a key is `(id before the last * names + last id) * names + id`.
    """

    def __init__(self, names: int, reading: bool):
        self.names, self.reading = names, reading
        self.bits0 = max(20, names.bit_length() + 2)
        self.bits1 = min(BITS1, SHARE_BITS - BITS2 - self.bits0)
        self.tail = self.bits0 + self.bits1
        self.bits = BITS2 + self.tail
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._count()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where different keys, ascending, stand among the known ones, and whether they do."""
        place = self.keys.searchsorted(keys)
        return place, np.append(self.keys, -1)[place] == keys

    def learn(self, keys: np.ndarray, counts: np.ndarray, place: np.ndarray, known: np.ndarray) -> None:
        """How often different keys, which `find` has found, occurred since the last time."""
        self.counts[place[known]] += counts[known]
        place, keys, counts = place[~known], keys[~known], counts[~known]
        at = place + np.arange(len(place))
        old = np.ones(len(self.keys) + len(keys), bool)
        old[at] = False
        held = self.keys, self.counts
        self.keys, self.counts = np.empty(len(old), np.int64), np.empty(len(old), np.int64)
        self.keys[old], self.counts[old] = held
        self.keys[at], self.counts[at] = keys, counts
        self._count()

    def _count(self) -> None:
        names = self.names
        self.two = Order(self.keys, self.counts, names, BITS2)
        after_one = self.keys % (names * names)
        after_one.sort()
        first, counts = runs(after_one)
        self.after_one = after_one[first]
        self.one = Order(self.after_one, counts, names, self.bits1)
        seen = np.bincount(self.after_one % names, minlength=names)
        self.share0 = 1 + (2 * seen + 1) * ((1 << self.bits0) - names) // (2 * len(first) + names)
        self.first0 = np.cumsum(self.share0) - self.share0
        self.rows1 = np.zeros(names, np.int32)
        self.rows1[self.one.context[1:]] = np.arange(1, len(self.one.context))
        if self.reading:
            self.one.lay()
            self.two.lay()
        # Rows of order 2 by a hash; of several in one place the last, or one that occurred again, stays.
        context = self.two.context[1:]
        self.mask = (1 << (2 * len(context)).bit_length()) - 1
        self.rows2 = np.zeros(self.mask + 1, np.int32)
        place, row = self._place(context), np.arange(1, len(context) + 1, dtype=np.int32)
        for part in (self.two.n[1:] == 1, self.two.n[1:] > 1):
            self.rows2[place[part]] = row[part]

    def _place(self, context: np.ndarray) -> np.ndarray:
        return ((context ^ context >> 15) * 0x9E3779B1 >> 16) & self.mask

    def row_of(self, context: np.ndarray) -> np.ndarray:
        row = self.rows2.take(self._place(context))
        row *= self.two.context.take(row) == context
        return row

    def intervals(self, keys: np.ndarray, place: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the shares of different keys' ids, which `find` has found, begin, of `2 ** bits`, and their sizes."""
        names, one, two = self.names, self.one, self.two
        context = keys // names
        new, sizes = runs(context)
        row = np.repeat(self.row_of(context[new]), sizes)
        entry = np.append(two.entry_of, np.int32(0))[place]
        entry *= known & (row > 0)
        held = two.entries[entry]
        first, size = (held >> 16 & 0xFFFF) << self.tail, (held & 0xFFFF) << self.tail

        others = np.flatnonzero(entry == 0)
        scale, after_one = two.escape[row[others]], keys[others] % (names * names)
        place = self.after_one.searchsorted(after_one)
        entry = np.append(one.entry_of, np.int32(0))[place]
        entry *= np.append(self.after_one, -1)[place] == after_one
        held = one.entries[entry]
        begin, part = (held >> 16 & 0xFFFF) << self.bits0, (held & 0xFFFF) << self.bits0
        miss = np.flatnonzero(entry == 0)
        last, now = np.divmod(after_one[miss], names)
        escape = one.escape[self.rows1[last]]
        begin[miss], part[miss] = self.first0[now] * escape, self.share0[now] * escape
        first[others], size[others] = begin * scale, part * scale
        return first, size

    def at(self, before: np.ndarray, last: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose shares hold these places, where those begin and their sizes."""
        row = self.row_of(before * self.names + last)
        held = self.two.at(row, place >> self.tail)
        now, first, size = held >> 32, (held >> 16 & 0xFFFF) << self.tail, (held & 0xFFFF) << self.tail
        others = (held == 0).nonzero()[0]
        if not len(others):
            return now, first, size

        scale = self.two.escape.take(row.take(others))
        place = place.take(others) // scale
        row = self.rows1.take(last.take(others))
        held = self.one.at(row, place >> self.bits0)
        found, begin, part = held >> 32, (held >> 16 & 0xFFFF) << self.bits0, (held & 0xFFFF) << self.bits0
        miss = (held == 0).nonzero()[0]
        if len(miss):
            escape = self.one.escape.take(row.take(miss))
            alone = self.first0.searchsorted(place.take(miss) // escape, side="right") - 1
            found[miss], begin[miss], part[miss] = alone, self.first0.take(alone) * escape, self.share0.take(alone) * escape
        now[others], first[others], size[others] = found, begin * scale, part * scale
        return now, first, size


class Encoder:
    """Range coders of `lanes` lanes: intervals of 64 bits, of which at least the lower 48 are in use. A carry goes into
    the words that are out."""

    def __init__(self, lanes: int, bits: int, most: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.bits = np.uint64(bits)
        self.words = np.zeros((lanes, most), np.uint16)
        self.starts = np.arange(lanes) * most
        self.place = self.starts.copy()

    def _add(self, more: np.ndarray) -> None:
        self.low += more
        at = self.place[(self.low < more).nonzero()[0]]
        flat = self.words.reshape(-1)
        while len(at):
            at = at - 1
            flat[at] += np.uint16(1)
            at = at[flat[at] == 0]

    def narrow(self, first: np.ndarray, size: np.ndarray) -> None:
        part = self.range >> self.bits
        self._add(part * first.view(np.uint64))
        self.range = part * size.view(np.uint64)
        out, flat = (self.range < LEAST).nonzero()[0], self.words.reshape(-1)
        while len(out):  # an unlikely id takes several rounds
            low, place, width = self.low.take(out), self.place.take(out), self.range.take(out) << WORD
            flat[place] = low >> BELOW
            self.place[out], self.low[out], self.range[out] = place + 1, low << WORD, width
            out = out[width < LEAST]

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of all lanes end to end, and how many each has."""
        # A number within the interval whose lower bits are zeros ends a lane.
        self._add(np.full(len(self.low), LEAST - np.uint64(1)))
        self.words.reshape(-1)[self.place] = self.low >> BELOW
        used = self.place + 1 - self.starts
        return self.words[np.arange(self.words.shape[1]) < used[:, None]], used


class Decoder:
    """Reads what an `Encoder` has written; `code` counts from the lower end of the interval."""

    def __init__(self, words: np.ndarray, used: np.ndarray, bits: int):
        # Zeros follow the words of a lane.
        held = np.zeros((len(used), int(used.max(initial=0)) + 4), np.uint16)
        held[np.arange(held.shape[1]) < used[:, None]] = words
        self.code = np.zeros(len(used), np.uint64)
        for k in range(4):
            self.code = self.code << WORD | held[:, k]
        self.words = held.reshape(-1)
        self.next = np.arange(len(used)) * held.shape[1] + 4
        self.range = np.full(len(used), 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.bits, self.most = np.uint64(bits), np.uint64((1 << bits) - 1)

    def place(self) -> np.ndarray:
        self.part = self.range >> self.bits
        return np.minimum(self.code // self.part, self.most).view(np.int64)

    def narrow(self, first: np.ndarray, size: np.ndarray) -> None:
        self.code -= self.part * first.view(np.uint64)
        self.range = self.part * size.view(np.uint64)
        out = (self.range < LEAST).nonzero()[0]
        while len(out):
            place, width = self.next.take(out), self.range.take(out) << WORD
            self.code[out] = self.code.take(out) << WORD | self.words.take(place)
            self.next[out], self.range[out] = place + 1, width
            out = out[width < LEAST]


def _cuts(steps: int) -> list[tuple[int, int]]:
    """Runs of steps between which the models learn, last after 5 of 16 steps; what they know grows sixfold."""
    ends, last = [steps], steps * 5 // 16
    while last > 0:
        ends.insert(0, last)
        last //= 6
    return list(zip([0, *ends], ends, strict=False))


def _keys(grid: np.ndarray, begin: int, end: int, names: int) -> np.ndarray:
    """Keys of the steps of a grid that has two more before."""
    return ((grid[begin:end].astype(np.int64) * names + grid[begin + 1 : end + 1]) * names + grid[begin + 2 : end + 2]).reshape(-1)


def _lanes(count: int) -> tuple[int, int]:
    """Lanes of a block of `count` ids, and the steps they take."""
    lanes = min(LANES, -(-count // LANE))
    return lanes, -(-count // max(lanes, 1))


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, ascending, and the place of each id among them."""
    if int(ids.max()) >= TABLE_IDS:
        return np.unique(ids, return_inverse=True)
    place = np.zeros(int(ids.max()) + 1, np.int32)
    place[ids] = 1
    names = np.flatnonzero(place)
    place[names] = np.arange(len(names))
    return names, place[ids]


def encode_block(ids: np.ndarray) -> bytes:
    """A block of one id or more."""
    lanes, steps = _lanes(len(ids))
    names, numbers = _numbered(ids)
    grid = np.zeros((2 + steps, lanes), np.int32)  # step by step, after two of zeros
    padded = np.zeros(lanes * steps, np.int32)
    padded[: len(ids)] = numbers
    grid[2:] = padded.reshape(lanes, steps).T
    models = Models(len(names), reading=False)
    coder = Encoder(lanes, models.bits, steps * models.bits // 16 + 8)
    for begin, end in _cuts(steps):
        keys = _keys(grid, begin, end, len(names))
        held = len(keys).bit_length()
        if len(names) ** 3 << held < 1 << 63:  # a number holds a key and its place
            keys = np.sort(keys << held | np.arange(len(keys)))
            order, keys = keys & ((1 << held) - 1), keys >> held
        else:
            order = np.argsort(keys)
            keys = keys[order]
        new, counts = runs(keys)
        keys = keys[new]
        which = np.empty(len(order), np.int32)
        which[order] = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
        found = models.find(keys)
        first, size = models.intervals(keys, *found)
        for one in which.reshape(-1, lanes):
            coder.narrow(first.take(one), size.take(one))
        if end < steps:
            models.learn(keys, counts, *found)
    words, used = coder.finish()
    held, gaps = words.astype("<u2").tobytes(), np.diff(names.astype(np.int64), prepend=0).astype("<u4")
    head = zlib.compress(gaps.tobytes() + used.astype("<u4").tobytes())
    return BLOCK_HEAD.pack(len(ids), len(names), len(head), len(held), zlib.crc32(held, zlib.crc32(head))) + head + held


def decode_block(stream: BinaryIO) -> np.ndarray:
    count, n_names, n_head, n_held, crc = BLOCK_HEAD.unpack(stream.read(BLOCK_HEAD.size))
    head, held = stream.read(n_head), stream.read(n_held)
    if zlib.crc32(held, zlib.crc32(head)) != crc:
        raise ValueError("a block fails its checksum")
    head = np.frombuffer(zlib.decompress(head), "<u4").astype(np.int64)
    names = np.cumsum(head[:n_names]).astype(np.uint32)
    lanes, steps = _lanes(count)
    models = Models(n_names, reading=True)
    coder = Decoder(np.frombuffer(held, "<u2"), head[n_names:], models.bits)
    grid = np.zeros((2 + steps, lanes), np.int32)
    before = last = np.zeros(lanes, np.int64)
    for begin, end in _cuts(steps):
        for step in range(begin, end):
            now, first, size = models.at(before, last, coder.place())
            coder.narrow(first, size)
            grid[step + 2] = now
            before, last = last, now
        if end < steps:
            keys = np.sort(_keys(grid, begin, end, n_names))
            new, counts = runs(keys)
            models.learn(keys[new], counts, *models.find(keys[new]))
    return names[grid[2:].T.reshape(-1)[:count]]


def write_file(out: BinaryIO, documents: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[int, int]:
    """Writes batches of doc ids, sizes and ids end to end; gives the numbers of documents and ids."""
    out.write(MAGIC)
    held: list[np.ndarray] = []
    waiting = 0
    names, lengths = [], []
    for doc_ids, sizes, ids in documents:
        names.append(doc_ids)
        lengths.append(sizes)
        held.append(ids)
        waiting += len(ids)
        if waiting >= BLOCK:
            everything = np.concatenate(held)
            whole = waiting // BLOCK * BLOCK
            for first in range(0, whole, BLOCK):
                out.write(encode_block(everything[first : first + BLOCK]))
            held, waiting = [everything[whole:].copy()], waiting - whole
    if waiting:
        out.write(encode_block(np.concatenate(held)))
    names, lengths = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (names, lengths))
    footer = zlib.compress(names.astype("<i8").tobytes() + lengths.astype("<i8").tobytes())
    out.write(footer + struct.pack("<II", len(footer), zlib.crc32(footer)))
    return len(names), int(lengths.sum())


def read_file(source: BinaryIO, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """The documents of a file: doc id (NO_DOC for null) and ids."""
    source.seek(size - 8)
    length, crc = struct.unpack("<II", source.read(8))
    source.seek(size - 8 - length)
    footer = source.read(length)
    if zlib.crc32(footer) != crc:
        raise ValueError("the footer fails its checksum")
    names, lengths = np.frombuffer(zlib.decompress(footer), "<i8").reshape(2, -1)
    source.seek(0)
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    held = np.zeros(0, np.uint32)
    for name, n in zip(names.tolist(), lengths.tolist(), strict=True):
        parts = [held]
        have = len(held)
        while have < n:
            parts.append(decode_block(source))
            have += len(parts[-1])
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield name, held[:n]
        held = held[n:]


class Library:
    """Ids by the tokenizers library. A byte-level tokenizer takes the matches of its split pattern one by one, so each
    distinct match is encoded once; texts with an added token, and other tokenizers' texts, are encoded whole."""

    def __init__(self, path: str):
        self.kind = Tokenizer.from_file(path)
        parts = json.loads(self.kind.to_str())
        before = parts.get("pre_tokenizer") or {}
        by_piece = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        by_piece = by_piece and parts.get("normalizer") is None and parts.get("truncation") is None
        self.tokens = [t["content"] for t in parts.get("added_tokens", [])]
        added = "|".join(map(regex.escape, self.tokens))
        self.by_piece = by_piece
        self.split = regex.compile(BYTE_LEVEL_PIECES) if by_piece else regex.compile(r"(?s).+")
        self.added = regex.compile(added) if added else None
        self.by_line = Tokenizer.from_file(path)
        # A line feed may stand in one part with the piece before it if no token ends in another character and one.
        joins = any(re.search(f"[^{LINE_FEED}]{LINE_FEED}", token) for token in self.kind.get_vocab())
        parting = pre_tokenizers.Split("\n", "isolated" if joins else "merged_with_previous")
        self.by_line.pre_tokenizer = pre_tokenizers.Sequence([parting, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        feed = self.by_line.encode("\n", add_special_tokens=False).ids
        self.line_feed = feed[0] if by_piece and len(feed) == 1 else -1
        #: Pieces by number, and their ids end to end.
        self.known = pa.array([], pa.large_string())
        self.flat, self.upto = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _ids_alone(self, pieces: list[str]) -> list[bytes]:
        return [array("i", x.ids).tobytes() for x in self.kind.encode_batch_fast(pieces, add_special_tokens=False)]

    def _ids_in_lines(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces end to end, and how many each has; these are lines of texts that are split at line feeds only."""
        flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for first in range(0, len(pieces), BATCH_PIECES):
            part = pieces.slice(first, BATCH_PIECES).to_pylist()
            ids = np.array(self.by_line.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, np.int32)
            inside = ids != self.line_feed
            ends = np.flatnonzero(~inside)
            if len(ends) == len(part) - 1:
                flat.append(ids[inside])
                sizes.append(np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1)
            else:
                alone = self._ids_alone(part)
                flat.append(np.frombuffer(b"".join(alone), np.int32))
                sizes.append(np.array([len(x) // 4 for x in alone], np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def _meet(self, pieces: pa.Array) -> None:
        """Learns the ids of pieces that are not known yet."""
        # A text with an added token is no single piece.
        alone = np.full(len(pieces), self.line_feed < 0)
        for token in ("\n", *self.tokens):
            alone |= pc.match_substring(pieces, token).to_numpy(zero_copy_only=False)
        ids = self._ids_alone(pieces.filter(pa.array(alone)).to_pylist())
        sizes = np.zeros(len(pieces), np.int64)
        sizes[alone] = [len(x) // 4 for x in ids]
        in_lines, sizes[~alone] = self._ids_in_lines(pieces.filter(pa.array(~alone)))
        owner = np.repeat(alone, sizes)
        flat = np.empty(len(owner), np.int32)
        flat[owner], flat[~owner] = np.frombuffer(b"".join(ids), np.int32), in_lines
        self.known = pa.concat_arrays([self.known, pieces])
        self.flat = np.concatenate([self.flat, flat])
        self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(sizes)])

    def _keep(self, numbers: np.ndarray) -> None:
        """Forgets all pieces but these."""
        self.known = self.known.take(pa.array(numbers))
        sizes = (self.upto[1:] - self.upto[:-1])[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = self.flat[np.repeat(self.upto[numbers] - ends[:-1], sizes) + np.arange(ends[-1])]
        self.upto = ends

    def _ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces end to end, and how many each has."""
        found = pieces.dictionary_encode()
        known = np.full(len(found.dictionary), -1)
        at = pc.index_in(self.known, value_set=found.dictionary)
        known[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        new = known < 0
        known[new] = len(self.known) + np.arange(int(new.sum()))
        self._meet(found.dictionary.filter(pa.array(new)))
        of_piece = known[found.indices.to_numpy()]
        begins = self.upto.take(of_piece)
        sizes = self.upto.take(of_piece + 1) - begins
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        if len(self.known) > REMEMBERED:
            self._keep(known)
        return flat, sizes

    def findall(self, text: str) -> list[str]:
        """The pieces of a text."""
        if self.added and self.added.search(text):
            return [text]
        return (PLAIN_PIECES if self.by_piece and not NOT_PLAIN.search(text) else self.split).findall(text)

    def _plain(self, data: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces of texts without odd characters, laid end to end, and how many each text has."""
        first = piece_starts(data, kind, starts)
        bounds = np.append(first, len(data))
        pieces = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        return pieces, np.diff(np.searchsorted(first, starts))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin (one more for the end)."""
        data, starts = string_bytes(column)
        kind, plain = kinds(data), np.full(len(column), self.by_piece)
        plain[np.searchsorted(starts, np.flatnonzero(kind == ODD), side="right") - 1] = False
        for token in self.tokens:
            plain &= ~pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        if not plain.all():
            data, starts = string_bytes(column.filter(pa.array(plain)))
            kind = kinds(data)
        pieces, counts = self._plain(data, kind, starts)
        if plain.all():
            flat, sizes = self._ids_of(pieces)
            return flat, np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        # All pieces are looked up at once, those of odd texts last.
        odd = [self.findall(t) if t else [] for t in column.filter(pa.array(~plain)).to_pylist()]
        flat, sizes = self._ids_of(pa.concat_arrays([pieces, pa.array(chain.from_iterable(odd), pa.large_string())]))
        counts = np.concatenate([counts, np.array([len(x) for x in odd], np.int64)])
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        text = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        lengths = np.zeros(len(column), np.int64)
        lengths[text] = np.diff(bounds)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        owner = np.repeat(plain, lengths)
        out, upto = np.empty(len(flat), np.int32), int(lengths[plain].sum())
        out[owner], out[~owner] = flat[:upto], flat[upto:]
        return out, ends


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


FILES = "part int, path string, n_docs bigint, n_ids bigint"


def write_ids(documents: DataFrame, tokens: str, end_id: int, folder: str) -> DataFrame:
    """Writes the ids of all texts, each followed by `end_id`, in ascending doc_id order over all files (by `part`).

    `tokens` is a tokenizer file that every executor can open. One range shuffle puts the texts in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, kind = TaskContext.get(), library(tokens)

        def encoded() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                names = batch["doc_id"].fill_null(NO_DOC).to_numpy(zero_copy_only=False)
                sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
                for first, last in slices(sizes, GROUP_BYTES):
                    found, bounds = kind.encode_column(batch["text"].slice(first, last - first))
                    ends = bounds[1:] + np.arange(last - first)  # each document's end id
                    flat = np.full(len(found) + last - first, end_id, np.uint32)
                    plain = np.ones(len(flat), bool)
                    plain[ends] = False
                    flat[plain] = found
                    yield names[first:last], np.diff(bounds) + 1, flat

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            n_docs, n_ids = write_file(out, encoded())
        give_back()
        columns = {"part": pa.array([task.partitionId()], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_ids": [n_ids]}
        yield pa.RecordBatch.from_pydict(columns)

    ordered = documents.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, FILES)


READ = "doc_id bigint, start bigint, n_tokens bigint, ids array<int>"


def read_ids(files: DataFrame, batch_rows: int = 256) -> DataFrame:
    """The documents of files (`part`, `path`, `n_ids`): `start` counts the ids of all documents before."""
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("path", F.coalesce(before, F.lit(0).cast("bigint")).alias("start"))  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            names, starts, ids = ([r[k] for r in rows] for k in range(3))
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            columns = [pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes), lists]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

        for path, start in ((p.as_py(), s.as_py()) for b in batches for p, s in zip(b["path"], b["start"], strict=True)):
            system, place = fs.FileSystem.from_uri(path)
            rows: list[tuple] = []
            with system.open_input_file(place) as source:
                for name, ids in read_file(source, source.size()):
                    rows.append((None if name == NO_DOC else name, start, ids))
                    start += len(ids)
                    if len(rows) == batch_rows:
                        yield out(rows)
                        rows = []
            yield out(rows)
            rows = []
            give_back()

    return placed.repartition(max(1, files.count())).mapInArrow(run, READ)


def round_trip(documents: DataFrame, tokens: str, end_id: int) -> DataFrame:
    """Documents' ids, written to files and read back from them."""
    folder = shared_folder(documents.sparkSession, "tokens")
    return read_ids(written(write_ids(documents, tokens, end_id, folder), "token-files"))


def ids_crc32(documents: DataFrame) -> DataFrame:
    """`doc_id`, `start`, `n_tokens` and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("bigint")
    def crc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, bounds = batch.values.to_numpy().view(np.uint32).astype("<u4", copy=False), batch.offsets.to_numpy()
            yield pa.array([zlib.crc32(flat[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], pa.int64())

    return documents.select("doc_id", "start", "n_tokens", crc("ids").alias("ids_crc32"))
