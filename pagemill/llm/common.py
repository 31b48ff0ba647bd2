"""What the operators of this package share: tables, the shared folder, words hashed in whole columns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below `spark.checkpoint.dir`, which all executors and the driver see.

    Where that is unset (tests on one machine) the session gets a checkpoint folder of its own; with executors on other
    machines, which would not see it, that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not (place := spark.sparkContext.getCheckpointDir()):
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagemill-"))
            place = spark.sparkContext.getCheckpointDir()
    return f"{place.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, without its lineage, safe if executors are lost."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.folder = folder
    return out


def removed(*tables: DataFrame) -> None:
    """Takes away tables of `written` of which all that was made is written too."""
    for df in tables:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def give_back() -> None:
    """At the end of a task: memory that Python and Arrow hold free goes back, since workers live on beside other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def packed(documents: DataFrame) -> DataFrame:
    """Rows as one struct `row`, so that no column of theirs has a name that an operator uses; `row.*` gives them back."""
    return documents.select(F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("row"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def text_hash(text: Column) -> Column:
    """Tells documents apart that share an id."""
    return F.xxhash64(text)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row starts (one more for the end).

    A null is as long as an empty text.
    """
    column = column.cast(pa.large_string()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(starts) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of about `most` bytes together; a longer row is a run of its own."""
    out, first, held = [], 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > first and held + size > most:
            out.append((first, row))
            first, held = row, 0
        held += size
    if first < len(sizes):
        out.append((first, len(sizes)))
    return out


_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWER_OF = 0x9E3779B97F4A7C15 | 1
PIECE_BYTES = 1 << 20


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    hashes = hashes ^ (hashes >> np.uint64(30))
    hashes = hashes * np.uint64(0xBF58476D1CE4E5B9)
    hashes = hashes ^ (hashes >> np.uint64(27))
    hashes = hashes * np.uint64(0x94D049BB133111EB)
    return hashes ^ (hashes >> np.uint64(31))


def _new_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    pair = []
    for factor in (_POWER_OF, pow(_POWER_OF, -1, 1 << 64)):
        powers = np.full(n, factor, np.uint64)
        powers[:1] = 1
        pair.append(np.cumprod(powers, dtype=np.uint64))
    return pair[0], pair[1]


_UP, _DOWN = _new_powers(PIECE_BYTES + 4097)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers of an odd factor and of its inverse: what a place weighs in running sums of bytes."""
    return (_UP, _DOWN) if n <= len(_UP) else _new_powers(n)


#: Sums modulo 2^64 of powers of any odd factor meet on some pairs of long strings, whatever the bytes' values (those of
#: Thue and Morse). So strings are told apart by sums modulo a prime too, of a factor whose order no power of two divides.
_PRIME = (1 << 31) - 1
_PRIME_FACTOR = 7**5
_JOIN = np.uint64(0xD1342543DE82EF95)


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    pair = []
    for factor in (_PRIME_FACTOR, pow(_PRIME_FACTOR, -1, _PRIME)):
        held = np.ones(1, np.uint64)
        while len(held) < n:
            held = np.concatenate([held, held * np.uint64(pow(factor, len(held), _PRIME)) % np.uint64(_PRIME)])
        pair.append(held[:n])
    return pair[0], pair[1]


_PRIME_UP, _PRIME_DOWN = _prime_powers(PIECE_BYTES + 4097)


class Sums:
    """Running sums over values of bytes, for hashes of any strings among them."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self._down = powers(n + 1)
        self.plain = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:n], dtype=np.uint64)])
        prime_up, self._prime_down = (_PRIME_UP, _PRIME_DOWN) if n < len(_PRIME_UP) else _prime_powers(n + 1)
        part = (values >> np.uint64(33)) * prime_up[:n]
        part = (part & np.uint64(_PRIME)) + (part >> np.uint64(31))  # equal modulo the prime, and of 32 bits
        self.prime = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the strings from `begin` to `end`."""
        plain = (self.plain[end] - self.plain[begin]) * self._down[begin]
        prime = (self.prime[end] - self.prime[begin]) % np.uint64(_PRIME) * self._prime_down[begin] % np.uint64(_PRIME)
        return mixed(plain ^ mixed(prime * _JOIN))


def word_hashes(data: np.ndarray, starts: np.ndarray, of_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts laid end to end, and where each text's begin (one more for the end).

    `of_byte` has a value for each byte that stands in words, 0 for those between words. Long data are taken in pieces
    that end between words.
    """
    hashes, counts = [], np.zeros(len(starts), np.int64)
    values = of_byte[data]
    inside = values != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = starts[:-1][np.diff(starts) > 0]
    begins[edges] = inside[edges]  # a text's first byte starts a word of its own
    first = 0
    while first < len(data):
        last = min(len(data), first + PIECE_BYTES)
        if last < len(data):  # a piece ends before a word or a gap
            cuts = np.flatnonzero(begins[first + 1 : last + 1] | ~inside[first + 1 : last + 1])
            if len(cuts):
                last = first + 1 + int(cuts[-1])
            else:
                beyond = np.flatnonzero(begins[last:] | ~inside[last:])
                last = last + int(beyond[0]) if len(beyond) else len(data)
        begin = np.flatnonzero(begins[first:last])
        if len(begin):
            # Gaps add nothing, so a word's sum reaches up to the next word.
            end = np.concatenate([begin[1:], [last - first]])
            hashes.append(Sums(values[first:last]).of(begin, end))
            np.add.at(counts, np.searchsorted(starts, first + begin, side="right"), 1)
        first = last
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.cumsum(counts)


def byte_values(between: set[int], lower: bool = True, seed: int = 1) -> np.ndarray:
    """Values for `word_hashes`: odd random ones, 0 for the bytes `between` words, equal for A-Z and a-z if `lower`."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    values[sorted(between)] = 0
    return values
