"""Importance resampling towards a target: documents drawn by how much their words are like those of a target corpus.

Features are the runs of 1 and 2 words of a text, hashed into buckets; a bucket's gain is the logarithm of its share in
the target over its share in the documents, and a document's weight the floored mean of the gains of its features. With
noise that its id fixes (Gumbel), the highest scores are a draw without replacement by weight.

Weights are made from arrays: distinct words of a piece of a column are hashed, pairs by joining the checksums of their
words, and gains are looked up and summed for whole pieces. Tables in between are of fixed size: counts and gains have a
row for each bucket.

The cutoff is found by bracketing: a quantile sketch of the scores tells two values between which it should be; exact
counts above and within them say whether it is, and widen the bracket where it is not. A bracket of few rows is sorted
for the cutoff; a larger one is bracketed again; rows that all tie are bracketed by id. Drawn rows are ranked by ranges:
sorted pieces, each with the sizes of those before it.

Null texts have no words; texts without features weigh 0. Null ids draw their noise as an empty text, and come last in
ties. Repeated rows are documents of their own, in any order among themselves, being equal. Very long texts are taken in
pieces. Empty tables give no rows, or gains against no features. Columns beyond the named ones are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import written
from pagemill.llm.terms import word_pieces

BUCKETS = 10_000
#: Rows of a bracket that are sorted in one task, and the error of a sketch as a part of all its rows.
SORTED_ROWS = 100_000
ACCURACY = 5_000
#: Second words of a pair up to this length are joined by tables, longer ones byte by byte.
JOINED_BYTES = 64


def _shifts() -> np.ndarray:
    """What a CRC-32 becomes when `n` zero bytes follow, as four tables for its bytes; joins are linear in both parts."""
    byte = np.arange(256, dtype=np.uint32)
    one = byte.copy()
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    out = np.zeros((JOINED_BYTES + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = byte << np.uint32(8 * k)
    for n in range(JOINED_BYTES):
        out[n + 1] = one[out[n] & np.uint32(0xFF)] ^ (out[n] >> np.uint32(8))
    return out.ravel()


_SHIFTS = _shifts()


def joined(before: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of strings end to end, from that of the first, and that and the length of the second."""
    at = np.minimum(length, JOINED_BYTES).astype(np.int64) * 1024
    for k in range(4):
        after = after ^ _SHIFTS[at + 256 * k + ((before >> np.uint32(8 * k)) & np.uint32(0xFF))]
    return after


def feature_pieces(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a column: the rows of their words, and the row and bucket of each run of one or two words."""
    row_before, word_before = -1, b""
    for rows, words in word_pieces(texts):
        coded = words.dictionary_encode()
        index, known = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        plain = np.array([zlib.crc32(w) for w in known], np.uint32)
        spaced = np.array([zlib.crc32(b" ", c) for c in plain.tolist()], np.uint32)
        sizes = np.array([len(w) for w in known])
        one, two = index[:-1], index[1:]
        same = rows[:-1] == rows[1:]
        one, two = one[same], two[same]
        pairs = joined(spaced[one], plain[two], sizes[two])
        for k in np.flatnonzero(sizes[two] > JOINED_BYTES).tolist():
            pairs[k] = zlib.crc32(known[two[k]], int(spaced[one[k]]))
        first = np.zeros(0, np.uint32)
        if rows[0] == row_before:  # the pair that a cut between pieces parted
            first = np.array([zlib.crc32(word_before + b" " + known[index[0]])], np.uint32)
        hashes = np.concatenate([plain[index], first, pairs])
        yield rows, np.concatenate([rows, rows[: len(first)], rows[1:][same]]), (hashes % np.uint32(buckets)).astype(np.int64)
        row_before, word_before = int(rows[-1]), known[index[-1]]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """`bucket`, `n`: how many features of all texts fall into it; a task gives a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, at in feature_pieces(batch["text"], buckets):
                counts += np.bincount(at, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, thousandths of natural logarithms: a list of fixed length."""
    both = []
    for texts in (documents, target):
        counts = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(texts, buckets).collect():  # `buckets` rows at most
            counts[bucket] = n
        both.append(counts)
    (own, all_own), (wanted, all_wanted) = ((c.astype(np.float64), float(c.sum())) for c in both)
    return np.floor(1000 * np.log((wanted + 1) * (all_own + buckets) / ((own + 1) * (all_wanted + buckets)))).astype(np.int64)


def weights(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """Per document (`doc_id`, `text`): `doc_id`, `n_words`, `n_features` and `weight`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, total = (np.zeros(n, np.int64) for _ in range(3))
            for rows, of, at in feature_pieces(batch["text"], len(gain)):
                n_words += np.bincount(rows, minlength=n)
                n_features += np.bincount(of, minlength=n)
                total += np.bincount(of, gain[at], n).astype(np.int64)  # sums of a piece are exact in doubles
            weight = total // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    schema = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable that the id fixes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    part = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(part)))


def nth(rows: DataFrame, value: str, n: int, of: int, sorted_rows: int = SORTED_ROWS) -> tuple[int, int]:
    """The `n`-th least of the whole numbers `value` of `of` rows, 1 <= n <= of, and how many rows are less."""
    less, own = 0, F.col(value)  # rows below all that are looked at
    while of > sorted_rows:
        margin = 2 / ACCURACY
        while True:
            if margin < 1:
                at = [min(1.0, max(0.0, (n - less) / of + side)) for side in (-margin, margin)]
                low, high = rows.agg(F.percentile_approx(value, at, ACCURACY)).first()[0]
            else:
                low, high = rows.agg(F.min(value), F.max(value)).first()
            counted = [own < low, own == low, (own > low) & (own < high), (own == high) & (own > low)]
            below, at_low, within, at_high = rows.agg(*map(F.count_if, counted)).first()
            place = n - less - below
            if 0 < place <= at_low + within + at_high:
                break
            margin *= 4
        less += below
        if place <= at_low:
            return low, less
        if place > at_low + within:
            return high, less + at_low + within
        rows, less, of = rows.filter(counted[2]), less + at_low, within
    for found, count in rows.groupBy(value).count().orderBy(value).collect():  # `sorted_rows` at most
        if less + count >= n:
            return found, less
        less += count
    raise ValueError(f"{n} is not among the rows")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` with `rank` from 1 in `order`: ranges of rows are sorted and each starts where those before it end."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits of the place in it
    parts = written(parts.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND((1 << 33) - 1)}), "ranges")
    before, total = {}, 0
    for part, n in sorted(parts.groupBy("_part").count().collect()):  # a row for each partition
        before[part], total = total, total + n
    start = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in before.items() for x in pair]), F.col("_part")) if before else F.lit(0)
    return parts.withColumn("rank", (start + F.col("_at") + 1).cast("bigint")).drop("_part", "_at")


def resampled(documents: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """Per document (`doc_id`, `text`) against a target (`text`): `doc_id`, `n_features`, `weight`, `score`, `rank`.

    Of the N documents with at least `min_words` words, the floor(percent * N / 100) of the highest scores are drawn and
    ranked from 1, ties to smaller ids; the others have no rank.
    """
    scored = weights(documents, gains(documents, target, buckets))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored, "scores")
    out = ["doc_id", "n_features", "weight", "score"]
    fit = F.col("n_words") >= min_words
    # As a number to order by, a missing id is the largest.
    keyed = scored.withColumns({"_down": -F.col("score"), "_id": F.coalesce("doc_id", F.lit((1 << 63) - 1))})
    able = keyed.filter(fit).select("_down", "_id")
    n = able.count()
    drawn = percent * n // 100
    if not drawn:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    cut, less = nth(able, "_down", drawn, n)
    tied = able.filter(F.col("_down") == cut)
    last, _ = nth(tied, "_id", drawn - less, tied.count())
    ahead = fit & ((F.col("_down") < cut) | ((F.col("_down") == cut) & (F.col("_id") <= last)))
    best = ranked(keyed.filter(ahead), [F.col("_down"), F.col("_id")]).select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return best.unionByName(keyed.filter(~ahead).select(*out, F.lit(None).cast("bigint").alias("rank")))
