"""Language identification by nearest centroids.

A text is the TF-IDF vector of its hashed byte n-grams (two and three bytes, lower case, everything but letters a gap),
of length one. Each language has several centroids, found by clustering its sample by cosine. A text has the language
of the nearest centroid. One that is farther from it than nearly all texts of the sample, and cuts of them, that have
about as many n-grams, less a margin, is rejected, unless it is too short to tell. So long texts have a tight bound, and
short ones, which are far from every centroid, a loose one. No language has a tighter bound than all together: its own
sample may lack odd texts.

`fit` draws a bounded sample for each language by the hash of doc_id and counts n-grams in Spark; the driver gets a
vector of `DIMS` floats and a few short cuts of each sampled text. The model has a fixed size for each language. `identify` looks at whole
texts, in pieces, and shuffles nothing.

Null texts and texts without a letter are `und` with score 0 and rejected. Equally near languages: the first in order.
Repeated rows get equal answers. An empty sample makes every text `und`. Columns of the same names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagemill.llm.common import packed, slices, string_bytes

UNKNOWN = "und"
DIMS = 4096
#: Labelled texts of each language that the model is fitted on, and its centroids.
SAMPLE = 300
CENTROIDS = 3
ROUNDS = 12
#: Of a language's texts and cuts of one length, the share that may be farther than the bound, and the part of that
#: bound that is enough. A bound is of so many of them that the share is at least one.
STRAYS = 0.005
MARGIN = 0.75
LEAST = 200
#: Bytes of the cuts, and how many places of a text they begin at.
CUTS = (16, 32, 64, 128, 256, 512, 1024, 2048)
PLACES = 4
#: Bounds are at powers of two, up to so many n-grams.
MOST_LOG = 24
#: N-grams that a text needs to be rejected for its distance: those of the shortest cuts, about.
ENOUGH = 32
CHUNK_BYTES = 1 << 20
#: Rows of a chunk: a vector each.
CHUNK_ROWS = 512

#: Bytes as n-grams see them: digits, marks and control characters are one gap.
_SEEN = np.arange(256, dtype=np.uint32)
_SEEN[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]


def gram_counts(texts: pa.Array, dims: int = DIMS) -> np.ndarray:
    """Hashed n-grams of whole texts: a row of counts each."""
    data, starts = string_bytes(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    rows, counts = len(texts), np.zeros(len(texts) * dims, np.float32)
    for first in range(0, len(data), CHUNK_BYTES):  # a piece and the two bytes after it
        seen = _SEEN[data[first : first + CHUNK_BYTES + 2]]
        n = min(CHUNK_BYTES, len(data) - first)
        row = np.searchsorted(starts, np.arange(first, first + n), side="right") - 1
        left = starts[row + 1] - np.arange(first, first + n)  # bytes up to the end of the text
        for size in (2, 3):
            at = np.flatnonzero(left >= size)
            gram = seen[at] | seen[at + 1] << np.uint32(8)
            if size == 3:
                gram = gram | seen[at + 2] << np.uint32(16)
            gap = gram == (0x2020 if size == 2 else 0x202020)
            slot = (gram + np.uint32(size)) * np.uint32(2654435761) >> np.uint32(32 - int(dims).bit_length() + 1)
            low, high = row[0], row[-1] + 1
            part = np.bincount((row[at] - low)[~gap] * dims + slot[~gap].astype(np.int64), minlength=(high - low) * dims)
            counts[low * dims : high * dims] += part
    return counts.reshape(rows, dims)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one; rows without n-grams stay zero."""
    weighted = np.log1p(counts) * idf
    size = np.linalg.norm(weighted, axis=1, keepdims=True)
    return weighted / np.where(size == 0, 1, size)


class Model(NamedTuple):
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    bounds: np.ndarray  # least cosine to each centroid of texts of 1, 2, 4, ... n-grams
    idf: np.ndarray


def cluster(rows: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one and each row's own."""
    rng = np.random.default_rng(seed)
    picks = [int(rng.integers(len(rows)))]
    while len(picks) < min(k, len(rows)):  # far from those there are
        near = (rows @ rows[picks].T).max(axis=1)
        picks.append(int(near.argmin()))
    centroids = rows[picks].copy()
    for _ in range(ROUNDS):
        own = (rows @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.where(size == 0, 1, size), centroids)
    return centroids, (rows @ centroids.T).argmax(axis=1)


def pieces(text: bytes) -> list[bytes]:
    """What the cuts of a text begin."""
    return [text[at : at + CUTS[-1]] for at in (len(text) * place // PLACES for place in range(PLACES))]


def cut_counts(parts: list[bytes]) -> Iterator[np.ndarray]:
    """N-grams of all cuts of pieces, some rows at a time."""
    cuts = [part[:size].decode(errors="ignore") for part in parts for size in CUTS if len(part) >= size]
    for first in range(0, len(cuts), CHUNK_ROWS):
        yield gram_counts(pa.array(cuts[first : first + CHUNK_ROWS], pa.string()))


def bounds_by_length(sizes: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The bounds for 1, 2, 4, ... n-grams from those of texts: a quantile for each doubling of length, or for some
    together that have `LEAST` texts; between them a straight line."""
    order = np.argsort(sizes, kind="stable")
    logs, cosines = np.log2(np.maximum(sizes[order], 1)), cosines[order]
    starts = np.searchsorted(np.floor(logs), np.arange(MOST_LOG + 1))
    edges = [0]
    for start in starts.tolist():
        if start - edges[-1] >= LEAST and len(logs) - start >= LEAST:
            edges.append(start)
    groups = list(zip(edges, [*edges[1:], len(logs)], strict=True))
    low = [MARGIN * np.quantile(cosines[a:b], STRAYS, method="lower") for a, b in groups]
    return np.interp(np.arange(MOST_LOG + 1), [np.median(logs[a:b]) for a, b in groups], low)


def fit_rows(labels: list[str], counts: np.ndarray, parts: list[list[bytes]], k: int = CENTROIDS) -> Model:
    """The model of sampled texts, given by their n-grams and pieces."""
    if not labels:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros((0, MOST_LOG + 1)), np.zeros(DIMS, np.float32))
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    rows, label = vectors(counts, idf), np.array(labels)
    languages, centroids, sizes, cosines, bounds = [], [], [], [], []
    for seed, language in enumerate(sorted(set(labels))):
        own_rows = rows[label == language]
        found, own = cluster(own_rows, k, seed)
        own_sizes, own_cosines = [counts[label == language].sum(axis=1)], [(own_rows * found[own]).sum(axis=1)]
        for cut in cut_counts([part for one, of in zip(parts, labels, strict=True) if of == language for part in one]):
            seen = cut.any(axis=1)
            own_sizes.append(cut[seen].sum(axis=1))
            own_cosines.append((vectors(cut[seen], idf) @ found.T).max(axis=1))
        languages += [language] * len(found)
        centroids.append(found)
        sizes.append(np.concatenate(own_sizes))
        cosines.append(np.concatenate(own_cosines))
        bounds += [bounds_by_length(sizes[-1], cosines[-1])] * len(found)
    together = bounds_by_length(np.concatenate(sizes), np.concatenate(cosines))
    return Model(languages, np.concatenate(centroids).astype(np.float32), np.minimum(bounds, together), idf)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(documents: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Learns from `text` and `lang` of labelled documents; `doc_id` only draws the sample."""
    known = documents.filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
    order = F.xxhash64("doc_id", "text")
    # One row for each language comes back: the share of it that surely holds the sample.
    shares = {r["lang"]: min(1.0, 3 * sample / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return fit_rows([], np.zeros((0, DIMS), np.float32), [], k)
    share = F.coalesce(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")], F.lit(0.0))
    drawn = known.select("text", "lang", order.alias("_order")).filter(F.pmod("_order", F.lit(1 << 20)) < share * (1 << 20) + 1)
    first = Window.partitionBy("lang").orderBy("_order", "text")
    drawn = drawn.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= sample).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                one = batch["text"].slice(row, 1)
                parts = pa.array([pieces(string_bytes(one)[0].tobytes())], pa.list_(pa.binary()))
                columns = [batch["lang"].slice(row, 1), pa.array([gram_counts(one)[0].tobytes()]), parts]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "counts", "parts"])

    found = drawn.mapInArrow(count, "lang string, counts binary, parts array<binary>").collect()
    rows = sorted((r["lang"], bytes(r["counts"]), [bytes(part) for part in r["parts"]]) for r in found)
    counts = np.stack([np.frombuffer(row, np.float32) for _, row, _ in rows])
    return fit_rows([lang for lang, _, _ in rows], counts, [parts for _, _, parts in rows], k)


def nearest(model: Model, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's centroid, its cosine, and whether it is too far."""
    near = vectors(counts, model.idf) @ model.centroids.T
    best = near.argmax(axis=1)
    cosine = near[np.arange(len(near)), best].astype(np.float64)
    size = counts.sum(axis=1, dtype=np.float64)
    log = np.clip(np.log2(np.maximum(size, 1)), 0, MOST_LOG)
    low = np.minimum(log.astype(int), MOST_LOG - 1)
    bound = model.bounds[best, low] + (log - low) * (model.bounds[best, low + 1] - model.bounds[best, low])
    return best, np.clip(cosine, 0, 1), (cosine < bound) & (size >= ENOUGH)


PREDICTED = "struct<lang_pred: string, score: double, rejected: boolean>"


def identify(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Documents with `lang_pred`, `score` (cosine, 0 to 1) and `rejected`."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # of a size that fit() bounds

    @F.arrow_udf(PREDICTED)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own: Model = sent.value
        for batch in batches:
            names, scores, far = [], [], []
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
            sizes = np.maximum(sizes, CHUNK_BYTES // CHUNK_ROWS)
            for a, b in slices(sizes, CHUNK_BYTES):
                part = batch.slice(a, b - a)
                letters = pc.fill_null(pc.match_substring_regex(part, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if not own.languages:
                    letters = np.zeros(b - a, bool)
                    best, cosine, out = np.zeros(b - a, int), np.zeros(b - a), np.ones(b - a, bool)
                else:
                    best, cosine, out = nearest(own, gram_counts(part))
                names += [own.languages[k] if known else UNKNOWN for k, known in zip(best.tolist(), letters.tolist(), strict=True)]
                scores.append(np.where(letters, cosine, 0.0))
                far.append(out | ~letters)
            joined = [np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((scores, float), (far, bool))]
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(joined[0]), pa.array(joined[1])], ["lang_pred", "score", "rejected"]
            )

    row = F.col("row")
    found = packed(documents).select("row", predict(row[text]).alias("found"))
    kept = [row[c].alias(c) for c in documents.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    return found.select(*kept, "found.lang_pred", "found.score", "found.rejected")


def known(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Documents, all columns kept, that are not rejected."""
    rows = packed(documents)
    found = identify(rows.withColumn("sent", F.col("row")[text]), model, "sent")
    return found.filter(~F.col("rejected")).select("row.*")
