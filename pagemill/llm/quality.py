"""Quality scores: random-indexing word vectors, pooled per document, and a small calibrated network.

A token is a run of letters, of digits, or of other characters; it has one of `BUCKETS` places by its hash. Each place
has a random sparse index vector; a place's word vector is the sum of the index vectors of its neighbours in the
sample's texts, weighted down for frequent places. A document is the mean of its tokens' vectors with its length and
repetition; a two-layer network in numpy gives the odds, and a temperature fitted on texts that it was not trained on
makes probabilities of them.

`fit` draws a bounded sample of labels by the hash of doc_id. Tasks sum up neighbours into a matrix of fixed size and
pool the sampled texts; the driver gets `PARTS` such matrices and a vector for each text, and trains. `score` looks at
whole texts in pieces and shuffles nothing.

Null, empty and blank texts are a document without tokens and get the network's answer for that. Several labels of a
document: the highest counts. Repeated documents each count. With one label value only, or none, every score is the
(smoothed) share of label 1. Columns of the same names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import powers, slices, string_bytes, written

#: Labelled documents that the model is fitted on.
SAMPLE = 4000
BUCKETS = 1 << 15
DIMS = 64
NONZERO = 8
REACH = 2
PARTS = 4
CHUNK_BYTES = 1 << 18
HIDDEN = 32
EPOCHS = 400
EXTRA = 3
THRESHOLD = 0.7

_BLANK, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.array(
    [_LETTER if b >= 128 or chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _BLANK if b <= 32 or b == 127 else _OTHER for b in range(256)], np.uint8
)
_FACTOR = 0x9E3779B97F4A7C15 | 1


def _bounds(kind: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of texts laid end to end: whole texts, or parts of a long one that end between tokens."""
    for a, b in slices(np.diff(starts), CHUNK_BYTES):
        first, stop = int(starts[a]), int(starts[b])
        while first < stop:
            last = min(stop, first + CHUNK_BYTES)
            if last < stop:
                ends = np.flatnonzero(kind[first + 1 : last + 1] != kind[first:last])
                if len(ends):
                    last = first + 1 + int(ends[-1])
                else:  # a token longer than a piece
                    beyond = np.flatnonzero(kind[last + 1 : stop] != kind[last : stop - 1])
                    last = last + 1 + int(beyond[0]) if len(beyond) else stop
            yield first, last
            first = last


def _runs(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of texts laid end to end: pieces of (bucket, row). Pieces cut no token, and a text's do not depend on the
    texts around it."""
    kind = _KIND[data]
    for first, last in _bounds(kind, starts):
        own, n = kind[first:last], last - first
        row = np.searchsorted(starts, np.arange(first, last), side="right") - 1
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])])
        begin = np.flatnonzero(fresh)
        end = np.concatenate([begin[1:], [n]])
        keep = own[begin] != _BLANK
        begin, end = begin[keep], end[keep]
        # Hash of a run: a difference of running sums, moved to the same power for every place.
        up, down = powers(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
        hashed = (sums[end] - sums[begin]) * down[begin]
        hashed ^= hashed >> np.uint64(29)
        yield (hashed * np.uint64(_FACTOR) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), row[begin]


def index_vectors() -> np.ndarray:
    """A few +1 and -1 at random places for each bucket."""
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    places = rng.random((BUCKETS, DIMS)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    out[np.arange(BUCKETS)[:, None], places] = rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))
    return out


def neighbour_sums(texts: pa.Array, index: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds the index vectors of each token's neighbours in its text to its bucket's sums."""
    before = np.zeros((2, 0), np.int64)  # the last tokens of the piece before, which those of this one may be near
    for bucket, row in _runs(*string_bytes(texts)):
        counts += np.bincount(bucket, minlength=BUCKETS)
        held = before.shape[1]
        bucket, row = both = np.concatenate([before, [bucket, row]], axis=1)
        before = both[:, -REACH:]
        for reach in range(1, REACH + 1):
            near = (row[reach:] == row[:-reach]) & (np.arange(reach, max(reach, len(row))) >= held)
            for one, other in ((bucket[reach:][near], bucket[:-reach][near]), (bucket[:-reach][near], bucket[reach:][near])):
                order = np.argsort(one, kind="stable")
                where, first = np.unique(one[order], return_index=True)
                if len(where):
                    sums[where] += np.add.reduceat(index[other[order]], first, axis=0)


class Model(NamedTuple):
    words: np.ndarray  # a row for each bucket, and its weight in the last column
    layers: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    temperature: float
    share: float


def word_vectors(index: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Directions of the sums; buckets that the sample lacks have their index vector."""
    rows = np.where(counts[:, None] > 0, sums + index, index)
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    share = counts / max(1.0, counts.sum())
    weight = 1e-3 / (1e-3 + share)
    return np.concatenate([rows * weight[:, None], (counts > 0)[:, None]], axis=1).astype(np.float32)


def pooled(texts: pa.Array, words: np.ndarray) -> np.ndarray:
    """A row for each whole text: the mean of its tokens' vectors, how many are known, length, and bytes a token."""
    data, starts = string_bytes(texts)
    sums = np.zeros((len(texts), words.shape[1]), np.float64)
    tokens = np.zeros(len(texts))
    for bucket, row in _runs(data, starts):
        if len(row):
            where, first = np.unique(row, return_index=True)
            sums[where] += np.add.reduceat(words[bucket], first, axis=0)
            tokens[where] += np.diff([*first, len(row)])
    size = np.diff(starts)
    n = np.maximum(tokens, 1)[:, None]
    return np.concatenate([sums / n, np.log1p(tokens)[:, None], (size / n[:, 0])[:, None]], axis=1)


def logits(layers: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    a, b, c, d = layers
    return np.tanh(rows @ a + b) @ c + d


def train(rows: np.ndarray, labels: np.ndarray, seed: int = 11) -> list[np.ndarray]:
    """Two layers by Adam on the log loss, with weight decay."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 1 / np.sqrt(rows.shape[1]), (rows.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in layers]
    for epoch in range(1, EPOCHS + 1):
        hidden = np.tanh(rows @ layers[0] + layers[1])
        wrong = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -30, 30))) - labels) / len(rows)
        back = wrong[:, None] * layers[2] * (1 - hidden**2)
        grads = [rows.T @ back + 1e-3 * layers[0], back.sum(axis=0), hidden.T @ wrong + 1e-3 * layers[2], wrong.sum()]
        for k, (grad, (m, v)) in enumerate(zip(grads, moments, strict=True)):
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            moments[k] = (m, v)
            layers[k] = layers[k] - 0.01 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    return layers


def temperature(raw: np.ndarray, labels: np.ndarray) -> float:
    """What to divide odds by for the least log loss."""
    tried = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, np.where(labels > 0, -1, 1) * raw / t)) for t in tried]
    return float(tried[int(np.argmin(loss))])


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns `label` (0 or 1, by `doc_id`) from the `text` of documents."""
    known = labels.filter(F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = written(documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").repartition(PARTS, "doc_id"), "quality-sample")
    index = index_vectors()

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((BUCKETS, DIMS), np.float32), np.zeros(BUCKETS, np.float32)
        for batch in batches:
            neighbour_sums(batch["text"], index, sums, counts)
        yield pa.RecordBatch.from_pydict({"sums": [sums.tobytes()], "counts": [counts.tobytes()]})

    sums, counts = np.zeros((BUCKETS, DIMS), np.float64), np.zeros(BUCKETS, np.float64)
    for part in texts.select("text").coalesce(PARTS).mapInArrow(sum_up, "sums binary, counts binary").collect():
        sums += np.frombuffer(part["sums"], np.float32).reshape(BUCKETS, DIMS)
        counts += np.frombuffer(part["counts"], np.float32)
    words = word_vectors(index, sums, counts)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row.tobytes() for row in pooled(batch["text"], words)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(rows, pa.binary())], ["doc_id", "label", "row"])

    found = sorted((bytes(r["row"]), r["label"]) for r in texts.coalesce(PARTS).mapInArrow(pool, "doc_id bigint, label int, row binary").collect())
    target = np.array([label for _, label in found], np.float64)
    share = float((target.sum() + 1) / (len(target) + 2))
    rows = np.array([np.frombuffer(row) for row, _ in found]).reshape(len(found), DIMS + EXTRA)
    if len(set(target.tolist())) < 2 or len(rows) < 20:
        return Model(words, [], np.zeros(DIMS + EXTRA), np.ones(DIMS + EXTRA), 1.0, share)
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    rows = (rows - mean) / spread
    aside = np.random.default_rng(3).random(len(rows)) < 0.2
    layers = train(rows[~aside], target[~aside])
    return Model(words, layers, mean, spread, temperature(logits(layers, rows[aside]), target[aside]), share)


def probabilities(model: Model, rows: np.ndarray) -> np.ndarray:
    if not model.layers:
        return np.full(len(rows), model.share)
    raw = logits(model.layers, (rows - model.mean) / model.spread) / model.temperature
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def score(documents: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Documents with the probability of label 1."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # 9 MB, whatever the corpus

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
            parts = [probabilities(sent.value, pooled(batch.slice(a, b - a), sent.value.words)) for a, b in slices(sizes, 8 * CHUNK_BYTES)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    return documents.withColumn(out, scored(F.col(text)))
