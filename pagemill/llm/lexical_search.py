"""Ranked lexical search: the documents that share the rarest terms with each of many items, by integer scores.

Blocks of documents are multiplied with blocks of items. A block of items has a compact vocabulary, the terms that occur
in it; its matrix holds each item's term weights, the matrix of a block of documents the impact of each term in each
document. Both are dense float64, so one BLAS call scores all items of a block on all documents of a block. Products
are whole numbers; columns are cut so that no partial sum reaches 2^53, and sums of the parts are 64-bit integers, so no
order of summation changes a score. From each block a row for each pair that reaches the item's bound is kept, ties
included, and the best k of a task go on to the ranking of all tasks.

Documents are read once for each group of items (`GROUP_TERMS` terms, so the usual benchmark is one group): a task gets
the group's vocabulary, which that number bounds, and leaves the counts of those terms in each document as a table,
from which the corpus' counts and then the scores are made.

Null and empty texts have no terms and no score. Items without terms have no rows. An item that occurs several times is
one item with the terms of all. Repeated documents are documents of their own; null ids come last among equal scores.
A very long text is taken in pieces; a very long item is a block of its own, against smaller blocks of documents. Empty
tables give no rows. Columns beyond the named ones are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import ascii_lower, written
from pagemill.llm.terms import Best, word_pieces

#: (item, term) rows of a group, which one scan of the documents serves, and items of a block.
GROUP_TERMS = 1 << 16
BLOCK_ITEMS = 128
#: Entries of a document block's matrix, and its documents at most.
BLOCK_ENTRIES, BLOCK_DOCUMENTS = 1 << 21, 512
#: Partial results of an item are first ranked in so many parts.
PARTS = 64
_EXACT = 1 << 53
#: Above any impact: (10^9 tf) div (1000 tf + 20 m) with m >= 50.
_IMPACT = 1_000_000
NO_ID = (1 << 63) - 1


def item_terms(items: DataFrame) -> DataFrame:
    """`item_id`, `term`: the distinct terms of each item (`item_id`, `text`)."""
    words = F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return items.select("item_id", F.explode(F.array_distinct(F.transform(words, ascii_lower))).alias("term")).filter("term <> ''").distinct()


def grouped(terms: DataFrame, most: int = GROUP_TERMS) -> tuple[DataFrame, int]:
    """`terms` with `part`, the group of the item, and the number of groups; none has more than `most` terms but one of
    a single item."""
    total, parts = terms.count(), 1
    while True:
        parts = max(parts, -(-total // most))
        dealt = terms.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
        sizes = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("item_id").eqNullSafe(F.max("item_id")).alias("one"))
        if parts > total or sizes.filter((F.col("n") > most) & ~F.col("one")).isEmpty():
            return dealt, parts
        parts *= 2


def term_counts(documents: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Per document with a term: `doc_id`, its terms `n` with repeats, and of those in the vocabulary their places
    `terms` and counts `tf`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = pa.array(vocabulary, pa.large_binary()), max(1, len(vocabulary))
        for batch in batches:
            n, keys, counts = np.zeros(batch.num_rows, np.int64), [], []
            for rows, words in word_pieces(batch["text"]):
                n += np.bincount(rows, minlength=len(n))
                place = pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False)
                key, count = np.unique((rows * size + place)[place >= 0], return_counts=True)
                keys.append(key)
                counts.append(count)
            key, at = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            tf = np.bincount(at, np.concatenate([np.zeros(0), *counts]), len(key)).astype(np.int64)
            offsets = pa.array(np.searchsorted(key // size, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((key % size).astype(np.int32), tf)]
            made = pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])
            yield made.filter(pa.array(n > 0))

    schema = "doc_id bigint, n bigint, terms array<int>, tf array<bigint>"
    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


class Block(NamedTuple):
    """Items `first` to `last` and their `terms`, weights in `matrix`, a column for each term."""

    first: int
    last: int
    terms: np.ndarray
    matrix: np.ndarray


def item_blocks(items: list[np.ndarray], weight: np.ndarray) -> list[Block]:
    """Blocks of items, each given as places of its terms in the vocabulary."""
    out, first = [], 0
    while first < len(items):
        last, held = first, 0
        while last < len(items) and (last == first or last - first < BLOCK_ITEMS and held + len(items[last]) <= BLOCK_ENTRIES // BLOCK_ITEMS):
            held += len(items[last])
            last += 1
        terms = np.unique(np.concatenate(items[first:last]))
        matrix = np.zeros((last - first, len(terms)))
        for k in range(first, last):
            matrix[k - first, np.searchsorted(terms, items[k])] = weight[items[k]]
        out.append(Block(first, last, terms, matrix))
        first = last
    return out


def exact_product(items: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Whole scores: weights (items, terms) times impacts (terms, documents) in parts whose sums stay below 2^53."""
    most = np.cumsum(items.max(axis=0, initial=0)) * _IMPACT
    out, first = np.zeros((len(items), documents.shape[1]), np.int64), 0
    while first < items.shape[1]:
        before = most[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(most, before + _EXACT)))
        out += (items[:, first:last] @ documents[first:last]).astype(np.int64)
        first = last
    return out


def lengths(n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """How long documents are for the mean one, in hundredths and half of it: 100 - 50 + (50 n N) div L."""
    if not len(n) or 50 * int(n.max()) * documents < 1 << 63:
        return 50 + 50 * n * documents // max(1, all_terms)
    return np.array([50 + 50 * x * documents // all_terms for x in n.tolist()], np.int64)


def scored(counts: DataFrame, blocks: list[Block], n_items: int, documents: int, all_terms: int, k: int) -> DataFrame:
    """`item`, `doc_id`, `score` and `part`: the best `k` of each task for each item."""

    def tiles(batch: pa.RecordBatch, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = batch["terms"].offsets.to_numpy()
        terms, tf = batch["terms"].values.to_numpy(), batch["tf"].values.to_numpy()
        m = lengths(batch["n"].to_numpy(), documents, all_terms)
        step = max(16, min(BLOCK_DOCUMENTS, BLOCK_ENTRIES // max(1, len(block.terms))))
        for first in range(0, batch.num_rows, step):
            last = min(batch.num_rows, first + step)
            own = slice(starts[first], starts[last])
            row = np.repeat(np.arange(last - first), np.diff(starts[first : last + 1]))
            at = np.minimum(np.searchsorted(block.terms, terms[own]), len(block.terms) - 1)
            held = block.terms[at] == terms[own]
            row, at, times = row[held], at[held], tf[own][held]
            present, at = np.unique(at, return_inverse=True)  # only terms that the tile has
            impact = np.zeros((len(present), last - first))
            impact[at, row] = 1_000_000_000 * times // (1000 * times + 20 * m[first:last][row])
            yield np.arange(first, last), exact_product(block.matrix[:, present], impact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_items, k, np.ones(n_items, np.int64))
        for batch in batches:
            ids = pc.fill_null(batch["doc_id"], NO_ID).to_numpy()
            for block in blocks:
                for rows, scores in tiles(batch, block):
                    item, place = np.nonzero(scores >= best.bound[block.first : block.last, None])
                    best.add(item + block.first, ids[rows[place]], scores[item, place])
        item, ids, score = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == NO_ID), pa.array(score)], ["item", "doc_id", "score"])

    found = counts.mapInArrow(run, "item bigint, doc_id bigint, score bigint")
    return found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))


def best_of(found: DataFrame, owner: str, k: int, order: list[Column]) -> DataFrame:
    """The first `k` rows of each `owner` with their `rank`, ranked in parts and then whole."""
    parts = found.withColumn("rank", F.row_number().over(Window.partitionBy(owner, "part").orderBy(*order)))
    whole = parts.filter(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy(*order)))
    return whole.filter(F.col("rank") <= k).drop("part")


def search(documents: DataFrame, items: DataFrame, k: int = 50, group_terms: int = GROUP_TERMS) -> DataFrame:
    """The `k` best documents (`doc_id`, `text`) of each item (`item_id`, `text`): `item_id`, `rank`, `doc_id`, `score`."""
    terms, parts = grouped(written(item_terms(items), "item-terms"), group_terms)
    kind = dict(terms.dtypes)["item_id"]
    out = None
    for part in range(parts):
        rows = terms.filter(F.col("part") == part).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()  # `group_terms` terms
        if not rows:
            continue
        words = sorted({t.encode() for r in rows for t in r["terms"]})
        place = {w: k for k, w in enumerate(words)}
        counts = written(term_counts(documents, words), "term-counts")
        n_documents, all_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(len(words), np.int64)
        holding = counts.select(F.explode("terms").alias("term")).groupBy("term").count()
        for term, df in holding.collect():  # a row for each word of the group
            weight[term] = math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))
        rows.sort(key=lambda r: (len(r["terms"]), str(r["item_id"])))
        blocks = item_blocks([np.array(sorted(place[t.encode()] for t in r["terms"])) for r in rows], weight)
        found = scored(counts, blocks, len(rows), n_documents, all_terms, k)
        ranked = best_of(found, "item", k, [F.desc("score"), F.asc_nulls_last("doc_id")])
        names = counts.sparkSession.createDataFrame([(n, r["item_id"]) for n, r in enumerate(rows)], f"item bigint, item_id {kind}")
        ranked = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return documents.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return out
