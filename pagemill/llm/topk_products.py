"""Exact top-k by inner product: for each asking vector the rows of the largest products, all rows considered.

Vectors become whole numbers, floor(scale * x). Rows are grouped by length into buckets at quantiles. A bound for each
asking vector comes first: its k-th best product with some of the longest rows. Divided by the vector's length it is the
length that a row must have, so a vector is sent only to buckets whose longest row has it. There, runs of rows of falling
length are gone through; the bound, divided by both lengths, is the cosine that a row of the run must reach (the local
threshold). Above one, the run and all after it are left out. The way of pruning a run is chosen by that threshold:
where it is high, by coordinates (a product is at most the part over some coordinates plus the product of the lengths
over the others), else by length (a row shorter than the bound needs is left out). What is left is verified: products are exact, in doubles where the lengths show that no sum reaches 2^53, in
64-bit integers below 2^62, else in Python's integers; a score beyond 64 bits is given as the nearest that fits.

A bucket's rows are dealt by hash into pieces of bounded size, and askers into blocks of bounded size, so a bucket that
holds all rows (vectors of one length) is as spread as any. A piece and a block meet in one task.

Vectors that are null or hold null or non-finite components (or such that are not finite times the scale) take no part,
nor do rows without an id. Only vectors of as many components are compared. Rows that repeat id and vector count once; no
row of the asker's own id is its candidate. An empty vector's products are 0. Empty tables give no rows. Columns beyond
the named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import written
from pagemill.llm.terms import Best

BUCKETS = 16
#: Bytes of rows of a piece, of askers of a block, and of the rows that give the first bounds; rows of a run.
PIECE_BYTES, BLOCK_BYTES, SEED_BYTES, RUN_ROWS = 32 << 20, 16 << 20, 2 << 20, 2048
#: Local thresholds from this on are pruned by coordinates, over this part of them.
COORDINATE_COSINE, COORDINATES = 0.5, 0.25
#: Askers at a time against a run.
ASKERS = 1024
#: What rounding can take from a bound, as a part of it.
SLACK = 1e-9
PARTS = 64
LEAST = -(1 << 63)
VECTOR = "vec_id bigint, dims int, vector array<double>, length double"


def whole_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """`vec_id`, `dims`, `vector`, `length`, and `asks` as it is, of rows (`vec_id`, `embedding`, `asks`) that take part."""
    given = rows.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("vector"), "asks")
    given = given.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: F.isnull(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch["vector"]
            dims = pc.list_value_length(vectors).to_numpy().astype(np.int32)
            flat = vectors.flatten().to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(flat * scale) + 0.0  # no negative zero
            row = np.repeat(np.arange(len(dims)), dims)
            finite = np.bincount(row, ~np.isfinite(flat), len(dims)) == 0
            most = np.zeros(len(dims))
            np.maximum.at(most, row, np.where(np.isfinite(flat), np.abs(flat), 0))
            part = flat / np.where(most > 0, most, 1)[row]
            with np.errstate(over="ignore", invalid="ignore"):
                length = np.minimum(most * np.sqrt(np.bincount(row, np.where(finite[row], part * part, 0), len(dims))), 1e308)
            offsets = np.concatenate([[0], np.cumsum(dims)]).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            columns = [batch["vec_id"], pa.array(dims), whole, pa.array(length), batch["asks"]]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dims", "vector", "length", "asks"]).filter(pa.array(finite))

    return given.mapInArrow(run, f"{VECTOR}, asks boolean").groupBy("vec_id", "dims", "vector", "length").agg(F.max("asks").alias("asks"))


def matrix(table: pa.Table, dims: int) -> np.ndarray:
    return pc.list_flatten(table["vector"].combine_chunks()).to_numpy().reshape(len(table), dims)


def products(asking: np.ndarray, rows: np.ndarray, pairs: bool = False) -> np.ndarray:
    """Exact inner products of whole numbers, of all askers with all rows or (`pairs`) of each asker with its row."""

    def longest(side: np.ndarray) -> float:
        return float(np.linalg.norm(side, axis=1).max(initial=0)) * (1 + SLACK)

    def multiplied(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return (one * other).sum(axis=1) if pairs else one @ other.T

    with np.errstate(over="ignore"):
        most = longest(asking) * longest(rows)  # no partial sum of either sign is larger
    if most < 1 << 53:
        return multiplied(asking, rows).astype(np.int64)
    if most < 1 << 62 and max(np.abs(asking).max(initial=0), np.abs(rows).max(initial=0)) < 1 << 62:
        return multiplied(asking.astype(np.int64), rows.astype(np.int64))
    exact = np.frompyfunc(int, 1, 1)
    found = multiplied(exact(asking), exact(rows)) if asking.shape[1] else np.zeros(len(asking) if pairs else (len(asking), len(rows)), object)
    return np.clip(found, LEAST, (1 << 63) - 1).astype(np.int64)


def needed(bound: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The length of a row without which its product with an asker of that length can't reach the bound."""
    return np.where((bound > 0) & (length > 0), bound / np.where(length > 0, length, 1) * (1 - SLACK), np.where(bound > 0, np.inf, 0))


def first_bounds(asking: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """`asking` with `bound`, the `k`-th best product with some of the longest rows, and the length `need` it leaves."""
    widest = rows.agg(F.max("dims")).first()[0] or 1
    longest = rows.select("vec_id", "dims", "vector").orderBy(F.desc("length"), "vec_id").limit(max(k + 1, SEED_BYTES // (8 * widest)))
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held = longest.toArrow()  # SEED_BYTES at most, or k + 1 rows
    for dims in pc.unique(held["dims"]).to_pylist():
        own = held.filter(pc.equal(held["dims"], dims))
        seeds[dims] = own["vec_id"].to_numpy(), matrix(own, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = np.full(batch.num_rows, LEAST, np.int64)
            all_dims, ids = batch["dims"].to_numpy(), batch["vec_id"].to_numpy()
            for dims, (seed_ids, seed) in seeds.items():
                for at in np.split(own := np.flatnonzero(all_dims == dims), range(ASKERS, len(own), ASKERS)):
                    if not len(at):
                        continue
                    found = products(matrix(pa.table(batch).take(at), dims), seed)
                    found[ids[at][:, None] == seed_ids] = LEAST
                    if found.shape[1] >= k:
                        bound[at] = np.partition(found, -k, axis=1)[:, -k]
            need = needed(bound.astype(np.float64), batch["length"].to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound), pa.array(need)], [*batch.schema.names, "bound", "need"])

    return asking.select("vec_id", "dims", "vector", "length").mapInArrow(run, f"{VECTOR}, bound bigint, need double")


def by_coordinates(asking: np.ndarray, rows: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs (asker, row) of vectors of length one whose cosine may reach the asker's; None if that is most of them."""
    energy = (asking * asking).sum(axis=0)
    some = np.argsort(-energy, kind="stable")[: max(1, int(asking.shape[1] * COORDINATES))]
    one, other = asking[:, some], rows[:, some]
    rest = [np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)) + SLACK) for x in (one, other)]
    may = one @ other.T + rest[0][:, None] * rest[1] >= cosine[:, None] - SLACK
    return None if 4 * np.count_nonzero(may) > may.size else np.nonzero(may)


def search(ids: np.ndarray, rows: np.ndarray, length: np.ndarray, asker_ids: np.ndarray, asking: np.ndarray, asker_length: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `k` best rows of each asker that reach its bound: asker's place, row's id, product."""
    order = np.argsort(-length, kind="stable")
    ids, rows, length = ids[order], rows[order], length[order]
    best = Best(len(asking), k, bound)
    for first in range(0, len(rows), RUN_ROWS):
        last = min(len(rows), first + RUN_ROWS)
        need = needed(best.bound.astype(np.float64), asker_length)
        open_ = np.flatnonzero(need <= length[first])
        if not len(open_):
            break  # rows only get shorter
        both = asker_length[open_] * length[first]
        local = np.where((best.bound[open_] > 0) & (both > 0), best.bound[open_] / np.where(both > 0, both, 1), -1.0) - SLACK
        high = (local >= COORDINATE_COSINE) & (asking.shape[1] > 1)
        run = rows[first:last]
        units = run / np.where(length[first:last] > 0, length[first:last], 1)[:, None] if high.any() else run
        for which in (high, ~high):
            for part in np.split(at := np.flatnonzero(which), range(ASKERS, len(at), ASKERS)):
                own, pairs = open_[part], None
                if len(own) and which is high:
                    pairs = by_coordinates(asking[own] / asker_length[own][:, None], units, local[part])
                if pairs is None:  # rows long enough for one of the askers
                    end = int(np.searchsorted(-length[first:last], -need[own].min(initial=np.inf), side="right"))
                    found = products(asking[own], run[:end])
                    asker, row = np.nonzero(found >= best.bound[own][:, None])
                    found = found[asker, row]
                else:
                    asker, row = pairs
                    found = products(asking[own[asker]], run[row], pairs=True)
                asker, row = own[asker], first + row
                kept = (found >= best.bound[asker]) & (ids[row] != asker_ids[asker])
                best.add(asker[kept], ids[row[kept]], found[kept])
        best.settle()
    return best.settle()


def quantile_edges(rows: DataFrame, buckets: int) -> list[float]:
    at = [k / buckets for k in range(1, buckets)]
    return sorted(set(rows.agg(F.percentile_approx("length", at, 1000)).first()[0] or []))


def pieces_of(total: int, most: int, least: int) -> int:
    """Pieces of `most` bytes at most; of small tables some more, for all cores."""
    return max(1, -(-total // most), min(least, total >> 20))


def top_products(rows: DataFrame, asks: Column, k: int = 10, scale: int = 1024, piece_bytes: int = PIECE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For rows (`vec_id`, `embedding`) that `asks` picks: `query_id`, `rank`, `vec_id`, `score` of the `k` best others."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows.withColumn("asks", F.coalesce(asks, F.lit(False))), scale)
    vectors = written(vectors, "vectors")
    asking = written(first_bounds(vectors.filter("asks"), vectors, k), "askers")

    # Buckets by length: a bucket's number is how many edges are below; 16 rows tell their sizes and longest rows.
    edges = quantile_edges(vectors, BUCKETS)
    bucket = sum((F.when(F.col("length") > edge, 1).otherwise(0) for edge in edges), F.lit(0))
    held = vectors.select("vec_id", "dims", "vector", "length", bucket.alias("bucket"))
    size = F.sum(8 * F.col("dims") + 8)
    known = {b: (n, most) for b, n, most in held.groupBy("bucket").agg(size, F.max("length")).collect()}
    blocks = pieces_of(asking.agg(size).first()[0] or 0, block_bytes, 1)
    pieces = {b: pieces_of(n, piece_bytes, spark.sparkContext.defaultParallelism) for b, (n, _) in known.items()}
    if not pieces:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    hashed = F.xxhash64("vec_id", "vector")
    count = F.element_at(F.create_map(*[F.lit(x) for pair in pieces.items() for x in pair]), F.col("bucket"))
    dealt = held.withColumns({"piece": F.pmod(hashed, count), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    # An asker goes to the pieces of the buckets that have rows as long as it needs.
    places = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(p).cast("bigint").alias("piece"), F.lit(known[b][1]).alias("most")) for b, n in pieces.items() for p in range(n)])
    sent = asking.withColumns({"block": F.pmod(hashed, F.lit(blocks)).cast("int"), "at": F.explode(places)})
    sent = sent.filter(F.col("need") <= F.col("at.most")).select("*", "at.bucket", "at.piece").drop("at", "need")
    names = ["query_id", "vec_id", "score"]

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in names]
        for dims in pc.unique(other["dims"]).to_pylist():
            near, mine = (t.filter(pc.equal(t["dims"], dims)) for t in (one, other))
            if not len(near):
                continue
            asker_ids = mine["vec_id"].to_numpy()
            asker, ids, score = search(near["vec_id"].to_numpy(), matrix(near, dims), near["length"].to_numpy(), asker_ids, matrix(mine, dims), mine["length"].to_numpy(), mine["bound"].to_numpy(), k)
            for held_, x in zip(out, (asker_ids[asker], ids, score), strict=True):
                held_.append(x)
        return pa.table([pa.array(np.concatenate(x)) for x in out], names)

    key = ["bucket", "piece", "block"]
    found = dealt.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    found = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    order = [F.desc("score"), F.asc("vec_id")]
    parts = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order)))
    whole = parts.filter(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return whole.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
