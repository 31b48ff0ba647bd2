"""Nearest neighbours by cosine: a vantage-point tree per shard of the vectors.

Vectors of length one have a metric, their distance, that orders like the cosine. A row goes to the shard of the nearest
of some pivots, rows of a bounded sample; a pivot with many rows has several shards, dealt by hash. Each shard becomes a
tree: a node splits its points at the median distance from a vantage point. A search descends with a block of queries at
once and leaves out what the triangle inequality rules out.

A query first searches the shard that it is in itself, which gives a distance to beat. It is sent on only to shards that
may hold something as near: those whose pivot is no farther than that distance and the farthest row of the pivot. Where
distances tell little, as among random vectors of many dimensions, that is most of them. `relax` above 1 shrinks the
distance to beat, in shards and between them, and so leaves out more; 1 searches exactly.

Shards, pivots and the queries that a tree is asked at once have a bounded number of rows, whatever the input. The
nearest of all shards are the answer. Distances only choose: the score is the cosine of the original vectors, summed up
in order in double precision, and ties at the last place are looked at whole, so equal vectors rank by their id.

Rows without id, and vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of
another length than the query's are not its candidates. A row that occurs twice counts once; rows with the query's id
are its own. With fewer candidates than asked for, all are given. An empty table gives no rows. Columns beyond the named
ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagemill.llm.common import written

SHARD_ROWS = 4096
#: Bytes of pivots, which every task gets, and queries that a tree is asked at once.
PIVOT_BYTES = 4 << 20
BLOCK_ROWS = 1 << 16
LEAF = 64
#: Distances that rounding may tell apart.
ROUNDING = 1e-7


def usable(vectors: DataFrame) -> DataFrame:
    """`vec_id` and `embedding` (doubles) of the rows that take part, each once."""
    whole = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("embedding"))

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad)
    return rows.filter(fine & F.exists("embedding", lambda x: x != 0)).dropDuplicates()


class Node(NamedTuple):
    first: int  # rows in tree order
    last: int
    vantage: int = -1  # a row, at `first`; -1: a leaf
    radius: float = 0.0
    inner: int = -1
    outer: int = -1


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, without overflow for huge components."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distances(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (one @ other.T)))


def build(rows: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[Node]]:
    """The order of rows in the tree, and its nodes; the first is the root. Each point is below one child only."""
    order, nodes = np.arange(len(rows)), [Node(0, len(rows))]
    todo = [0]
    while todo:
        k = todo.pop()
        first, last = nodes[k].first, nodes[k].last
        if last - first <= leaf:
            continue
        # The point farthest from the node's middle is a good place to look from.
        own = order[first:last]
        far = int(distances(unit_mean(rows[own]), rows[own])[0].argmax())
        own[[0, far]] = own[[far, 0]]
        away = distances(rows[own[:1]], rows[own[1:]])[0]
        by = np.argsort(away, kind="stable")
        order[first + 1 : last] = own[1:][by]
        half = len(by) // 2
        nodes[k] = Node(first, last, first, float(away[by[half - 1]]), len(nodes), len(nodes) + 1)
        nodes += [Node(first + 1, first + 1 + half), Node(first + 1 + half, last)]
        todo += [nodes[k].inner, nodes[k].outer]
    return order, nodes


def unit_mean(rows: np.ndarray) -> np.ndarray:
    middle = rows.mean(axis=0, keepdims=True)
    size = np.linalg.norm(middle)
    return middle / size if size > 0 else rows[:1]


def cosines(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, every sum taken in order."""
    dot, a, b = (np.cumsum(x, axis=1)[:, -1] for x in (one * other, one * one, other * other))
    return dot / (np.sqrt(a) * np.sqrt(b))


class Tree(NamedTuple):
    ids: np.ndarray
    rows: np.ndarray  # original vectors in tree order
    units: np.ndarray
    nodes: list[Node]


def plant(ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
    units = unit(rows)
    order, nodes = build(units, leaf)
    return Tree(ids[order], rows[order], units[order], nodes)


def search(
    tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float = 1.0, beat: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the k nearest rows of each query: query's place, row's place, cosine; all of them if there are fewer.
    Those farther than a distance to `beat` may be left out."""
    units = unit(queries)
    best = np.full((len(queries), k), np.inf)  # nearest distances so far, sorted

    def near(asked: np.ndarray, first: int, last: int) -> np.ndarray:
        found = distances(units[asked], tree.units[first:last])
        found[query_ids[asked][:, None] == tree.ids[None, first:last]] = np.inf
        return found

    def learn(asked: np.ndarray, first: int, last: int) -> None:
        best[asked] = np.sort(np.concatenate([best[asked], near(asked, first, last)], axis=1), axis=1)[:, :k]

    def walk(visit, sides) -> None:
        todo = [(0, np.arange(len(queries)))]
        while todo:
            at, asked = todo.pop()
            if not len(asked):
                continue
            node = tree.nodes[at]
            if node.vantage < 0:
                visit(asked, node.first, node.last)
                continue
            visit(asked, node.first, node.first + 1)
            away = distances(units[asked], tree.units[node.first : node.first + 1])[:, 0]
            inner, outer = sides(away, node.radius, asked)
            todo += [(node.outer, asked[outer]), (node.inner, asked[inner])]

    # First each query's own leaf, for a distance to beat; then everything that may beat it.
    walk(learn, lambda away, radius, asked: (away <= radius, away > radius))
    best += 2 * ROUNDING
    reach = best[:, -1].copy()
    if beat is not None:
        reach = np.minimum(reach, beat + 2 * ROUNDING)
    best[:] = np.inf

    def sides(away: np.ndarray, radius: float, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        beat = np.minimum(reach[asked], best[asked, -1] + 2 * ROUNDING) / relax
        return away - radius <= beat + ROUNDING, radius - away <= beat + ROUNDING

    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def gather(asked: np.ndarray, first: int, last: int) -> None:
        found = near(asked, first, last)
        best[asked] = np.sort(np.concatenate([best[asked], found], axis=1), axis=1)[:, :k]
        mine = found <= np.minimum(reach[asked], best[asked, -1] + 2 * ROUNDING)[:, None]
        q, row = np.nonzero(mine & np.isfinite(found))
        q, row = asked[q], row + first
        pairs.append((q, row, cosines(queries[q], tree.rows[row])))
        if sum(len(p[0]) for p in pairs) > 1 << 18:
            pairs[:] = [_nearest(pairs, tree.ids, k)]

    walk(gather, sides)
    return _nearest(pairs, tree.ids, k)


def _nearest(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, row, score = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(zip(*pairs, strict=True), (int, int, float), strict=True)) if pairs else (np.zeros(0, int),) * 3
    order = np.lexsort((ids[row], -score, q))
    q, row, score = q[order], row[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], row[place < k], score[place < k]


class Pivots(NamedTuple):
    """Pivots of each number of dimensions: their numbers and units."""

    of: dict[int, tuple[np.ndarray, np.ndarray]]

    def distances(self, dims: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pivots of `dims`, and the distances of all units from them; without one all are in shard -1."""
        if dims not in self.of:
            return np.full(1, -1), np.zeros((len(units), 1))
        numbers, pivots = self.of[dims]
        return numbers, distances(units, pivots)


def pivots(rows: DataFrame, shard_rows: int) -> Pivots:
    """As many rows by hash as there are shards, or as PIVOT_BYTES hold."""
    n, widest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    asked = min(-(-n // shard_rows), max(1, PIVOT_BYTES // (8 * widest)))
    held: dict[int, list[tuple[int, list[float]]]] = {}
    if asked > 1:
        by_hash = rows.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(asked)
        for number, (vector,) in enumerate(by_hash.collect()):
            held.setdefault(len(vector), []).append((number, vector))
    return Pivots({d: (np.array([n for n, _ in x]), unit(np.array([v for _, v in x]))) for d, x in held.items()})


def _flat(table: pa.Table | pa.RecordBatch, dims: int) -> np.ndarray:
    column = table["embedding"]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, dims)


def _by_dims(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each number of dimensions of a batch, the rows of it and their vectors, some thousand at a time."""
    sizes = batch["dims"].to_numpy()
    for dims in np.unique(sizes).tolist():
        for at in np.array_split(own := np.flatnonzero(sizes == dims), -(-len(own) // 2048)):
            yield dims, at, _flat(batch.take(pa.array(at)), dims)


ROW = "row bigint, vec_id bigint, embedding array<double>, dims int, asks boolean"


def _dealt(rows: DataFrame, known: Pivots) -> DataFrame:
    """Rows with their nearest pivot and the distance `away` from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, away = np.full(len(batch), -1), np.zeros(len(batch))
            for dims, at, vectors in _by_dims(batch):
                numbers, far = known.distances(dims, unit(vectors))
                least = far.argmin(axis=1)
                pivot[at], away[at] = numbers[least], far[np.arange(len(at)), least]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(away)], [*batch.schema.names, "pivot", "away"])

    return rows.mapInArrow(run, f"{ROW}, pivot bigint, away double")


FOUND = "row bigint, query_id bigint, vec_id bigint, score double"
_NAMES = [f.split()[0] for f in FOUND.split(", ")]


def _answers(shard: pa.Table, asking: pa.Table, k: int, relax: float, beat: np.ndarray | None) -> pa.Table:
    """What a shard's rows answer to queries of as many dimensions."""
    dims = asking["dims"][0].as_py()
    shard = shard.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # the same tree from every attempt
    tree = plant(shard["vec_id"].to_numpy(), _flat(shard, dims))
    query_ids = asking["vec_id"].to_numpy()
    q, row, score = search(tree, query_ids, _flat(asking, dims), k, relax, beat)
    return pa.table([asking["row"].to_numpy()[q], query_ids[q], tree.ids[row], score], _NAMES)


def _no_answers() -> pa.Table:
    return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], _NAMES)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, relax: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each row of `vectors` (`vec_id`, `embedding`) with `is_query`, its k nearest other rows: `query_id`, `rank`,
    `vec_id`, `score`."""
    row = F.xxhash64("vec_id", "embedding").alias("row")  # tells rows of one id apart
    asks = F.coalesce(is_query, F.lit(False)).alias("asks")
    rows = usable(vectors).select(row, "vec_id", "embedding", F.size("embedding").alias("dims"), asks)
    rows = written(rows, "vectors")
    known = pivots(rows, shard_rows)
    rows = written(_dealt(rows, known), "dealt")
    # A row for each pivot, and one for each number of dimensions that has none.
    facts = rows.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    if not facts:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shards = {f["pivot"]: -(-f["n"] // shard_rows) for f in facts}
    radius = {f["pivot"]: f["radius"] for f in facts}
    count = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in shards.items() for x in pair]), F.col("pivot"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), count))

    def own(table: pa.Table) -> pa.Table:
        asking = table.filter(table["asks"])
        return _answers(table, asking, k, relax, None) if len(asking) else _no_answers()

    first = written(rows.groupBy("dims", "pivot", "shard").applyInArrow(own, FOUND), "own-shards")
    last = first.groupBy("row").agg(F.count("*").alias("found"), F.min("score").alias("last"))
    bound = F.when(F.col("found") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("last")))).otherwise(float("inf"))
    queries = rows.filter("asks").join(last, "row", "left").withColumn("beat", F.coalesce(bound, F.lit(float("inf"))))
    queries = queries.select("row", "vec_id", "embedding", "dims", "pivot", "shard", "beat")
    blocks = max(1, -(-rows.filter("asks").count() // BLOCK_ROWS))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beat, home, home_shard = (batch[c].to_numpy() for c in ("beat", "pivot", "shard"))
            for dims, at, vectors in _by_dims(batch):
                numbers, far = known.distances(dims, unit(vectors))
                near = far - np.array([radius.get(n, -np.inf) for n in numbers.tolist()]) <= beat[at][:, None] / relax + 2 * ROUNDING
                q, p = np.nonzero(near)
                times = np.array([shards.get(n, 0) for n in numbers.tolist()])[p]
                q, p = np.repeat(q, times), np.repeat(p, times)
                shard = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
                elsewhere = (numbers[p] != home[at[q]]) | (shard != home_shard[at[q]])
                q, p, shard = at[q[elsewhere]], numbers[p[elsewhere]], shard[elsewhere]
                for some in range(0, len(q), 1 << 14):
                    part = slice(some, some + (1 << 14))
                    taken = batch.take(pa.array(q[part]))
                    columns = [*(taken[c] for c in ("row", "vec_id", "embedding", "dims", "beat")), pa.array(p[part]), pa.array(shard[part])]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "embedding", "dims", "beat", "pivot", "shard"])

    schema = "row bigint, vec_id bigint, embedding array<double>, dims int, beat double, pivot bigint, shard bigint"
    asked = queries.mapInArrow(sent, schema).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    def other(shard: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(shard) or not len(asking):
            return _no_answers()
        return _answers(shard, asking, k, relax, asking["beat"].to_numpy())

    held = rows.select("row", "vec_id", "embedding", "dims", "pivot", "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    key = ["dims", "pivot", "shard", "block"]
    more = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(other, FOUND)
    rank = F.row_number().over(Window.partitionBy("row", "query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = first.unionByName(more).withColumn("rank", rank)
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
