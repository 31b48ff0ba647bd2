"""All pairs of documents whose word shingles are alike enough, and the groups that they form.

Set similarity by a partition of the universe. Two sets with a Jaccard similarity of at least t differ in few elements:
in at most H = (1 - t) / (1 + t) * (a + b) of them. The hash range of shingles is cut into segments; if the larger set
has more than H segments with elements, the smaller one is equal to it in at least one of them. Sets are therefore
indexed by (size band, segment, hash of the elements in it), in their own band of sizes and, where a larger set may be
there, in the next. Small sets, which may have too few such segments, get more from one-deletion neighbourhoods: a
segment that is also matched with one element less counts for two.

What a set has to look up is chosen by cost. Keys that no other set has cost nothing, and most keys are such; a set that
has more than H of them has no larger-or-equal partner to find, and one that has still more has no partner at all.
Otherwise it looks up its rarest other keys until there are H + 1. Within a bucket, sets are first compared with its
most typical one only. Then those that look it up are compared with the sets that this did not bring into their group,
if sketches of fixed size (the parity of elements by hash, which differ in no more bits than the sets in elements) let
them be near enough. So copies of one text never become all pairs of them, and no link between groups is lost. Sets that
even so have too few segments (the check for it is exact) are looked up by single shingles.

Every candidate is verified on whole sets. Sets are of 64-bit shingle hashes and are named by a 64-bit hash of all of
them: with 10^9 different documents the chance that any two names meet is three per cent; with 10^6 it is 10^-8.

Documents without words or text have no set: they are linked with nothing. Null ids are rows without a smaller id.
Repeated rows have equal sets, so they are in one group. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagemill.llm.common import byte_values, give_back, mixed, packed, removed, slices, string_bytes, text_hash, word_hashes, written
from pagemill.llm.components import components

SHINGLE = 5
CHUNK_BYTES = 1 << 20
#: Words are of anything but ASCII white space; A-Z count as a-z.
_OF_BYTE = byte_values({0x20, *range(0x09, 0x0E)})
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of a shorter text, of all its words as one."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        out = out * _FACTOR + words[k : k + n]
    return np.unique(mixed(out))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes, CHUNK_BYTES):
        words, bounds = word_hashes(*string_bytes(texts.slice(a, b - a)), _OF_BYTE)
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield shingles(words[first:last])


def set_name(hashes: np.ndarray) -> int:
    return int.from_bytes(blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


class Partition:
    """How sets of a size are cut, for a similarity of `percent` hundredths."""

    def __init__(self, percent: int, most_segments: int = 1 << 62):
        """With `most_segments` all sets beyond that take the way by shingles."""
        self.percent, self.most_segments = percent, most_segments

    def differing(self, size: int) -> int:
        """Elements in which a set and one that is no larger can differ."""
        return 2 * size * (100 - self.percent) // (100 + self.percent)

    @staticmethod
    def band(size: int) -> int:
        return size.bit_length()

    def segments(self, band: int) -> int:
        """Enough that a set of the band nearly always has more than it needs with elements in them, and no more: each
        is a row to shuffle. By the odds of empty segments, six standard deviations from the need for large sets."""
        most = 1 << band
        share = 2 * (100 - self.percent) / (100 + self.percent)
        load = 1.0 if most <= 32 else 3.1
        while load > 0.05:
            need, full = most * share + 1, most * (1 - np.exp(-load)) / load
            spread = np.sqrt(most / load * max(1e-9, np.exp(-load) - (1 + load) * np.exp(-2 * load)))
            if full - (6 if most > 256 else 3) * spread >= need:
                break
            load -= 0.1
        return min(self.most_segments, int(np.ceil(most / max(load, 0.05))))

    @staticmethod
    def deletions(band: int) -> bool:
        """Whether sets of the band are also indexed with one element less."""
        return 1 << band <= 256


#: What a key row is for: a segment less one element, for others to look up; a segment to look up if it is among the
#: rarest, or always; a mark of sets with too few segments; a segment in the next band, for others to look up.
INDEXED, CHOSEN, ALWAYS, SHORT, NEXT = range(5)
SKETCH_BITS = 512
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
KEYS = "key bigint, name bigint, size int, spare int, use int"


def set_keys(hashes: np.ndarray, plan: Partition) -> list[tuple[np.ndarray, int, int]]:
    """The index keys of a set: (keys, spare segments, use)."""
    size, out = len(hashes), []
    own = plan.band(size)
    bands = [own] + [own + 1] * (size * 100 // plan.percent >= 1 << own)
    element = mixed(hashes * _FACTOR)
    for band in bands:
        count = plan.segments(band)
        segment = (hashes >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)  # rising, as the hashes are
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        sums = np.add.reduceat(element, first)
        place = segment[first] + np.uint64(band << 40)
        keys = mixed(sums * _FACTOR + place)
        spare = len(first) - plan.differing(size) - 1
        sizes = np.diff(np.concatenate([first, [size]]))
        # A set with too few segments looks up everything, and those with two elements or more count twice.
        short = band == own and spare < 0
        out.append((keys, spare, NEXT if band != own else ALWAYS if short else CHOSEN))
        if plan.deletions(band):
            which = np.repeat(np.arange(len(first)), sizes)
            less = (sums[which] - element) * _FACTOR + place[which]
            out.append((mixed(less[sizes[which] > 1]), 0, ALWAYS if short else INDEXED))
        if short and spare + (int((sizes > 1).sum()) if plan.deletions(band) else 0) < 0:
            out.append((np.array([set_name(hashes)], np.int64).astype(np.uint64), 0, SHORT))
    return out


def _sets(documents: DataFrame, *extra: str) -> DataFrame:
    """`doc_id`, `name` of its set, `size` and bigint columns `extra`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(set_name(s), len(s)) for s in shingle_sets(batch["text"])]
            names, sizes = zip(*found, strict=True) if found else ((), ())
            columns = [batch["doc_id"], pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), *[batch[c] for c in extra]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "name", "size", *extra])
        give_back()

    schema = "doc_id bigint, name bigint, size bigint" + "".join(f", {c} bigint" for c in extra)
    return documents.select(F.col("doc_id").cast("bigint"), "text", *extra).mapInArrow(run, schema)


SEEN = 1 << 18


def _keys(documents: DataFrame, plan: Partition) -> DataFrame:
    """The key rows of all documents' sets; of equal sets that a task meets, mostly those of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = [np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [np.zeros(0, k) for k in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in KEYS.split(", ")])

        for batch in batches:
            rows, held = [], 0
            for hashes in shingle_sets(batch["text"]):
                if not len(hashes) or (name := set_name(hashes)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                for keys, spare, use in set_keys(hashes, plan):
                    n = len(keys)
                    rows.append((keys.view(np.int64), *(np.full(n, x, k) for x, k in zip((name, len(hashes), spare, use), kinds[1:], strict=True))))
                    held += n
                if held > 1 << 18:
                    yield out(rows)
                    rows, held = [], 0
            yield out(rows)
        give_back()

    return documents.select("text").mapInArrow(run, KEYS)


def _shared(keys: DataFrame) -> DataFrame:
    """Key rows that more than one set has, each once, with the number of rows of the key."""
    own = Window.partitionBy("key")
    spread = keys.select("*", F.min("name").over(own).alias("low"), F.max("name").over(own).alias("high"), F.count("*").over(own).alias("n"))
    return spread.filter((F.col("low") != F.col("high")) | (F.col("use") == SHORT)).drop("low", "high").dropDuplicates(["key", "name", "use"])


def _buckets(shared: DataFrame, plan: Partition) -> DataFrame:
    """Rows of keys that some set looks up, with `asks`, whether this one does, and the bucket's most typical set."""
    own = Window.partitionBy("name")
    rarest = Window.partitionBy("name", "use").orderBy("n", "key")
    use, size = F.col("use"), F.col("size")
    counted = shared.filter(use != SHORT).select(
        "*",
        F.row_number().over(rarest).alias("rank"),
        F.sum((use == CHOSEN).cast("int")).over(own).alias("common"),
        F.sum((use == NEXT).cast("int")).over(own).alias("common_next"),
    )
    # Every segment that no other set has is a difference from any of them.
    need = F.floor(2 * size * (100 - plan.percent) / (100 + plan.percent)) + 1
    alone = F.col("spare") + need - F.when(use == NEXT, F.col("common_next")).otherwise(F.col("common"))
    near = F.when(use.isin(CHOSEN, NEXT), alone * plan.percent <= size * (100 - plan.percent)).when(use == ALWAYS, True)
    hopeful = counted.withColumn("near", near)
    hopeful = hopeful.withColumn("near", F.coalesce("near", F.max("near").over(own), F.lit(True))).filter("near")
    # `spare` segments need not be looked up; keys that no other set has are the first of those that are.
    asks = (use == ALWAYS) | ((use == CHOSEN) & (F.col("rank") <= F.col("common") - F.col("spare")))
    typical = F.struct((F.col("common") / size).alias("common"), F.col("name").alias("name"))
    rows = hopeful.select("key", "name", "size", asks.alias("asks"), typical.alias("typical"))
    bucket = Window.partitionBy("key")
    sets = F.min("name").over(bucket) != F.max("name").over(bucket)
    found = rows.select("key", "name", "size", "asks", F.max("typical").over(bucket)["name"].alias("typical"), (F.max("asks").over(bucket) & sets).alias("asked"))
    return found.filter("asked").drop("asked")


def _alike(one: str, other: str, percent: int) -> Column:
    """Whether sizes allow it."""
    return (100 * F.least(one, other)) >= (percent * F.greatest(one, other))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """For each remainder of hashes whether their number is odd, as 64-bit words."""
    odd = np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _whole(documents: DataFrame, sets: DataFrame, names: DataFrame) -> DataFrame:
    """The sets of `names`: `name`, `hashes` and the words of their sketch."""
    first = sets.groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    wanted = first.join(names, "name").select("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for s in shingle_sets(batch["text"]) if len(s)]
            words = np.array([sketch(s) for s in found], np.int64).reshape(-1, len(SKETCH))
            columns = [pa.array([set_name(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, words.T)], ["name", "hashes", *SKETCH])
        give_back()

    known = documents.select(F.col("doc_id").cast("bigint"), "text")
    # A set whose documents have no id is found among those.
    texts = known.join(wanted, known["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text")
    schema = "name bigint, hashes binary, " + ", ".join(f"{c} bigint" for c in SKETCH)
    return texts.mapInArrow(run, schema).dropDuplicates(["name"])


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (`u`, `v` names) that are alike, on their whole sets."""

    @F.arrow_udf("boolean")
    def alike(both: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in both:
            out = []
            for a, b in zip(left, right, strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                out.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.array(out, pa.bool_())
        give_back()

    left = whole.select(F.col("name").alias("u"), F.col("hashes").alias("one"))
    right = whole.select(F.col("name").alias("v"), F.col("hashes").alias("other"))
    return pairs.join(left, "u").join(right, "v").filter(alike("one", "other")).select("u", "v")


PAIRS = "u bigint, v bigint"
#: Rows of a bucket that one task compares with all of it.
BUCKET_ROWS = 4096
#: Rows of buckets of one least set that are kept together.
PLACE_ROWS = 8192
#: Pairs of a place that are remembered, so that the next bucket does not give them again.
REMEMBERED = 1 << 18


def _across(buckets: DataFrame, linked: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket from different groups, one of which looks the bucket up, as far as sizes and sketches allow.

    Two sets of different groups that are much alike share many buckets, so buckets are brought together by the least
    set in them: buckets of the same two sets are in one place, and buckets of the same many sets in few. A place gives
    each pair once. A set that is the least of very many rows has several places, its buckets dealt by key, and rows of a
    bucket that many sets have are compared with the others in parts.
    """
    grouped = buckets.join(linked.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    mixed_keys = grouped.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("name").alias("home"), F.count("*").alias("n")
    )
    mixed_keys = mixed_keys.filter("low <> high").select("key", "home", "n")
    homes = mixed_keys.groupBy("home").agg(F.ceil(F.sum("n") / PLACE_ROWS).alias("places"))
    place = F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("places")))
    parts = F.ceil(F.col("n") / BUCKET_ROWS).alias("parts")
    mixed_keys = mixed_keys.join(homes, "home").select("key", parts, F.when(F.col("n") <= BUCKET_ROWS, place).otherwise(F.col("key")).alias("place"))
    rows = grouped.join(mixed_keys, "key").join(whole.drop("hashes"), "name")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    rows = rows.withColumn("asks", F.col("asks") & (F.pmod(F.xxhash64("name"), F.col("parts")) == F.col("part")))
    rows = rows.select("place", "part", "key", "name", "size", "asks", "root", *SKETCH)
    placed = rows.repartition("place", "part").sortWithinPartitions("place", "part", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        place, held = None, None
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            ids = np.stack([held[c].to_numpy() for c in ("place", "part", "key")])
            edges = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            if not len(edges):
                continue
            out, place = _told(held.slice(0, int(edges[-1])), [0, *edges.tolist()], percent, place, told)
            held = held.slice(int(edges[-1]))
            yield out
        if held is not None:
            yield _told(held, [0, len(held)], percent, place, told)[0]

    return placed.mapInArrow(run, PAIRS).distinct()


def _told(rows: pa.RecordBatch, bounds: list[int], percent: int, place: tuple | None, told: set) -> tuple[pa.RecordBatch, tuple | None]:
    """New pairs of the buckets between `bounds`, and the place of the last; `told` are those of the place so far."""
    places, name, size, asks, root = (rows[c].to_numpy(zero_copy_only=False) for c in ("place", "name", "size", "asks", "root"))
    sketches = np.stack([rows[c].to_numpy() for c in SKETCH], axis=1).view(np.uint64) if len(rows) else np.zeros((0, len(SKETCH)), np.uint64)
    out: list[tuple[int, int]] = []
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        if places[first] != place or len(told) > REMEMBERED:
            place = places[first]
            told.clear()
        for asking in range(first, last, 256):  # some rows at a time against the bucket
            own = asking + np.flatnonzero(asks[asking : min(last, asking + 256)])
            if not len(own):
                continue
            both = slice(first, last)
            one, other = size[own][:, None].astype(np.int64), size[None, both].astype(np.int64)
            near = (root[own][:, None] != root[None, both]) & (100 * np.minimum(one, other) >= percent * np.maximum(one, other))
            a, b = np.nonzero(near)
            differing = np.bitwise_count(sketches[own[a]] ^ sketches[first + b]).sum(axis=1, dtype=np.int64)
            close = (100 + percent) * differing <= (100 - percent) * (one[a, 0] + other[0, b])
            a, b = name[own[a[close]]], name[first + b[close]]
            pairs = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)) - told
            told |= pairs
            out += pairs
    u, v = zip(*out, strict=True) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"]), place


def _by_shingles(documents: DataFrame, shared: DataFrame, plan: Partition) -> DataFrame:
    """Candidates of sets that have too few segments: whatever shares one of enough of their shingles."""
    short = shared.filter(F.col("use") == SHORT).select("name").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in shingle_sets(batch["text"]):
                name = np.full(len(s), set_name(s))
                enough = np.arange(len(s)) < len(s) - (plan.percent * len(s) + 99) // 100 + 1
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(name), pa.array(np.full(len(s), len(s), np.int64)), pa.array(enough)], ["key", "name", "size", "enough"])

    every = documents.select("text").mapInArrow(run, "key bigint, name bigint, size bigint, enough boolean").dropDuplicates()
    asked = every.filter("enough").join(short, "name", "left_semi").select("key", F.col("name").alias("u"), F.col("size").alias("mine"))
    return asked.join(every, "key").filter((F.col("u") != F.col("name")) & _alike("mine", "size", plan.percent)).select("u", F.col("name").alias("v")).distinct()


def _rooted(documents: DataFrame, plan: Partition, *extra: str) -> DataFrame:
    """Per document: `doc_id`, `size` of its set, columns `extra`, and the `root` that links lead to."""
    percent = plan.percent
    sets = written(_sets(documents, *extra), "shingle-sets")
    shared = written(_shared(_keys(documents, plan)), "shared-keys")
    buckets = written(_buckets(shared, plan), "buckets")
    more = _by_shingles(documents, shared, plan) if not shared.filter(F.col("use") == SHORT).isEmpty() else None
    names = buckets.select("name") if more is None else buckets.select("name").union(more.select("u")).union(more.select("v"))
    whole = written(_whole(documents, sets, names.distinct()), "sets")

    sizes = buckets.select(F.col("name").alias("typical"), F.col("size").alias("other")).distinct()
    stars = buckets.filter("name <> typical").select("name", "size", "typical").distinct().join(sizes, "typical")
    stars = stars.filter(_alike("size", "other", percent)).select(F.col("name").alias("u"), F.col("typical").alias("v"))
    stars = written(stars if more is None else stars.unionByName(more), "stars")
    linked = components(_verified(stars, whole, percent))

    tested = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    rest = _across(buckets, linked, whole, percent).join(tested, ["u", "v"], "left_anti")
    links = written(_verified(rest, whole, percent), "links")
    removed(shared, buckets, whole, stars)
    if not links.isEmpty():
        linked = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))

    # Documents without a set are groups of their own.
    own = F.when(F.col("size") == 0, F.xxhash64("doc_id")).otherwise(F.col("name"))
    named = sets.select("doc_id", "size", *extra, own.alias("node")).join(linked, "node", "left")
    return named.select("doc_id", "size", *extra, F.coalesce("root", "node").alias("root"))


def groups(documents: DataFrame, percent: int = 75, plan: Partition | None = None) -> DataFrame:
    """Per document (`doc_id`, `text`): `doc_id`, `n_shingles` and `component_id`, the least doc_id that links lead to."""
    named = _rooted(documents.select("doc_id", "text"), plan or Partition(percent))
    least = named.filter("size > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return named.join(least, "root", "left").select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))


def one_of_each(documents: DataFrame, percent: int = 75) -> DataFrame:
    """Documents, all columns kept, without those that links lead from to a smaller doc_id; of rows that share an id,
    one (the least text). Rows with null ids all stay."""
    found = groups(documents, percent)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    rows, row = packed(documents), F.col("row")
    own = rows.join(kept, row["doc_id"] == F.col("doc_id"), "left_semi")
    least = Window.partitionBy(row["doc_id"]).orderBy(row["text"].asc_nulls_last())
    own = own.withColumn("n", F.row_number().over(least)).filter("n = 1").select("row.*")
    return own.unionByName(documents.filter(F.col("doc_id").isNull()))


def one_of_each_group(documents: DataFrame, percent: int = 75) -> DataFrame:
    """Documents, all columns kept, one row of each group: of the least doc_id that has a text in it. Different texts of
    one id are documents of their own. Of exactly repeated rows (id and text) one stays, also of those without words.
    Rows with null ids all stay."""
    named = documents.select("doc_id", "text", text_hash(F.col("text")).alias("hash"))
    found = _rooted(named, Partition(percent), "hash").filter(F.col("doc_id").isNotNull())
    least = found.filter("size > 0").groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("least")).select("least.*")
    kept = least.unionByName(found.filter("size = 0").select("doc_id", "hash").distinct())
    row = F.col("row")
    hashed = packed(documents).withColumn("own", text_hash(row["text"]))
    own = hashed.join(kept, (row["doc_id"] == F.col("doc_id")) & (F.col("own") == F.col("hash")), "left_semi")
    repeated = Window.partitionBy(row["doc_id"], "own").orderBy(row["text"].asc_nulls_last())
    own = own.withColumn("n", F.row_number().over(repeated)).filter("n = 1").select("row.*")
    return own.unionByName(documents.filter(F.col("doc_id").isNull()))
