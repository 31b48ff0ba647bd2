"""Removal of text that stands elsewhere too, by suffix order and longest previous factors.

A byte goes if a string of `min_bytes` bytes covers it that also starts somewhere else, in another document or in the
same one; with keep="first", only if that string also starts earlier (by doc_id, then place), so a first copy stays.

A suffix array of a corpus has no end, so suffixes are sorted where they can be equal for `min_bytes` bytes:

1.  Every string of `min_bytes` bytes has a k-gram, the one of the least hash among those in it (the first if several),
    and equal strings have the same. So each document names the places of such k-grams, its anchors, with a hash of the
    context, all bytes of strings that hold the anchor. An anchor that no other place has is of no interest.
2.  A context that occurs twice is whole: each string in it does too.
3.  The other contexts of an anchor, one of each kind, are laid end to end and their suffixes sorted to a depth of
    `min_bytes` (by joining ranks of shorter prefixes). Common prefixes of neighbours in that order are told to this
    depth; the nearest smaller places before and after a suffix are its earlier matches, which give its longest previous
    factor. What is as long as `min_bytes` goes.
4.  Contexts of one anchor beyond `CONTEXTS` are cut into shares that are sorted apart; from each share one string of
    each kind, by its hash, then meets those of the other shares.

Anchors are counted per task before they meet, and steps 3 and 4 hold a bounded number of contexts, so a passage that a
third of all documents share is split like any other. Texts move once, to their spans.

Null texts are empty. Texts shorter than `min_bytes` stay whole. Rows that repeat a document (same id and text) are
documents of their own, so each one's text stands elsewhere too; with keep="first" they count as one place, and all
stay. Null ids come first. Columns beyond the named ones are not looked at. Contexts are equal by hashes of 64 bits,
made of sums modulo 2^64 and modulo a prime: a byte is wrongly removed with a chance below n^2 / 2^65 for n contexts of
an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagemill.llm.common import PIECE_BYTES, Sums, byte_values, give_back, mixed, packed, powers, removed, slices, string_bytes, written

MIN_BYTES = 400
#: Contexts of one anchor that are sorted together (10 MB, with 400 MB to work in), and bytes of contexts of several
#: anchors of one suffix array.
CONTEXTS = 16_384
SORTED_BYTES = 1 << 20
CHUNK_BYTES = 1 << 20
_OF_BYTE = byte_values(set(), lower=False, seed=5)
_PLACE = np.uint64((1 << 21) - 1)


class Sizes:
    """What follows from the length of strings: a window of k-grams (a power of two) and the k-grams' length."""

    def __init__(self, min_bytes: int, contexts: int = CONTEXTS):
        if min_bytes < 16:
            raise ValueError("strings of fewer than 16 bytes are not looked for")
        self.string = min_bytes
        self.window = 1 << int(np.log2(2 * min_bytes / 3))
        self.gram = min_bytes - self.window + 1
        self.contexts = contexts
        self.before = self.window - 1  # bytes of a context before its anchor; after it: min_bytes


def anchors(data: np.ndarray, starts: np.ndarray, sizes: Sizes) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of texts laid end to end: (hash, hash of the context, row, place in the row). Long data come in pieces;
    an anchor may be told by two of them."""
    ends = starts[1:]
    step = PIECE_BYTES
    for first in range(0, len(data), step):
        low = max(0, first - sizes.before)  # contexts of the first anchors
        last = min(len(data), first + step + 2 * sizes.string)
        n = last - low
        grams = n - sizes.gram + 1
        if grams < sizes.window:
            continue
        sums, down = Sums(_OF_BYTE[data[low:last]]), powers(n + 1)[1]
        hashes = mixed((sums.plain[sizes.gram :] - sums.plain[:grams]) * down[:grams])  # these only bring places together
        least = hashes & ~_PLACE | np.arange(grams, dtype=np.uint64)
        width = 1
        while width < sizes.window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        # Strings that start in this piece and end in their text.
        begin = np.arange(first, min(first + step, low + len(least)))
        row = np.searchsorted(starts, begin, side="right") - 1
        inside = begin + sizes.string <= ends[row]
        chosen = least[begin[inside] - low]
        fresh = np.concatenate([[True], chosen[1:] != chosen[:-1]]) if len(chosen) else np.zeros(0, bool)
        at = np.unique((chosen[fresh] & _PLACE).astype(np.int64))
        row = np.searchsorted(starts, at + low, side="right") - 1
        left = np.maximum(starts[row], at + low - sizes.before) - low
        right = np.minimum(ends[row], at + low + sizes.string) - low
        context = sums.of(left, right)
        context = mixed(context ^ ((at - left) * 65537 + (right - at)).astype(np.uint64))
        yield hashes[at], context, row, at + low - starts[row]


PLACES = "anchor bigint, context bigint, doc_id bigint, doc bigint, place int"


def _identified(documents: DataFrame) -> DataFrame:
    """`doc_id`, `text` and `doc`, which tells documents of one id apart."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    named = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text)
    return named.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc"))


def _places(documents: DataFrame, sizes: Sizes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(pc.binary_length(batch["text"]).to_numpy(), CHUNK_BYTES):
                part = batch.slice(a, b - a)
                seen = None  # a place that two pieces tell
                for anchor, context, row, place in anchors(*string_bytes(part["text"]), sizes):
                    if seen is not None and len(row):
                        again = np.isin(row * (1 << 40) + place, seen)
                        anchor, context, row, place = (x[~again] for x in (anchor, context, row, place))
                    if not len(row):
                        continue
                    seen = (row * (1 << 40) + place)[-4 * sizes.string :]
                    rows = pa.array(row)
                    columns = [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), part["doc_id"].take(rows), part["doc"].take(rows)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(place.astype(np.int32))], [f.split()[0] for f in PLACES.split(", ")])
        give_back()

    return _identified(documents).mapInArrow(run, PLACES)


def _kinds(places: DataFrame, sizes: Sizes) -> DataFrame:
    """Contexts of anchors that occur twice: number of places `n` of each kind, its `first` place, number of kinds of the
    anchor, and the `share` to sort it in."""
    place = F.struct("doc_id", "doc", "place")
    kinds = places.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    twice = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).filter("all > 1").drop("all")
    share = F.pmod(F.col("context"), F.ceil(F.col("kinds") / sizes.contexts)).cast("int")
    return kinds.join(twice, "anchor").select("anchor", "context", "n", "first", "kinds", share.alias("share"))


CONTEXT = "anchor bigint, share int, context bigint, n bigint, kinds bigint, doc_id bigint, doc bigint, place int, start int, bytes binary"


def _contexts(documents: DataFrame, kinds: DataFrame, sizes: Sizes) -> DataFrame:
    """The bytes of one context of each kind, for anchors with several."""
    several = kinds.filter("kinds > 1")
    asked = several.select(F.col("first.doc").alias("asked"), F.struct("anchor", "share", "context", "n", "kinds", "first.place").alias("one"))
    asked = asked.groupBy("asked").agg(F.collect_list("one").alias("ones"))  # at most a document's anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CONTEXT.split(", ")]
        for batch in batches:
            for row in range(len(batch)):
                data = batch["text"][row].as_py().encode()
                ones = batch["ones"][row].values
                place = ones.field("place").to_numpy()
                start = np.maximum(0, place - sizes.before)
                cut = [data[s : p + sizes.string] for s, p in zip(start.tolist(), place.tolist(), strict=True)]
                columns = [*(ones.field(c) for c in ("anchor", "share", "context", "n", "kinds"))]
                columns += [pa.array([batch[c][row].as_py()] * len(cut), pa.int64()) for c in ("doc_id", "doc")]
                columns += [ones.field("place"), pa.array(start.astype(np.int32)), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    joined = _identified(documents).join(asked, F.col("doc") == F.col("asked"))
    return joined.select("doc_id", "doc", "text", "ones").mapInArrow(run, CONTEXT)


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of `data` by their first `depth` (16 or more) bytes; equal where those are."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k : k + n]
    rank = np.unique(words, return_inverse=True)[1]
    width = 8

    def joined(offsets: list[int]) -> np.ndarray:
        every = np.zeros(n, np.int64)
        for by in offsets:
            every *= n + 1
            every[: max(0, n - by)] += rank[by:] + 1
        return np.unique(every, return_inverse=True)[1]

    parts = max(k for k in (2, 3, 4) if k == 2 or (n + 1) ** k < 1 << 63)  # as many ranks as a number holds
    while width < depth:
        upto = min(depth, parts * width)
        rank = joined(sorted({min(k * width, upto - width) for k in range(parts)}))
        width = upto
    return rank


def smaller_before(place: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it in its run whose place is smaller, or -1; `begins` marks first entries.

    Each looks at the one before it, and from one that is no smaller goes on to what that one has found, so all entries
    that still look take a step together. In order of places the first step is the last.
    """
    found = np.arange(-1, len(place) - 1, dtype=np.int32)
    found[begins] = -1
    looking = np.flatnonzero((found >= 0) & (place[found] >= place))
    while len(looking):
        found[looking] = found[found[looking]]
        looking = looking[(found[looking] >= 0) & (place[found[looking]] >= place[looking])]
    return found


def smaller_after(place: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The same behind it."""
    ends = np.append(begins[1:], True)[: len(begins)]
    found = smaller_before(place[::-1], ends[::-1])[::-1]
    return np.where(found >= 0, len(place) - 1 - found, -1)


def previous_factors(rank: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factors of strings of which `rank` is the suffix order to `depth` bytes: `depth` if the string
    starts at a smaller place too, else 0 (what is shorter is not told apart), and an entry of that place, or -1.

    Common prefixes (LCP) of neighbours in suffix order are `depth` within a run of equal ranks and less between runs, so
    the nearest smaller places before and after in that order are matches if they are in the run.
    """
    order = np.argsort(rank, kind="stable")
    lcp = np.where(np.append(False, rank[order][1:] == rank[order][:-1])[: len(order)], depth, 0)
    begins, sorted_place = lcp < depth, place[order]
    before, after = smaller_before(sorted_place, begins), smaller_after(sorted_place, begins)
    source = np.where(before >= 0, before, after)
    del before, after, sorted_place, begins, lcp
    factor, match = np.zeros(len(rank), np.int32), np.full(len(rank), -1, np.int32)
    factor[order] = np.where(source >= 0, depth, 0)
    match[order] = np.where(source >= 0, order[source], -1)
    return factor, match


def has_match(rank: np.ndarray, place: np.ndarray, earlier: bool, depth: int = MIN_BYTES) -> np.ndarray:
    """Whether a string of `depth` bytes starts at another place, an earlier one if asked: whether its previous factor is
    long enough, or it is the earlier match of one."""
    factor, match = previous_factors(rank, place, depth)
    found = factor >= depth
    if not earlier:
        found[match[found]] = True
        # An entry of the same place as a match has that one's later copy.
        same = np.lexsort((place, rank))
        equal = np.append(False, (rank[same][1:] == rank[same][:-1]) & (place[same][1:] == place[same][:-1]))[: len(same)]
        group = np.cumsum(~equal) - 1
        if len(same):
            found[same] = np.maximum.reduceat(found[same], np.flatnonzero(~equal))[group]
    return found


def covered(starts: np.ndarray, length: int) -> list[int]:
    """Ends of the maximal runs of bytes under strings from sorted `starts`: first, end, first, end ..."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    first = starts[np.concatenate([[0], gap + 1])]
    end = starts[np.concatenate([gap, [len(starts) - 1]])] + length
    return np.stack([first, end], axis=1).reshape(-1).tolist()


FOUND = "anchor bigint, context bigint, spans array<int>, string bigint, matched boolean, doc_id bigint, doc bigint, at int"


def _sorted(contexts: DataFrame, sizes: Sizes, earlier: bool) -> DataFrame:
    """For each kind of context the `spans` to remove, counted from the anchor; for shares of an anchor also one
    `string` of each kind (its hash, whether it has a match, and where it starts)."""

    def block(rows: list[dict]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["doc"], r["place"]))
        data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        length = np.array([len(r["bytes"]) for r in rows])
        base = np.concatenate([[0], np.cumsum(length)])
        rank = suffix_ranks(data, sizes.string)
        strings = np.maximum(0, length - sizes.string + 1)
        own = np.repeat(np.arange(len(rows)), strings)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(strings) - strings, strings)
        # Places in the order of documents; two contexts may hold one place.
        doc = np.array([(r["doc_id"] is not None, r["doc_id"] or 0, r["doc"]) for r in rows], np.int64).reshape(-1, 3)
        number = np.unique(doc, axis=0, return_inverse=True)[1].reshape(-1)
        start = np.array([r["start"] for r in rows], np.int64)[own] + inner
        order_of = number[own] << 32 | start
        rank = rank[base[own] + inner]
        several = np.array([r["n"] > 1 for r in rows])
        found = has_match(rank, order_of, earlier, sizes.string)
        if not earlier:
            found |= several[own]
        out: dict[str, list] = {f.split()[0]: [] for f in FOUND.split(", ")}
        bounds = np.cumsum(strings)
        for k, r in enumerate(rows):
            mine = slice(bounds[k] - strings[k], bounds[k])
            where = inner[mine][found[mine]] + r["start"] - r["place"]
            for name, value in (("anchor", r["anchor"]), ("context", r["context"]), ("spans", covered(where, sizes.string))):
                out[name].append(value)
        for name in ("string", "matched", "doc_id", "doc", "at"):
            out[name] = [None] * len(rows)
        shared = np.array([r["kinds"] > sizes.contexts for r in rows])[own]
        if shared.any():
            at = base[own] + inner
            order = np.lexsort((order_of, rank))
            least = order[np.concatenate([[True], rank[order][1:] != rank[order][:-1]])]
            least = least[shared[least]]
            out["string"] += Sums(_OF_BYTE[data]).of(at[least], at[least] + sizes.string).view(np.int64).tolist()
            out["matched"] += found[least].tolist()
            out["at"] += start[least].tolist()
            for name in ("anchor", "context", "doc_id", "doc"):
                out[name] += [rows[k][name] for k in own[least].tolist()]
            out["spans"] += [None] * len(least)
        kinds = {"spans": pa.list_(pa.int32()), "matched": pa.bool_(), "at": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                fresh = not rows or (row["anchor"], row["share"]) != (rows[-1]["anchor"], rows[-1]["share"])
                if fresh and held >= SORTED_BYTES:
                    yield block(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row["bytes"])
        if rows:
            yield block(rows)
        give_back()

    ordered = contexts.repartition("anchor", "share").sortWithinPartitions("anchor", "share", "context")
    return ordered.mapInArrow(run, FOUND)


def removed_spans(documents: DataFrame, min_bytes: int = MIN_BYTES, keep: str = "none", contexts: int = CONTEXTS) -> DataFrame:
    """Per document with text to remove: `doc` and `marks`, arrays [first, end, ...] of bytes that may overlap and reach
    beyond the text."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep is 'none' or 'first', not {keep!r}")
    sizes, earlier = Sizes(min_bytes, contexts), keep == "first"
    places = written(_places(documents, sizes), "places")
    kinds = written(_kinds(places, sizes), "kinds")
    found = written(_sorted(_contexts(documents, kinds, sizes), sizes, earlier), "found")

    # Contexts that occur again are whole but for a first copy that stays; spans are those of a kind's first place.
    whole = F.array(F.col("place") - sizes.before, F.col("place") + sizes.string).alias("span")
    first = kinds.filter("n > 1").select("anchor", "context", "first")
    again = places.join(first, ["anchor", "context"])
    if earlier:
        again = again.filter(~F.struct("doc_id", "doc", "place").eqNullSafe(F.col("first")))
    spans = found.filter(F.size("spans") > 0).select("anchor", "context", "spans")
    own = kinds.select("anchor", "context", "n", "first").join(spans, ["anchor", "context"])
    own = own if earlier else own.filter("n = 1")
    moved = F.transform("spans", lambda x: x + F.col("first.place")).alias("span")
    marks = again.select("doc", whole).unionByName(own.select("first.doc", moved))

    # Strings of anchors with several shares: those that other shares have too.
    strings = found.filter(F.col("string").isNotNull()).select("string", "matched", "doc_id", "doc", "at")
    order = F.struct("doc_id", "doc", "at")
    meet = strings.groupBy("string").agg(F.count_distinct(order).alias("n"), F.min(order).alias("least")).filter("n > 1")
    late = strings.filter(~F.col("matched")).join(meet, "string")
    late = late.filter(~order.eqNullSafe(F.col("least"))) if earlier else late
    late = late.select("doc", F.array(F.col("at"), F.col("at") + sizes.string).alias("span"))
    every = marks.unionByName(late)
    out = written(every.groupBy("doc").agg(F.flatten(F.collect_set("span")).alias("marks")), "marks")  # at most a document's anchors
    removed(places, kinds, found)
    return out


CLEAN = "doc_id bigint, doc bigint, n_bytes bigint, spans array<int>, kept binary"


def deduplicated(documents: DataFrame, min_bytes: int = MIN_BYTES, keep: str = "none") -> DataFrame:
    """Per document (`doc_id`, `text`): `doc_id`, `doc` (tells documents of one id apart), `n_bytes`, the removed `spans`
    (first, end, ... in bytes, maximal) and the `kept` bytes."""
    marks = removed_spans(documents, min_bytes, keep).withColumnRenamed("doc", "marked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, sizes = [], [], []
            for text, marks_of in zip(batch["text"], batch["marks"], strict=True):
                data = text.as_py().encode()
                own: list[int] = []
                if marks_of.is_valid:
                    pairs = marks_of.values.to_numpy().reshape(-1, 2).clip(0, len(data))
                    for first, end in pairs[pairs[:, 0].argsort(kind="stable")].tolist():
                        if own and first <= own[-1]:
                            own[-1] = max(own[-1], end)
                        elif end > first:
                            own += [first, end]
                cuts = [0, *own, len(data)]
                spans.append(own)
                sizes.append(len(data))
                kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            columns = [batch["doc_id"], batch["doc"], pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc", "n_bytes", "spans", "kept"])
        give_back()

    joined = _identified(documents).join(marks, F.col("doc") == F.col("marked"), "left")
    return joined.select("doc_id", "doc", "text", "marks").mapInArrow(run, CLEAN)


def without_repeats(documents: DataFrame, min_bytes: int = MIN_BYTES, keep: str = "first") -> DataFrame:
    """Documents, all columns kept, with `text` cut; characters of which a part went go whole. Texts that lose nothing,
    null ones too, stay as they are; documents that lose everything stay with an empty text."""
    marks = removed_spans(documents, min_bytes, keep).withColumnRenamed("doc", "marked")

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, marked in batches:
            out = []
            for text, marks_of in zip(texts, marked, strict=True):
                if not marks_of.is_valid or not text.is_valid:
                    out.append(text.as_py())
                    continue
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                gone = np.zeros(len(data) + 1, np.int64)
                pairs = marks_of.values.to_numpy().reshape(-1, 2).clip(0, len(data))
                np.add.at(gone, pairs[:, 0], 1)
                np.add.at(gone, pairs[:, 1], -1)
                out.append(data[np.cumsum(gone)[:-1] == 0].tobytes().decode(errors="ignore"))
            yield pa.array(out, pa.string())
        give_back()

    row = F.col("row")
    doc = F.xxhash64(row["doc_id"].cast("bigint"), F.coalesce(row["text"], F.lit("")))
    joined = packed(documents).withColumn("doc", doc).join(marks, F.col("doc") == F.col("marked"), "left")
    left = joined.select("row", cut(row["text"], F.col("marks")).alias("left"))
    return left.select(*[F.col("left").alias(c) if c == "text" else row[c].alias(c) for c in documents.columns])
