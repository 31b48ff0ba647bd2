"""Benchmark decontamination: words of documents that stand in a window of a benchmark item.

Only DataFrame and SQL functions. The hashes of all benchmark windows become a bit set, sized by their number within
bounds, which every task gets as the value of a scalar subquery; documents are scanned window by window against it inside one generated
loop. The few windows that pass are checked word for word by a join with the benchmark's windows, so the bit set
decides nothing, and a benchmark of any size gives the same result: a full bit set only lets more windows through.

Null, empty and wordless texts have no words and no hits. Rows that repeat a document (same id and text) count as one
document; the same id with another text is another document. Null ids are kept as they are. An item that occurs twice
counts once. Columns beyond the named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import ascii_lower, packed, text_hash, written

WINDOW = 10
#: Bits of the set of a window length: so many a window, a power of two, from 512 bytes to 16 MB. Windows beyond the
#: 8 million that this suits fill the set more, which then lets more pass, but drops none.
WINDOW_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 12, 1 << 27
#: Between words: everything of ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = f"[^{GAP[1:]}+"


def word_list(text: Column) -> Column:
    """The words, upper case kept."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{GAP}+"), "")


def _window_text(words: Column, start: Column, length: Column) -> Column:
    """Words joined by blanks, which are in no word."""
    return ascii_lower(F.array_join(F.slice(words, start, length), " "))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """`item_id`, `length` and the words `key` of each distinct window."""
    words = items.select("item_id", word_list(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    length = F.least("n", F.lit(window)).alias("length")
    starts = F.explode(F.sequence(F.lit(1), F.col("n") - length + 1)).alias("start")
    cut = words.filter(F.col("n") > 0).select("item_id", "words", length, starts)
    return cut.select("item_id", "length", _window_text(F.col("words"), F.col("start"), F.col("length")).alias("key")).distinct()


def _word_hashes(words: Column) -> Column:
    """Hashes by which no pair of words differs that are equal but for upper case."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _places(hashed: Column, n_bits: Column) -> list[Column]:
    """The two bits of a window."""
    return [F.pmod(hashed, n_bits), F.pmod(F.shiftright(hashed, 32), n_bits)]


def set_sizes(windows: DataFrame) -> dict[int, int]:
    """How many bits the set of each window length there is has: a row for each length."""
    out = {}
    for length, n in windows.groupBy("length").count().collect():
        out[length] = min(MOST_BITS, max(LEAST_BITS, 1 << (n * WINDOW_BITS - 1).bit_length()))
    return out


def _bits_of(sizes: dict[int, int]) -> Column:
    """The size of the set of a row's `length`."""
    own = [F.when(F.col("length") == length, F.lit(n).cast("bigint")) for length, n in sizes.items()]
    return F.coalesce(*own, F.lit(LEAST_BITS).cast("bigint"))


def bit_sets(windows: DataFrame, sizes: dict[int, int], window: int = WINDOW) -> DataFrame:
    """One row, `sets`: the window `lengths` there are, and for each length the `bits` as an array of 64-bit words."""
    hashed = F.xxhash64(_word_hashes(F.split("key", " ")))
    places = windows.select("length", F.explode(F.array(*_places(hashed, _bits_of(sizes)))).alias("bit"))
    words = places.select(
        "length", F.shiftright("bit", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("value")
    )
    # Every word of the set, so that its number is its place.
    every = F.explode(F.sequence(F.lit(0), (_bits_of(sizes) / 64 - 1).cast("int"))).alias("word")
    empty = windows.select("length").distinct().select("length", every, F.lit(0).cast("bigint").alias("value"))
    full = words.unionByName(empty).groupBy("length", "word").agg(F.bit_or("value").alias("value"))
    dense = full.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("word", "value")))["value"].alias("bits"))
    own = [F.any_value(F.when(F.col("length") == n, F.col("bits")), True) for n in range(1, window + 1)]
    lengths = F.sort_array(F.collect_set(F.col("length").cast("int")))
    return dense.agg(
        F.struct(lengths.alias("lengths"), F.array(*own).alias("bits")).alias("sets")
    )


def _candidates(documents: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """A row for each window that the bit sets let through, and one with `length` 0 for each document."""
    text, start, length, n_words = (F.col(c) for c in ("text", "start", "length", "n_words"))
    lists = documents.select("doc_id", text_hash(text).alias("_text"), word_list(text).alias("words"))
    lists = lists.select("*", _word_hashes(F.col("words")).alias("hashes"), F.size("words").alias("n_words"))
    sizes = set_sizes(windows)
    sets = bit_sets(windows, sizes, window).scalar()
    asked = F.explode(F.concat(F.array(F.lit(0)), sets["lengths"])).alias("length")
    last = F.when(length == 0, 1).otherwise(n_words - length + 1)
    scanned = lists.select("*", asked).filter((length == 0) | (n_words >= length))
    bits = F.get(sets["bits"], length - 1)
    # The set's size is told once a document and length, not once a window.
    scanned = scanned.select("*", _bits_of(sizes).alias("n_bits")).select("*", F.explode(F.sequence(F.lit(1), last)).alias("start"))

    def held(bit: Column) -> Column:
        word = F.get(bits, F.shiftright(bit, 6).cast("int"))
        return F.call_function("shiftright", word, bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    one, two = _places(F.xxhash64(F.slice("hashes", start, length)), F.col("n_bits"))
    found = scanned.filter((length == 0) | (held(one) & held(two)))
    # No word holds a '#': a document's own row meets no window, and these rows spread evenly.
    own_key = F.concat(F.lit("#"), F.xxhash64("doc_id", "_text").cast("string"))
    key = F.when(length == 0, own_key).otherwise(_window_text(F.col("words"), start, length))
    return found.select("doc_id", "_text", n_words.cast("bigint").alias("n_words"), "start", "length", key.alias("key"))


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document (`doc_id`, `text`) against items (`item_id`, `text`): `doc_id`, `_text` (a hash that tells
    documents of one id apart), `n_words`, `hits` (sorted arrays [start, length], words counted from 1),
    `items` (sorted ids as strings) and `n_rows`, how many rows the document has."""
    windows = written(item_windows(items, window), "windows")
    known = windows.select("key", F.col("item_id").cast("string").alias("item"), F.lit(True).alias("known"))
    # A key with many rows on the left is split by adaptive execution; the right side has a row for each item.
    checked = _candidates(documents, windows, window).join(known, "key", "left")
    hit = F.when(F.col("known"), F.array("start", "length"))
    return checked.groupBy("doc_id", "_text").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(hit)).alias("hits"),
        F.sort_array(F.collect_set("item")).alias("items"),
        F.count_if(F.col("length") == 0).alias("n_rows"),
    )


def of_each_row(found: DataFrame) -> DataFrame:
    """`contamination` with a row for each row of the documents."""
    return found.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows")))).drop("_row", "n_rows")


def hit_count(hits: Column) -> Column:
    """Words under sorted spans, each once."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(held: Column, span: Column) -> Column:
        end = span[0] + span[1]
        more = F.greatest(F.lit(0), end - F.greatest(held["end"], span[0])).cast("bigint")
        return F.struct(F.greatest(held["end"], end).alias("end"), (held["n"] + more).alias("n"))

    return F.aggregate(hits, start, add, lambda held: held["n"])


def decontaminated(documents: DataFrame, items: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """Documents, all columns kept, without what stands in the items.

    remove="documents" drops each document with a hit. remove="spans" cuts the hit words, and what separates them from
    the word before, out of `text`. Repeated rows are all kept or all dropped.
    """
    found = contamination(documents, items, window).filter(F.size("hits") > 0).select("doc_id", "_text", "hits")
    rows, row, hits = packed(documents), F.col("row"), F.col("hits")
    same = row["doc_id"].eqNullSafe(F.col("doc_id")) & (text_hash(row["text"]) == F.col("_text"))
    if remove == "documents":
        return rows.join(found, same, "left_anti").select("row.*")
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    joined = rows.join(found, same, "left")
    # A piece is a word with the gap before it, or the gap at the end.
    pieces = F.regexp_extract_all(row["text"], F.lit(f"{GAP}*{WORD}|{GAP}+"), F.lit(0))
    under = F.flatten(F.transform(hits, lambda s: F.sequence(s[0], s[0] + s[1] - 1)))
    kept = F.array_except(F.sequence(F.lit(1), F.size(pieces)), under)
    cut = F.array_join(F.transform(kept, lambda p: F.get(pieces, p - 1)), "")
    text = F.when(hits.isNull(), row["text"]).otherwise(cut)
    return joined.select(*[(text if c == "text" else row[c]).alias(c) for c in documents.columns])
