"""Equi-join to a table with at most one row per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYLESS_PIECES = 4096


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: str | Column | None = None,
    newest: str | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """`left` with the columns of the one row of `right` that has the same `on`, NULLs where there is none.

    `right` has one row per key, or several of which the one with the highest `newest` counts.

    One left join: adaptive execution splits the partitions of hot keys and broadcasts a side that turns out small.
    Where it is off, `hot_rows` has keys with at least that many rows on the left cut into salted pieces, their right
    row copied to each; rows without a key are spread too. `spread` is a column whose values differ among the rows of
    a key.
    """
    single = newest_rows(right, on, newest) if newest else right
    if hot_rows is None:
        return left.join(single, on, "left")
    spread = F.col(spread) if isinstance(spread, str) else spread
    counts = left.groupBy(on).agg(F.count("*").alias("_rows")).filter(F.col("_rows") >= hot_rows)
    hot = counts.select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_pieces"))
    # Rows without a key match nothing: they may go anywhere.
    keyless = reduce(Column.__or__, [F.col(k).isNull() for k in on])
    piece = F.pmod(F.xxhash64(spread), F.when(keyless, KEYLESS_PIECES).otherwise(F.coalesce("_pieces", F.lit(1))))
    pieces = F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)
    salted = left.join(hot, on, "left").withColumn("_piece", piece.cast("int")).drop("_pieces")
    copied = single.join(hot, on, "left").withColumn("_piece", F.explode(pieces)).drop("_pieces")
    return salted.join(copied, [*on, "_piece"], "left").drop("_piece")


def newest_rows(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the one with the highest `version`; rows without one are older than all others, and
    among equal versions the hash of the rows decides."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(version).isNotNull(), F.col(version), F.xxhash64(*rest))
    newest = df.groupBy(keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}") for c in rest])
