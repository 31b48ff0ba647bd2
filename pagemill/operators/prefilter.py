"""A bit set of fixed size over hashes of keys: what is not in it is surely not wanted.

It is the value of a scalar subquery, so tasks get it without a shuffle or a join, and its size does not depend on the
data. Rows that it lets through by chance are left to the join that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 512 KB. Keys set two bits each, so up to a million keys it lets fewer than one row in five through by chance.
BITS = 1 << 22


def _bits(hashed: Column) -> list[Column]:
    return [F.pmod(hashed, F.lit(BITS)), F.pmod(F.shiftright(hashed, 32), F.lit(BITS))]


def bit_set(hashes: DataFrame) -> Column:
    """The set of a one-column DataFrame of 64-bit hashes, as a value for any other query."""
    (name,) = hashes.columns
    bits = hashes.select(F.explode(F.array(*_bits(F.col(name)))).alias("bit"))
    words = bits.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("value"))
    every = hashes.sparkSession.range(BITS // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("value"))
    full = words.unionByName(every).groupBy("word").agg(F.bit_or("value").alias("value"))
    return full.agg(F.sort_array(F.collect_list(F.struct("word", "value")))["value"].alias("set")).scalar()


def may_hold(bits: Column, hashed: Column) -> Column:
    """False for hashes that are not in the set."""
    one, two = (
        F.call_function("shiftright", F.get(bits, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int"))
        for b in _bits(hashed)
    )
    return one.bitwiseAND(two).bitwiseAND(F.lit(1)) == 1
