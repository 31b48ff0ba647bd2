"""Scored CSV records and file listings: filter, order, top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.numbers import order_key, to_date, whole

# What the report keeps.
MIN_SCORE = 80
TOP = 5


def kept_records(records: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """Records with a plain whole `score`, of any length, and a typed `date`; those with a low or unreadable one are
    dropped."""
    typed = records.withColumn("score", whole(F.col("score"))).withColumn("date", to_date(F.col("date")))
    enough = F.col("score").isNotNull() & (order_key(F.col("score")) >= order_key(F.lit(str(min_score))))
    return typed.filter(enough & F.col("date").isNotNull() & F.col("name").isNotNull())


def newest_records(records: DataFrame, tie: str, n: int = TOP, min_score: int = MIN_SCORE) -> DataFrame:
    """`name` and `score` of the `n` newest kept records, earlier `tie` first among equals."""
    newest = kept_records(records, min_score).orderBy(F.desc("date"), tie).limit(n)
    return newest.select("name", "score")


def sorted_files(files: DataFrame, sort_by: str = "size", order: str = "desc") -> DataFrame:
    """A listing (`name`, `size`) by size or name, either way, names breaking ties."""
    direction = F.desc if order == "desc" else F.asc
    return files.orderBy(direction("size"), "name") if sort_by == "size" else files.orderBy(direction("name"))
