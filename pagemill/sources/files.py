"""Readers of the file-based inputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.functions.text import strip, strip_bom


def list_files(spark: SparkSession, root: str, glob: str = "*.csv", recursive: bool = False) -> DataFrame:
    """`name` and `size` of the files of a directory; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive)
        .load(root)
    )
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def read_scored_csv(spark: SparkSession, path: str) -> DataFrame:
    """`name`, `score`, `date` as text; short rows have NULLs."""
    return spark.read.schema(schemas.SCORED_CSV).option("header", True).csv(path)


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def url_rows(lines: DataFrame, every_bom: bool = False) -> DataFrame:
    """`pos` and `url` of the lines of a URL list, blank ones dropped; byte-order marks go from every line or only
    where the reader took them."""
    url = strip(strip_bom(F.col("url"))) if every_bom else strip(F.col("url"))
    return lines.select("pos", url.alias("url")).filter(F.col("url") != "")


def read_urls(
    spark: SparkSession, path: str, invalid: str = "replace", every_bom: bool = False, missing_ok: bool = False
) -> DataFrame:
    """URL list, one per line: `pos` (increasing, not consecutive) and `url`; blank lines dropped.

    `invalid` bytes become U+FFFD or are ignored; byte-order marks go at the start of the file or of every
    line; a missing file is an error or an empty list.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if missing_ok and _missing(error):
            return spark.createDataFrame([], "pos BIGINT, url STRING")
        raise
    raw = F.col("value")
    valid = F.make_valid_utf8(raw)
    if invalid == "ignore":
        valid = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(valid, F.lit("\ufffd"), F.lit("")))
    numbered = lines.select(F.monotonically_increasing_id().alias("pos"), valid.alias("url"))
    return url_rows(numbered, every_bom)


def read_documents(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """`file` and whole `text` of small text files of one folder or many, byte-order marks removed."""
    whole = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return whole.select(
        F.col("_metadata.file_name").alias("file"), strip_bom(F.make_valid_utf8("value")).alias("text")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """`file`, `pos` (0, 1, ... within the file) and `line` of text files of any size.

    Files are read in splits. Ids increase within a split, so a line's position is its distance from the
    first id of the split plus the lines of the splits before. That table has one row per split. Both scans
    have to cut files alike; a line whose split is not in the table is an error, not a loss.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.groupBy("file", "_block")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
        .select("file", "_block", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    )
    known = F.coalesce("_first", F.raise_error(F.concat(F.lit("lines were read in other splits: "), "file")).cast("bigint"))
    pos = F.col("_before") + F.col("_id") - known
    return lines.join(blocks, ["file", "_block"], "left").select("file", pos.alias("pos"), "line")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Five-column result CSV with header."""
    return (
        spark.read.schema(schemas.CLEAN_RESULT)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )


def read_prefs(spark: SparkSession, path: str) -> DataFrame:
    """Limits per domain (`domain`, `limit`); a missing or unreadable file has none."""
    try:
        prefs = spark.read.schema(schemas.PREFS).option("multiLine", True).json(path)
    except AnalysisException as error:
        if _missing(error):
            return spark.createDataFrame([], "domain STRING, limit INT")
        raise
    limits = prefs.select(F.explode("domain_overrides").alias("domain", "_pref"))
    return limits.select("domain", F.col("_pref.limit").alias("limit")).filter(F.col("limit").isNotNull())


def read_trial_log(spark: SparkSession, path: str) -> DataFrame:
    """Metrics and exit code of trials, JSON lines."""
    return spark.read.schema(schemas.TRIAL_LOG).json(path)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Leaderboard rows, JSON lines."""
    return spark.read.schema(schemas.LEADERBOARD).json(path)
