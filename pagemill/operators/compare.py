"""Expected against actual output, line by line or as sets of lines.

Both sides are tables of lines: `file`, `pos` (0, 1, ...), `line`. Every join and grouping is on
(file, pos) or (file, line), so one huge file is spread over all tasks; what is grouped by file alone is
pre-aggregated flags and counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import output_lines, split_lines, strip


def normalised_lines(outputs: DataFrame) -> DataFrame:
    """Lines of captured outputs (`file`, `text`), empty ones dropped and the rest right-trimmed."""
    return outputs.select("file", F.posexplode(output_lines(F.col("text"))).alias("pos", "line"))


def raw_lines(outputs: DataFrame) -> DataFrame:
    """All lines of the outputs as they are."""
    return outputs.select("file", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))


def paired(expected: DataFrame, got: DataFrame) -> DataFrame:
    """`expected` and `got` line per (file, pos), NULL where a side is shorter."""
    left = expected.select("file", "pos", F.col("line").alias("expected"))
    return left.join(got.select("file", "pos", F.col("line").alias("got")), ["file", "pos"], "full_outer")


def _per_file(verdicts: DataFrame, files: DataFrame | None) -> DataFrame:
    if files is None:
        return verdicts
    # A file without lines on either side has nothing to differ in; lines of a file that is not expected count as wrong.
    return files.select("file").distinct().join(verdicts, "file", "full_outer").fillna(1.0, ["correct"])


def lines_equal(expected: DataFrame, got: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """`correct` per file: 1.0 if both sides have the same lines in the same order, else 0.0."""
    same = F.col("expected").eqNullSafe(F.col("got")).cast("double")
    return _per_file(paired(expected, got).groupBy("file").agg(F.min(same).alias("correct")), files)


def line_sets_equal(expected: DataFrame, got: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """`correct` per file: 1.0 if both sides have the same stripped lines, whatever order and number."""

    def side(lines: DataFrame, mark: int) -> DataFrame:
        return lines.select("file", strip(F.col("line")).alias("line"), F.lit(mark).alias("side"))

    both = side(expected, 0).unionByName(side(got, 1)).filter(F.col("line") != "")
    sides = both.groupBy("file", "line").agg(F.min("side").alias("_from"), F.max("side").alias("_to"))
    shared = ((F.col("_from") == 0) & (F.col("_to") == 1)).cast("double")
    return _per_file(sides.groupBy("file").agg(F.min(shared).alias("correct")), files)


def first_difference(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Per file with any difference: the first differing `line_no` (from 1) and both texts, or NULLs if one
    side only ends earlier; and the number of lines of both sides.

    Equal lines lose their texts before they are grouped.
    """
    differs = F.col("expected") != F.col("got")
    pairs = paired(expected, got).select(
        "file",
        F.when(differs, F.struct((F.col("pos") + 1).alias("line_no"), "expected", "got")).alias("_diff"),
        F.col("expected").isNotNull().alias("_expected"),
        F.col("got").isNotNull().alias("_got"),
    )
    found = pairs.groupBy("file").agg(
        F.min_by("_diff", "_diff.line_no").alias("_diff"),
        F.count_if("_expected").alias("n_expected"),
        F.count_if("_got").alias("n_got"),
    )
    unequal = F.col("_diff").isNotNull() | (F.col("n_expected") != F.col("n_got"))
    return found.filter(unequal).select("file", "_diff.line_no", "_diff.expected", "_diff.got", "n_expected", "n_got")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Set of stripped, non-empty lines per file."""
    return lines.select("file", strip(F.col("line")).alias("line")).filter(F.col("line") != "").distinct()
