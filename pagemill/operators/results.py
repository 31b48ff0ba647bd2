"""Result tables brought to the five columns `url, title, h1, meta_description, texto`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.functions.text import strip, truncate
from pagemill.functions.urls import domain_key
from pagemill.operators.lookup import lookup

HEADER = ",".join(schemas.CLEAN_COLUMNS)
SHORT_HEADER = "url,texto"


#: Positions of a file that one task puts in order.
BLOCK = 1 << 16


def _block() -> Column:
    """File and block as one value that is never null: windows, aggregates and joins by it share one shuffle."""
    return F.struct(F.col("file").alias("file"), F.expr(f"pos div {BLOCK}").alias("n"))


def _records(lines: DataFrame, shape: Column) -> DataFrame:
    """`records_of` with `_shape`, that of the first line of the file."""
    odd = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    own = Window.partitionBy("_block").orderBy("pos")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.select("file", "pos", "line", _block().alias("_block"), (F.coalesce(odd, F.lit(0)) % 2).alias("_odd"))
    marked = marked.withColumn("_before", F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2)
    # A block's last line that begins a record, as no quote is open where the block begins, or as one is.
    blocks = marked.groupBy("_block").agg(
        F.sum("_odd").alias("_odds"),
        F.max(F.when(F.col("_before") == 0, F.col("pos"))).alias("_closed"),
        F.max(F.when(F.col("_before") == 1, F.col("pos"))).alias("_opened"),
        F.min_by(shape, "pos").alias("_shape"),
    )
    whole = Window.partitionBy("_block.file")
    file = whole.orderBy("_block.n")
    earlier = file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_open", F.coalesce(F.sum("_odds").over(earlier), F.lit(0)) % 2)
    blocks = blocks.withColumn("_last", F.when(F.col("_open") == 0, F.col("_closed")).otherwise(F.col("_opened")))
    blocks = blocks.select(
        "_block",
        "_open",
        F.max("_last").over(earlier).alias("_carried"),
        F.when(F.sum("_odds").over(whole) % 2 == 1, F.max("_last").over(whole)).alias("_never"),
        F.first("_shape").over(file).alias("_shape"),
    )
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.when((F.col("_before") + F.col("_open")) % 2 == 0, F.col("pos"))
    known = marked.join(blocks, "_block").withColumn("_first", first)
    known = known.withColumn("_record", F.coalesce(F.max("_first").over(upto), F.col("_carried")))
    record = F.when(F.col("_record") == F.col("_never"), F.col("pos")).otherwise(F.col("_record"))
    parts = known.groupBy("file", record.alias("pos")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("_parts"), F.any_value("_shape").alias("_shape")
    )
    return parts.select("file", "pos", F.array_join(F.transform("_parts", lambda p: p["line"]), "\n").alias("line"), "_shape")


def records_of(lines: DataFrame) -> DataFrame:
    """Records of lines (`file`, `pos`, `line`): a record goes on as long as a quote is open, and has the position
    of its first line. Lines of a record that never closes are a record each.

    A task passes blocks of lines; over a whole file go a few values of each block. Only the lines of one record are put
    together."""
    return _records(lines, F.lit(None)).drop("_shape")


def places(df: DataFrame) -> DataFrame:
    """Rows with `pos` counted from 1 in each `file`."""
    rows = df.withColumn("_block", _block())
    file = Window.partitionBy("_block.file").orderBy("_block.n").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_block").agg(F.count("*").alias("_rows"))
    counts = counts.select("_block", F.coalesce(F.sum("_rows").over(file), F.lit(0)).alias("_earlier"))
    place = F.col("_earlier") + F.row_number().over(Window.partitionBy("_block").orderBy("pos"))
    return rows.join(counts, "_block").withColumn("pos", place.cast("bigint")).select(*df.columns)


def normalised(lines: DataFrame) -> DataFrame:
    """Result records (`file`, `pos`, `line`) under the five-column header; texts are moved by blocks of their file.

    Told by the first line of each file: five columns stay, `url,texto` records get three empty columns in
    between and lose blank lines, and a file without header gets one.
    """
    start = F.lower(strip(F.col("line")))
    shape = F.when(start.startswith(HEADER), "full").when(start.startswith(SHORT_HEADER), "short").otherwise("bare")
    known = _records(lines, shape)

    header = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit(HEADER).alias("line"))

    def moved(line: Column, by: int) -> Column:
        return F.struct((F.col("pos") + by).cast("bigint").alias("pos"), line.alias("line"))

    line, first = F.col("line"), F.col("pos") == 0
    widened = F.regexp_replace(line, r"(?s)^([^,]*+),?+(.*)\z", "$1,,,,$2")
    short = F.when(first, F.array(header)).when(strip(line) != "", F.array(moved(widened, 0)))
    bare = F.when(first, F.array(header, moved(line, 1))).otherwise(F.array(moved(line, 1)))
    out = (
        F.when(F.col("_shape") == "full", F.array(moved(line, 0)))
        .when(F.col("_shape") == "short", short)
        .otherwise(bare)
    )
    return known.select("file", F.inline(out))


def rows(lines: DataFrame) -> DataFrame:
    """The five columns of normalised records: `file`, `pos` and the columns, absent ones empty."""
    schema = ", ".join(f"{c} STRING" for c in schemas.CLEAN_COLUMNS)
    data = lines.filter((F.col("pos") > 0) & (F.col("line") != ""))
    record = F.from_csv("line", schema, {"escape": '"', "multiLine": "true"})
    return five_columns(data.select("file", "pos", record.alias("_r")).select("file", "pos", "_r.*"), "file", "pos")


def five_columns(df: DataFrame, *keep: str) -> DataFrame:
    """The five columns in order, missing columns and NULLs empty."""
    have = set(df.columns)
    return df.select(
        *keep, *[F.coalesce(c, F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in schemas.CLEAN_COLUMNS]
    )


def merged_prefs(base: DataFrame, override: DataFrame) -> DataFrame:
    """Limits per domain (`domain`, `limit`) of two tables, the override's where it has one."""
    return base.join(override.withColumnRenamed("limit", "_over"), "domain", "full_outer").select(
        "domain", F.coalesce("_over", "limit").alias("limit")
    )


def limited(
    results: DataFrame,
    prefs: DataFrame,
    default: Column | int | None = None,
    compat: bool = False,
    spread: Column | str = "url",
) -> DataFrame:
    """`texto` cut to the limit of the URL's domain (the highest, if it has several), else to `default`.

    `spread` differs among the rows of a domain. Adaptive execution broadcasts preferences that turn out small.
    """
    limits = prefs.groupBy(F.col("domain").alias("_domain")).agg(F.max("limit").alias("_limit"))
    keyed = results.withColumn("_domain", domain_key(strip(F.col("url")), compat))
    found = lookup(keyed, limits, ["_domain"], spread=spread)
    default = F.lit(default) if isinstance(default, int) else default
    own = F.col("_limit") if default is None else F.coalesce("_limit", default)
    return found.withColumn("texto", truncate(F.col("texto"), own)).drop("_domain", "_limit")
