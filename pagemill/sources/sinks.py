"""Writers of the output formats. Rows are sorted here, once, where the order of a file matters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.operators.results import five_columns


#: Quotes doubled, empty values blank, and blanks at the ends of values kept.
CSV = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: Files of one row each that a task writes.
FILES_A_TASK = 500


def write_lines(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None) -> None:
    """Unquoted `a,b` lines; the values must not hold commas."""
    rows = df.orderBy(*order) if order else df
    rows.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).write.mode(
        "overwrite"
    ).text(path)


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None) -> None:
    """CSV without header, quoted where needed, empty values left blank."""
    rows = df.orderBy(*order) if order else df
    rows.select(*columns).write.mode("overwrite").options(**CSV).csv(path)


def write_results(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Five-column CSV with header."""
    rows = df.orderBy(*order) if order else df
    five_columns(rows).select(schemas.CLEAN_COLUMNS).write.mode("overwrite").options(header=True, **CSV).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    """JSON lines added to a log."""
    df.write.mode("append").json(path)


def write_documents(texts: DataFrame, path: str) -> list[str]:
    """A text file, ended by a line feed, for each row of one string column; gives the folders that hold them.

    A file costs much the same whatever its size, so rows are dealt to tasks by their number, not by bytes. Every attempt
    of a task writes a folder of its own, and only folders of attempts that Spark committed are given. Spark's own text
    writer is not used: on a local disk it starts several processes for each file, to set permissions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(path)
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        system.create_dir(f"{root}/{name}", recursive=True)
        for k, text in enumerate(text for batch in batches for text in batch.column(0)):
            with system.open_output_stream(f"{root}/{name}/{task.partitionId():06d}-{k:06d}.txt", compression=None) as out:
                out.write((text.as_py() or "").encode() + b"\n")
        yield pa.RecordBatch.from_pydict({"folder": [f"{path}/{name}"]})

    system, root = fs.FileSystem.from_uri(path)
    system.create_dir(root, recursive=True)
    tasks = -(-texts.count() // FILES_A_TASK)
    folders = texts.repartition(max(1, tasks)).mapInArrow(run, "folder string").collect()
    return [row.folder for row in folders] or [path]


def preview(lines: DataFrame, k: int = 3) -> DataFrame:
    """First `k` lines of every file (`file`, `pos`, `line`), whatever their positions; each task passes on at most
    `k` lines of a file."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("pos"))
    return lines.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def preferred_preview(results: DataFrame, output: DataFrame, k: int = 3) -> DataFrame:
    """Preview of the result lines of each file, of its raw output where it has none."""
    head = preview(results, k)
    return head.unionByName(preview(output, k).join(head.select("file").distinct(), "file", "left_anti"))
