"""Trials of candidates: scores against a baseline, repeats aggregated, the best one kept, leaderboard.

A trial has `task`, `seq` (order of the trials of a task, unique there), `candidate`, `rc`, `correct`,
`time_s` and `peak_mb`. The baseline of a task is its first trial.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.numbers import score
from pagemill.operators import lookup as lookups
from pagemill.operators import medians

# Metrics of a candidate that was never run.
NO_TRIALS = {"correct": 0.0, "time_s": 9e9, "peak_mb": 0.0, "score": 0.0}


def with_baseline(trials: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """`base_time_s` and `base_peak_mb` of the task's first trial on every trial."""
    base = trials.groupBy("task").agg(
        # One column each: with a struct Spark could not aggregate by hash.
        F.min_by("time_s", "seq").alias("base_time_s"),
        # Memory that was not measured is recorded as 0 and gives no gain.
        F.nullif(F.min_by("peak_mb", "seq"), F.lit(0.0)).alias("base_peak_mb"),
    )
    return lookups.lookup(trials, base, ["task"], spread="seq", hot_rows=hot_rows)


def scored(trials: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """`score` of every trial; `correct` is 0 for a failed one. The baseline itself has nothing to gain on."""
    based = with_baseline(trials, hot_rows)
    points = score(*[F.col(c) for c in ("rc", "correct", "time_s", "peak_mb", "base_time_s", "base_peak_mb")])
    return based.withColumn("score", points).withColumn(
        "correct", F.when(F.col("rc") == 0, F.col("correct")).otherwise(0.0)
    )


def aggregate_repeats(
    trials: DataFrame, candidates: DataFrame | None = None, hot_rows: int = medians.HOT_ROWS
) -> DataFrame:
    """One row per (task, candidate): lowest `correct`, median `time_s` and `score`, median of the measured
    `peak_mb` (the last trial's where none was measured), the last `rc`, the first `seq`, `trials`.

    With `candidates` (task, candidate) those that were never run are there too, with NO_TRIALS.
    """
    keys = ["task", "candidate"]
    plain = trials.groupBy(keys).agg(
        F.min("correct").alias("correct"),
        F.max_by("peak_mb", "seq").alias("_last_peak_mb"),
        F.max_by("rc", "seq").alias("rc"),
        F.min("seq").alias("seq"),
        F.count("*").alias("trials"),
    )
    measured = trials.select(
        *keys, "time_s", "score", F.when(F.col("peak_mb") > 0, F.col("peak_mb")).alias("peak_mb")
    )
    middle = medians.grouped_median(measured, keys, ["time_s", "score", "peak_mb"], hot_rows)
    found = plain.join(middle, keys, "left").select(
        *keys,
        "seq",
        "trials",
        "correct",
        "time_s",
        F.coalesce("peak_mb", "_last_peak_mb", F.lit(0.0)).alias("peak_mb"),
        "score",
        "rc",
    )
    if candidates is None:
        return found
    every = candidates.select(keys).distinct().join(found, keys, "left")
    return every.fillna({**NO_TRIALS, "trials": 0})


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A metric to compare by: missing below all numbers, NaN above."""
    found = pc.fill_null(batch[name].cast(pa.float64()), float("-inf")).to_numpy(zero_copy_only=False)
    return np.where(np.isnan(found), np.inf, found)


class _Staircase:
    """The candidates of a run of a task that no later one of the run beats, falling in both numbers, and the highest
    numbers of the run. Runs that follow one another add up, in any grouping."""

    def __init__(self) -> None:
        self.steps: list[tuple[float, float, pa.RecordBatch]] = []
        self.tops = (float("-inf"), float("-inf"))

    def add(self, rows: pa.RecordBatch, correct: np.ndarray, score: np.ndarray) -> None:
        """Another run, after those so far."""
        tops = correct.max(), score.max()
        while self.steps and (self.steps[-1][0] < tops[0] or self.steps[-1][1] < tops[1]):
            self.steps.pop()
        self.tops = tuple(map(max, self.tops, tops))
        later = [np.append(np.maximum.accumulate(x[::-1])[::-1][1:], -np.inf) for x in (correct, score)]
        for k in np.flatnonzero((correct >= later[0]) & (score >= later[1])).tolist():
            if not self.steps or self.steps[-1][:2] != (correct[k], score[k]):  # of equals the first is enough
                self.steps.append((correct[k], score[k], rows.slice(k, 1)))

    def rows(self, piece: int) -> Iterator[pa.RecordBatch]:
        for batch in pa.Table.from_batches([row for *_, row in self.steps]).combine_chunks().to_batches():
            extra = [pa.repeat(x, batch.num_rows) for x in (piece, *map(float, self.tops))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "_piece", "_c", "_s"])


def _staircases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The staircase of each task of a partition sorted by `task`, `seq`."""
    piece, now, task = TaskContext.get().partitionId(), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        names, metrics = batch["task"], [_numbers(batch, c) for c in ("correct", "score")]
        same = pc.equal(names.slice(1), names.slice(0, len(names) - 1))
        both_null = pc.and_(pc.is_null(names.slice(1)), pc.is_null(names.slice(0, len(names) - 1)))
        same = pc.or_(pc.fill_null(same, False), both_null).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(~same) + 1).tolist(), len(names)]
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            if now is None or names[first].as_py() != task:
                if now is not None:
                    yield from now.rows(piece)
                now, task = _Staircase(), names[first].as_py()
            now.add(batch.slice(first, last - first), *[m[first:last] for m in metrics])
    if now is not None:
        yield from now.rows(piece)


def best(candidates: DataFrame, strict: bool = False) -> DataFrame:
    """The candidate of every task left standing when each one, in `seq` order, replaces the one before if
    its `correct` or its `score` is higher.

    The rule depends on the order, but not on history: the survivor is the first candidate that no later
    one beats in either number. (A candidate standing at the end beats or equals all later ones in both.
    Of the candidates that do, the first is let in, since whatever stood before it and kept it out would
    be an earlier one of them.) So ranges of (task, seq), however they cut a task, are cut down to their
    staircases where they are, and only those and the ranges' highest numbers go on to one place a task.

    `strict` counts the score of a candidate that is not fully correct as 0.
    """
    if strict:
        candidates = candidates.withColumn("score", F.when(F.col("correct") >= 1.0, F.col("score")).otherwise(0.0))
    ranges = candidates.repartitionByRange("task", "seq").sortWithinPartitions("task", "seq")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields]
    steps = ranges.mapInArrow(_staircases, ", ".join([*fields, "_piece bigint", "_c double", "_s double"]))
    later = Window.partitionBy("task").orderBy("_piece").rangeBetween(1, Window.unboundedFollowing)
    standing = steps.withColumns({"_c": F.max("_c").over(later), "_s": F.max("_s").over(later)})

    def unbeaten(own: str, after: str) -> Column:
        return F.col(after).isNull() | (F.coalesce(own, F.lit(float("-inf"))) >= F.col(after))

    rest = [c for c in candidates.columns if c != "task"]
    kept = standing.filter(unbeaten("correct", "_c") & unbeaten("score", "_s"))
    first = kept.groupBy("task").agg(F.min_by(F.struct(*rest), "seq").alias("_best"))
    return first.select("task", *[F.col(f"_best.{c}") for c in rest])


def latest_runs(leaderboard: DataFrame, key: str = "task_root") -> DataFrame:
    """Newest leaderboard row of every task."""
    return leaderboard.groupBy(key).agg(F.max_by(F.struct(*leaderboard.columns), "ts").alias("_run")).select("_run.*")


def top_runs(leaderboard: DataFrame, key: str = "task_root") -> DataFrame:
    """Leaderboard row of every task with the highest score, the earliest of equals."""
    order = F.struct(F.col("best.score"), -F.col("ts"))
    return leaderboard.groupBy(key).agg(F.max_by(F.struct(*leaderboard.columns), order).alias("_run")).select("_run.*")


def recipe_wins(leaderboard: DataFrame, key: str = "task_root") -> DataFrame:
    """In how many tasks' top runs each recipe took part."""
    return (
        top_runs(leaderboard, key)
        .select(F.explode("recipes").alias("recipe"))
        .groupBy("recipe")
        .agg(F.count("*").alias("wins"))
    )
