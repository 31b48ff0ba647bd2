"""Declared schemas; nothing in this package infers one."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SCORED_CSV = _strings("name", "score", "date")

CLEAN_COLUMNS = ["url", "title", "h1", "meta_description", "texto"]
CLEAN_RESULT = _strings(*CLEAN_COLUMNS)
RECORD = _strings(*CLEAN_COLUMNS[1:])

PREFS = T.StructType(
    [
        T.StructField(
            "domain_overrides",
            T.MapType(T.StringType(), T.StructType([T.StructField("limit", T.IntegerType())])),
        )
    ]
)

METRICS = T.StructType(
    [
        T.StructField("correct", T.DoubleType()),
        T.StructField("time_s", T.DoubleType()),
        T.StructField("peak_mb", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)

TRIAL_LOG = T.StructType([T.StructField("metrics", METRICS), T.StructField("rc", T.IntegerType())])

LEADERBOARD = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("task_root", T.StringType()),
        T.StructField("expected", T.StringType()),
        T.StructField("backend", T.StringType()),
        T.StructField("persistent", T.BooleanType()),
        T.StructField("allow_net", T.BooleanType()),
        T.StructField("cpus", T.DoubleType()),
        T.StructField("mem_mb", T.LongType()),
        T.StructField("rounds", T.LongType()),
        T.StructField("repeats", T.LongType()),
        T.StructField("timeout_s", T.LongType()),
        T.StructField("recipes", T.ArrayType(T.StringType())),
        T.StructField("best", METRICS),
    ]
)

TASK_SPEC = T.StructType(
    [
        T.StructField("goal", T.StringType()),
        T.StructField("inputs", T.ArrayType(T.StringType())),
        T.StructField("constraints", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metric", T.StringType()),
        T.StructField("timeout_s", T.IntegerType()),
        T.StructField("io_contract", T.MapType(T.StringType(), T.StringType())),
    ]
)

LINK = T.ArrayType(_strings("text", "href"))
META = T.ArrayType(_strings("key", "value"))
