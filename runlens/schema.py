"""Schemas and fixed domains of the test-run data model."""

from __future__ import annotations

from pyspark.sql import types as T

PASSED = "passed"

# The failure categories, in their documented order.
CLASSES = ["REAL_BUG", "TIMEOUT_FLAKE", "DEVICE_FLAKE", "LOCATOR_FLAKE", "UNKNOWN"]

# Category of a step that drives the application under test.
API_STEP = "pw:api"

# Names and types of the interchange format, one JSON line per
# finished test, as every framework adapter writes it.
RAW_RUN = T.StructType(
    [
        T.StructField("test_file", T.StringType()),
        T.StructField("test_name", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("result", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("last_actions", T.ArrayType(T.StringType())),
        T.StructField("classification", T.StringType()),
        T.StructField("classification_reason", T.StringType()),
        T.StructField("screen_name", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("run_at", T.StringType()),
    ]
)

MANDATORY = ["test_name", "result", "run_at"]

# The stored table. ``load_id`` ascends with each load and ``id`` with the records of
# a load: together they identify a run, in the order of insertion. ``run_at`` is UTC wall-clock time, so no report depends on
# the session time zone; ``run_at_text`` is the text the record came with and,
# with the test name, identifies the record when it is loaded again.
RUNS = T.StructType(
    [T.StructField("load_id", T.LongType()), T.StructField("id", T.LongType())]
    + [f for f in RAW_RUN.fields if f.name != "run_at"]
    + [
        T.StructField("action_type", T.StringType()),
        T.StructField("run_at_text", T.StringType()),
        T.StructField("run_at", T.TimestampNTZType()),
        T.StructField("run_date", T.DateType()),
    ]
)

ANNOTATIONS = T.ArrayType(
    T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("description", T.StringType()),
        ]
    )
)

# One row per step a test performs; an end row closes the attempt
# (test_id, retry).
STEP_EVENT = T.StructType(
    [
        T.StructField("test_id", T.LongType()),
        T.StructField("retry", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("is_end", T.BooleanType()),
    ]
)
