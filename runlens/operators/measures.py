"""Runs as additive measures, so a report reads raw runs and rollups alike.

A raw run is a group of one. Every measure is a sum, a minimum or a maximum of
fixed width, so aggregation is a hash aggregate with map-side combining at
each level, and a hot key leaves a map task as one row per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.scalars import duration_bucket, fail_flag, pass_flag

DIMENSIONS = [
    "run_date",
    "test_name",
    "platform",
    "device_id",
    "screen_name",
    "action_type",
    "session_id",
    "classification",
    "result",
    "load_id",
]
MEASURES = {
    "n_runs": F.sum,
    "n_passed": F.sum,
    "n_failed": F.sum,
    "n_timed": F.sum,
    "duration_sum": F.sum,
    "duration_min": F.min,
    "first_run": F.min,
    "last_run": F.max,
}
# Narrow rollups, each as fine as its reports need: tests and devices vary too
# much together for one rollup of both to be smaller than the runs.
COUNTS = ["n_runs", "n_passed", "n_failed", "last_run"]
ROLLUPS = {
    "daily": (
        ["screen_name", "action_type", "platform", "classification", "result", "duration_band"],
        list(MEASURES),
    ),
    "test": (["test_name", "platform", "screen_name", "classification"], COUNTS),
    "device": (["device_id", "platform", "classification"], COUNTS),
    "session": (["session_id", "platform", "device_id"], list(MEASURES)),
}
SESSION = ROLLUPS["session"][0]
# Which loads the cells of a day come from.
LOADS = (["load_id"], ["n_runs"])


def as_measures(runs: DataFrame) -> DataFrame:
    """Runs with measure columns; a rollup is returned as it is."""
    if "n_runs" in runs.columns:
        return runs
    duration, result = F.col("duration_ms"), F.col("result")
    return runs.select(
        *[d for d in DIMENSIONS if d in runs.columns],
        duration_bucket(duration).alias("duration_band"),
        F.lit(1).cast("bigint").alias("n_runs"),
        pass_flag(result).cast("bigint").alias("n_passed"),
        fail_flag(result).cast("bigint").alias("n_failed"),
        F.when(duration.isNotNull(), 1).otherwise(0).cast("bigint").alias("n_timed"),
        duration.alias("duration_sum"),
        duration.alias("duration_min"),
        F.col("run_at").alias("first_run"),
        F.col("run_at").alias("last_run"),
    )


def rollup(
    runs: DataFrame, dimensions: list[str], measures: list[str] | None = None
) -> DataFrame:
    """Runs or a rollup, grouped by the dimensions."""
    merged = [MEASURES[m](m).alias(m) for m in measures or MEASURES]
    return as_measures(runs).groupBy(*dimensions).agg(*merged)
