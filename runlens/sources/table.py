"""The runs table: Parquet, one partition per day."""

from __future__ import annotations

import hashlib
import time
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.schema import RUNS
from runlens.session import make_folder, read_note, write_note


def create_table(spark: SparkSession, path: str) -> None:
    """Create the table unless it is there."""
    make_folder(spark, path)


def new_load_id(after: int = 0) -> int:
    """An id greater than those of earlier loads: the time in microseconds."""
    return max(time.time_ns() // 1000, after + 1)


def batch_load_id(spark: SparkSession, path: str, stream: str, batch_id: int) -> int:
    """The load id of a stream's micro-batch; the same one when the batch is replayed.

    The newest batch of each stream is noted beside the table before it is loaded.
    """
    note = f"{path}/_loads/{hashlib.sha256(stream.encode()).hexdigest()}"
    last_batch, last_id = map(int, (read_note(spark, note) or "-1 0").split())
    if last_batch != batch_id:
        last_id = new_load_id(last_id)
        make_folder(spark, f"{path}/_loads")
        write_note(spark, note, f"{batch_id} {last_id}")
    return last_id


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(path)


def between(runs: DataFrame, first: date, last: date) -> DataFrame:
    """Runs of the days from ``first`` to ``last``; reads these partitions only."""
    return runs.where(F.col("run_date").between(F.lit(first), F.lit(last)))


def on_days(runs: DataFrame, days) -> DataFrame:
    """Runs of the given days, None for those without one; reads these partitions only."""
    known = [d for d in days if d is not None]
    day = F.col("run_date")
    wanted = day.isin(known) if known else F.lit(False)
    return runs.where(wanted | day.isNull() if None in days else wanted)


def append_table(runs: DataFrame, path: str) -> None:
    """Append rows by day; sorting keeps each file's range of screens narrow.

    The rebalance splits a day too large for one task and joins small ones at
    run time.
    """
    spread = runs.select(*RUNS.fieldNames()).hint("rebalance", F.col("run_date"))
    ordered = spread.sortWithinPartitions("run_date", "screen_name", "test_name")
    ordered.write.mode("append").partitionBy("run_date").parquet(path)

