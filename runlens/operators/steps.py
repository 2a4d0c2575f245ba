"""The last application steps of each test attempt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.scalars import is_api_step

KEEP = 10


def last_actions(steps: DataFrame, keep: int = KEEP) -> DataFrame:
    """Titles of the last ``keep`` steps per (test_id, retry), in order.

    The rank limit is applied on both sides of the shuffle, so a hot attempt
    sends at most ``keep`` rows per map task and collects at most ``keep``.
    """
    newest_first = Window.partitionBy("test_id", "retry").orderBy(
        F.col("ts").desc(), F.col("seq").desc()
    )
    kept = (
        steps.where(is_api_step(F.col("category")))
        .select("test_id", "retry", "ts", "seq", "title")
        .withColumn("rank", F.row_number().over(newest_first))
        .where(F.col("rank") <= keep)
    )
    in_order = F.array_sort(F.collect_list(F.struct("ts", "seq", "title")))
    return kept.groupBy("test_id", "retry").agg(
        F.transform(in_order, lambda s: s["title"]).alias("last_actions")
    )
