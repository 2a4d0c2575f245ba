"""A run plan: every test on every day and device, repeated."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The devices of a plan and their platforms.
DEVICES = [("Medium_Phone_API_36.0", "android"), ("emulator-5554", "android")]


def run_grid(
    tests: DataFrame,
    devices: list[tuple[str, str]] = DEVICES,
    first_day: date = date(2024, 1, 1),
    num_days: int = 30,
    runs_per_day: int = 5,
) -> DataFrame:
    """Planned runs of each test, generated in place from the distributed tests.

    The other dimensions are literals of known length, so each test expands
    where it is and nothing is shuffled.
    """
    device = F.array(
        *[F.struct(F.lit(d).alias("device_id"), F.lit(p).alias("platform")) for d, p in devices]
    )
    expanded = (
        tests.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(num_days - 1))))
        .withColumn("device", F.explode(device))
        .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(runs_per_day))))
    )
    return expanded.select(
        *tests.columns,
        "device.device_id",
        "device.platform",
        "day",
        "repeat",
        F.date_add(F.lit(first_day), F.col("day")).alias("run_date"),
        F.concat_ws("_", "device.device_id", "day").alias("session_id"),
    )
