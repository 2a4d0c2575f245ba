"""Expected failure rates by screen and platform, and how far runs are from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.scalars import pct1
from runlens.operators.measures import rollup

# Expected failure rate per screen on (android, ios).
EXPECTED_RATES = {
    "login": (0.15, 0.05),
    "profile": (0.12, 0.04),
    "form": (0.08, 0.03),
    "list": (0.20, 0.06),
    "alert": (0.10, 0.04),
    "animation": (0.18, 0.07),
    "calendar": (0.08, 0.03),
    "gesture": (0.22, 0.08),
    "media": (0.25, 0.10),
    "signature": (0.15, 0.06),
    "home": (0.05, 0.02),
}
DEFAULT_RATE = 0.10


def with_expected_rate(df: DataFrame, rates: dict | None = None) -> DataFrame:
    """Rows with the rate expected for their screen and platform.

    The rates are driver-side literals, so their broadcast has a known size.
    """
    rates = EXPECTED_RATES if rates is None else rates
    rows = [
        (screen, platform, float(rate))
        for screen, pair in rates.items()
        for platform, rate in zip(("android", "ios"), pair)
    ]
    dim = df.sparkSession.createDataFrame(
        rows, "screen_name string, platform string, expected_rate double"
    )
    return df.join(F.broadcast(dim), ["screen_name", "platform"], "left").withColumn(
        "expected_rate", F.coalesce("expected_rate", F.lit(DEFAULT_RATE))
    )


def rate_gap(runs: DataFrame) -> DataFrame:
    """Failure percentage per screen and platform against the expected one.

    Runs are counted first, so the lookup joins one row per group.
    """
    counts = rollup(runs, ["screen_name", "platform"], ["n_runs", "n_failed"])
    rate = pct1(F.col("n_failed"), F.col("n_runs"))
    expected = F.round(F.col("expected_rate") * F.lit(100.0), 1)
    return with_expected_rate(counts).select(
        "screen_name",
        "platform",
        F.col("n_runs").alias("total"),
        F.col("n_failed").alias("fail_count"),
        rate.alias("rate"),
        expected.alias("expected_pct"),
        F.round(rate - expected, 1).alias("gap"),
    )
