"""Grouped operators behind the reports: rates, common values, latest values.

Each reduces the input to small cells first, with fixed-width buffers, and only
then compares or orders inside a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.scalars import pct1
from runlens.operators.measures import rollup


def rate_by(df: DataFrame, keys: list[str], min_rows: int = 1) -> DataFrame:
    """Totals and failure percentage per group of at least ``min_rows`` runs."""
    counts = rollup(df, keys, ["n_runs", "n_passed", "n_failed"])
    return counts.where(F.col("n_runs") >= min_rows).select(
        *keys,
        F.col("n_runs").alias("total"),
        F.col("n_passed").alias("pass_count"),
        F.col("n_failed").alias("fail_count"),
        pct1(F.col("n_failed"), F.col("n_runs")).alias("rate"),
    )


def by_count(count: Column, value: Column) -> Column:
    """A counted value, to be compared; its greatest is the most common value.

    Equal counts go to the greater value, NULL being least. A value that was
    never counted does not take part.
    """
    ranked = F.struct(
        count.alias("n"), F.coalesce(value, F.lit("")).alias("rank"), value.alias("value")
    )
    return F.when(count > 0, ranked)


def common_value_by(
    df: DataFrame, keys: list[str], value: str, alias: str
) -> DataFrame:
    """Per group, the value most of its rows have; groups with a NULL key match nothing."""
    present = df
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    cells = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(*keys).agg(
        F.max(by_count(F.col("n"), F.col(value)))["value"].alias(alias)
    )


def newest(moment: Column, *values: Column) -> Column:
    """Aggregate over cells: a struct of the values of the newest cell.

    Cells of the same moment go to the greater values, NULL being least.
    """
    return F.max(F.struct(moment.alias("moment"), *values))


def latest_by(df: DataFrame, keys: list[str], moment: str, values: list[str]) -> DataFrame:
    """Per group, the values its newest row has."""
    cells = df.groupBy(*keys, *values).agg(F.max(moment).alias(moment))
    last = newest(F.col(moment), *[F.col(v) for v in values]).alias("last")
    return cells.groupBy(*keys).agg(last).select(
        *keys, *[F.col("last")[v].alias(v) for v in values]
    )
