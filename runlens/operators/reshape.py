"""Windows over daily counts, matrices and dimension values."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from runlens.functions.scalars import is_failed, pct1
from runlens.operators.groups import rate_by
from runlens.operators.measures import as_measures, rollup
from runlens.schema import CLASSES

OTHER = "OTHER"


def rolling_rate(runs: DataFrame, days: int = 7) -> DataFrame:
    """Failure percentage pooled over each day and the ``days - 1`` before it.

    Each day's counts are added to the days they belong to and summed there:
    gaps in the calendar need no care, and no single task sees all days.
    """
    daily = rollup(runs, ["run_date"], ["n_runs", "n_failed"])
    reach = F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("ahead")
    shares = daily.where(F.col("run_date").isNotNull()).select("*", reach)
    pooled = shares.groupBy(
        F.date_add("run_date", F.col("ahead")).alias("day")
    ).agg(
        F.sum("n_runs").alias("total"),
        F.sum("n_failed").alias("fail_count"),
        F.min("ahead").alias("nearest"),
    )
    return (
        pooled.where(F.col("nearest") == 0)
        .select(
            "day",
            "total",
            "fail_count",
            pct1(F.col("fail_count"), F.col("total")).alias("rate"),
        )
        .orderBy("day")
    )


def recent_days(runs: DataFrame, days: int = 60) -> DataFrame:
    """Daily failure percentage of the last ``days`` days that have runs."""
    daily = rate_by(runs, ["run_date"]).where(F.col("run_date").isNotNull())
    last = daily.orderBy(F.col("run_date").desc()).limit(days)
    return last.select(F.col("run_date").alias("day"), "rate").orderBy("day")


def dim_values(df: DataFrame, dims: list[str]) -> DataFrame:
    """Sorted distinct values of each dimension, without NULL, as (dim, value).

    One pass: a row's values are told apart by name and made distinct together.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"))
            for d in dims
        ]
    )
    return (
        df.select(*dims)
        .distinct()
        .select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("dim", "value")
    )


def _classified_failures(runs: DataFrame) -> DataFrame:
    return as_measures(runs).where(is_failed(F.col("result")) & F.col("classification").isNotNull())


def class_counts(runs: DataFrame) -> DataFrame:
    """Failures per day and category, as a map of all categories the day has."""
    cells = _classified_failures(runs).groupBy(F.col("run_date").alias("day"), "classification")
    pairs = F.sort_array(F.collect_list(F.struct("classification", "n")))
    counted = cells.agg(F.sum("n_runs").alias("n")).groupBy("day").agg(pairs.alias("pairs"))
    return counted.select("day", F.map_from_entries("pairs").alias("counts")).orderBy("day")


def class_matrix(runs: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    """Failures per day, a column per given category and ``OTHER`` for all the rest."""
    klass = F.col("classification")
    cells = [
        F.sum(F.when(which, F.col("n_runs")).otherwise(0)).alias(name)
        for name, which in [*((c, klass == c) for c in classes), (OTHER, ~klass.isin(*classes))]
    ]
    failed = _classified_failures(runs)
    return failed.groupBy(F.col("run_date").alias("day")).agg(*cells).orderBy("day")


def heat_rows(cells: DataFrame) -> DataFrame:
    """Per screen, its daily rates in order and their unweighted mean.

    ``cells`` are heatmap rows (day, screen, rate). A screen's list has one
    entry per calendar day. Rates have one decimal, so their sum is exact in
    tenths.
    """
    in_order = F.array_sort(F.collect_list(F.struct("day", "rate")))
    tenths = F.sum(F.round(F.col("rate") * F.lit(10.0)).cast("bigint"))
    return (
        cells.groupBy("screen")
        .agg(
            in_order.alias("days"),
            F.round(tenths.cast("double") / (F.count("rate") * F.lit(10.0)))
            .cast("bigint")
            .alias("avg_rate"),
        )
        .orderBy("screen")
    )


def heat_matrix(cells: DataFrame, days: list[date]) -> DataFrame:
    """The heatmap with one column per given day; a missing cell is NULL."""
    columns = [
        F.max(F.when(F.col("day") == F.lit(d), F.col("rate"))).alias(d.isoformat())
        for d in days
    ]
    return cells.groupBy("screen").agg(*columns).orderBy("screen")


def heat_arrays(cells: DataFrame) -> DataFrame:
    """The heatmap over all its days: (screen, days, rates), alike in length for every screen, missing cells NULL.

    The day axis is one value a calendar day, so it goes to all tasks.
    """
    axis = cells.select("day").distinct().agg(F.sort_array(F.collect_list("day")).alias("days"))
    own = cells.groupBy("screen").agg(F.map_from_entries(F.collect_list(F.struct("day", "rate"))).alias("own"))
    own = own.join(F.broadcast(axis.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"))
    rates = F.transform("days", lambda d: F.try_element_at("own", d))
    return own.select("screen", "days", rates.alias("rates")).orderBy("screen")


def with_places(df: DataFrame, folder: str, *order: Column) -> DataFrame:
    """The rows with ``place``, from 1 in the given order, which must have no ties; staged in a folder.

    Rows are sorted in ranges; a row's place is the number of rows in the ranges before its
    own, which are a few numbers, and its place in it.
    """
    # an id has the range in its upper 31 bits and the row's place there in the lower 33
    at = F.monotonically_increasing_id()
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at).write.parquet(folder)
    rows = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("_at", LongType())])).parquet(folder)
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))  # a row a range
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(starts), "_range").select(*df.columns, place.alias("place"))
