"""The reports over test runs.

Each takes the runs table or a rollup of it (``measures.rollup``) and gives a
DataFrame. Sorted results end in a tie-break, so they are the same every time; with
``sort=False`` the rows come in any order, for a reader that orders them anyway.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.scalars import (
    class_label,
    date_range,
    duration_place,
    is_failed,
    is_present,
    pct1,
    pct1_half_even,
    whole_seconds,
)
from runlens.operators.groups import by_count, newest, rate_by
from runlens.operators.measures import SESSION, as_measures, rollup

FIRST_DAYS = 60
TOP_TESTS = 20
TOP_SESSIONS = 20
MIN_RUNS = 2


def _day(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("run_date", "day")


def stats(runs: DataFrame) -> DataFrame:
    """One row over the whole table; counts but the total are NULL without runs."""
    one, klass = as_measures(runs), F.col("classification")
    totals = one.agg(
        F.coalesce(F.sum("n_runs"), F.lit(0).cast("bigint")).alias("total_runs"),
        F.sum("n_failed").alias("fail_count"),
        F.sum(F.when(klass.isNotNull(), F.col("n_runs")).otherwise(0)).alias("classified_count"),
        F.sum(F.when(klass == "REAL_BUG", F.col("n_runs")).otherwise(0)).alias("real_bug_count"),
        F.sum("duration_sum").alias("duration_sum"),
        F.sum("n_timed").alias("n_timed"),
        F.min("run_date").alias("first_day"),
        F.max("run_date").alias("last_day"),
    )
    rate = pct1_half_even(F.col("fail_count"), F.col("total_runs"))
    seconds = whole_seconds(F.col("duration_sum"), F.col("n_timed"))
    return totals.select(
        "total_runs",
        "fail_count",
        "classified_count",
        "real_bug_count",
        F.coalesce(rate, F.lit(0.0)).alias("flake_rate"),
        F.coalesce(seconds, F.lit(0).cast("bigint")).alias("avg_duration"),
        date_range(F.col("first_day"), F.col("last_day")).alias("date_range"),
    )


def flake_rate(runs: DataFrame, days: int = FIRST_DAYS) -> DataFrame:
    """Failure percentage of the first ``days`` days that have runs."""
    daily = _day(rate_by(runs, ["run_date"])).select("day", "rate")
    return daily.orderBy("day").limit(days)


def _in(order: list, rows: DataFrame, sort: bool) -> DataFrame:
    return rows.orderBy(*order) if sort else rows


def breakdown(runs: DataFrame, sort: bool = True) -> DataFrame:
    """Failures per category; those without one are UNCLASSIFIED.

    Groups by the stored value, so a category of that very name is a row apart.
    """
    failed = as_measures(runs).where(is_failed(F.col("result")))
    counts = rollup(failed, ["classification"], ["n_runs"])
    labelled = counts.select(
        class_label(F.col("classification")).alias("classification"),
        F.col("n_runs").alias("count"),
    )
    return _in([F.col("count").desc(), "classification"], labelled, sort)


def heatmap(runs: DataFrame, sort: bool = True) -> DataFrame:
    """Failure percentage per day and screen with at least two runs."""
    named = as_measures(runs).where(is_present(F.col("screen_name")))
    cells = rate_by(named, ["run_date", "screen_name"], MIN_RUNS)
    cells = cells.select(F.col("run_date").alias("day"), F.col("screen_name").alias("screen"), "rate")
    return _in(["day", "screen"], cells, sort)


def by_fail_ratio(groups: DataFrame, *ties) -> DataFrame:
    """Groups with (total, fail_count), those that fail most often first."""
    ratio = F.col("fail_count").cast("double") / F.col("total")
    return groups.orderBy(ratio.desc(), F.col("total").desc(), *ties)


def top_by_ratio(groups: DataFrame, keys: list[str], k: int = TOP_TESTS) -> DataFrame:
    """The ``k`` groups that fail most often."""
    return by_fail_ratio(groups, *[F.col(c).asc_nulls_last() for c in keys]).limit(k)


def top_flakes(runs: DataFrame) -> DataFrame:
    """The tests that fail most, per platform, with their screen and usual category.

    The usual category is that of the test's failures on all platforms. Runs
    shrink to cells in one scan; the cells of a test are then brought together
    once, and both results come from that partitioning.
    """
    cells = rollup(
        runs,
        ["test_name", "platform", "screen_name", "classification"],
        ["n_runs", "n_failed", "last_run"],
    ).repartition("test_name")
    per_class = Window.partitionBy("test_name", "classification")
    per_test = Window.partitionBy("test_name")
    judged = cells.withColumn("class_fails", F.sum("n_failed").over(per_class))
    usual = F.max(by_count(F.col("class_fails"), F.col("classification"))).over(per_test)
    judged = judged.withColumn(
        "common", F.when(F.col("test_name").isNotNull(), usual["value"])
    )
    groups = (
        judged.groupBy("test_name", "platform")
        .agg(
            newest(F.col("last_run"), F.col("screen_name"))["screen_name"].alias("screen_name"),
            F.sum("n_runs").alias("total"),
            F.sum("n_failed").alias("fail_count"),
            F.first("common").alias("common_classification"),
        )
        .where(F.col("total") >= MIN_RUNS)
    )
    return top_by_ratio(groups, ["test_name", "platform"])


def devices(runs: DataFrame, sort: bool = True) -> DataFrame:
    """Devices by how often runs fail on them, with their usual category."""
    cells = rollup(
        runs,
        ["device_id", "platform", "classification"],
        ["n_runs", "n_failed", "last_run"],
    ).repartition("device_id")
    per_class = cells.groupBy("device_id", "classification").agg(
        newest(F.col("last_run"), F.col("platform")).alias("last"),
        F.sum("n_runs").alias("n_runs"),
        F.sum("n_failed").alias("n_failed"),
    )
    groups = (
        per_class.groupBy("device_id")
        .agg(
            F.max("last")["platform"].alias("platform"),
            F.sum("n_runs").alias("total"),
            F.sum("n_failed").alias("fail_count"),
            F.max(by_count(F.col("n_failed"), F.col("classification")))["value"].alias("common"),
        )
        .where(F.col("total") >= MIN_RUNS)
    )
    groups = groups.select(
        "device_id",
        "platform",
        "total",
        "fail_count",
        F.when(F.col("device_id").isNotNull(), F.col("common")).alias("common_classification"),
    )
    return by_fail_ratio(groups, F.col("device_id").asc_nulls_last()) if sort else groups


def by_action(runs: DataFrame, sort: bool = True) -> DataFrame:
    named = as_measures(runs).where(is_present(F.col("action_type")))
    rates = rate_by(named, ["action_type"]).drop("pass_count")
    return _in([F.col("rate").desc(), "action_type"], rates, sort)


def by_platform(runs: DataFrame, sort: bool = True) -> DataFrame:
    named = as_measures(runs).where(is_present(F.col("platform")))
    rates = rate_by(named, ["platform"]).withColumnRenamed("rate", "fail_rate")
    return _in([F.col("fail_rate").desc(), "platform"], rates, sort)


def volume(runs: DataFrame, sort: bool = True) -> DataFrame:
    daily = _day(rate_by(runs, ["run_date"]))
    return _in(["day"], daily.select("day", "pass_count", "fail_count"), sort)


def duration_dist(runs: DataFrame, sort: bool = True) -> DataFrame:
    """Failures per duration band, shortest first."""
    failed = as_measures(runs).where(is_failed(F.col("result")))
    bands = rollup(failed, ["duration_band"], ["n_runs"])
    bands = bands.select(F.col("duration_band").alias("bucket"), F.col("n_runs").alias("count"))
    return _in([duration_place(F.col("bucket"))], bands, sort)


def class_trend(runs: DataFrame, sort: bool = True) -> DataFrame:
    """Failures with a category per day and category."""
    failed = as_measures(runs).where(
        is_failed(F.col("result")) & F.col("classification").isNotNull()
    )
    counts = _day(rollup(failed, ["run_date", "classification"], ["n_runs"]))
    return _in(["day", "classification"], counts.withColumnRenamed("n_runs", "count"), sort)


def _all_sessions(runs: DataFrame) -> DataFrame:
    """Every session, with the platform and device of its newest run."""
    named = as_measures(runs).where(is_present(F.col("session_id")))
    cells = rollup(named, SESSION)
    sessions = cells.groupBy("session_id").agg(
        newest(F.col("last_run"), F.col("platform"), F.col("device_id")).alias("last"),
        F.sum("n_runs").alias("total_runs"),
        F.sum("n_passed").alias("passed"),
        F.sum("n_failed").alias("failed"),
        whole_seconds(F.sum("duration_sum"), F.sum("n_timed")).alias("avg_duration_s"),
        F.min("first_run").alias("first_run"),
        F.max("last_run").alias("last_run"),
    )
    return sessions.select(
        "session_id",
        "last.platform",
        "last.device_id",
        "total_runs",
        "passed",
        "failed",
        "avg_duration_s",
        "first_run",
        "last_run",
    )


def first_day_of_newest(runs: DataFrame, k: int, days: list[date]) -> date | None:
    """A day from which on at least ``k`` sessions have runs; None if no known day is.

    ``days`` are those that the rows are stored by, newest first. A session that has no run
    since then is older than all that do, so the ``k`` newest are among these. The days
    are tried from the newest back, four times as many each time.
    """
    n = 1
    while n <= len(days):
        first = days[n - 1]
        since = runs.where((F.col("run_date") >= F.lit(first)) & is_present(F.col("session_id")))
        if since.select("session_id").distinct().limit(k).count() >= k:
            return first
        n *= 4
    return None


def newest_ids(runs: DataFrame, k: int, days: list[date] | None = None) -> DataFrame:
    """(session_id) of the ``k`` newest sessions, by their newest runs alone.

    The days that rows are stored by, where given, are read only as far back as needed.
    """
    named = as_measures(runs).where(is_present(F.col("session_id")))
    first = first_day_of_newest(runs, k, days) if days else None
    if first is not None:
        named = named.where(F.col("run_date") >= F.lit(first))
    last = named.groupBy("session_id").agg(F.max("last_run").alias("last_run"))
    return last.orderBy(F.col("last_run").desc(), "session_id").limit(k).select("session_id")


def _newest_sessions(runs: DataFrame, k: int, days: list[date] | None = None) -> DataFrame:
    """The ``k`` newest sessions.

    Where rows are stored by day, ``k`` ids are found in the newest days, and only these
    sessions' rows are brought together. Otherwise one pass over all rows makes all sessions.
    """
    chosen = runs
    if days:
        ids = F.broadcast(newest_ids(runs, k, days))
        chosen = as_measures(runs).join(ids, "session_id", "left_semi")
    return _all_sessions(chosen).orderBy(F.col("last_run").desc(), "session_id").limit(k)


def sessions(runs: DataFrame, k: int = TOP_SESSIONS, days: list[date] | None = None) -> DataFrame:
    """The ``k`` newest sessions."""
    return _newest_sessions(runs, k, days)


def latest_session(runs: DataFrame, days: list[date] | None = None) -> DataFrame:
    """One row for the newest session; zero counts when there is none."""
    top = _newest_sessions(runs, 1, days)
    zero = F.lit(0).cast("bigint")
    return top.agg(
        F.max("session_id").alias("session_id"),
        F.max("platform").alias("platform"),
        F.max("device_id").alias("device_id"),
        *[F.coalesce(F.max(c), zero).alias(c) for c in ("total_runs", "passed", "failed")],
        F.max("avg_duration_s").alias("avg_duration_s"),
    )


def _in_order(found: DataFrame) -> DataFrame:
    """Runs picked from the table, by time.

    They are shuffled before the sort, which would otherwise scan the table
    twice: once to learn the ranges and once to fill them.
    """
    return found.repartition("id").orderBy("run_at", *_identity(found))


def _identity(runs: DataFrame) -> list[str]:
    """What tells runs apart, in the order of insertion."""
    return [c for c in ("load_id", "id") if c in runs.columns]


def latest_session_tests(
    runs: DataFrame, rolled: DataFrame | None = None, days: list[date] | None = None, sort: bool = True
) -> DataFrame:
    """The runs of the newest session in order, one row each.

    ``rolled`` may be a session rollup of the runs. The session's days, one row
    per calendar day, are broadcast, and prune the partitions of ``runs``; runs
    without a day are looked up by session alone.
    """
    cells = as_measures(runs if rolled is None else rolled).where(is_present(F.col("session_id")))
    if days:
        cells = cells.join(F.broadcast(newest_ids(cells, 1, days)), "session_id", "left_semi")
    ends = [F.min("first_run").alias("first_run"), F.max("last_run").alias("last_run")]
    top = cells.groupBy("session_id").agg(*ends).orderBy(F.col("last_run").desc(), "session_id").limit(1)
    span = F.sequence(F.col("first_run").cast("date"), F.col("last_run").cast("date"))
    # an explode of an array with a NULL gives the days, and one row for runs without one
    every = F.array_append(F.coalesce(span, F.array().cast("array<date>")), F.lit(None).cast("date"))
    spanned = top.select(F.col("session_id").alias("_session"), F.explode(every).alias("_day"))
    rows = runs.select(
        *_identity(runs),
        "session_id",
        "run_date",
        "run_at",
        "test_name",
        "result",
        "duration_ms",
        "platform",
        "screen_name",
        "classification",
    )
    same = (F.col("session_id") == F.col("_session")) & F.col("run_date").eqNullSafe(F.col("_day"))
    found = rows.join(F.broadcast(spanned), same, "left_semi").drop("run_date")
    return _in_order(found) if sort else found


def session_runs(runs: DataFrame, session_id: str) -> DataFrame:
    """The runs of one session in order."""
    return _in_order(runs.where(F.col("session_id") == F.lit(session_id)))


def batch_summary(runs: DataFrame) -> DataFrame:
    """One row: total, passed, failed and the pass percentage of a batch."""
    totals = as_measures(runs).agg(
        F.coalesce(F.sum("n_runs"), F.lit(0).cast("bigint")).alias("total"),
        F.coalesce(F.sum("n_passed"), F.lit(0).cast("bigint")).alias("passed"),
        F.coalesce(F.sum("n_failed"), F.lit(0).cast("bigint")).alias("failed"),
    )
    return totals.withColumn("pass_pct", pct1(F.col("passed"), F.col("total")))


REPORTS = {
    "stats": stats,
    "flake_rate": flake_rate,
    "breakdown": breakdown,
    "heatmap": heatmap,
    "top_flakes": top_flakes,
    "devices": devices,
    "by_action": by_action,
    "by_platform": by_platform,
    "volume": volume,
    "duration_dist": duration_dist,
    "class_trend": class_trend,
    "sessions": sessions,
    "latest_session": latest_session,
}
