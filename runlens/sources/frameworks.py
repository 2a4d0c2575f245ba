"""Results of other test frameworks as run records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.schema import RAW_RUN


def _without(text: Column, suffix: str) -> Column:
    """The text without the first occurrence of the suffix."""
    at = F.locate(suffix, text)
    rest = F.substring(text, at + len(suffix), F.length(text))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), rest)).otherwise(text)


def file_screen(path: Column, suffix: str) -> Column:
    """Screen by the last part of a file's path, without its suffix."""
    return _without(F.substring_index(path, "/", -1), suffix)


def _no_actions() -> Column:
    return F.array().cast("array<string>")


def _or_else(value: Column | None, default: str) -> Column:
    return F.lit(default) if value is None else F.coalesce(value, F.lit(default))


def _records(native: DataFrame, **columns: Column) -> DataFrame:
    absent = F.lit(None).cast("string")
    columns = {"classification": absent, "classification_reason": absent} | columns
    return native.select(
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in RAW_RUN.fields]
    )


def conform_detox(
    native: DataFrame,
    platform: Column,
    session_id: Column,
    run_at: Column,
    device_id: Column | None = None,
) -> DataFrame:
    """Rows of (testFilePath, testTitle, duration, status, failureMessages)."""
    messages = F.coalesce("failureMessages", _no_actions())
    return _records(
        native,
        test_file=F.col("testFilePath"),
        test_name=F.col("testTitle"),
        platform=platform,
        device_id=_or_else(device_id, "unknown"),
        duration_ms=F.col("duration"),
        result=F.col("status"),
        error_message=F.array_join(messages, "\n", ""),
        last_actions=_no_actions(),
        screen_name=file_screen(F.col("testFilePath"), ".test.js"),
        session_id=session_id,
        run_at=run_at,
    )


def conform_appium(
    native: DataFrame,
    platform: Column,
    device_id: Column,
    session_id: Column,
    run_at: Column,
) -> DataFrame:
    """Rows of (file, title, duration, passed, error, commands)."""
    return _records(
        native,
        test_file=F.col("file"),
        test_name=F.col("title"),
        platform=platform,
        device_id=device_id,
        duration_ms=F.col("duration"),
        result=F.when(F.col("passed"), "passed").otherwise("failed"),
        error_message=F.coalesce("error", F.lit("")),
        last_actions=F.coalesce("commands", _no_actions()),
        screen_name=file_screen(F.col("file"), ".js"),
        session_id=session_id,
        run_at=run_at,
    )


def conform_pytest(
    native: DataFrame,
    session_id: Column,
    run_at: Column,
    device_id: Column | None = None,
) -> DataFrame:
    """Rows of (when, fspath, name, duration in seconds, exc); only calls count."""
    return _records(
        native.where(F.col("when") == "call"),
        test_file=F.col("fspath"),
        test_name=F.col("name"),
        platform=F.lit("selenium"),
        device_id=_or_else(device_id, "chrome"),
        duration_ms=(F.col("duration") * F.lit(1000)).cast("bigint"),
        result=F.when(F.col("exc").isNull(), "passed").otherwise("failed"),
        error_message=F.coalesce("exc", F.lit("")),
        last_actions=_no_actions(),
        screen_name=F.col("name"),
        session_id=session_id,
        run_at=run_at,
    )


def conform_capture(attempts: DataFrame, steps: DataFrame) -> DataFrame:
    """Finished attempts of the step-recording runner as run records.

    ``attempts`` has (test_id, retry, test_file, test_name, project,
    annotations, duration_ms, result, error_message, session_id, run_at) and
    ``steps`` the last actions per (test_id, retry).
    """
    from runlens.functions.scalars import annotation_value, platform_fallback
    from runlens.functions.screens import screen_of

    rows = attempts.join(steps, ["test_id", "retry"], "left").withColumn(
        "last_actions", F.coalesce("last_actions", _no_actions())
    )
    notes = F.col("annotations")
    return _records(
        rows,
        test_file=F.col("test_file"),
        test_name=F.col("test_name"),
        platform=platform_fallback(annotation_value(notes, "device.platform"), F.col("project")),
        device_id=annotation_value(notes, "device.id"),
        duration_ms=F.col("duration_ms"),
        result=F.col("result"),
        error_message=F.coalesce("error_message", F.lit("")),
        last_actions=F.col("last_actions"),
        screen_name=screen_of(F.col("test_name"), F.col("last_actions")),
        session_id=F.col("session_id"),
        run_at=F.col("run_at"),
    )


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """One table of run records; columns a source lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
