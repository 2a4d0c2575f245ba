"""Rollups of the runs in a folder: whole days are rewritten, loads are added to what is there.

A folder holds the cells of all rollups by version and day, and notes, the newest of
which says which version holds each day. A version is written under a new name and counts from
the moment its note is there, so a reader sees all of a change or nothing, and what a
failed job leaves behind is never read. The cells that a note replaces stay until the
next one, for readers that have begun.
"""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.measures import LOADS, MEASURES, ROLLUPS, as_measures
from runlens.schema import RUNS
from runlens.session import delete, make_folder, names_in, read_note, write_note
from runlens.sources.table import on_days

NO_DAY = "__HIVE_DEFAULT_PARTITION__"
EVERY = list(dict.fromkeys(["run_date", *(d for dims, _ in (*ROLLUPS.values(), LOADS) for d in dims)]))


def rolled(runs: DataFrame, by_day: bool) -> DataFrame:
    """All rollups from one scan, told apart by ``rollup``; other dimensions are NULL.

    By day there is one more, ``load``: the loads that the cells of a day come from.
    """
    sets = {
        name: [*(["run_date"] if by_day or name == "daily" else []), *dims]
        for name, (dims, _) in ROLLUPS.items()
    }
    if by_day:
        sets["load"] = ["run_date", *LOADS[0]]
    every = [d for d in EVERY if any(d in dims for dims in sets.values())]
    merged = [MEASURES[m](m).alias(m) for m in MEASURES]
    cells = as_measures(runs)
    for absent in set(every) - set(cells.columns):
        cells = cells.withColumn(absent, F.lit(None).cast("bigint"))
    cells = cells.groupingSets([[F.col(d) for d in dims] for dims in sets.values()], *every)
    cells = cells.agg(F.grouping_id().alias("_set"), *merged)
    name = F.lit(None).cast("string")
    for rollup_name, dims in sets.items():
        bits = sum(0 if d in dims else 1 << k for k, d in enumerate(reversed(every)))
        name = F.when(F.col("_set") == bits, rollup_name).otherwise(name)
    return cells.withColumn("rollup", name).drop("_set")


def pick(cells: DataFrame, name: str, by_day: bool) -> DataFrame:
    """One rollup of the cells."""
    dims, measures = ROLLUPS[name]
    keys = ["run_date", *dims] if by_day or name == "daily" else dims
    return cells.where(F.col("rollup") == name).select(*keys, *measures)


def _named(day: date | None) -> str:
    return NO_DAY if day is None else day.isoformat()


def _notes(spark: SparkSession, folder: str) -> list[str]:
    return [n for n in names_in(spark, f"{folder}/notes") if n.isdigit()]


def _held(spark: SparkSession, folder: str, note: str) -> dict[str, str]:
    return json.loads(read_note(spark, f"{folder}/notes/{note}"))


def held_days(spark: SparkSession, folder: str) -> dict[str, str]:
    """The version that holds each day, by the days' names."""
    notes = _notes(spark, folder)
    return _held(spark, folder, notes[-1]) if notes else {}


def days_of(held: dict[str, str]) -> list[date]:
    """The known days, newest first."""
    return sorted((date.fromisoformat(d) for d in held if d != NO_DAY), reverse=True)


def read_cells(spark: SparkSession, folder: str, held: dict[str, str]) -> DataFrame:
    """The cells of the days, with ``rollup``."""
    empty = spark.createDataFrame([], RUNS)
    schema = rolled(empty, by_day=True).schema
    paths = [f"{folder}/cells/version={version}/run_date={day}" for day, version in held.items()]
    if not paths:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", f"{folder}/cells").parquet(*paths)
    return found.select(*schema.fieldNames())


def _write(cells: DataFrame, folder: str, replaced: list[str] | None) -> None:
    """Write the cells' days as a new version; ``replaced`` are the days they stand for, None for all."""
    spark, version = cells.sparkSession, uuid.uuid4().hex
    path = f"{folder}/cells/version={version}"
    spread = cells.hint("rebalance", F.col("run_date"))
    spread.sortWithinPartitions("run_date", "rollup").write.partitionBy("run_date").parquet(path)
    days = [n.removeprefix("run_date=") for n in names_in(spark, path) if n.startswith("run_date=")]
    notes = _notes(spark, folder)
    before = _held(spark, folder, notes[-1]) if notes else {}
    left = {} if replaced is None else {d: v for d, v in before.items() if d not in replaced}
    after = left | dict.fromkeys(days, version)
    make_folder(spark, f"{folder}/notes")
    write_note(spark, f"{folder}/notes/{int(notes[-1]) + 1 if notes else 0:012d}", json.dumps(after), new=True)
    for old in notes[:-1]:  # no reader begins with these any more
        for day, version in _held(spark, folder, old).items():
            if before.get(day) != version and after.get(day) != version:
                delete(spark, f"{folder}/cells/version={version}/run_date={day}")
        delete(spark, f"{folder}/notes/{old}")


def refresh_rollups(
    runs: DataFrame, folder: str, days: tuple[date | None, ...] | None = None
) -> None:
    """Make the rollups the reports read from the runs, all or those of some days.

    The runs are read once, all of these days.
    """
    replaced = None if days is None else [_named(d) for d in days]
    chosen = runs if days is None else on_days(runs, days)
    _write(rolled(chosen, by_day=True), folder, replaced)


def merge_rollups(
    runs: DataFrame, folder: str, load_id: int, days: tuple[date | None, ...]
) -> None:
    """Add the runs of a load to the cells of its days; again, it changes nothing.

    Measures add up, so a day's new cells are its old ones and those of the load,
    reduced together. Only the load's own runs are read: their files hold no other load,
    and the others are skipped by their statistics. Days whose cells name the load have it.
    Without any rollups yet they are made of all runs.
    """
    spark = runs.sparkSession
    if not _notes(spark, folder):
        return refresh_rollups(runs, folder)
    held = held_days(spark, folder)
    old = read_cells(spark, folder, {_named(d): held[_named(d)] for d in days if _named(d) in held})
    same = (F.col("rollup") == "load") & (F.col("load_id") == load_id)
    done = {r.run_date for r in old.where(same).select("run_date").distinct().collect()}
    days = tuple(d for d in days if d not in done)
    if not days:
        return None
    new = on_days(runs.where(F.col("load_id") == load_id), days)
    both = on_days(old, days).unionByName(rolled(new, by_day=True))
    merged = [MEASURES[m](m).alias(m) for m in MEASURES]
    _write(both.groupBy("rollup", *EVERY).agg(*merged), folder, [_named(d) for d in days])
