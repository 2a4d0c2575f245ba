"""Loading run records into the runs table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runlens.functions.failures import merge_class
from runlens.operators.dedupe import first_wins, not_stored
from runlens.plans.classify_batch import BatchClassifier, Calls, Classifier, classify_runs
from runlens.schema import PASSED
from runlens.session import staging
from runlens.sources.jsonl import POSITION, read_runs, read_runs_lenient, to_table_rows
from runlens.sources.table import append_table, create_table, new_load_id, on_days, read_table

KEYS = ["test_name", "run_at_text"]
# Drops plans without rows while they run, and what is counted in them.
EMPTIED = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


@dataclass(frozen=True)
class LoadCounts:
    """Records a load has read, newly categorised and skipped as known.

    ``days`` are those of the records, None among them for records without one.
    ``unanswered`` are added failures that a given classifier had no reply for.
    """

    processed: int
    classified: int
    skipped: int
    days: tuple[date | None, ...] = field(default=(), compare=False)
    unanswered: int = field(default=0, compare=False)
    load_id: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Asking:
    """A classifier, where its replies are kept (None: for this load only), and how it is called."""

    classifier: Classifier | BatchClassifier
    replies: str | None = None
    calls: Calls = Calls()
    batch: bool = False


def merged(runs: DataFrame) -> DataFrame:
    """Runs with their final category and whether it was newly ``found``."""
    incoming = F.struct("classification", "classification_reason")
    final = merge_class(F.col("result"), F.col("found"), incoming)
    return (
        runs.withColumn("newly", F.col("found.classification").isNotNull())
        .withColumn("final", final)
        .withColumn("classification", F.col("final.classification"))
        .withColumn("classification_reason", F.col("final.classification_reason"))
        .drop("final", "found")
    )


def load_records(
    records: DataFrame,
    table: str,
    classifier: Classifier | Asking | None = None,
    load_id: int | None = None,
) -> LoadCounts:
    """Add the records the table does not have; loading them again adds none.

    The records are read once: the first of each key is staged with the number of its copies.
    A narrow pass over these finds the records' days, one value per calendar day: only these
    days of the table can hold a known run and are compared. ``load_id`` must
    ascend from load to load; it is the time in microseconds if not given.
    """
    spark = records.sparkSession
    create_table(spark, table)
    load_id = new_load_id() if load_id is None else load_id
    rows = to_table_rows(records).withColumn("load_id", F.lit(load_id).cast("bigint"))
    asking = classifier if isinstance(classifier, Asking) or classifier is None else Asking(classifier)
    with staging(spark, "load") as folder:
        firsts = first_wins(rows, KEYS, POSITION)
        firsts.write.parquet(f"{folder}/firsts")
        firsts = spark.read.schema(firsts.schema).parquet(f"{folder}/firsts")
        seen = firsts.groupBy("run_date").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("keys")).collect()
        processed, days = sum(r.n for r in seen), tuple(r.run_date for r in seen)
        stored = on_days(read_table(spark, table), days)
        fresh = not_stored(firsts, stored, KEYS, sum(r["keys"] for r in seen))
        if asking is None:
            added = _append(classify_runs(fresh), table)
        else:  # the rows are needed twice: to ask, and to answer
            fresh.write.parquet(f"{folder}/fresh")
            found = classify_runs(
                spark.read.schema(fresh.schema).parquet(f"{folder}/fresh"),
                asking.classifier,
                asking.replies or f"{folder}/replies",
                asking.calls,
                asking.batch,
            )
            added = _append(found, table)
    return LoadCounts(
        processed=processed,
        classified=added["classified"],
        skipped=processed - added["rows"],
        days=days,
        unanswered=added["unanswered"] if asking else 0,
        load_id=load_id,
    )


@contextmanager
def _counting(spark: SparkSession) -> Iterator[None]:
    """Jobs inside count what they were asked to count, even if it is nothing."""
    key = "spark.sql.adaptive.optimizer.excludedRules"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ",".join(filter(None, [before, EMPTIED])))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def _append(found: DataFrame, table: str) -> dict[str, int]:
    """Add the rows, counted while they are written."""
    counts = Observation()
    no_reply = ~F.col("result").eqNullSafe(PASSED) & ~F.col("newly")
    rows = merged(found).observe(
        counts,
        F.count(F.lit(1)).alias("rows"),
        F.count_if("newly").alias("classified"),
        F.count_if(no_reply).alias("unanswered"),
    )
    with _counting(found.sparkSession):
        append_table(rows, table)
    return counts.get


def load_runs(
    spark: SparkSession,
    path: str | list[str],
    table: str,
    classifier: Classifier | Asking | None = None,
    quarantine: str | None = None,
) -> LoadCounts:
    """Load JSON lines. Unreadable records fail the load, or go to ``quarantine``.

    Each input has a folder of its own there, which a repeated load replaces.
    """
    if quarantine is None:
        return load_records(read_runs(spark, path), table, classifier)
    records, rejected = read_runs_lenient(spark, path)
    name = hashlib.sha256("\n".join([path] if isinstance(path, str) else path).encode()).hexdigest()
    rejected.write.mode("overwrite").json(f"{quarantine}/input={name}")
    return load_records(records, table, classifier)
