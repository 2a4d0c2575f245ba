"""Run records as JSON lines: reading, quarantining and appending."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.scalars import action_type, utc_time
from runlens.schema import MANDATORY, RAW_RUN

CORRUPT = "_corrupt"
# Where a record stands in its input: file, split of the file, row of the split.
POSITION = ["source_file", "source_block", "id"]
# Durations may be any JSON number; they are kept in whole milliseconds, halves up.
AS_READ = T.StructType(
    [T.StructField(f.name, T.DoubleType() if f.name == "duration_ms" else f.dataType) for f in RAW_RUN.fields]
)
WITH_CORRUPT = T.StructType([*AS_READ.fields, T.StructField(CORRUPT, T.StringType())])


def _any_missing() -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in MANDATORY])


def _positioned(records: DataFrame) -> DataFrame:
    return records.select(
        *records.columns,
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
    )


def _numbered(records: DataFrame) -> DataFrame:
    """Number the rows of a load in input order; how files fall into tasks sets the numbers."""
    return records.withColumn("id", F.monotonically_increasing_id())


def _filled(records: DataFrame) -> DataFrame:
    return records.withColumn(
        "last_actions", F.coalesce("last_actions", F.array().cast("array<string>"))
    ).withColumns(
        {
            "error_message": F.coalesce("error_message", F.lit("")),
            "duration_ms": F.floor(F.col("duration_ms") + 0.5).cast("bigint"),
        }
    )


def _checked(records: DataFrame) -> DataFrame:
    """Fail the job when a mandatory key is missing."""
    for key in MANDATORY:
        missing = F.raise_error(F.lit(f"run record without {key}")).cast("string")
        records = records.withColumn(key, F.coalesce(F.col(key), missing))
    return records


def read_runs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Run records; a malformed line or a missing mandatory key fails the job."""
    lines = spark.read.schema(AS_READ).option("mode", "FAILFAST").json(path)
    return _filled(_checked(_numbered(_positioned(lines))))


def _set_apart(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable records, and the text of the others."""
    bad = F.col(CORRUPT).isNotNull() | _any_missing()
    text = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*RAW_RUN.fieldNames())))
    rejected = numbered.where(bad).select(*POSITION, text.alias("record"))
    return _filled(numbered.where(~bad).drop(CORRUPT)), rejected


def read_runs_lenient(
    spark: SparkSession, path: str | list[str]
) -> tuple[DataFrame, DataFrame]:
    """Readable run records, and the text of the others."""
    lines = (
        spark.read.schema(WITH_CORRUPT)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    return _set_apart(_numbered(_positioned(lines)))


def stream_runs(spark: SparkSession, path: str, strict: bool = True, **options: str) -> DataFrame:
    """New run files of a folder as a stream; rows are numbered per micro-batch."""
    reader = spark.readStream.options(**options)
    if strict:
        reader = reader.schema(AS_READ).option("mode", "FAILFAST")
    else:
        reader = reader.schema(WITH_CORRUPT).option("columnNameOfCorruptRecord", CORRUPT)
    return _positioned(reader.json(path))


def from_stream(batch: DataFrame) -> DataFrame:
    """A micro-batch of a strict stream as ``read_runs`` would give it."""
    return _filled(_checked(_numbered(batch)))


def from_stream_lenient(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A micro-batch of a lenient stream as ``read_runs_lenient`` would give it."""
    return _set_apart(_numbered(batch))


def to_table_rows(records: DataFrame) -> DataFrame:
    """Records with the derived columns of the runs table, not yet classified."""
    moment = utc_time(F.col("run_at"))
    return records.select(
        *[c for c in records.columns if c != "run_at"],
        action_type(F.col("last_actions")).alias("action_type"),
        F.col("run_at").alias("run_at_text"),
        moment.alias("run_at"),
        moment.cast("date").alias("run_date"),
    )


def to_records(runs: DataFrame) -> DataFrame:
    """Table rows as raw records again."""
    clock = F.replace(F.col("run_at").cast("string"), F.lit(" "), F.lit("T"))
    text = F.concat(clock, F.lit("Z"))
    if "run_at_text" in runs.columns:
        text = F.coalesce("run_at_text", text)
    return runs.withColumn("run_at", text).select(*RAW_RUN.fieldNames())


def append_runs_json(records: DataFrame, path: str) -> None:
    """Append records as JSON lines, keys without a value included."""
    records.select(*RAW_RUN.fieldNames()).write.mode("append").option(
        "ignoreNullFields", "false"
    ).json(path)
