"""Every operator as a query over the given tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.functions import display, failures, scalars, screens
from runlens.operators import dedupe, grid, groups, lookup, measures, reshape
from runlens.operators import steps as step_ops
from runlens.plans import bundle, classify_batch, reports
from runlens.plans.ingest import load_runs
from runlens.schema import STEP_EVENT
from runlens.session import new_folder
from runlens.sources import frameworks, jsonl, table
from runlens.streaming.ingest import stream_ingest
from runlens.streaming.last_actions import ended_attempts, stream_last_actions
from runlens.workload import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SESSION_ASKED = "dev5_2024-01-05"
HOUR_KEYS = ["test_name", "run_at"]


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def over_runs(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a query that needs the runs only."""
    QUERIES[make.__name__] = lambda spark, sf_dir: make(inputs.runs(spark, sf_dir))
    return make


def _flat(records: DataFrame) -> DataFrame:
    return records.withColumn("last_actions", F.array_join("last_actions", "|"))


def _iso():
    return F.concat(F.replace(F.col("run_at").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


# Sources, sinks and table maintenance


@query
def read_runs(spark, sf_dir):
    """Some durations have half a millisecond more than the runs."""
    folder = new_folder(spark, "records")
    half = F.when(F.col("id") % 9 == 0, 0.5).otherwise(0.0)
    runs = inputs.runs(spark, sf_dir).withColumn("duration_ms", F.col("duration_ms") + half)
    jsonl.append_runs_json(jsonl.to_records(runs), folder)
    return _flat(jsonl.read_runs(spark, folder).drop(*jsonl.POSITION))


@query
def append_runs_json(spark, sf_dir):
    folder, runs = new_folder(spark, "records"), inputs.runs(spark, sf_dir)
    passed = F.col("result") == "passed"
    jsonl.append_runs_json(jsonl.to_records(runs.where(passed)), folder)
    jsonl.append_runs_json(jsonl.to_records(runs.where(~passed)), folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


@query
def runs_table(spark, sf_dir):
    """The runs in two loads."""
    folder = new_folder(spark, "table")
    table.create_table(spark, folder)
    runs = inputs.runs(spark, sf_dir).withColumn("run_at_text", _iso())
    for load in (0, 1):
        part = runs.where(F.col("id") % 2 == load).withColumn("load_id", F.lit(load).cast("bigint"))
        table.append_table(part, folder)
    stored = table.read_table(spark, folder)
    return stored.select("load_id", "id", "run_date", "run_at", "test_name", "action_type", "duration_ms")


@query
def merge_new_runs(spark, sf_dir):
    incoming, stored = inputs.hourly(spark, sf_dir), inputs.hourly_stored(spark, sf_dir)
    return dedupe.merge_new_runs(incoming, stored, HOUR_KEYS, ["id"])


@over_runs
def report_json(runs):
    return bundle.report_json(reports.by_platform(runs))


def _tests(runs: DataFrame) -> DataFrame:
    return runs.select("test_file", "test_name", "screen_name").distinct()


@over_runs
def run_grid(runs):
    return grid.run_grid(_tests(runs))


@over_runs
def grid_cross(runs):
    planned = grid.run_grid(_tests(runs))
    return planned.groupBy("test_name", "device_id").agg(
        F.count(F.lit(1)).alias("planned"), F.max("run_date").alias("last_day")
    )


@over_runs
def report_bundle(runs):
    """The reports' rows with their places."""
    rows = bundle.report_bundle(runs)
    place = F.row_number().over(Window.partitionBy("report").orderBy("position"))
    return rows.select("report", place.alias("place"), "payload")


# Projections and scalar expressions


@over_runs
def action_type(runs):
    return runs.select("id", scalars.action_type(F.col("last_actions")).alias("action_type"))


@over_runs
def screen_of(runs):
    title = inputs.title_variant()
    return runs.select(
        "id", title.alias("title"), screens.screen_of(title, F.col("last_actions")).alias("screen")
    )


@over_runs
def annotation_value(runs):
    notes = inputs.annotations()
    return runs.select(
        "id",
        scalars.annotation_value(notes, "device.platform").alias("platform"),
        scalars.annotation_value(notes, "device.id").alias("device_id"),
    )


@over_runs
def platform_fallback(runs):
    noted = scalars.annotation_value(inputs.annotations(), "device.platform")
    project = F.when(F.col("screen_name") != "login", F.col("screen_name"))
    return runs.select("id", scalars.platform_fallback(noted, project).alias("platform"))


@over_runs
def run_day(runs):
    text = inputs.time_variant()
    return runs.select("id", text.alias("text"), scalars.run_day(text).alias("day"))


@over_runs
def pass_fail_flags(runs):
    result = F.nullif("result", F.lit("skipped"))
    return runs.select(
        "id",
        scalars.pass_flag(result).alias("passed"),
        scalars.fail_flag(result).alias("failed"),
    )


@over_runs
def duration_bucket(runs):
    duration = F.when(F.col("device_id").isNotNull(), F.col("duration_ms"))
    return runs.select("id", scalars.duration_bucket(duration).alias("bucket"))


@over_runs
def class_label(runs):
    return runs.select("id", scalars.class_label(F.col("classification")).alias("label"))


@over_runs
def pct1(runs):
    counts = groups.rate_by(runs, ["test_name", "run_date"])
    half_even = scalars.pct1_half_even(F.col("fail_count"), F.col("total"))
    return counts.select("test_name", "run_date", "rate", half_even.alias("rate_half_even"))


@over_runs
def avg_seconds(runs):
    return runs.groupBy("test_name").agg(
        scalars.avg_seconds(F.col("duration_ms")).alias("avg_duration_s")
    )


@over_runs
def failure_prompt(runs):
    asked = classify_batch.with_prompts(runs)
    return asked.where(F.col("prompt").isNotNull()).select("id", "prompt")


@over_runs
def parse_reply(runs):
    reply = inputs.reply_variant()
    return runs.select("id", failures.parse_reply(reply).alias("parsed")).select("id", "parsed.*")


@over_runs
def rule_classify(runs):
    found = classify_batch.with_rules(runs)
    return found.select("id", "found.*")


@over_runs
def merge_class(runs):
    found = failures.parse_reply(inputs.reply_variant())
    incoming = F.struct("classification", "classification_reason")
    final = failures.merge_class(F.col("result"), found, incoming)
    return runs.select("id", final.alias("final")).select("id", "final.*")


@over_runs
def actions_json(runs):
    text = scalars.actions_json(F.col("last_actions"))
    return runs.select(
        "id", text.alias("text"), F.size(scalars.actions_from_json(text)).alias("n_actions")
    )


@over_runs
def date_range(runs):
    span = scalars.date_range(F.min("run_date"), F.max("run_date"))
    return runs.groupBy("test_name").agg(span.alias("date_range"))


@over_runs
def severity_bands(runs):
    rates = groups.rate_by(runs, ["test_name", "platform"])
    bar = display.bar_pct(F.col("fail_count"), F.col("total"))
    passed = display.session_pct(F.col("pass_count"), F.col("total"))
    return rates.select(
        "test_name",
        "platform",
        display.rate_band(F.col("rate")).alias("rate_band"),
        display.heat_band(F.col("rate")).alias("heat_band"),
        display.bar_band(bar).alias("bar_band"),
        display.pass_band(passed).alias("pass_band"),
    )


@over_runs
def display_text(runs):
    device = F.concat(F.lit("a device with a long name "), F.col("device_id"))
    return runs.select(
        "id",
        display.session_label(F.concat("session_id", F.lit("_"), "test_name")).alias("session"),
        display.device_label(device).alias("device"),
        display.minute_label(F.col("run_at")).alias("minute"),
        display.day_label(F.col("run_date")).alias("day"),
    )


@over_runs
def display_pct(runs):
    failed, total = F.col("n_failed"), F.col("n_runs")
    counts = measures.as_measures(runs).groupBy("test_name").agg(
        F.sum("n_runs").alias("n_runs"),
        F.sum("n_passed").alias("n_passed"),
        F.sum("n_failed").alias("n_failed"),
        F.count("classification").alias("classified"),
        F.count_if(F.col("classification") == "REAL_BUG").alias("bugs"),
    )
    return counts.select(
        "test_name",
        display.rate_text(failed, total).alias("fail_pct"),
        display.bar_pct(failed, total).alias("bar_pct"),
        display.whole_pct(F.col("bugs"), F.col("classified")).alias("bug_share"),
        display.session_pct(F.col("n_passed"), total).alias("pass_pct"),
    )


@over_runs
def issue_default(runs):
    return runs.select(
        "id",
        display.issue_label(F.col("classification")).alias("issue"),
        display.text_label(F.col("platform")).alias("platform"),
    )


def _detox(runs):
    return frameworks.conform_detox(
        inputs.as_detox(runs), F.col("platform"), F.col("session_id"), _iso(), F.col("device_id")
    )


def _appium(runs):
    return frameworks.conform_appium(
        inputs.as_appium(runs), F.col("platform"), F.col("device_id"), F.col("session_id"), _iso()
    )


def _pytest(runs):
    return frameworks.conform_pytest(
        inputs.as_pytest(runs), F.col("session_id"), _iso(), F.col("device_id")
    )


@over_runs
def conform_detox(runs):
    return _flat(_detox(runs))


@over_runs
def conform_appium(runs):
    return _flat(_appium(runs))


@over_runs
def conform_pytest(runs):
    return _flat(_pytest(runs))


@query
def conform_capture(spark, sf_dir):
    """Steps and attempts of the step-recording runner, to records."""
    steps = inputs.steps(spark, sf_dir)
    attempts = steps.groupBy("test_id", "retry").agg(
        F.lit("tests/a.spec.ts").alias("test_file"),
        F.concat(F.lit("Login - case "), F.col("test_id")).alias("test_name"),
        F.lit("web").alias("project"),
        F.array(
            F.struct(F.lit("device.id").alias("type"), F.concat(F.lit("d"), F.col("retry")).alias("description"))
        ).alias("annotations"),
        F.count(F.lit(1)).alias("duration_ms"),
        F.when(F.col("retry") == 0, "failed").otherwise("passed").alias("result"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit("s").alias("session_id"),
        F.lit("2026-01-15T10:30:00Z").alias("run_at"),
    )
    found = frameworks.conform_capture(attempts, step_ops.last_actions(steps))
    return _flat(
        found.select("test_name", "platform", "device_id", "duration_ms", "result", "error_message", "screen_name", "last_actions")
    )


# Filters


@over_runs
def failed_only(runs):
    return runs.where(scalars.is_failed(F.col("result"))).select("id", "result")


@over_runs
def present_dim(runs):
    kept = runs.where(scalars.is_present(F.col("platform")) & scalars.is_present(F.col("session_id")))
    return kept.select("id", "platform", "session_id")


@over_runs
def classified_only(runs):
    return runs.where(F.col("classification").isNotNull()).select("id", "classification")


@over_runs
def min_runs(runs):
    kept = groups.rate_by(runs, ["test_name", "device_id", "run_date"], min_rows=2)
    return kept.select("test_name", "device_id", "run_date", "total")


@over_runs
def session_runs(runs):
    return reports.session_runs(runs, SESSION_ASKED).select(
        "id", "run_at", "test_name", "result", "duration_ms"
    )


@query
def api_steps(spark, sf_dir):
    steps = inputs.steps(spark, sf_dir)
    return steps.where(scalars.is_api_step(F.col("category"))).select("seq", "test_id", "title")


# Joins


@query
def dedupe_anti(spark, sf_dir):
    incoming, stored = inputs.hourly(spark, sf_dir), inputs.hourly_stored(spark, sf_dir)
    return dedupe.not_stored(incoming, stored, HOUR_KEYS)


def _common_class(runs, key):
    failed = runs.where(scalars.is_failed(F.col("result")))
    return groups.common_value_by(failed, [key], "classification", "common_classification")


@over_runs
def test_common_class(runs):
    return _common_class(runs, "test_name")


@over_runs
def device_common_class(runs):
    return _common_class(runs, "device_id")


@over_runs
def rate_lookup(runs):
    return lookup.rate_gap(runs)


@over_runs
def latest_session_tests(runs):
    return reports.latest_session_tests(runs)


# Reports


def _report(name):
    return lambda spark, sf_dir: reports.REPORTS[name](inputs.runs(spark, sf_dir))


QUERIES.update({name: _report(name) for name in reports.REPORTS})


@query
def load_counts(spark, sf_dir):
    """What two loads report: the runs on android, then all of them."""
    folder = new_folder(spark, "loads")
    hourly = inputs.runs(spark, sf_dir).withColumn(
        "run_at", F.date_trunc("hour", "run_at").cast("timestamp_ntz")
    )
    found = []
    for k, part in enumerate((hourly.where(F.col("platform") == "android"), hourly)):
        jsonl.append_runs_json(jsonl.to_records(part), f"{folder}/in{k}")
        counts = load_runs(spark, f"{folder}/in{k}", f"{folder}/runs")
        found.append((k, counts.processed, counts.classified, counts.skipped, len(counts.days)))
    return spark.createDataFrame(
        found, "load int, processed bigint, classified bigint, skipped bigint, days bigint"
    )


@over_runs
def seed_summary(runs):
    return reports.batch_summary(runs)


# Windows, ordering, top-k


@over_runs
def rolling7(runs):
    return reshape.rolling_rate(runs)


@over_runs
def recent60(runs):
    return reshape.recent_days(runs)


@query
def last_actions_n(spark, sf_dir):
    return _flat(step_ops.last_actions(inputs.steps(spark, sf_dir)))


@query
def first_wins(spark, sf_dir):
    return dedupe.first_wins(inputs.hourly(spark, sf_dir), HOUR_KEYS, ["id"])


@over_runs
def topk_ratio(runs):
    top = reports.top_by_ratio(groups.rate_by(runs, ["device_id", "screen_name"]), ["device_id", "screen_name"])
    return top.select("device_id", "screen_name", "total", "fail_count")


@over_runs
def topk_sessions(runs):
    return reports.sessions(runs).select("session_id", "last_run")


@over_runs
def order_by_agg(runs):
    """Tests in the order of their shortest run, with their places."""
    cells = measures.rollup(runs, ["test_name"], ["n_runs", "duration_min"])
    folder = new_folder(runs.sparkSession, "places")
    placed = reshape.with_places(cells, folder, F.asc("duration_min"), F.asc("test_name"))
    return placed.select("test_name", "n_runs", F.col("place").cast("int").alias("place"))


# Set operations and reshaping


@over_runs
def dim_values(runs):
    return reshape.dim_values(runs, ["screen_name", "run_date", "classification"])


@over_runs
def union_sources(runs):
    """Each platform's runs come from the framework that tests it."""
    platform = F.coalesce("platform", F.lit(""))
    return _flat(
        frameworks.union_sources(
            [
                _detox(runs.where(platform == "ios")),
                _appium(runs.where(platform == "android")),
                _pytest(runs.where(~platform.isin("ios", "android"))),
            ]
        )
    )


@over_runs
def class_matrix(runs):
    return reshape.class_matrix(inputs.with_sixth_class(runs))


@over_runs
def class_counts(runs):
    counts = reshape.class_counts(inputs.with_sixth_class(runs))
    pair = lambda c: F.concat(c["key"], F.lit("="), c["value"].cast("string"))
    entries = F.transform(F.sort_array(F.map_entries("counts")), pair)
    return counts.select("day", F.array_join(entries, "|").alias("counts"))


@over_runs
def heat_matrix(runs):
    """The heatmap over all days: a rate a day for every screen, '-' where it has none."""
    matrix = reshape.heat_arrays(reports.heatmap(runs, sort=False))
    rate = lambda r: F.coalesce(r.cast("string"), F.lit("-"))
    return matrix.select(
        "screen", F.size("days").alias("n_days"), F.array_join(F.transform("rates", rate), "|").alias("rates")
    )


@over_runs
def heat_rows(runs):
    rows = reshape.heat_rows(reports.heatmap(runs))
    cell = lambda c: F.concat(c["day"].cast("string"), F.lit("="), c["rate"].cast("string"))
    return rows.select(
        "screen", F.array_join(F.transform("days", cell), "|").alias("days"), "avg_rate"
    )


# Streaming


@query
def stream_last(spark, sf_dir):
    """Steps arrive in four spans of time; attempts reach over several of them."""
    folder = new_folder(spark, "steps")
    for part in inputs.slices(inputs.steps_with_ends(spark, sf_dir), 4):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(STEP_EVENT).parquet(f"{folder}/in")
        stream_last_actions(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    found = ended_attempts(spark, f"{folder}/out")
    return _flat(found.select("test_id", "retry", "last_actions"))


QUERIES["stream_last_actions"] = QUERIES.pop("stream_last")


@query
def stream_ingest_runs(spark, sf_dir):
    folder = new_folder(spark, "ingest")
    hourly = inputs.runs(spark, sf_dir).withColumn(
        "run_at", F.date_trunc("hour", "run_at").cast("timestamp_ntz")
    )
    last = hourly.agg(F.max("id").alias("id")).first()["id"] or 0
    for third in range(3):  # a run of the stream, and so a micro-batch at least, for each
        part = hourly.where(F.floor(F.col("id") * 3 / (last + 1)) == third).orderBy("id")
        jsonl.append_runs_json(jsonl.to_records(part), f"{folder}/in")
        stream_ingest(
            spark, f"{folder}/in", f"{folder}/runs", f"{folder}/checkpoint", rollups=f"{folder}/rollups"
        ).awaitTermination()
    stored = table.read_table(spark, f"{folder}/runs")
    return stored.select(
        "test_name", "run_at", "run_date", "platform", "device_id", "result", "action_type", "classification"
    )


QUERIES["stream_ingest"] = QUERIES.pop("stream_ingest_runs")


# Pluggable classifier


def digest_classifier() -> classify_batch.Classifier:
    """A stand-in for a model: a reply, a malformed one or an error, by digest."""

    def classify(prompt: str) -> str | None:
        first = hashlib.md5(prompt.encode()).hexdigest()[0]
        if first in "0123":
            return f"REAL_BUG|digest {first}"
        if first in "4567":
            return f" timeout_flake | digest {first} "
        if first in "89ab":
            return f"no idea {first}"
        raise ValueError("unavailable")

    return classify


@query
def classify_batch_runs(spark, sf_dir):
    folder = new_folder(spark, "replies")
    runs = inputs.runs(spark, sf_dir)
    calls = classify_batch.Calls(parallelism=8)
    found = classify_batch.with_classifier(runs, digest_classifier(), folder, calls)
    incoming = F.struct("classification", "classification_reason")
    final = failures.merge_class(F.col("result"), F.col("found"), incoming)
    return found.select("id", final.alias("final")).select("id", "final.*")


QUERIES["classify_batch"] = QUERIES.pop("classify_batch_runs")
