"""Inputs of the registered queries, derived from the given tables.

The tables hold no test runs, so runs are read off ``events``; the same SQL
serves Spark and the checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.scalars import action_type

# Error texts as runners write them, one for each rule of the classifier.
RUNS_SQL = """
select *, 'reported as ' || classification as classification_reason from (
select id, test_file, test_name, platform, device_id, duration_ms, result,
  case when result in ('passed', 'skipped') then ''
       when result = 'timedOut' then case k % 3 when 0 then 'actionTimeout 20000ms exceeded' when 1 then 'Timeout 30000ms exceeded while waiting for #element' else 'Test timeout of 120000ms exceeded' end
       else case k % 7 when 0 then 'ExpectError: Expected 1, but received 0' when 1 then 'ExpectError: Expected value to be truthy, but received false' when 2 then 'Error: element is not visible' when 3 then 'Error: Method not found' when 4 then 'Error: Could not verify foreground activity' when 5 then 'Error: fill failed - element detached from DOM' else 'something odd' end
  end as error_message,
  case when k % 50 = 0 then {EMPTY}
       when event_type = 'click' then {ARR}('waitFor(#s)', 'tap(#a)')
       when event_type = 'view' then {ARR}('swipe(up)', 'scrollIntoView(#x)')
       when event_type = 'signup' then {ARR}('tap(#email)', 'FILL(#email)', 'waitFor(#loginScreen)')
       when event_type = 'purchase' then {ARR}('tap(#x)', 'press(Enter)')
       else {ARR}('waitForText(x)') end as last_actions,
  case when result = 'passed' then null when k % 6 = 0 then 'REAL_BUG' when k % 6 = 1 then 'TIMEOUT_FLAKE' when k % 6 = 2 then 'DEVICE_FLAKE' when k % 6 = 3 then 'LOCATOR_FLAKE' when k % 6 = 4 then 'UNKNOWN' end as classification,
  lower(scr) as screen_name,
  case when u % 41 = 0 then '' when u % 43 = 0 then null else concat(coalesce(device_id, 'nodev'), '_', cast(cast(run_at as date) as {S})) end as session_id,
  run_at, cast(run_at as date) as run_date
from (
  select event_id as id, ts as run_at, event_type, u, k, scr,
    concat('tests/', lower(scr), '.spec.ts') as test_file,
    concat(scr, ' - ', event_type, ' case ', cast(u % 7 as {S})) as test_name,
    case when u % 31 = 0 then null when u % 29 = 0 then '' when u % 3 = 0 then 'ios' else 'android' end as platform,
    case when u % 37 = 0 then null else concat('dev', cast(u % 40 as {S})) end as device_id,
    cast(floor(value * 2000) as bigint) as duration_ms,
    case when k % 25 = 0 then 'skipped' when event_type = 'error' and value > 30 then 'timedOut' when event_type = 'error' then 'failed' else 'passed' end as result
  from (
    select event_id, ts, event_type, value, user_id as u, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k,
      case user_id % 11 when 0 then 'Login' when 1 then 'Profile' when 2 then 'Form' when 3 then 'List' when 4 then 'Alert' when 5 then 'animate' when 6 then 'Calendar' when 7 then 'gesture' when 8 then 'media' when 9 then 'Zed 9' else 'checkout' end as scr
    from {EVENTS}) a) b) c
"""
SPARK_WORDS = {
    "S": "string",
    "ARR": "array",
    "EMPTY": "cast(array() as array<string>)",
    "EVENTS": "{events}",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as enriched test runs."""
    view = spark.sql(RUNS_SQL.format(**SPARK_WORDS), events=events(spark, sf_dir))
    return view.withColumn("action_type", action_type(F.col("last_actions")))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as steps of test attempts."""
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("test_id"),
        (F.col("event_id") % 2).cast("int").alias("retry"),
        F.when(kind == "view", "expect").otherwise("pw:api").alias("category"),
        F.concat(kind, F.lit("#"), (F.col("event_id") % 97).cast("string")).alias("title"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.lit(False).alias("is_end"),
    )


def slices(frame: DataFrame, n: int) -> list[DataFrame]:
    """The rows in ``n`` spans of time of equal length, the first one first."""
    ends = frame.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    if ends["low"] is None:
        return [frame]
    width = (ends["high"] - ends["low"]) / n
    cuts = [ends["low"] + width * k for k in range(1, n)]
    ts = F.col("ts")
    parts = [frame.where(ts < F.lit(cuts[0]))]
    parts += [frame.where((ts >= F.lit(a)) & (ts < F.lit(b))) for a, b in zip(cuts, cuts[1:])]
    return [*parts, frame.where(ts >= F.lit(cuts[-1]))]


def with_sixth_class(all_runs: DataFrame) -> DataFrame:
    """The runs, some of whose failures have a category of their own."""
    odd = F.col("classification").isNotNull() & (F.col("id") % 5 == 0)
    return all_runs.withColumn("classification", F.when(odd, "ENV_FLAKE").otherwise(F.col("classification")))


def steps_with_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps, and the end of each attempt right after its last step."""
    all_steps = steps(spark, sf_dir)
    ends = all_steps.groupBy("test_id", "retry").agg(
        F.max("ts").alias("ts"), (F.max("seq") + 1).alias("seq")
    )
    closing = ends.select(
        "test_id",
        "retry",
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("title"),
        "ts",
        "seq",
        F.lit(True).alias("is_end"),
    )
    return all_steps.unionByName(closing)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs timed to the hour, so tests repeat a time; nameless without platform."""
    return runs(spark, sf_dir).select(
        "id",
        F.when(F.col("platform").isNotNull(), F.col("test_name")).alias("test_name"),
        F.date_trunc("hour", "run_at").cast("timestamp_ntz").alias("run_at"),
        "platform",
        "result",
    )


def hourly_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the table holds of these already: the runs on android."""
    return hourly(spark, sf_dir).where(F.col("platform") == "android")


def title_variant() -> Column:
    """Test titles with and without a screen in front, by run id."""
    name = F.col("test_name")
    kind = F.col("id") % 5
    return (
        F.when(kind == 0, name)
        .when(kind == 1, F.replace(name, F.lit(" - "), F.lit(" ")))
        .when(kind == 2, F.concat(F.lit(" - "), name))
        .when(kind == 3, "works as told")
        .otherwise(F.upper(name))
    )


def time_variant() -> Column:
    """Run times in the forms ISO-8601 allows, by run id."""
    at = F.col("run_at")
    kind = F.col("id") % 6
    return (
        F.when(kind == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(kind == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'-05:00'"))
        .when(kind == 3, F.date_format(at, "yyyy-MM-dd"))
        .when(kind == 4, "junk")
        .otherwise(F.date_format(at, "yyyy-MM-dd HH:mm"))
    )


def reply_variant() -> Column:
    """Classifier replies, well-formed, malformed and missing, by run id."""
    i = F.col("id")
    named = (
        F.when(i % 5 == 0, "REAL_BUG")
        .when(i % 5 == 1, " timeout_flake ")
        .when(i % 5 == 2, "DEVICE_FLAKE")
        .when(i % 5 == 3, "Locator_Flake")
        .otherwise("UNKNOWN")
    )
    return (
        F.when(i % 11 == 0, None)
        .when(i % 7 == 0, F.concat(F.lit("  MAYBE: "), F.col("error_message"), F.lit(" ")))
        .when(i % 13 == 0, F.concat(F.lit("GUESS|"), F.col("test_name")))
        .otherwise(F.concat(named, F.lit("| seen in "), F.col("test_name"), F.lit("|again\n")))
    )


def annotations() -> Column:
    """What the runner notes about a run: device and, if known, platforms."""

    def note(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("description"))

    notes = F.array(
        note("issue", F.col("test_name")),
        note("device.id", F.col("device_id")),
        note("device.platform", F.col("platform")),
        note("device.platform", F.lit("second")),
    )
    return F.when(F.col("device_id").isNotNull(), notes).otherwise(F.slice(notes, 1, 1))


def as_detox(all_runs: DataFrame) -> DataFrame:
    error = F.col("error_message")
    return all_runs.select(
        F.replace("test_file", F.lit(".spec.ts"), F.lit(".test.js")).alias("testFilePath"),
        F.col("test_name").alias("testTitle"),
        F.col("duration_ms").alias("duration"),
        F.col("result").alias("status"),
        F.when(error == "", F.array().cast("array<string>"))
        .otherwise(F.array(error, F.concat(F.lit("in "), F.col("test_name"))))
        .alias("failureMessages"),
        "platform",
        "session_id",
        "device_id",
        "run_at",
    )


def as_appium(all_runs: DataFrame) -> DataFrame:
    return all_runs.select(
        F.replace("test_file", F.lit(".spec.ts"), F.lit(".js")).alias("file"),
        F.col("test_name").alias("title"),
        F.col("duration_ms").alias("duration"),
        (F.col("result") == "passed").alias("passed"),
        F.nullif("error_message", F.lit("")).alias("error"),
        F.when(F.size("last_actions") > 0, F.col("last_actions")).alias("commands"),
        "platform",
        "session_id",
        "device_id",
        "run_at",
    )


def as_pytest(all_runs: DataFrame) -> DataFrame:
    return all_runs.select(
        F.when(F.col("result") == "skipped", "setup").otherwise("call").alias("when"),
        F.col("test_file").alias("fspath"),
        F.col("test_name").alias("name"),
        (F.col("duration_ms").cast("double") / 1000).alias("duration"),
        F.nullif("error_message", F.lit("")).alias("exc"),
        "session_id",
        "device_id",
        "run_at",
    )
