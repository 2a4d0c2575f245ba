"""Reading, deduplicating, classifying and storing run records."""

import json
from datetime import date, datetime

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from runlens.operators.dedupe import first_wins, merge_new_runs, not_stored
from runlens.plans import classify_batch
from runlens.plans.ingest import LoadCounts, load_records, load_runs
from runlens.schema import RUNS
from runlens.sources import frameworks
from runlens.sources.jsonl import append_runs_json, read_runs, read_runs_lenient, to_records
from runlens.sources.table import between, create_table, read_table
from runlens.streaming.ingest import stream_ingest


def record(**changes):
    base = {
        "test_file": "tests/a.spec.ts", "test_name": "login - works", "platform": "ios", "device_id": "d",
        "duration_ms": 4500, "result": "passed", "error_message": "", "last_actions": ["tap(#a)"],
        "classification": None, "classification_reason": None, "screen_name": "login",
        "session_id": "s", "run_at": "2026-01-15T10:30:00Z",
    }
    return {**base, **changes}


def write_lines(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
    return str(path)


def test_read_fills_what_may_be_missing(spark, tmp_path):
    bare = {"test_name": "t", "result": "failed", "run_at": "2026-01-15T10:30:00Z"}
    path = write_lines(tmp_path / "r.jsonl", [record(), "", bare, "   "])
    got = read_runs(spark, path).orderBy("id").collect()
    assert [r.last_actions for r in got] == [["tap(#a)"], []]
    assert (got[1].error_message, got[1].platform, got[1].duration_ms) == ("", None, None)


@pytest.mark.parametrize("bad", ["{not json", '{"test_name": "t", "result": "passed"}'])
def test_strict_load_commits_nothing(spark, tmp_path, bad):
    path = write_lines(tmp_path / "r.jsonl", [record(), bad])
    with pytest.raises((PySparkException, Py4JJavaError)):
        load_runs(spark, path, str(tmp_path / "runs"))
    assert read_table(spark, str(tmp_path / "runs")).count() == 0


def test_lenient_load_sets_bad_lines_aside(spark, tmp_path):
    bad = ["{not json", {"test_name": "t", "result": "passed"}]
    path = write_lines(tmp_path / "r.jsonl", [record(), *bad])
    good, rejected = read_runs_lenient(spark, path)
    assert good.count() == 1 and rejected.count() == 2
    counts = load_runs(spark, path, str(tmp_path / "runs"), quarantine=str(tmp_path / "bad"))
    assert counts == LoadCounts(processed=1, classified=0, skipped=0)
    assert spark.read.json(str(tmp_path / "bad")).count() == 2


def test_load_classifies_and_loads_once(spark, tmp_path):
    lines = [
        record(),
        record(run_at="2026-01-15T10:31:00Z", result="failed", error_message="Error: Method not found"),
        record(device_id="second"),
        record(run_at="2026-01-16T23:30:00-05:00", classification="REAL_BUG"),
        record(run_at="someday"),
        record(run_at="someday", device_id="second"),
    ]
    path, table = write_lines(tmp_path / "r.jsonl", lines), str(tmp_path / "runs")
    assert load_runs(spark, path, table) == LoadCounts(processed=6, classified=1, skipped=2)
    assert load_runs(spark, path, table) == LoadCounts(processed=6, classified=0, skipped=6)
    got = {r.run_at_text: r for r in read_table(spark, table).collect()}
    assert len(got) == 4 and {r.device_id for r in got.values()} == {"d"}
    assert got["2026-01-15T10:31:00Z"].classification == "DEVICE_FLAKE"
    moved = got["2026-01-16T23:30:00-05:00"]
    assert (moved.run_at, moved.run_date) == (datetime(2026, 1, 17, 4, 30), date(2026, 1, 17))
    assert (moved.classification, moved.action_type) == (None, "tap")
    assert (got["someday"].run_at, got["someday"].run_date) == (None, None)
    assert between(read_table(spark, table), date(2026, 1, 17), date(2026, 1, 18)).count() == 1


def test_create_table_twice(spark, tmp_path):
    for _ in range(2):
        create_table(spark, str(tmp_path / "runs"))
    assert read_table(spark, str(tmp_path / "runs")).count() == 0


def test_first_in_the_file_wins_across_splits(spark, tmp_path):
    lines = [record(device_id=f"d{i}", test_name=f"t{i % 5}") for i in range(2000)]
    path, table = write_lines(tmp_path / "r.jsonl", lines), str(tmp_path / "runs")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records = read_runs(spark, path)
        assert records.rdd.getNumPartitions() > 5
        load_records(records, table)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = read_table(spark, table).select("test_name", "device_id").collect()
    assert sorted(map(tuple, got)) == [(f"t{i}", f"d{i}") for i in range(5)]


def test_hot_and_missing_keys(spark):
    """A third of the rows share a key, a third have none."""
    n = 30000
    third = F.col("id") % 3
    incoming = spark.range(n, numPartitions=8).select(
        "id",
        F.when(third == 0, "hot").when(third == 1, F.concat(F.lit("t"), "id")).alias("test_name"),
        F.when(third != 2, F.lit(1)).alias("run_at"),
    )
    stored = incoming.where((third == 1) & (F.col("id") < n // 2))
    keys = ["test_name", "run_at"]
    firsts = first_wins(incoming, keys, ["id"])
    assert firsts.where("test_name = 'hot'").collect()[0][:] == (0, "hot", 1, n // 3)
    assert firsts.where("test_name is null").count() == n // 3
    fresh = merge_new_runs(incoming, stored, keys, ["id"])
    assert fresh.count() == 1 + n // 3 + n // 6
    assert not_stored(incoming, stored, keys).count() == n - n // 6
    assert merge_new_runs(fresh.drop("copies"), fresh, keys, ["id"]).where("test_name is not null").count() == 0


def test_keys_without_a_value_never_match(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x")], "id bigint, test_name string, run_at string")
    assert merge_new_runs(df, df, ["test_name", "run_at"], ["id"]).count() == 2


def test_append_json_keeps_absent_values(spark, tmp_path):
    path = write_lines(tmp_path / "r.jsonl", [record(platform=None)])
    records = read_runs(spark, path)
    for _ in range(2):
        append_runs_json(records, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == [record(platform=None)] * 2


def test_table_rows_become_records_again(spark, tmp_path):
    path, table = write_lines(tmp_path / "r.jsonl", [record()]), str(tmp_path / "runs")
    load_runs(spark, path, table)
    assert json.loads(to_records(read_table(spark, table)).toJSON().first()) == {
        k: v for k, v in record().items() if v is not None
    }


@pytest.fixture
def shouting():
    def classify(prompt):
        if "refuse" in prompt:
            raise ValueError("down")
        if "silent" in prompt:
            return None
        return "device_flake|" + prompt.split("Error: ")[1].split("\n")[0]

    return classify


def test_classifier_is_asked_once_per_question(spark, tmp_path, shouting):
    errors = ["same"] * 30 + ["refuse", "silent"] + [f"own {i}" for i in range(20)]
    lines = [
        record(test_name=f"t" , run_at=f"2026-01-15T10:30:{i:02d}Z", result="failed", error_message=e,
               classification="REAL_BUG", classification_reason="before")
        for i, e in enumerate(errors)
    ]
    path, table = write_lines(tmp_path / "r.jsonl", lines + [record()]), str(tmp_path / "runs")
    assert load_runs(spark, path, table, shouting) == LoadCounts(processed=53, classified=50, skipped=0)
    got = {r.error_message: (r.classification, r.classification_reason) for r in read_table(spark, table).collect()}
    assert got["same"] == ("DEVICE_FLAKE", "same")
    assert got["own 7"] == ("DEVICE_FLAKE", "own 7")
    assert got["refuse"] == got["silent"] == ("REAL_BUG", "before")
    assert got[""] == (None, None)


@pytest.mark.parametrize("hot, chars", [(1, 1000), (5, 1000), (1000, 3)])
def test_broadcast_replies_change_nothing(spark, tmp_path, monkeypatch, shouting, hot, chars):
    runs = spark.range(300).select(
        "id",
        F.lit("t").alias("test_name"),
        F.lit("ios").alias("platform"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 17)).alias("error_message"),
        F.array().cast("array<string>").alias("last_actions"),
        F.when(F.col("id") % 10 == 1, "passed").otherwise("failed").alias("result"),
        F.lit(None).cast("timestamp_ntz").alias("run_at"),
    )
    monkeypatch.setattr(classify_batch, "HOT_PROMPTS", hot)
    monkeypatch.setattr(classify_batch, "HOT_CHARS", chars)
    calls = classify_batch.Calls(parallelism=4)
    got = classify_batch.with_classifier(runs, shouting, str(tmp_path / "replies"), calls).collect()
    assert len(got) == 300
    for r in got:
        want = None if r.result == "passed" else r.error_message
        assert (r.found and r.found.classification_reason) == want


def rows_per_task(df):
    return sorted(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def hot_failures(spark, n=40_000):
    """Nine in ten failures ask the same question."""
    return spark.range(n, numPartitions=8).select(
        "id", F.lit("t").alias("test_name"), F.lit("ios").alias("platform"),
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id"))).alias("error_message"),
        F.array().cast("array<string>").alias("last_actions"), F.lit("failed").alias("result"),
        F.lit(None).cast("timestamp_ntz").alias("run_at"),
    )


@pytest.fixture
def shuffled_joins(spark):
    """Joins as on large inputs: sorted, and not joined anew at run time."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("kind", ["failing", "long"])
def test_a_hot_question_is_not_one_task(spark, tmp_path, shuffled_joins, kind):
    """Whether its classifier fails or gives a reply too long to broadcast."""

    def classify(prompt):
        if "Error: hot" in prompt:
            if kind == "failing":
                raise ValueError("down")
            return "REAL_BUG|" + "x" * 1500
        return "REAL_BUG|fine"

    runs = hot_failures(spark)
    found = classify_batch.with_classifier(runs, classify, str(tmp_path / "replies"))
    counts = rows_per_task(found)
    assert sum(counts) == 40_000 and counts[-1] < 2.5 * 40_000 / len(counts)
    hot = found.where("error_message = 'hot'")
    answered = hot.where("found.classification is not null").count()
    assert answered == (0 if kind == "failing" else 36_000)


def test_replies_last_and_failures_are_counted(spark, tmp_path, shouting):
    asked = str(tmp_path / "asked")

    def counting(prompt):
        with open(asked, "a") as f:
            f.write("x")
        return shouting(prompt)

    from runlens.plans.ingest import Asking

    asking = Asking(counting, str(tmp_path / "replies"), classify_batch.Calls(parallelism=2))
    lines = [record(run_at=f"2026-01-15T10:30:{i:02d}Z", result="failed", error_message=e) for i, e in enumerate(["a", "a", "refuse"])]
    first = load_runs(spark, write_lines(tmp_path / "1.jsonl", lines), str(tmp_path / "runs"), asking)
    assert (first.classified, first.unanswered, len(open(asked).read())) == (2, 1, 2)
    again = load_runs(spark, write_lines(tmp_path / "2.jsonl", lines), str(tmp_path / "other"), asking)
    assert (again.classified, again.unanswered, len(open(asked).read())) == (2, 1, 3)


def test_batch_classifier_and_timeout(spark, tmp_path):
    import time

    runs = hot_failures(spark, 20)
    found = classify_batch.with_classifier(
        runs, lambda prompts: "REAL_BUG|" + prompts.str.len().astype(str), str(tmp_path / "a"), batch=True
    )
    assert found.where("found.classification = 'REAL_BUG'").count() == 20
    slow = classify_batch.one_by_one(lambda p: time.sleep(30) if p == "slow" else p, timeout=0.2)
    import pandas as pd

    assert slow(pd.Series(["slow", "quick"])).tolist() == [None, "quick"]


def test_rows_without_a_key_pass_by_the_join(spark, shuffled_joins):
    incoming = hot_failures(spark).select("id", F.when(F.col("id") % 2 == 0, F.col("error_message")).alias("k"))
    fresh = not_stored(incoming, incoming.where("k = 'e0'"), ["k"])
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    # one pass over each side, and the rows without a key are spread by a lane of their own
    assert plan.count("Range (") == 2 and "Union" not in plan and "Aggregate" not in plan
    counts = rows_per_task(fresh.where("k is null"))
    assert sum(counts) == 20_000 and counts[-1] < 2.5 * 20_000 / len(counts)


def test_a_hot_key_is_split(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k) for k in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        incoming = hot_failures(spark, 200_000).select("id", F.col("error_message").alias("k"))
        stored = spark.range(50_000, numPartitions=8).select(F.concat(F.lit("x"), "id").alias("k"))
        counts = rows_per_task(not_stored(incoming, stored, ["k"]))
        assert sum(counts) == 200_000 and counts[-1] < 100_000
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_runs_are_told_apart_over_loads_and_streams(spark, tmp_path):
    table = str(tmp_path / "runs")
    for day in (15, 16):
        lines = [record(run_at=f"2026-01-{day}T10:30:{i:02d}Z") for i in range(3)]
        load_runs(spark, write_lines(tmp_path / f"{day}.jsonl", lines), table)
    lines = [record(run_at=f"2026-01-17T10:30:{i:02d}Z") for i in range(3)]
    write_lines(tmp_path / "in" / "a.jsonl", lines)
    stream_ingest(spark, str(tmp_path / "in"), table, str(tmp_path / "checkpoint")).awaitTermination()
    got = [(r.load_id, r.id, r.run_at_text) for r in read_table(spark, table).collect()]
    assert len({g[:2] for g in got}) == 9
    assert [text for *_, text in sorted(got)] == sorted(text for *_, text in got)


def test_durations_may_be_any_number(spark, tmp_path):
    path = write_lines(tmp_path / "r.jsonl", [record(duration_ms=d) for d in (12.5, 12.4, 7, 1e3, None)])
    got = read_runs(spark, path).orderBy("id").collect()
    assert [r.duration_ms for r in got] == [13, 12, 7, 1000, None]


def test_one_wrong_clock_reads_its_own_day_only(spark, tmp_path):
    from runlens.sources.table import on_days

    table = str(tmp_path / "runs")
    lines = [record(run_at=f"20{year}-01-15T10:30:00Z") for year in range(10, 30)]
    load_runs(spark, write_lines(tmp_path / "1.jsonl", lines), table)
    lines = [record(run_at="1970-01-01T00:00:00Z"), record(run_at="2029-01-15T10:30:00Z")]
    counts = load_runs(spark, write_lines(tmp_path / "2.jsonl", lines), table)
    assert (counts.processed, counts.skipped, set(counts.days)) == (2, 1, {date(1970, 1, 1), date(2029, 1, 15)})
    scan = on_days(read_table(spark, table), counts.days)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [run_date" in scan


def test_a_repeated_lenient_load_sets_aside_once(spark, tmp_path):
    path = write_lines(tmp_path / "r.jsonl", [record(), "{not json"])
    for _ in range(2):
        load_runs(spark, path, str(tmp_path / "runs"), quarantine=str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "bad")).count() == 1


def test_rollups_follow_the_stream(spark, tmp_path):
    from runlens.plans.bundle import reports

    where = [str(tmp_path / name) for name in ("in", "runs", "checkpoint")]
    for k in range(2):
        write_lines(tmp_path / "in" / f"{k}.jsonl", [record(run_at=f"2026-01-1{k}T10:30:00Z")])
        stream_ingest(spark, *where, rollups=str(tmp_path / "rollups")).awaitTermination()
    stats = reports(read_table(spark, where[1]), str(tmp_path / "rollups"))["stats"].first()
    assert (stats.total_runs, stats.date_range) == (2, "2026-01-10 to 2026-01-11")


def test_frameworks(spark):
    at, sid = F.lit("2026-01-15T10:30:00Z"), F.lit("s")
    detox = spark.createDataFrame(
        [("src/a.test.js.test.js", "t", 5, "failed", ["x", None, "y"]), ("b.js", "u", 6, "passed", None)],
        "testFilePath string, testTitle string, duration bigint, status string, failureMessages array<string>",
    )
    got = frameworks.conform_detox(detox, F.lit("ios"), sid, at).collect()
    assert [(r.screen_name, r.error_message, r.device_id) for r in got] == [
        ("a.test.js", "x\n\ny", "unknown"), ("b.js", "", "unknown"),
    ]
    appium = spark.createDataFrame(
        [("tests/android/login.js", "t", 5, True, None, None), ("x.js", "t", 5, None, "e", ["click"])],
        "file string, title string, duration bigint, passed boolean, error string, commands array<string>",
    )
    got = frameworks.conform_appium(appium, F.lit("android"), F.lit("d"), sid, at).collect()
    assert [(r.screen_name, r.result, r.error_message, r.last_actions) for r in got] == [
        ("login", "passed", "", []), ("x", "failed", "e", ["click"]),
    ]
    pytest_rows = spark.createDataFrame(
        [("setup", "f", "n", 1.0, None), ("call", "f", "n", 1.2349, None), ("call", "f", "m", 0.0, "boom")],
        "when string, fspath string, name string, duration double, exc string",
    )
    got = frameworks.conform_pytest(pytest_rows, sid, at).collect()
    assert [(r.screen_name, r.duration_ms, r.result, r.platform, r.device_id) for r in got] == [
        ("n", 1234, "passed", "selenium", "chrome"), ("m", 0, "failed", "selenium", "chrome"),
    ]
    both = frameworks.union_sources([frameworks.conform_pytest(pytest_rows, sid, at), detox.select("testTitle")])
    assert both.count() == 4 and "testTitle" in both.columns


def test_capture(spark):
    attempts = spark.createDataFrame(
        [(1, 0, "f", "zap", "web", [("device.id", "d")], 9, "failed", None, "s", "2026-01-15T10:30:00Z"),
         (2, 0, "f", "Login - x", "web", [("device.platform", "ios")], 9, "passed", "", "s", "2026-01-15T10:30:00Z")],
        """test_id bigint, retry int, test_file string, test_name string, project string,
        annotations array<struct<type:string,description:string>>, duration_ms bigint, result string,
        error_message string, session_id string, run_at string""",
    )
    steps = spark.createDataFrame([(1, 0, ["tap(#photo)"])], "test_id bigint, retry int, last_actions array<string>")
    got = frameworks.conform_capture(attempts, steps).orderBy("test_name").collect()
    assert [(r.screen_name, r.platform, r.device_id, r.last_actions) for r in got] == [
        ("login", "ios", "", []), ("media", "web", "d", ["tap(#photo)"]),
    ]


def test_stream_loads_new_files_only(spark, tmp_path):
    table, checkpoint = str(tmp_path / "runs"), str(tmp_path / "checkpoint")
    write_lines(tmp_path / "in" / "a.jsonl", [record(), record(device_id="again")])

    def load(at=checkpoint):
        stream_ingest(spark, str(tmp_path / "in"), table, at).awaitTermination()
        return read_table(spark, table).count()

    assert load() == 1
    write_lines(tmp_path / "in" / "b.jsonl", [record(), record(run_at="2026-01-16T10:30:00Z")])
    assert load() == 2
    assert load() == 2
    assert load(str(tmp_path / "lost-checkpoint")) == 2


def test_stream_sets_bad_lines_aside(spark, tmp_path):
    write_lines(tmp_path / "in" / "a.jsonl", [record(), "{not json", {"test_name": "t"}])
    where = [str(tmp_path / name) for name in ("in", "runs", "checkpoint")]
    stream_ingest(spark, *where, quarantine=str(tmp_path / "bad")).awaitTermination()
    assert read_table(spark, where[1]).count() == 1
    texts = {r.record for r in spark.read.json(str(tmp_path / "bad")).collect()}
    assert texts == {"{not json", '{"test_name":"t"}'}


def test_a_large_day_is_spread_over_tasks(spark, tmp_path):
    """One day holds most rows; its partition is split and small ones are joined."""
    from runlens.sources.table import append_table

    rows = spark.range(200_000, numPartitions=8).select(
        "id",
        *[F.sha2(F.concat(F.lit(c), "id"), 256).alias(c) for c in ("test_name", "error_message")],
        F.date_add(F.lit(date(2026, 1, 1)), F.when(F.col("id") < 1000, F.col("id") % 5).otherwise(9).cast("int")).alias("run_date"),
    )
    columns = {f.name: F.lit(None).cast(f.dataType) for f in RUNS.fields if f.name not in rows.columns}
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4MB"}
    before = {k: spark.conf.get(k) for k in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        append_table(rows.withColumns(columns), str(tmp_path / "runs"))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "runs").glob("run_date=*")}
    assert files["run_date=2026-01-10"] > 3
    assert [n for day, n in files.items() if day != "run_date=2026-01-10"] == [1] * 5
    assert read_table(spark, str(tmp_path / "runs")).count() == 200_000
