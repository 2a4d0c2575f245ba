"""Rollups that follow loads, sessions found by day, places, and questions asked in slices."""

import json
import random
import re
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from runlens.functions import failures
from runlens.operators.dedupe import merge_new_runs, not_stored
from runlens.operators.reshape import heat_arrays, with_places
from runlens.plans import bundle, classify_batch, reports
from runlens.plans.ingest import LoadCounts, load_records, load_runs
from runlens.plans.rollups import days_of, held_days, merge_rollups, read_cells, refresh_rollups
from runlens.session import names_in, shared_folder
from runlens.sources.jsonl import read_runs
from runlens.sources.table import batch_load_id, read_table
from runlens.streaming.ingest import stream_ingest

SEED = random.Random(3)


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
    path.write_text("\n".join(json.dumps(r) for r in records) + "\n")
    return str(path)


def varied(first, n):
    return [
        record(
            test_name=f"t{i % 7}", run_at=f"2026-01-{10 + i % 9:02d}T10:{i // 60 % 60:02d}:{i % 60:02d}Z" if i % 11 else f"someday {i}",
            platform=["ios", "web", None, ""][i % 4], device_id=["x", None][i % 2], session_id=f"s{i % 5}",
            screen_name=["home", "list", None][i % 3], duration_ms=[None, 999, 61000][i % 3],
            result=["passed", "failed", "skipped"][i % 3], error_message=["", "Error: Method not found", ""][i % 3],
        )
        for i in range(first, first + n)
    ]


def files(table):
    return {p for p in Path(table).glob("run_date=*/*.parquet")}


SOME = ("stats", "top_flakes", "sessions", "class_trend")


def same_reports(runs, folder, names=SOME):
    for name, report in bundle.reports(runs, folder).items():
        if name not in names:
            continue
        want = reports.REPORTS.get(name, reports.latest_session_tests)(runs)
        assert [tuple(r) for r in report.collect()] == [tuple(r) for r in want.collect()], name


def test_a_late_run_reads_its_load_and_the_cells_of_its_day(spark, tmp_path):
    table, rollups = str(tmp_path / "runs"), str(tmp_path / "rollups")
    load_records(read_runs(spark, write_lines(tmp_path / "1.jsonl", varied(0, 300))), table, load_id=1)
    refresh_rollups(read_table(spark, table), rollups)
    before, held = files(table), held_days(spark, rollups)
    late = record(run_at="2026-01-12T23:00:00Z", result="failed", session_id="late")
    counts = load_records(read_runs(spark, write_lines(tmp_path / "2.jsonl", [late])), table, load_id=2)
    assert (counts.load_id, counts.days) == (2, (date(2026, 1, 12),))
    aside = {p: p.read_bytes() for p in before}
    for p in before:  # none of the earlier runs is there to be read
        p.unlink()
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    for _ in range(2):  # again, it adds nothing
        merge_rollups(read_table(spark, table), rollups, 2, counts.days)
    after = held_days(spark, rollups)
    assert {d for d in after if after[d] != held.get(d)} == {"2026-01-12"}
    for p, data in aside.items():
        p.write_bytes(data)
    spark.catalog.refreshByPath(table)
    same_reports(read_table(spark, table), rollups)
    plan = read_table(spark, table).where("load_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(load_id,2)" in plan


def test_merged_loads_make_the_rollups_of_all_runs(spark, tmp_path):
    table, rollups = str(tmp_path / "runs"), str(tmp_path / "rollups")
    for load in range(4):
        lines = varied(70 * load, 90)  # some are known from the load before
        counts = load_records(read_runs(spark, write_lines(tmp_path / f"{load}.jsonl", lines)), table, load_id=load)
        merge_rollups(read_table(spark, table), rollups, load, counts.days)
    same_reports(read_table(spark, table), rollups, [*reports.REPORTS, "latest_session_tests"])
    assert len(names_in(spark, f"{rollups}/notes")) == 2
    # what no note names but one or two is gone
    held = {f"version={v}/run_date={d}" for d, v in held_days(spark, rollups).items()}
    kept = {f"{p.parent.name}/{p.name}" for p in Path(rollups, "cells").glob("version=*/run_date=*")}
    assert held <= kept and len(kept) <= 2 * len(held)


def test_a_failed_write_is_not_read(spark, tmp_path):
    rollups, table = str(tmp_path / "rollups"), str(tmp_path / "runs")
    load_records(read_runs(spark, write_lines(tmp_path / "1.jsonl", varied(0, 50))), table, load_id=1)
    refresh_rollups(read_table(spark, table), rollups)
    some = next(Path(rollups, "cells").glob("version=*/run_date=*"))
    lost = Path(rollups, "cells", "version=lost", some.name)
    lost.mkdir(parents=True)
    for p in some.rglob("*.parquet"):
        (lost / p.parent.name).mkdir(exist_ok=True)
        (lost / p.parent.name / p.name).write_bytes(p.read_bytes())
    same_reports(read_table(spark, table), rollups)


def test_a_replayed_micro_batch_counts_once(spark, tmp_path):
    where = [str(tmp_path / name) for name in ("in", "runs", "checkpoint")]
    rollups = str(tmp_path / "rollups")
    for k in range(3):
        write_lines(tmp_path / "in" / f"{k}.jsonl", varied(30 * k, 40))
        stream_ingest(spark, *where, rollups=rollups).awaitTermination()
    for name in ("2", ".2.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    stream_ingest(spark, *where, rollups=rollups).awaitTermination()
    runs = read_table(spark, where[1])
    assert runs.count() == 100 and runs.select("load_id").distinct().count() == 3
    same_reports(runs, rollups)


def test_a_batch_keeps_its_load_id(spark, tmp_path):
    table = str(tmp_path / "runs")
    first = batch_load_id(spark, table, "stream", 4)
    assert batch_load_id(spark, table, "stream", 4) == first
    assert batch_load_id(spark, table, "other", 4) > first
    assert batch_load_id(spark, table, "stream", 5) > first


def test_an_empty_load(spark, tmp_path):
    (tmp_path / "none.jsonl").write_text("\n")
    path, table = str(tmp_path / "none.jsonl"), str(tmp_path / "runs")
    assert load_runs(spark, path, table) == LoadCounts(processed=0, classified=0, skipped=0)
    rollups = str(tmp_path / "rollups")
    refresh_rollups(read_table(spark, table), rollups)
    assert held_days(spark, rollups) == {} and days_of({}) == []
    assert read_cells(spark, rollups, {}).count() == 0
    assert bundle.reports(read_table(spark, table), rollups)["stats"].first().total_runs == 0


def test_a_load_reads_its_records_once(spark, tmp_path, monkeypatch):
    from runlens.plans import ingest

    table = str(tmp_path / "runs")
    load_runs(spark, write_lines(tmp_path / "1.jsonl", varied(0, 60)), table)
    seen = []
    plain = ingest.append_table

    def append_table(rows, path):
        seen.append(rows._jdf.queryExecution().executedPlan().toString())
        plain(rows, path)

    monkeypatch.setattr(ingest, "append_table", append_table)
    counts = load_runs(spark, write_lines(tmp_path / "2.jsonl", varied(30, 60)), table)
    assert (counts.processed, counts.skipped) == (60, 30)
    (plan,) = seen
    assert "FileScan json" not in plan and "SortMergeJoin" not in plan
    # the stored runs meet the load's keys where they are
    branch = plan[: plan.index(str(tmp_path / "runs")[:40])].split("\n")
    assert not re.search("Exchange hashpartitioning", branch[-2]) and "BroadcastHashJoin" in plan


def test_both_ways_to_leave_stored_rows_out_agree(spark):
    keys = ["k", "at"]
    incoming = spark.range(500).select(
        "id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.col("id") % 3).alias("at")
    )
    stored = spark.range(400).select(
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), F.col("id") % 20)).alias("k"), (F.col("id") % 2).alias("at")
    )
    ways = [sorted(map(tuple, not_stored(incoming, stored, keys, n).collect()), key=str) for n in (None, 500)]
    assert ways[0] == ways[1] and 0 < len(ways[0]) < 500
    assert sum(k is None for _, k, _ in ways[0]) == 72


def test_first_and_new_rows_with_a_folder_and_without(spark, tmp_path):
    keys = ["k"]
    incoming = spark.range(300).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 40).alias("k"))
    stored = spark.range(10).select(F.col("id").alias("k"))
    plain = merge_new_runs(incoming, stored, keys, ["id"]).collect()
    staged = merge_new_runs(incoming, stored, keys, ["id"], str(tmp_path / "firsts")).collect()
    assert sorted(map(tuple, plain), key=str) == sorted(map(tuple, staged), key=str)


# -- sessions by day

RUN = """id bigint, test_name string, platform string, device_id string, screen_name string,
action_type string, session_id string, classification string, result string, duration_ms bigint,
run_at timestamp_ntz, run_date date"""


def session_runs(n_days=40):
    rows = []
    for i in range(600):
        day = SEED.randrange(n_days)
        session = f"s{day // 3}" if i % 9 else SEED.choice(["s1", "", None, f"x{i % 4}"])
        at = datetime(2026, 1, 1) + timedelta(days=day, seconds=i)
        rows.append((i, "t", "ios", f"d{i % 3}", "home", "tap", session, None, ["passed", "failed"][i % 2], 1000 + i, at, at.date()))
    return rows + [(700 + i, "t", "ios", "d", "home", "tap", f"undated{i}", None, "passed", 1, None, None) for i in range(5)]


def test_newest_sessions_read_the_newest_days(spark, tmp_path):
    path = str(tmp_path / "runs")
    spark.createDataFrame(session_runs(), RUN).write.partitionBy("run_date").parquet(path)
    runs = spark.read.schema(RUN).parquet(path)
    days = sorted((date(2026, 1, 1) + timedelta(days=k) for k in range(40)), reverse=True)
    for k in (1, 5, 20, 100):
        by_day = reports.sessions(runs, k, days)
        assert [tuple(r) for r in by_day.collect()] == [tuple(r) for r in reports.sessions(runs, k).collect()], k
    assert reports.first_day_of_newest(runs, 1, days) == days[0]
    assert reports.first_day_of_newest(runs, 100, days) is None
    ids = reports.newest_ids(runs, 3, days)
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*run_date#\d+ >= ", plan) and "SortAggregate" not in plan
    assert "partial_max(last_run" in plan and plan.count("FileScan") == 1


# -- matrices and places

def test_heat_arrays_have_a_rate_for_every_day(spark):
    cells = spark.createDataFrame(
        [(date(2026, 1, d), s, float(r)) for d, s, r in [(1, "a", 10), (9, "a", 30), (3, "b", 0), (3, "a", 5)]],
        "day date, screen string, rate double",
    )
    got = heat_arrays(cells).collect()
    assert [(r.screen, r.rates) for r in got] == [("a", [10.0, 5.0, 30.0]), ("b", [None, 0.0, None])]
    assert all(r.days == [date(2026, 1, 1), date(2026, 1, 3), date(2026, 1, 9)] for r in got)
    assert heat_arrays(cells.limit(0)).collect() == []


@pytest.fixture
def several_ranges(spark):
    """Small ranges are not joined at run time."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_places_are_dense_over_ranges(spark, tmp_path, several_ranges):
    df = spark.range(5000, numPartitions=7).select("id", (F.xxhash64("id") % 100).alias("v"))
    got = with_places(df, str(tmp_path / "places"), F.desc("v"), F.asc("id")).collect()
    want = sorted(((r.id, r.v) for r in got), key=lambda x: (-x[1], x[0]))
    assert [r.place for r in sorted(got, key=lambda r: r.place)] == list(range(1, 5001))
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [i for i, _ in want]
    assert len({p.name for p in (tmp_path / "places").glob("*.parquet")}) > 1
    none = with_places(df.limit(0), str(tmp_path / "none"), F.asc("id"))
    assert none.collect() == [] and none.columns == ["id", "v", "place"]


def test_bundle_of_rollups_in_a_folder_and_for_one_use(spark, tmp_path):
    table, rollups = str(tmp_path / "runs"), str(tmp_path / "rollups")
    load_records(read_runs(spark, write_lines(tmp_path / "1.jsonl", varied(0, 200))), table, load_id=1)
    runs = read_table(spark, table)
    refresh_rollups(runs, rollups)
    wanted = {name: [json.loads(r.payload) for r in bundle.report_json(report(runs)).collect()] for name, report in reports.REPORTS.items()}
    before = set(names_in(spark, f"{shared_folder(spark)}/runlens"))
    for given in (None, rollups):
        rows = bundle.report_bundle(runs, given, str(tmp_path / f"out-{given is None}")).orderBy("report", "position").collect()
        for name, want in wanted.items():
            assert [json.loads(r.payload) for r in rows if r.report == name] == want, name
        tests = [json.loads(r.payload)["run_at"] for r in rows if r.report == "latest_session_tests"]
        assert tests == sorted(tests, key=lambda t: t or "")
    assert set(names_in(spark, f"{shared_folder(spark)}/runlens")) == before
    assert not spark.sparkContext._jsc.getPersistentRDDs()


# -- classifying

def failures_frame(spark, n):
    return spark.range(n).select(
        "id", F.lit("t").alias("test_name"), F.lit("ios").alias("platform"), F.concat(F.lit("e"), "id").alias("error_message"),
        F.array().cast("array<string>").alias("last_actions"), F.lit("failed").alias("result"),
        F.lit(None).cast("timestamp_ntz").alias("run_at"),
    )


def test_a_lost_job_repeats_its_slice_only(spark, tmp_path):
    asked, broken = str(tmp_path / "asked"), tmp_path / "broken"
    broken.touch()

    def classify(prompt):
        if prompt.split("Error: e")[1].startswith("77\n") and broken.exists():
            raise SystemExit  # the worker ends
        with open(asked, "a") as f:
            f.write("x")
        return "REAL_BUG|fine"

    runs, folder = failures_frame(spark, 400), str(tmp_path / "replies")
    calls = classify_batch.Calls(parallelism=2, slice_size=40, timeout=None)
    with pytest.raises(Exception):
        classify_batch.with_classifier(runs, classify, folder, calls)
    committed = spark.read.schema(classify_batch.REPLIES).parquet(folder).count()
    first = len(open(asked).read())
    broken.unlink()
    found = classify_batch.with_classifier(runs, classify, folder, calls)
    assert found.where("found.classification = 'REAL_BUG'").count() == 400
    assert first - committed <= 80 and len(open(asked).read()) == first + 400 - committed


def test_rules_in_one_scan_are_the_rules_one_by_one(spark):
    words = ["timeout ", "exceeded", "timed out", "assert", "assertimed out", "Crash", "stale", "an anr dialog", "canr", "anr",
             "method not found", "not visible", "METHOD NOT VISIBLE", "expected 1, but received 0", "expecterror", "\n", "x" * 50]
    texts = [None, "", *[" ".join(SEED.choices(words, k=SEED.randint(1, 5))) for _ in range(400)], "stale" * 20_000]
    got = spark.createDataFrame(list(enumerate(texts)), "id bigint, e string").select(
        "id", failures.rule_classify(F.col("e")).alias("r")
    )
    for r in got.collect():
        text = (texts[r.id] or "").lower()
        want = next(((name, why) for p, name, why in failures.RULES if re.search(p, text, re.S)), failures.NO_RULE)
        assert tuple(r.r) == want, texts[r.id][:80]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("timed out") == 2  # in the pattern and among the matches
