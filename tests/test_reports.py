"""Reports on hand-written runs, and on rollups of them."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from runlens.operators.grid import run_grid
from runlens.operators.groups import common_value_by, latest_by
from runlens.operators.lookup import with_expected_rate
from runlens.operators.measures import ROLLUPS, rollup
from runlens.operators.reshape import class_counts, class_matrix, heat_matrix, heat_rows, recent_days, rolling_rate
from runlens.plans import bundle, reports

SCHEMA = """id bigint, test_name string, platform string, device_id string, screen_name string,
action_type string, session_id string, classification string, result string, duration_ms bigint,
run_at timestamp_ntz, run_date date"""


def run(i, day=1, test="t", platform="ios", device="d", screen="home", action="tap", session="s",
        klass=None, result="passed", duration=1000, at=None):
    at = at or datetime(2026, 1, day, 10, 0, 0, i)
    return (i, test, platform, device, screen, action, session, klass, result, duration, at, at.date())


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stats_of_an_empty_table(make):
    assert rows(reports.stats(make([]))) == [(0, None, None, None, 0.0, 0, "")]


def test_latest_session_of_an_empty_table(make):
    assert rows(reports.latest_session(make([]))) == [(None, None, None, 0, 0, 0, None)]
    assert rows(reports.latest_session_tests(make([]))) == []


def test_stats_round_half_even(make):
    df = make([run(i, result="failed" if i == 0 else "passed", klass="REAL_BUG" if i == 0 else None)
               for i in range(16)])
    assert rows(reports.stats(df)) == [(16, 1, 1, 1, 6.2, 1, "2026-01-01 to 2026-01-01")]
    assert rows(reports.flake_rate(df)) == [(date(2026, 1, 1), 6.3)]


def test_unknown_result_counts_in_the_total_only(make):
    df = make([run(1, result=None), run(2, result="skipped"), run(3)])
    assert rows(reports.by_platform(df)) == [("ios", 3, 1, 1, 33.3)]


def test_breakdown_tells_null_from_its_label(make):
    classes = [None, None, "UNCLASSIFIED", "B"]
    df = make([run(i, klass=c, result="failed") for i, c in enumerate(classes)])
    assert rows(reports.breakdown(df)) == [("UNCLASSIFIED", 2), ("B", 1), ("UNCLASSIFIED", 1)]


def test_null_wins_the_common_class(make):
    df = make([run(i, klass=c, result="failed") for i, c in enumerate([None, None, "A"])] + [run(9, klass="Z")])
    assert rows(reports.top_flakes(df))[0] == ("t", "ios", "home", 4, 3, None)
    assert rows(reports.devices(df)) == [("d", "ios", 4, 3, None)]
    failed = df.where("result != 'passed'")
    assert rows(common_value_by(failed, ["test_name"], "classification", "c")) == [("t", None)]


def test_common_class_spans_platforms_and_needs_a_name(make):
    df = make(
        [run(i, platform="ios", klass="A", result="failed") for i in range(2)]
        + [run(10 + i, platform="web", klass="B", result="failed") for i in range(3)]
        + [run(20 + i, test=None, device=None, klass="B", result="failed") for i in range(2)]
    )
    got = {(r[0], r[1]): r[5] for r in rows(reports.top_flakes(df))}
    assert got == {("t", "ios"): "B", ("t", "web"): "B", (None, "ios"): None}
    assert {r[0]: r[4] for r in rows(reports.devices(df))} == {"d": "B", None: None}


def test_min_runs_and_order(make):
    df = make([run(1, test="once", result="failed")] + [run(i, test="calm") for i in (2, 3)]
              + [run(i, test="wild", result="failed") for i in (4, 5)])
    assert [r[0] for r in rows(reports.top_flakes(df))] == ["wild", "calm"]


def test_newest_run_gives_platform_and_device(make):
    df = make([run(1, platform="ios", device="a"), run(2, platform="web", device="b"),
               run(3, session="older", at=datetime(2025, 12, 31)), run(4, session=""), run(5, session=None)])
    got = rows(reports.sessions(df))
    assert [r[:6] for r in got] == [("s", "web", "b", 2, 2, 0), ("older", "ios", "d", 1, 1, 0)]
    assert rows(reports.latest_session(df)) == [("s", "web", "b", 2, 2, 0, 1)]


def test_latest_session_keeps_runs_without_a_day(make):
    undated = (7, "u", "ios", "d", "home", "tap", "s", None, "passed", 1, None, None)
    df = make([run(1, day=1), run(2, day=3), run(3, session="o", day=2), undated])
    assert [r[0] for r in rows(reports.latest_session_tests(df))] == [7, 1, 2]


def test_duration_dist_is_ordered_by_duration(make):
    durations = [None, 200000, 3000, 70000, 6000]
    df = make([run(i, result="failed", duration=d) for i, d in enumerate(durations)])
    assert rows(reports.duration_dist(df)) == [("0-5s", 1), ("5-15s", 1), ("60-120s", 1), ("120s+", 2)]


def test_rolling_rate_pools_days_and_gaps(make):
    df = make([run(1, day=1, result="failed"), run(2, day=5), run(3, day=20)])
    assert rows(rolling_rate(df)) == [
        (date(2026, 1, 1), 1, 1, 100.0), (date(2026, 1, 5), 2, 1, 50.0), (date(2026, 1, 20), 1, 0, 0.0),
    ]


def test_first_and_last_days(make):
    from datetime import timedelta

    start = datetime(2026, 1, 1)
    df = make([run(i, at=start + timedelta(days=i)) for i in range(70)])
    first, last = rows(reports.flake_rate(df)), rows(recent_days(df))
    assert (len(first), first[0][0], len(last), last[-1][0]) == (60, date(2026, 1, 1), 60, date(2026, 3, 11))


def test_matrices(make):
    df = make(
        [run(1, day=1, klass="REAL_BUG", result="failed"), run(2, day=1), run(3, day=2), run(4, day=2),
         run(5, day=2, screen="list"), run(6, day=2, screen="list", result="failed"), run(7, day=3)]
    )
    assert rows(class_matrix(df)) == [(date(2026, 1, 1), 1, 0, 0, 0, 0, 0)]
    odd = df.withColumn("classification", F.when(F.col("classification") == "REAL_BUG", "ENV_FLAKE"))
    assert rows(class_matrix(odd)) == [(date(2026, 1, 1), 0, 0, 0, 0, 0, 1)]
    assert rows(class_matrix(odd, ["ENV_FLAKE"])) == [(date(2026, 1, 1), 1, 0)]
    assert rows(class_counts(odd)) == [(date(2026, 1, 1), {"ENV_FLAKE": 1})]
    cells = reports.heatmap(df)
    assert rows(cells) == [(date(2026, 1, 1), "home", 50.0), (date(2026, 1, 2), "home", 0.0),
                           (date(2026, 1, 2), "list", 50.0)]
    days = [date(2026, 1, 1), date(2026, 1, 2)]
    assert rows(heat_matrix(cells, days)) == [("home", 50.0, 0.0), ("list", None, 50.0)]
    assert [(r.screen, r.avg_rate) for r in heat_rows(cells).collect()] == [("home", 25), ("list", 50)]


def test_latest_by(make):
    df = make([run(1, screen="a"), run(2, screen="b"), run(3, test="u", screen=None)])
    assert sorted(rows(latest_by(df, ["test_name"], "run_at", ["screen_name"]))) == [("t", "b"), ("u", None)]


def test_expected_rate_default(make):
    df = make([run(1, screen="login", platform="android"), run(2, screen="x"), run(3, screen=None)])
    got = {r.screen_name: r.expected_rate for r in with_expected_rate(df).collect()}
    assert got == {"login": 0.15, "x": 0.1, None: 0.1}


def test_grid_size(spark):
    tests = spark.range(17).select(F.col("id").cast("string").alias("test_name"))
    grid = run_grid(tests)
    assert grid.count() == 5100
    assert grid.select("session_id").distinct().count() == 60
    assert grid.agg(F.max("run_date")).first()[0] == date(2024, 1, 30)


@pytest.fixture
def varied(make):
    names = ["a", "b", None]
    return make([
        run(i, day=1 + i % 9, test=names[i % 3], platform=["ios", "", None, "web"][i % 4],
            device=["x", None][i % 2], screen=["home", "", None, "list"][i % 4], action=["tap", None][i % 2],
            session=f"s{i % 7}", klass=[None, "A", "REAL_BUG"][i % 3],
            result=["passed", "failed", None, "skipped", "passed"][i % 5], duration=[None, 999, 61000][i % 3])
        for i in range(400)
    ])


@pytest.mark.parametrize("name", list(reports.REPORTS))
def test_rollup_gives_the_same_report(varied, name):
    dims, measures = ROLLUPS[bundle.ROLLUP_OF.get(name, "daily")]
    rolled = rollup(varied, ["run_date", *dims], measures)
    again = rollup(rolled, ["run_date", *dims], measures)
    expected = rows(reports.REPORTS[name](varied))
    assert rows(reports.REPORTS[name](rolled)) == expected
    assert rows(reports.REPORTS[name](again)) == expected


def test_group_totals_add_up(varied):
    total = varied.where("platform is not null and platform != ''").count()
    got = reports.by_platform(varied).agg(F.sum("total"), F.sum("pass_count"), F.sum("fail_count")).first()
    assert got[0] == total and got[1] + got[2] <= total


def test_bundle_holds_every_report(varied):
    got = bundle.report_bundle(varied)
    names = {r.report for r in got.select("report").distinct().collect()}
    assert names == {*reports.REPORTS, "latest_session_tests"}
    stats = got.where("report = 'stats'").first().payload
    assert stats.startswith('{"total_runs":400,')


def test_bundle_keeps_the_order_of_its_reports(varied):
    import json

    got = bundle.report_bundle(varied).orderBy("report", "position").collect()
    for name in ("top_flakes", "volume", "sessions", "class_trend"):
        want = [json.loads(r.payload) for r in bundle.report_json(reports.REPORTS[name](varied)).collect()]
        assert [json.loads(r.payload) for r in got if r.report == name] == want


def scans(df):
    """Reads of the runs in the plan that ran, reused ones not counted."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("FileScan parquet") or plan.count("Scan ExistingRDD")


def test_rollups_and_the_latest_session_read_the_runs_seldom(spark, varied, tmp_path):
    varied.write.parquet(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert scans(bundle._rollups(runs, by_day=False)) == 1
    assert scans(reports.latest_session_tests(runs)) <= 2


def test_refreshed_days_keep_the_rollups_whole(make, tmp_path):
    undated = (99, "u", "ios", "d", "home", "tap", "s9", None, "failed", 1, None, None)
    early = [run(i, day=1 + i % 4) for i in range(20)] + [undated]
    late = [run(50 + i, day=3 + i % 4, result="failed", session=f"s{i % 2}") for i in range(20)]
    folder = str(tmp_path / "rollups")
    bundle.refresh_rollups(make(early), folder)
    whole = make(early + late)
    days = (*[date(2026, 1, d) for d in range(3, 7)], None)
    bundle.refresh_rollups(whole, folder, days)
    for name, report in bundle.reports(whole, folder).items():
        expected = reports.REPORTS.get(name, reports.latest_session_tests)(whole)
        assert rows(report) == rows(expected), name
