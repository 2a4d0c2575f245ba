"""Column functions on hand-written rows."""

from datetime import date, datetime
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.functions import display, failures, scalars, screens


def evaluate(spark, schema, rows, expression):
    """Values of the expression over the rows, in order."""
    numbered = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)], f"row_no int, {schema}"
    )
    return [r.v for r in numbered.select("row_no", expression.alias("v")).orderBy("row_no").collect()]


def test_action_type(spark):
    cases = {
        "fill": ["tap(#a)", "fill(#b)", "waitFor(#c)"],
        "swipe": ["swipe(up)", "scrollIntoView(#x)"],
        "tap": ["long press (tap area)"],
        "press": ["tap(#x)", "press(Enter)"],
        "other": ["waitForText(x)"],
    }
    got = evaluate(
        spark,
        "a array<string>",
        [(v,) for v in cases.values()] + [(["waitFor(#fillForm)"],), ([],), (None,), ([None, "TAP"],)],
        scalars.action_type(F.col("a")),
    )
    assert got == [*cases, "fill", "other", "other", "tap"]


@pytest.mark.parametrize(
    "title, actions, screen",
    [
        ("Alerts - show dialog", [], "alert"),
        ("Zed - tap login", [], "zed"),
        ("Zed 9 - update x", [], "calendar"),
        ("validation - x", [], "login"),
        (" - login", [], "login"),
        ("information page", [], "form"),
        ("checkout works", ["tap(#photoBtn)"], "media"),
        ("checkout works", ["tap(#x)", "tap(#Draw)", "tap(#photo)"], "signature"),
        ("checkout works", [], "unknown"),
        ("\tProfile\n - edit - login", [], "profile"),
        ("Cart2 - x", [], "unknown"),
    ],
)
def test_screen_of(spark, title, actions, screen):
    row = [(title, actions)]
    expr = screens.screen_of(F.col("t"), F.col("a"))
    assert evaluate(spark, "t string, a array<string>", row, expr) == [screen]


def test_annotations(spark):
    rows = [
        ([("device.id", "d"), ("device.platform", "ios"), ("device.platform", "web")], "p"),
        ([("device.platform", "")], "p"),
        ([], None),
        ([("device.platform", None)], "p"),
    ]
    schema = "a array<struct<type:string,description:string>>, project string"
    noted = scalars.annotation_value(F.col("a"), "device.platform")
    assert evaluate(spark, schema, rows, noted) == ["ios", "", "", ""]
    resolved = scalars.platform_fallback(noted, F.col("project"))
    assert evaluate(spark, schema, rows, resolved) == ["ios", "p", "", "p"]


TIMES = {
    "2026-01-15T10:30:00Z": datetime(2026, 1, 15, 10, 30),
    "2026-01-15T10:30:00.123Z": datetime(2026, 1, 15, 10, 30, 0, 123000),
    "2026-01-15T08:15:30.123456": datetime(2026, 1, 15, 8, 15, 30, 123456),
    "2026-01-15T23:30:00-05:00": datetime(2026, 1, 16, 4, 30),
    "2026-01-15 10:30": datetime(2026, 1, 15, 10, 30),
    "2026-01-15 10:30 +02:00": datetime(2026, 1, 15, 8, 30),
    "2026-01-15": datetime(2026, 1, 15),
    "2026-11-01T06:30:00Z": datetime(2026, 11, 1, 6, 30),
    "2026-03-08T02:30:00": datetime(2026, 3, 8, 2, 30),
    "2026-02-30T10:30:00Z": None,
    "junk": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [(t,) for t in TIMES]
        assert evaluate(spark, "t string", rows, scalars.utc_time(F.col("t"))) == list(TIMES.values())
        days = [v and v.date() for v in TIMES.values()]
        assert evaluate(spark, "t string", rows, scalars.run_day(F.col("t"))) == days
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_flags(spark):
    rows = [("passed",), ("failed",), ("timedOut",), ("skipped",), (None,)]
    assert evaluate(spark, "r string", rows, scalars.pass_flag(F.col("r"))) == [1, 0, 0, 0, 0]
    assert evaluate(spark, "r string", rows, scalars.fail_flag(F.col("r"))) == [0, 1, 1, 1, 0]


def test_duration_bucket(spark):
    rows = [(v,) for v in (0, 4999, 5000, 29999, 30000, 119999, 120000, None)]
    assert evaluate(spark, "d bigint", rows, scalars.duration_bucket(F.col("d"))) == [
        "0-5s", "0-5s", "5-15s", "15-30s", "30-60s", "60-120s", "120s+", "120s+",
    ]


def test_percentages_round_both_ways(spark):
    rows = [(1, 16), (1, 8), (0, 5), (3, 2000), (7, 2000), (1235, 10000), (1, 0)]
    up = evaluate(spark, "f bigint, n bigint", rows, scalars.pct1(F.col("f"), F.col("n")))
    even = evaluate(spark, "f bigint, n bigint", rows, scalars.pct1_half_even(F.col("f"), F.col("n")))
    assert up[:3] == [6.3, 12.5, 0.0] and up[-1] is None
    assert even[:-1] == [round(f / n * 100, 1) for f, n in rows[:-1]] and even[-1] is None


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40000), st.integers(1, 40000)), min_size=300, max_size=300))
def test_half_even_is_exact(spark, pairs):
    rows = [(min(f, n), n) for f, n in pairs] + [(f, 2000) for f in range(0, 2000, 3)]
    got = evaluate(spark, "f bigint, n bigint", rows, scalars.pct1_half_even(F.col("f"), F.col("n")))
    assert got == [round(f / n * 100, 1) for f, n in rows]
    up = evaluate(spark, "f bigint, n bigint", rows, scalars.pct1(F.col("f"), F.col("n")))
    assert up == [float(Fraction(int(Fraction(1000 * f, n) + Fraction(1, 2)), 10)) for f, n in rows]


def test_avg_seconds(spark):
    df = spark.createDataFrame([("a", 1500), ("a", None), ("b", 400), ("c", None)], "k string, d bigint")
    got = df.groupBy("k").agg(scalars.avg_seconds(F.col("d")).alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == [2, 0, None]


def test_actions_json(spark):
    rows = [(["a", 'say "x"', "b/c"],), ([],), (None,)]
    text = scalars.actions_json(F.col("a"))
    assert evaluate(spark, "a array<string>", rows, text) == ['["a", "say \\"x\\"", "b/c"]', "[]", "[]"]
    back = scalars.actions_from_json(text)
    assert evaluate(spark, "a array<string>", rows, back) == [["a", 'say "x"', "b/c"], [], []]


def test_failure_prompt(spark):
    rows = [("t {platform}", None, "x" * 3000, ["a", "b"])]
    prompt = failures.failure_prompt(F.col("t"), F.col("p"), F.col("e"), F.col("a"))
    got = evaluate(spark, "t string, p string, e string, a array<string>", rows, prompt)[0]
    assert got == failures.PROMPT.replace("{platform}", "unknown").replace(
        "{test_name}", "t {platform}"
    ).replace("{error_message}", "x" * 2000).replace("{last_actions}", '["a", "b"]')


@pytest.mark.parametrize(
    "reply, category, reason",
    [
        ("TIMEOUT_FLAKE|slow|render", "TIMEOUT_FLAKE", "slow|render"),
        (" real_bug | x \n", "REAL_BUG", "x"),
        ("REAL_BUG|", "REAL_BUG", ""),
        ("MAYBE|x", "UNKNOWN", "Could not parse: MAYBE|x"),
        ("REAL_BUG", "UNKNOWN", "Could not parse: REAL_BUG"),
        ("|x", "UNKNOWN", "Could not parse: |x"),
        ("", "UNKNOWN", "Could not parse: "),
        ("y" * 300, "UNKNOWN", "Could not parse: " + "y" * 200),
        (None, None, None),
    ],
)
def test_parse_reply(spark, reply, category, reason):
    got = evaluate(spark, "r string", [(reply,)], failures.parse_reply(F.col("r")))[0]
    assert (got.classification, got.classification_reason) == (category, reason)


# Error texts and the category each must get.
LABELLED = [
    ("actionTimeout 20000ms exceeded", "TIMEOUT_FLAKE"),
    ("Timeout 30000ms exceeded while waiting for #element", "TIMEOUT_FLAKE"),
    ("Test timeout of 120000ms exceeded", "TIMEOUT_FLAKE"),
    ("ExpectError: Expected 1, but received 0", "LOCATOR_FLAKE"),
    ("ExpectError: Expected value to be truthy, but received false", "REAL_BUG"),
    ("Error: element is not visible", "LOCATOR_FLAKE"),
    ("Error: Method not found", "DEVICE_FLAKE"),
    ("Error: Could not verify foreground activity", "DEVICE_FLAKE"),
    ("Error: fill failed - element detached from DOM", "LOCATOR_FLAKE"),
    ("ExpectError: Expected 'Profile updated' but received 'Error saving'", "REAL_BUG"),
]


def test_rule_classify(spark):
    extra = [("something odd", "UNKNOWN"), ("", "UNKNOWN"), (None, "UNKNOWN"), ("an anrx", "UNKNOWN"),
             ("the ANR dialog", "DEVICE_FLAKE"), ("z" * 5000 + "\ncrash", "REAL_BUG")]
    cases = LABELLED + extra
    got = evaluate(spark, "e string", [(e,) for e, _ in cases], failures.rule_classify(F.col("e")))
    assert [g.classification for g in got] == [c for _, c in cases]


def test_merge_class(spark):
    pair = "struct<classification:string,classification_reason:string>"
    rows = [
        ("failed", (None, None), ("REAL_BUG", "old")),
        ("failed", ("UNKNOWN", "new"), ("REAL_BUG", "old")),
        ("passed", ("UNKNOWN", "new"), ("REAL_BUG", "old")),
        ("failed", None, ("REAL_BUG", "old")),
        (None, ("UNKNOWN", "new"), (None, None)),
    ]
    merged = failures.merge_class(F.col("r"), F.col("f"), F.col("i"))
    got = evaluate(spark, f"r string, f {pair}, i {pair}", rows, merged)
    assert [tuple(g) for g in got] == [
        ("REAL_BUG", "old"), ("UNKNOWN", "new"), (None, None), ("REAL_BUG", "old"), ("UNKNOWN", "new"),
    ]


def test_rates_are_shown_by_their_binary_value(spark):
    """As fixed-point formatting prints them; exact ties go up."""
    from decimal import ROUND_HALF_UP, Decimal

    pairs = [(167, 2000), (1, 2000), (1, 16), (3, 16), (5, 16), (0, 7), (7, 7), (1, 3)]
    pairs += [(k, 400) for k in range(0, 401, 7)]
    want = [float(Decimal(a / b * 100.0).quantize(Decimal("0.1"), ROUND_HALF_UP)) for a, b in pairs]
    assert evaluate(spark, "a int, b int", pairs, display.rate_text(F.col("a"), F.col("b"))) == want
    assert want[0] == 8.3


def test_actions_json_is_ascii(spark):
    import json

    lists = [["é—"], ["😀 tap"], ["plain", 'q"\\ é\n']]
    text = scalars.actions_json(F.col("a"))
    assert evaluate(spark, "a array<string>", [(x,) for x in lists], text) == [json.dumps(x) for x in lists]
    back = scalars.actions_from_json(text)
    assert evaluate(spark, "a array<string>", [(x,) for x in lists], back) == lists


def test_prefixes_are_arguments(spark):
    error = "x" * 3000
    prompt = lambda **given: failures.failure_prompt(F.lit("t"), F.lit("p"), F.lit(error), F.array().cast("array<string>"), **given)
    whole, head = evaluate(spark, "a int", [(1,)], prompt(error_chars=None))[0], evaluate(spark, "a int", [(1,)], prompt())[0]
    assert len(whole) - len(head) == 1000
    reason = failures.parse_reply(F.lit("y" * 500), reply_chars=None)["classification_reason"]
    assert evaluate(spark, "a int", [(1,)], reason)[0].endswith("y" * 500)


def test_display(spark):
    rows = [(0.0,), (9.9,), (10.0,), (34.9,), (35.0,), (50.0,), (None,)]
    assert evaluate(spark, "v double", rows, display.heat_band(F.col("v"))) == [
        "none", "low", "mild", "warm", "hot", "severe", None,
    ]
    rows = [(10,), (11,), (21,), (50,), (51,), (69,), (70,), (90,)]
    assert evaluate(spark, "v int", rows, display.rate_band(F.col("v")))[:3] == ["low", "medium", "high"]
    assert evaluate(spark, "v int", rows, display.bar_band(F.col("v")))[:5] == [
        "green", "orange", "orange", "yellow", "red",
    ]
    assert evaluate(spark, "v int", rows, display.pass_band(F.col("v")))[5:] == ["poor", "fair", "good"]
    rows = [("2026-01-15T10:30:45Z",), (None,)]
    assert evaluate(spark, "t string", rows, display.minute_label(F.col("t"))) == ["2026-01-15 10:30", "—"]
    rows = [("d" * 40,), ("",), (None,)]
    assert evaluate(spark, "t string", rows, display.device_label(F.col("t"))) == ["d" * 25, "—", "—"]
    rows = [(date(2026, 1, 5),)]
    assert evaluate(spark, "d date", rows, display.day_label(F.col("d"))) == ["01-05"]
    rows = [(3, 2), (1, 3), (0, 0)]
    assert evaluate(spark, "f int, n int", rows, display.bar_pct(F.col("f"), F.col("n"))) == [100, 33, 100]
