"""Last steps of test attempts, in batch and as a stream."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from runlens.operators.steps import last_actions
from runlens.schema import STEP_EVENT
from runlens.streaming.last_actions import ended_attempts, stream_last_actions

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def step(test, i, retry=0, category="pw:api", end=False, minutes=None):
    at = START + timedelta(minutes=i if minutes is None else minutes)
    return (test, retry, None if end else category, None if end else f"s{i}", at, i, end)


def frame(spark, rows):
    return spark.createDataFrame(rows, STEP_EVENT)


def by_key(rows):
    return {(r.test_id, r.retry): r.last_actions for r in rows}


def test_short_attempts_are_kept_whole(spark):
    rows = [step(1, i) for i in range(3)] + [step(2, i, category="expect") for i in range(3)]
    assert by_key(last_actions(frame(spark, rows)).collect()) == {(1, 0): ["s0", "s1", "s2"]}


def test_last_ten_in_order_whatever_the_input_order(spark):
    rows = [step(1, i) for i in range(25)] + [step(1, i, retry=1) for i in range(4)]
    random.Random(1).shuffle(rows)
    assert by_key(last_actions(frame(spark, rows)).collect()) == {
        (1, 0): [f"s{i}" for i in range(15, 25)], (1, 1): ["s0", "s1", "s2", "s3"],
    }


def stream(spark, folder, batches, **options):
    """Feed the batches one after the other; rows that come out."""
    out, checkpoint = f"{folder}/out", f"{folder}/checkpoint"
    for rows in batches:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(STEP_EVENT).parquet(f"{folder}/in")
        stream_last_actions(source, out, checkpoint, **options).awaitTermination()
    return ended_attempts(spark, out).collect()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_stream_equals_batch(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        steps = [step(t, i, retry=t % 2) for t in range(6) for i in range(5 + 4 * t)]
        ends = [step(t, 100, retry=t % 2, end=True) for t in range(6)]
        rng = random.Random(2)
        rng.shuffle(steps)
        third = len(steps) // 3
        batches = [steps[:third], steps[third : 2 * third], steps[2 * third :] + ends]
        got = stream(spark, str(tmp_path), batches)
        assert by_key(got) == by_key(last_actions(frame(spark, steps)).collect())
        assert len(got) == 6
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_state_is_cleared_at_the_end_and_kept_in_silence(spark, tmp_path):
    batches = [
        [step(1, 0), step(1, 1), step(2, 0)],
        [step(1, 2), step(1, 3, end=True)],
        # A day later test 1 runs again; test 2 has been silent, and one clock is ahead.
        [step(1, 5, minutes=1500), step(9, 0, minutes=3_000_000)],
        [step(2, 7, minutes=3002), step(2, 8, minutes=3003, end=True)],
        [step(1, 9, minutes=3004, end=True), step(3, 1, minutes=3004, end=True)],
    ]
    got = stream(spark, str(tmp_path), batches)
    assert sorted((r.test_id, r.last_actions) for r in got) == [
        (1, ["s0", "s1", "s2"]), (1, ["s5"]), (2, ["s0", "s7"]), (3, []),
    ]
    assert not any(r.expired for r in got)


def test_an_expired_attempt_is_given_out_with_its_steps(spark, tmp_path):
    batches = [
        [step(1, 0), step(1, 1), step(3, 0)],
        [step(2, 0, minutes=300), step(3, 1, minutes=299)],
        [step(2, 1, minutes=301), step(2, 2, minutes=301, end=True)],
    ]
    got = stream(spark, str(tmp_path), batches, patience="1 hour")
    assert sorted((r.test_id, r.last_actions, r.expired) for r in got) == [
        (1, ["s0", "s1"], True), (2, ["s0", "s1"], False),
    ]


def test_a_replayed_batch_gives_the_same(spark, tmp_path):
    batches = [[step(1, i) for i in range(8)], [step(1, i) for i in range(8, 12)] + [step(1, 12, end=True)]]
    first = stream(spark, str(tmp_path), batches)
    for folder in ("commits", "offsets"):
        for name in ("1", ".1.crc"):
            (tmp_path / "checkpoint" / folder / name).unlink(missing_ok=True)
    source = spark.readStream.schema(STEP_EVENT).parquet(f"{tmp_path}/in")
    stream_last_actions(source, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert ended_attempts(spark, f"{tmp_path}/out").collect() == first
    assert by_key(first) == {(1, 0): [f"s{i}" for i in range(2, 12)]}


def test_a_hot_attempt(spark, tmp_path):
    rows = [step(1, i, minutes=i / 1000) for i in range(5000)] + [step(1, 5000, end=True)]
    got = stream(spark, str(tmp_path), [rows])
    assert by_key(got) == {(1, 0): [f"s{i}" for i in range(4990, 5000)]}
