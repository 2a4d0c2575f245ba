"""The last application steps of each test attempt, as attempts end.

The engine keeps the state in RocksDB: at most ``keep`` steps for each open attempt.
Attempts share buckets, so that a bucket's attempts are worked on together, in a few array
operations and one reading and one writing of state, rather than one by one. A micro-batch touches
only the buckets it has steps for.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runlens.functions.scalars import is_api_step
from runlens.operators.steps import KEEP

KEY = ["test_id", "retry"]
ATTEMPT = "test_id bigint, retry int, last_actions array<string>, ended_at timestamp, expired boolean"
COLUMNS = {"test_id": "bigint", "retry": "int", "moment": "bigint", "seq": "bigint", "title": "string"}
STATE = ", ".join(f"{c} array<{kind}>" for c, kind in COLUMNS.items())
#: Buckets of attempts. A checkpoint keeps to the number it began with.
BUCKETS = 32
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _last(steps: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The last ``keep`` steps of each attempt, in order."""
    steps = steps.sort_values(["test_id", "retry", "moment", "seq"], kind="stable", ignore_index=True)
    if not len(steps):
        return steps
    test, retry = steps["test_id"].to_numpy(), steps["retry"].to_numpy()
    starts = np.flatnonzero(np.r_[True, (test[1:] != test[:-1]) | (retry[1:] != retry[:-1])])
    sizes = np.diff(np.r_[starts, len(steps)])
    behind = np.repeat(starts + sizes, sizes) - np.arange(len(steps))
    return steps[behind <= keep]


def _attempts(steps: pd.DataFrame, ended: pd.DataFrame, expired: bool) -> pd.DataFrame:
    """The attempts ``ended`` (test_id, retry, ended_at) with their steps."""
    titles = steps.groupby(KEY)["title"].agg(list).rename("last_actions").reset_index()
    found = ended.merge(titles, on=KEY, how="left")
    found["last_actions"] = [x if isinstance(x, list) else [] for x in found["last_actions"]]
    found["expired"] = expired
    return found[["test_id", "retry", "last_actions", "ended_at", "expired"]]


def _without(steps: pd.DataFrame, ended: pd.DataFrame) -> pd.DataFrame:
    left = steps.merge(ended[KEY], on=KEY, how="left", indicator=True)
    return left.loc[left["_merge"] == "left_only", list(COLUMNS)]


def _advance(keep: int, expires: bool):
    columns = list(COLUMNS)

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else [[] for _ in columns]
        steps = pd.DataFrame(dict(zip(columns, held)))
        ends = []
        for batch in batches:
            is_end = batch["is_end"].to_numpy(bool)
            ends.append(batch.loc[is_end, [*KEY, "moment"]])
            new = batch.loc[~is_end, columns]
            if len(new):
                steps = _last(pd.concat([steps, new], ignore_index=True) if len(steps) else new, keep)
        if any(map(len, ends)):
            ended = pd.concat(ends, ignore_index=True).groupby(KEY, as_index=False)["moment"].max()
            ended["ended_at"] = pd.to_datetime(ended.pop("moment"), unit="us")
            yield _attempts(steps, ended, False)
            steps = _without(steps, ended)
        if expires and len(steps):
            newest = steps.groupby(KEY, as_index=False)["moment"].max()
            silent = newest[newest["moment"] // 1000 < state.getCurrentWatermarkMs()].drop(columns="moment")
            if len(silent):
                silent["ended_at"] = pd.NaT
                yield _attempts(steps, silent, True)
                steps = _without(steps, silent)
        if not len(steps):
            if state.exists:
                state.remove()
            return
        state.update(tuple(steps[c].tolist() for c in columns))
        if expires:
            oldest = int(steps.groupby(KEY)["moment"].max().min()) // 1000
            state.setTimeoutTimestamp(max(oldest, state.getCurrentWatermarkMs()) + 1)

    return advance


def last_actions_stream(
    steps: DataFrame, keep: int = KEEP, patience: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Attempts of a stream of STEP_EVENT as they end, with their last ``keep`` steps.

    The micro-batch of an attempt's end counts as a whole. Without ``patience`` an
    attempt stays open until its end arrives. With it ("1 hour"), one whose newest step
    is so far behind the newest event is given out with the steps it has, flagged
    ``expired``, and what arrives later than that is not counted.
    """
    if patience is not None:
        steps = steps.withWatermark("ts", patience)
    ends = F.coalesce("is_end", F.lit(False))
    useful = steps.where(ends | is_api_step(F.col("category"))).select(
        F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int").alias("bucket"),
        *KEY, "ts", F.unix_micros("ts").alias("moment"), "seq", "title", ends.alias("is_end"),
    )
    timeout = GroupStateTimeout.NoTimeout if patience is None else GroupStateTimeout.EventTimeTimeout
    return useful.groupBy("bucket").applyInPandasWithState(
        _advance(keep, patience is not None), ATTEMPT, STATE, "append", timeout
    )


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def stream_last_actions(
    steps: DataFrame,
    folder: str,
    checkpoint: str,
    keep: int = KEEP,
    patience: str | None = None,
    buckets: int = BUCKETS,
    **trigger,
) -> StreamingQuery:
    """Append the attempts that end to the files in ``folder``; ``ended_attempts`` reads them."""
    with rocksdb_state(steps.sparkSession):
        return (
            last_actions_stream(steps, keep, patience, buckets)
            .writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start(folder)
        )


def ended_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """The attempts given out so far."""
    return spark.read.schema(ATTEMPT).parquet(folder)
