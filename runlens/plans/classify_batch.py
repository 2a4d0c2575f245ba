"""Failure categories from a pluggable classifier, asked once per distinct question."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.failures import (
    ERROR_CHARS,
    REPLY_CHARS,
    failure_prompt,
    parse_reply,
    rule_classify,
)
from runlens.schema import PASSED
from runlens.session import make_folder, staging

Classifier = Callable[[str], str | None]
BatchClassifier = Callable[[pd.Series], pd.Series]

# The questions most failures ask are settled by a broadcast, as many as this, if
# their replies are no longer than this or missing. A longer reply to one of them is
# joined by a shuffle like those to rarer questions, but spread over SALT tasks.
HOT_PROMPTS = 1000
HOT_CHARS = 1000
SALT = 64
LANES = 4096
REPLIES = "prompt_key string, reply string"


@dataclass(frozen=True)
class Calls:
    """How a classifier is called.

    ``parallelism`` bounds the questions open at the same time. A call that takes
    more than ``timeout`` seconds counts as unanswered. ``error_chars`` and
    ``reply_chars`` are how much of an error is asked and of an unreadable reply
    quoted, None for all. Replies are committed for about ``slice_size`` questions at a time.
    """

    parallelism: int = 64
    slice_size: int = 10_000
    timeout: float | None = 30.0
    error_chars: int | None = ERROR_CHARS
    reply_chars: int | None = REPLY_CHARS


def one_by_one(classifier: Classifier, timeout: float | None = None) -> BatchClassifier:
    """A classifier of single questions as one of many; errors and long calls give None."""

    def reply(prompt: str) -> str | None:
        got: list[str | None] = [None]

        def call() -> None:
            try:
                got[0] = classifier(prompt)
            except Exception:
                pass

        if timeout is None:
            call()
        else:
            thread = threading.Thread(target=call, daemon=True)
            thread.start()
            thread.join(timeout)
        return got[0]

    return lambda prompts: prompts.map(reply)


def _is_failure():
    """A run to classify: anything but a pass, an unknown result included."""
    return ~F.col("result").eqNullSafe(PASSED)


def with_rules(runs: DataFrame) -> DataFrame:
    """Runs with ``found``, the category by error patterns; NULL for a pass."""
    return runs.withColumn(
        "found", F.when(_is_failure(), rule_classify(F.col("error_message")))
    )


def with_prompts(runs: DataFrame, error_chars: int | None = ERROR_CHARS) -> DataFrame:
    """Runs with ``prompt``, the question about a failure; NULL for a pass."""
    prompt = failure_prompt(
        F.col("test_name"),
        F.col("platform"),
        F.col("error_message"),
        F.col("last_actions"),
        error_chars,
    )
    return runs.withColumn("prompt", F.when(_is_failure(), prompt))


def ask(prompts: DataFrame, classifier: BatchClassifier, parallelism: int) -> DataFrame:
    """Replies to (prompt_key, prompt); NULL where the classifier has none or fails."""

    def replies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = [x if isinstance(x, str) else None for x in classifier(batch["prompt"])]
            except Exception:
                found = [None] * len(batch)
            yield pd.DataFrame({"prompt_key": batch["prompt_key"], "reply": pd.Series(found, batch.index, object)})

    return prompts.select("prompt_key", "prompt").repartition(parallelism).mapInPandas(replies, REPLIES)


def ask_new(asked: DataFrame, classifier: BatchClassifier, folder: str, calls: Calls) -> None:
    """Ask the questions without a reply in ``folder`` and keep the replies there.

    The questions' keys are hashes, so equal ranges of them are slices of about equal size. Each is asked and
    committed by a job of its own: what is lost with a job is asked again, at most ``slice_size`` or so.
    """
    spark = asked.sparkSession
    known = spark.read.schema(REPLIES).parquet(folder).where(F.col("reply").isNotNull())
    with staging(spark, "new-questions") as staged:
        new = asked.select("prompt_key", "prompt").join(known.select("prompt_key"), "prompt_key", "left_anti")
        new.repartitionByRange("prompt_key").sortWithinPartitions("prompt_key").write.parquet(staged)
        new = spark.read.schema(new.schema).parquet(staged)
        n_slices = -(-new.count() // calls.slice_size)
        cuts = [f"{(k << 32) // n_slices:08x}" for k in range(n_slices)]
        for low, high in zip(cuts, [*cuts[1:], "g"]):
            part = new.where((F.col("prompt_key") >= low) & (F.col("prompt_key") < high))
            ask(part, classifier, calls.parallelism).write.mode("append").parquet(folder)


def _replies(spark: SparkSession, folder: str, calls: Calls) -> DataFrame:
    """(prompt_key, answer) of the questions that have a reply."""
    replies = spark.read.schema(REPLIES).parquet(folder).where(F.col("reply").isNotNull())
    one = replies.groupBy("prompt_key").agg(F.max("reply").alias("reply"))
    return one.select("prompt_key", parse_reply(F.col("reply"), calls.reply_chars).alias("answer"))


def with_classifier(
    runs: DataFrame,
    classifier: Classifier | BatchClassifier,
    folder: str,
    calls: Calls = Calls(),
    batch: bool = False,
) -> DataFrame:
    """Runs with ``found``, the classifier's category; NULL where it has none.

    Replies are kept in ``folder`` by the hash of their question. What has a reply
    there is not asked again, by later loads either; the questions of a slice whose job
    fails before it commits are. ``batch`` says that the classifier takes a series.
    """
    spark = runs.sparkSession
    if not batch:
        classifier = one_by_one(classifier, calls.timeout)
    keyed = with_prompts(runs, calls.error_chars).withColumn("prompt_key", F.sha2("prompt", 256))
    make_folder(spark, folder)
    with staging(spark, "questions") as staged:
        asked = (
            keyed.where(F.col("prompt").isNotNull())
            .groupBy("prompt_key")
            .agg(F.min("prompt").alias("prompt"), F.count(F.lit(1)).alias("asked"))
        )
        asked.repartitionByRange("prompt_key").sortWithinPartitions("prompt_key").write.parquet(staged)
        asked = spark.read.schema(asked.schema).parquet(staged)
        ask_new(asked, classifier, folder, calls)
        answered = asked.select("prompt_key", "asked").join(_replies(spark, folder, calls), "prompt_key", "left")
        # Every hot question, whether it has a short reply, a long one or none.
        short = F.coalesce(F.length("answer.classification_reason") <= HOT_CHARS, F.lit(True))
        hot = answered.orderBy(F.col("asked").desc(), "prompt_key").limit(HOT_PROMPTS)
        hot = hot.select("prompt_key", short.alias("settled"), F.when(short, F.col("answer")).alias("hot"))
        rows = hot.collect()  # HOT_PROMPTS replies of HOT_CHARS characters at most
        all_settled = len(rows) < HOT_PROMPTS and all(r.settled for r in rows)
    hot = F.broadcast(spark.createDataFrame(rows, hot.schema))
    if all_settled:
        return keyed.join(hot, "prompt_key", "left").select(*runs.columns, F.col("hot").alias("found"))
    spread = F.when(F.col("settled").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALT - 1)))
    cold = _replies(spark, folder, calls).join(hot, "prompt_key", "left")
    cold = cold.where(~F.coalesce("settled", F.lit(False))).select(
        "prompt_key", F.explode(spread).alias("salt"), F.col("answer").alias("cold")
    )
    cold = cold.select(F.concat_ws("#", "prompt_key", "salt").alias("cold_key"), "cold")
    # Rows that need no second lookup get a key of their own lane, which
    # matches nothing and spreads them over the shuffle.
    row = F.xxhash64("id", "test_name", "run_at")
    lane = F.concat(F.lit("lane "), F.pmod(row, F.lit(LANES)))
    salt = F.when(F.col("settled").isNull(), F.lit(0)).otherwise(F.pmod(row, F.lit(SALT)))
    done = F.col("prompt_key").isNull() | F.coalesce("settled", F.lit(False))
    looked = keyed.join(hot, "prompt_key", "left").withColumn(
        "cold_key", F.when(done, lane).otherwise(F.concat_ws("#", "prompt_key", salt))
    )
    return looked.join(cold, "cold_key", "left").select(
        *runs.columns, F.coalesce("hot", "cold").alias("found")
    )


def classify_runs(
    runs: DataFrame,
    classifier: Classifier | BatchClassifier | None = None,
    folder: str | None = None,
    calls: Calls = Calls(),
    batch: bool = False,
) -> DataFrame:
    """Runs with ``found`` by the classifier, or by the error rules without one."""
    if classifier is None:
        return with_rules(runs)
    if folder is None:
        raise ValueError("a classifier needs a folder for its replies")
    return with_classifier(runs, classifier, folder, calls, batch)
