"""Loading run files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from runlens.plans.classify_batch import Classifier
from runlens.plans.ingest import Asking, load_records
from runlens.plans.rollups import merge_rollups
from runlens.sources.jsonl import from_stream, from_stream_lenient, stream_runs
from runlens.sources.table import batch_load_id, read_table


def stream_ingest(
    spark: SparkSession,
    path: str,
    table: str,
    checkpoint: str,
    classifier: Classifier | Asking | None = None,
    quarantine: str | None = None,
    rollups: str | None = None,
    **options: str,
) -> StreamingQuery:
    """Load the new files of a folder into the runs table and stop.

    A micro-batch that is replayed has the load id it had, finds its rows stored and adds none.
    With ``rollups``, the runs of each micro-batch are added to the cells of their days there,
    once; other runs of these days are not read. Unreadable records stop the stream, or go to
    ``quarantine``, where each micro-batch has a folder of its own.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        if quarantine is None:
            records = from_stream(batch)
        else:
            records, rejected = from_stream_lenient(batch)
            rejected.write.mode("overwrite").json(f"{quarantine}/batch={batch_id}")
        load_id = batch_load_id(spark, table, checkpoint, batch_id)
        counts = load_records(records, table, classifier, load_id)
        if rollups is not None:
            merge_rollups(read_table(spark, table), rollups, load_id, counts.days)

    return (
        stream_runs(spark, path, strict=quarantine is None, **options)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
