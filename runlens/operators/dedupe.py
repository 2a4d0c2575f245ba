"""Idempotent loading: the first record of a key wins, stored keys are skipped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a load that are sent to the stored rows.
BROADCAST_KEYS = 200_000


def _has_key(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``, with the number of its ``copies``.

    A grouped minimum rather than a window: copies of a hot key are combined
    before the shuffle. A row whose key has a NULL equals no other row, so it
    is grouped by its own position. ``order`` must tell all rows apart.
    """
    position = F.struct(*order)
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(
        *keys, F.when(~_has_key(keys), position).alias("_alone")
    ).agg(
        F.min_by(F.struct(*others), position).alias("_row"),
        F.count(F.lit(1)).alias("copies"),
    )
    return picked.select(*keys, "_row.*", "copies").select(*df.columns, "copies")


def not_stored(
    incoming: DataFrame, stored: DataFrame, keys: list[str], n_incoming: int | None = None
) -> DataFrame:
    """Incoming rows whose key is not stored; a NULL in a key matches nothing.

    With at most ``BROADCAST_KEYS`` incoming rows, if their number is known, their keys go to where the
    stored rows are, and those found come back, no more than went: nothing stored is shuffled.

    Otherwise both sides are shuffled by key in one pass. Rows without a key, which match
    nothing, get a lane of their own there that spreads them over the tasks. The stored side is
    not made distinct: an anti join needs no distinct keys, and with nothing between
    shuffle and join adaptive execution can split a hot key.
    """
    known = stored.where(_has_key(keys)).select(*[F.col(k).cast(incoming.schema[k].dataType).alias(k) for k in keys])
    if n_incoming is not None and n_incoming <= BROADCAST_KEYS:
        asked = incoming.where(_has_key(keys)).select(*keys)
        found = known.join(F.broadcast(asked), keys, "left_semi").distinct()
        return incoming.join(F.broadcast(found), keys, "left_anti").select(*incoming.columns)
    # a constant lane would not be a key to shuffle by
    lane = F.when(_has_key(keys), F.xxhash64(*keys)).otherwise(F.xxhash64(*incoming.columns))
    known = known.withColumn("_lane", F.xxhash64(*keys))
    fresh = incoming.withColumn("_lane", lane).join(known, [*keys, "_lane"], "left_anti")
    return fresh.select(*incoming.columns)


def merge_new_runs(
    incoming: DataFrame, stored: DataFrame, keys: list[str], order: list[str], folder: str | None = None
) -> DataFrame:
    """The rows a load adds: first of each key, not stored yet.

    With a ``folder`` the firsts are written there, so that the input is read once, and counted.
    """
    firsts = first_wins(incoming, keys, order)
    if folder is None:
        return not_stored(firsts, stored, keys)
    firsts.write.parquet(folder)
    firsts = incoming.sparkSession.read.schema(firsts.schema).parquet(folder)
    return not_stored(firsts, stored, keys, firsts.count())

