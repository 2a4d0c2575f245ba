"""Mixing sources to target weights by entropy balancing.

Of all ways to copy documents at rates between 0 and ``MOST`` that give each source its
target of words, entropy balancing takes the one nearest to one copy each. Its dual is
convex with one variable a source: a document of x words (in units of the source's mean)
gets the rate MOST / (1 + (MOST - 1) exp(-v x)), exponentially tilted by its words and
saturating at the most copies. Newton's steps, kept inside a bracket, find the v at which
the source's words meet its target; each step is one aggregation over the counts of equal
sizes, with exact decimal sums, so reruns agree.

Rates become copies within hashed buckets of a source's documents, as many as its own number of
documents asks for, from the longest document to the shortest: each gets the whole number of copies
nearest to what its rate and the debt of words before it ask for, and the new debt is handed on. The
shortest document of every bucket stays open; a second pass over these, a row a bucket, settles
the buckets' debts together. So a source ends about as near to its target as its shorter documents allow,
whether it has one document or many buckets.

Null texts have no words. Sources are ordered by code point, a null source last. Weights
repeat along that order. Empty sources get nothing. Rows that share an id are taken each
for itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.llm import blocks as B

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
BUCKET_ROWS = 5_000
STEPS = 60
#: A source has met its target within this part of it.
CLOSE = 1e-7


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in B.blocks(batches):
        data, starts = B.text_bytes(batch.column("text"))
        _, _, offsets = B.spans(data, starts, B.NOT_SPACE)
        columns = [batch.column(c) for c in ("doc_id", "source", "mark")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(offsets))], ["doc_id", "source", "mark", "size"])


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mark, size in words); the mark is a hash of id and text."""
    docs = docs.select(*[F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("text", "string"))])
    docs = docs.withColumn("mark", F.xxhash64("doc_id", "text"))
    return B.kept(docs.mapInArrow(_sizes, "doc_id long, source string, mark long, size long"), "sizes")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target): shares by weight, at most ``most`` times the source's words.

    What a source cannot take goes to the others by weight: with sources ordered by
    room per weight, all up to some place are full and the rest share the remainder.
    """
    of = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    of = of.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    of = of.withColumn("room", F.col("source_size") * most)
    by_room = Window.orderBy(F.col("room") / F.col("weight"), F.asc_nulls_last("source"))
    before, all_ = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(all_) * F.lit(float(total)) - F.coalesce(F.sum("room").over(before), F.lit(0))
    open_ = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    of = of.withColumn("level", left / open_)
    # the first source that its share does not fill sets the level for all from there on
    fits = F.when(F.col("level") * F.col("weight") <= F.col("room"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, 0))
    of = of.withColumn("target", F.coalesce(level * F.col("weight"), F.col("room").cast("double")))
    return of.select("source", "source_size", "n_docs", "target")


def _rate(v, size, mean, most: int):
    """Copies of a document of ``size`` words under the source's dual variable."""
    return F.lit(float(most)) / (1 + F.lit(float(most - 1)) * F.exp(-v * size / mean))


def tilts(sized: DataFrame, of: DataFrame, most: int = MOST) -> DataFrame:
    """Solve for each source's dual variable ``v``; null for sources that take all or nothing."""
    counts = B.kept(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    state = of.withColumn("mean", F.col("source_size") / F.col("n_docs"))
    inner = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * most * (1 - 1e-12))
    nothing = F.lit(None).cast("double")
    state = state.withColumns(
        {"v": F.when(inner, F.lit(0.0)), "low": nothing, "high": nothing, "met": ~inner}
    )
    state = B.kept(state, "tilts")
    decimal = "decimal(38,9)"
    for _ in range(STEPS):
        if not state.where("not met").limit(1).count():
            break
        todo = state.where("not met").select(F.col("source").alias("s"), "v", "mean", "target", "low", "high")
        at = counts.join(todo, F.col("source").eqNullSafe(F.col("s")))
        rate = _rate(F.col("v"), F.col("size"), F.col("mean"), most)
        words = (F.col("n") * F.col("size") * rate).cast(decimal)
        slope = (F.col("n") * F.col("size") * (F.col("size") / F.col("mean")) * rate * (1 - rate / most)).cast(decimal)
        got = at.groupBy("s").agg(F.sum(words).cast("double").alias("words"), F.sum(slope).cast("double").alias("slope"))
        new = state.join(got, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.col("words") - F.col("target")
        new = new.withColumns(
            {
                "met": F.col("met") | (F.abs(gap) <= CLOSE * F.col("target")),
                "low": F.when(gap < 0, F.col("v")).otherwise(F.col("low")),
                "high": F.when(gap > 0, F.col("v")).otherwise(F.col("high")),
            }
        )
        newton = F.col("v") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("low").isNull() | (newton > F.col("low")))
        inside = inside & (F.col("high").isNull() | (newton < F.col("high"))) & (F.abs(newton) < 1e6)
        # outside the bracket: its middle, or twice as far where one side is still open
        middle = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1)
        middle = middle.otherwise((F.col("low") + F.col("high")) / 2)
        new = new.withColumn("v", F.when(F.col("met"), F.col("v")).when(inside, newton).otherwise(middle))
        state = B.kept(new.drop("words", "slope"), "tilts")
    else:
        if state.where("not met").limit(1).count():
            raise ArithmeticError(f"a source has not met its target after {STEPS} steps")
    return state.select("source", "source_size", "n_docs", "target", "mean", "v")


def _rounded(rows: pa.Table, most: int, settle: bool) -> pa.Table:
    """Copies of documents that share a debt: rates rounded so that the words add up.

    Unless it is to ``settle``, the shortest document with words gets none yet, but all that is due by then.
    """
    rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending"), ("mark", "ascending")])
    sizes, due_of = rows["size"].to_pylist(), rows["due"].to_pylist()
    n_open = len(sizes) - sizes.count(0) - 1
    debt, copies, dues = 0.0, [], []
    for k, (size, due) in enumerate(zip(sizes, due_of)):
        due += debt
        if k == n_open and not settle:
            copies.append(None)
            debt = 0.0
        else:
            copies.append(min(most, max(0, math.ceil(due / size - 0.5))) if size else 0)
            debt = due - copies[-1] * size
        dues.append(due)
    rows = rows.set_column(rows.schema.get_field_index("due"), "due", pa.array(dues, pa.float64()))
    return rows.append_column("copies", pa.array(copies, pa.int64()))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """Each document's copies: (doc_id, source, size, source_size, target, rate, copies, taken)."""
    sized = sizes(docs)
    of = tilts(sized, B.kept(targets(sized, weights, total, most), "targets"), most)
    n_buckets = F.greatest(F.ceil(F.col("n_docs") / BUCKET_ROWS), F.lit(1))
    bucket = F.pmod("mark", n_buckets)
    of = of.withColumnRenamed("source", "s")
    found = sized.join(of, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    fixed = F.when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0)
    rate = F.when(F.col("v").isNull(), fixed).otherwise(_rate(F.col("v"), F.col("size"), F.col("mean"), most))
    found = found.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
    columns = ["doc_id", "source", "size", "source_size", "target", "rate"]
    due = (F.col("rate") * F.col("size")).alias("due")
    found = found.withColumn("bucket", bucket).select(*columns, "mark", "bucket", due)
    schema = f"{', '.join(f'{c} {t}' for c, t in found.dtypes)}, copies long"
    found = B.kept(found.groupBy("source", "bucket").applyInArrow(lambda rows: _rounded(rows, most, False), schema), "rounded")
    open_ = found.where("copies is null").drop("copies")
    settled = open_.groupBy("source").applyInArrow(lambda rows: _rounded(rows, most, True), schema)
    found = found.where("copies is not null").unionByName(settled)
    return found.select(*columns, "copies", (F.col("copies") * F.col("size")).alias("taken"))
