"""Benchmark decontamination with a distributed positional inverted index.

The index stores, for every block of documents and every bucket of terms, the
terms with the positions of all their occurrences. A phrase is found by taking
the positions of its rarest term, then intersecting them with those of the next
rarer terms, each shifted by its offset in the phrase, until nothing is left or
all terms agree. With ``slop`` the terms of an occurrence, each moved back by its offset, lie
within that many words of each other, in one document; one place may serve equal words.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z
lower-cased; null has none. Terms are 64-bit hashes of words. Positions leave a
gap between documents, so no phrase crosses from one into the next. Repeated rows
are documents of their own. A benchmark item without an id counts as the empty id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import blocks as B

WINDOW = 10
BUCKET_BITS = 6
#: Test terms sent to every executor (8 bytes each); beyond it the index is joined with them by a shuffle.
BROADCAST_TERMS = 4_000_000
INDEX = "kind int, block long, bucket int, ids array<long>, has_id array<boolean>, n_words array<long>, data binary"


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, starts = B.text_bytes(column)
    data = B.LOWER[data]
    first, last, offsets = B.spans(data, starts, B.ALNUM)
    return B.hash_spans(data, first, last), offsets


def _positions(offsets: np.ndarray) -> np.ndarray:
    """Where each word of a block stands; one place is free after each document."""
    return np.arange(offsets[-1]) + B.row_of(offsets)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << 32
    for batch in B.blocks(batches):
        terms, offsets = _terms(batch.column("text"))
        order = np.argsort(terms, kind="stable")
        terms, places = terms[order], _positions(offsets)[order].astype(np.uint32)
        new = np.ones(len(terms), bool)
        new[1:] = terms[1:] != terms[:-1]
        first = np.flatnonzero(new)
        distinct, counts = terms[first], np.diff(np.append(first, len(terms))).astype(np.uint32)
        edges = np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
        cuts = np.append(np.searchsorted(distinct, edges), len(distinct))
        rows = {"bucket": [], "data": []}
        for bucket, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                stop = first[b] if b < len(first) else len(terms)
                parts = B.pack(distinct[a:b]), B.pack(counts[a:b]), B.pack(places[first[a] : stop])
                head = np.array([len(x) for x in parts[:2]], np.uint32).tobytes()
                rows["bucket"].append(bucket)
                rows["data"].append(head + b"".join(parts))
        n = len(rows["bucket"])
        ids = batch.column("doc_id")
        about = [
            pa.array([pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)], pa.list_(pa.int64())),
            pa.array([ids.is_valid().to_numpy(zero_copy_only=False)], pa.list_(pa.bool_())),
            pa.array([np.diff(offsets)], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([0] + [1] * n, pa.int32()),
                pa.array([at] * (n + 1), pa.int64()),
                pa.array([None, *rows["bucket"]], pa.int32()),
                *[pa.concat_arrays([x, pa.nulls(n, x.type)]) for x in about],
                pa.array([None, *rows["data"]], pa.binary()),
            ],
            ["kind", "block", "bucket", "ids", "has_id", "n_words", "data"],
        )
        at += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all documents: one row of kind 0 a block with its documents, and
    rows of kind 1 with the postings of the terms of a bucket."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return B.kept(docs.mapInArrow(_index, INDEX), "index", "kind")


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.blocks(batches):
            terms, offsets = _terms(batch.column("text"))
            items, found = [], []
            for item, a, b in zip(batch.column("item_id").to_pylist(), offsets[:-1], offsets[1:]):
                own = terms[a:b].view(np.int64)
                for k in range(max(1, len(own) - size + 1) if len(own) else 0):
                    items.append(item)
                    found.append(own[k : k + size])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["item_id", "terms"]
            )

    return run


def phrases(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Each distinct window of ``size`` words, or whole shorter item: (terms, items)."""
    items = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")
    )
    found = items.mapInArrow(_windows(size), "item_id string, terms array<long>")
    return found.groupBy("terms").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of the wanted terms, unpacked one by one."""
    for row in B.rows(batches):
        data, wanted = row["data"], np.unique(np.array(row["terms"], np.int64).view(np.uint64))
        a, b = np.frombuffer(data[:8], np.uint32).astype(int) + 0
        terms = B.unpack(data[8 : 8 + a], np.uint64)
        at = np.searchsorted(terms, wanted)
        there = at < len(terms)
        there[there] = terms[at[there]] == wanted[there]
        at = at[there]
        if not len(at):
            continue
        counts = B.unpack(data[8 + a : 8 + a + b], np.uint32).astype(np.int64)
        places = B.unpack(data[8 + a + b :], np.uint32)
        ends = np.cumsum(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([row["block"]] * len(at), pa.int64()),
                pa.array(terms[at].view(np.int64)),
                pa.array(counts[at]),
                pa.array([B.pack(places[ends[i] - counts[i] : ends[i]]) for i in at], pa.binary()),
            ],
            ["block", "term", "n", "places"],
        )


def _match(plan: list, places: dict, document: np.ndarray, starts: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every occurrence of one phrase in a block.

    ``plan`` has (offset, term) from the rarest term on; ``document`` the number of
    the document that holds a place and ``starts`` its first place. A term at place p is p - offset
    along; an occurrence begins at some term's w, and every term's first in the document from
    w on is at most ``slop`` further along. Which term is the rarest does not matter.
    """
    offset, term = plan[0]
    anchors = places[term]
    lows, highs = [anchors[:0]], [anchors[:0]]
    for back in range(slop + 1):  # the rarest term is that much further along than where the occurrence begins
        w, owner = anchors - offset - back, document[anchors]
        begun = np.zeros(len(w), bool)
        low, high = np.full(len(w), np.iinfo(np.int64).max), np.full(len(w), -1)
        for offset_of, term in plan:
            if term not in places:
                return anchors[:0], anchors[:0]
            of = places[term]
            at = np.searchsorted(of, np.maximum(w + offset_of, starts[owner]))
            found = of[np.minimum(at, len(of) - 1)]
            good = (at < len(of)) & (found - offset_of - w <= slop)
            good[good] = document[found[good]] == owner[good]
            w, owner, found = w[good], owner[good], found[good]
            low, high = np.minimum(low[good], found), np.maximum(high[good], found)
            begun = begun[good] | (found - offset_of == w)
            if not len(w):
                break
        lows.append(low[begun])
        highs.append(high[begun])
    return np.concatenate(lows), np.concatenate(highs)


def _search(slop: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows["kind"] == 0].iloc[0]
        n_words = np.asarray(head["n_words"], np.int64)
        offsets = np.concatenate([[0], np.cumsum(n_words)])
        starts = offsets[:-1] + np.arange(len(n_words))
        document = np.repeat(np.arange(len(n_words)), n_words + 1)
        lists = rows[rows["kind"] == 1]
        places = {t: B.unpack(p, np.uint32).astype(np.int64) for t, p in zip(lists["term"], lists["places"])}
        cover = np.zeros(len(document) + 1, np.int64)
        items: dict[int, set] = {}
        asked = rows[rows["kind"] == 2]
        for terms, at, names in zip(asked["plan_terms"], asked["plan_offsets"], asked["items"]):
            low, high = _match(list(zip(at.tolist(), terms.tolist())), places, document, starts, slop)
            np.add.at(cover, low, 1)
            np.add.at(cover, high + 1, -1)
            for d in np.unique(document[low]).tolist():
                items.setdefault(d, set()).update(names)
        sums = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        names = [sorted(items.get(d, ())) for d in range(len(n_words))]
        return pd.DataFrame(
            {
                "doc_id": pd.arrays.IntegerArray(np.array(head["ids"], np.int64), ~np.array(head["has_id"], bool)),
                "n_words": n_words,
                "n_hit": sums[starts + n_words] - sums[starts],
                "n_items": [len(x) for x in names],
                "items": [",".join(x) for x in names],
            }
        )

    return run


def find(index: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """Every document with the words inside occurrences of the wanted phrases.

    ``wanted`` comes from `phrases`. Returns (doc_id, n_words, n_hit, n_items, items),
    the items sorted as strings and joined by commas.
    """
    wanted = B.kept(wanted, "phrases")
    terms = wanted.select(F.explode("terms").alias("term")).distinct()
    bucket = F.shiftrightunsigned("term", 64 - BUCKET_BITS).cast("int")
    terms = B.kept(terms.select("term", bucket.alias("bucket")), "terms")
    by_bucket = terms.groupBy("bucket").agg(F.collect_list("term").alias("terms"))
    if terms.count() <= BROADCAST_TERMS:
        by_bucket = F.broadcast(by_bucket)
    postings = index.where("kind = 1").select("block", "bucket", "data").join(by_bucket, "bucket")
    lists = postings.select("block", "data", "terms").mapInArrow(_lists, "block long, term long, n long, places binary")
    lists = B.kept(lists, "lists")

    counts = lists.groupBy("term").agg(F.sum("n").alias("n"))
    plan = wanted.select("terms", "items", F.posexplode("terms").alias("offset", "term")).join(counts, "term")
    plan = plan.groupBy("terms").agg(
        F.first("items").alias("items"), F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("plan")
    )
    plan = plan.where("size(plan) = size(terms)")  # a phrase with a term that no document has occurs nowhere
    plan = plan.select(
        "items",
        F.col("plan.term").alias("plan_terms"),
        F.col("plan.offset").alias("plan_offsets"),
        F.col("plan")[0]["term"].alias("term"),
    )
    asked = lists.select("block", "term").join(B.kept(plan, "plan"), "term")
    no_term = F.lit(0).cast("long").alias("term")  # a null would turn the terms into floating-point numbers
    rows = (
        index.where("kind = 0")
        .select("kind", "block", no_term, "ids", "has_id", "n_words")
        .unionByName(lists.select(F.lit(1).alias("kind"), "block", "term", "places"), allowMissingColumns=True)
        .unionByName(
            asked.select(F.lit(2).alias("kind"), "block", no_term, "plan_terms", "plan_offsets", "items"),
            allowMissingColumns=True,
        )
    )
    return rows.groupBy("block").applyInPandas(
        _search(slop), "doc_id long, n_words long, n_hit long, n_items long, items string"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per document: (doc_id, n_words, n_hit, n_items, items, contaminated)."""
    found = find(build_index(docs), phrases(benchmark, size), slop)
    return found.withColumn("contaminated", F.col("n_hit") > 0)
