"""Divergence between the sources of a language, over texts collapsed to distinct ones.

Identical texts of a language become one with a multiplicity for each source, and only it is cut into
terms; its counts go to each source as often as that has the text. A language keeps the terms that at
least ``LEAST_DOCS`` of its documents have. Over these, of V, a source whose counts add
up to N gives a term with ``count`` occurrences the share

    p = 1 + floor(10^9 (count + 2) / (N + 2 V)),

and two sources differ in a term by floor((p - q)^2 / (p + q)), in whole numbers throughout.

Pairs of sources are evaluated by buckets of a language's terms, each a small matrix of sources by terms.
Only terms that one of the two has are looked at; all others have the same two shares, so they are
counted and multiplied. A bucket gives one partial sum a pair of sources, half of the pairs,
since the difference is the same both ways.

Nulls of text, lang and source are empty texts. Rows count each for itself, repeated or not. A
language without terms gives pairs of value 0 and no terms. Empty tables give no rows; other
columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.llm import blocks as B

LEAST_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
#: Sources times terms of a bucket.
CELLS = 1 << 20

LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def texts(docs: DataFrame) -> DataFrame:
    """(lang, text, sources: array of (source, n)): each distinct text of a language once."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    docs = docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
    once = docs.groupBy("lang", "digest").agg(F.any_value("text").alias("text"))
    of = docs.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    of = of.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    return once.join(of, ["lang", "digest"]).drop("digest")


COUNTS = "lang string, source string, term string, n long, n_docs long"


def _terms(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, the code of every term, and each one's row."""
    first, last, offsets = B.spans(data, starts, LETTER)
    letters = B.LOWER[data[LETTER[data]]]
    ends = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), B.row_of(offsets)


def _sums(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return [key[at], *[np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in B.blocks(batches):
        data, starts = B.text_bytes(batch.column("text"))
        words, codes, row = _terms(data, starts)
        pairs, count = np.unique(row << 32 | codes, return_counts=True)
        row, codes = pairs >> 32, pairs & 0xFFFFFFFF
        # a text's counts go to each of its sources
        sources = batch.column("sources")
        lists = sources.combine_chunks() if isinstance(sources, pa.ChunkedArray) else sources
        parts = lists.flatten()
        owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        group = pa.table(
            {"lang": batch.column("lang").take(pa.array(owner)), "source": parts.field("source"), "at": np.arange(len(owner))}
        )
        groups = group.group_by(["lang", "source"]).aggregate([("at", "list")])
        number = np.empty(len(owner), np.int64)
        number[groups["at_list"].combine_chunks().flatten().to_numpy()] = B.row_of(groups["at_list"].combine_chunks().offsets.to_numpy())
        times = parts.field("n").to_numpy(zero_copy_only=False)
        n_owned = np.bincount(owner, minlength=batch.num_rows)
        first = np.cumsum(n_owned) - n_owned
        copies = n_owned[row]
        at = np.repeat(first[row] - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())
        key, n, n_docs = _sums(
            number[at] << 32 | np.repeat(codes, copies), np.repeat(count, copies) * times[at], times[at]
        )
        for k in range(0, len(key), 1 << 16):
            part = slice(k, k + (1 << 16))
            of, term = pa.array(key[part] >> 32), pa.array(key[part] & 0xFFFFFFFF)
            columns = [groups["lang"].take(of), groups["source"].take(of), words.take(term).cast(pa.string())]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n[part]), pa.array(n_docs[part])], ["lang", "source", "term", "n", "n_docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs) of all terms, documents counted as often as they occur."""
    found = texts(docs).mapInArrow(_counts, COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _share(count: Column, total: Column, n_terms: Column) -> Column:
    """p of a term, exact."""
    return (1 + F.call_function("div", F.lit(UNIT).cast("decimal(20,0)") * (count + 2), total + 2 * n_terms)).cast("long")


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _difference(p: np.ndarray, q) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


PAIRS = "lang string, a string, b string, value long"


def _pairs(key, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of one bucket of terms, for each two sources a < b of the language."""
    groups = groups.sort_values("place")
    names, none = groups["source"].to_numpy(), groups["none"].to_numpy(np.int64)
    n_terms = int(cells["term"].nunique())
    source = pd.Series(np.arange(len(names)), index=names)[cells["source"]].to_numpy()
    term = pd.factorize(cells["term"])[0]
    p = np.repeat(none[:, None], n_terms, axis=1)
    p[source, term] = cells["p"].to_numpy(np.int64)
    has = np.zeros(p.shape, bool)
    has[source, term] = True
    rows = []
    for a in range(len(names) - 1):
        mine = np.flatnonzero(has[a])
        value = _difference(p[a + 1 :, mine], p[a, mine]).sum(axis=1)
        # terms that b alone has, then those that neither has
        alone = np.where(has[a + 1 :] & ~has[a], _difference(p[a + 1 :], none[a]), 0).sum(axis=1)
        neither = n_terms - (has[a + 1 :] | has[a]).sum(axis=1)
        rows.append(value + alone + neither * _difference(none[a + 1 :], none[a]))
    a, b = np.triu_indices(len(names), 1)
    value = np.concatenate([np.zeros(0, np.int64), *rows])
    lang = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
    return pd.DataFrame({"lang": [lang] * len(a), "a": names[a], "b": names[b], "value": value})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and by which terms it stands out."""
    spark = docs.sparkSession
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    every = plain.groupBy("lang", "source").agg(F.count("*").alias("rows")).drop("rows")
    with B.small_batches(spark):
        cells = B.kept(term_counts(docs), "term-counts")
    terms = cells.groupBy("lang", "term").agg(F.sum("n_docs").alias("d"), F.sum("n").alias("of_lang"))
    terms = B.kept(terms.where(F.col("d") >= least_docs).drop("d"), "kept-terms")
    cells = B.kept(cells.drop("n_docs").join(terms, ["lang", "term"]), "kept-counts")

    big = "decimal(20,0)"
    langs = terms.groupBy("lang").agg(F.count("*").cast(big).alias("n_terms"), F.sum("of_lang").cast(big).alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").cast(big).alias("total"))
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.withColumns({c: F.coalesce(c, F.lit(0).cast(big)) for c in ("total", "n_terms", "lang_total")})
    none = F.when(F.col("n_terms") > 0, _share(F.lit(0).cast(big), F.col("total"), F.col("n_terms")))
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumns(
        {
            "none": none,
            "n_sources": F.count("*").over(by_lang),
            "place": F.row_number().over(by_lang.orderBy("source")),
        }
    )
    groups = B.kept(groups, "audit-groups")

    cells = cells.join(groups.select("lang", "source", "total", "n_terms", "lang_total", "n_sources"), ["lang", "source"])
    cells = cells.withColumns(
        {
            "p": _share(F.col("n").cast(big), F.col("total"), F.col("n_terms")),
            "q": _share(F.col("of_lang").cast(big), F.col("lang_total"), F.col("n_terms")),
        }
    )
    buckets = F.ceil(F.col("n_terms") * F.col("n_sources") / CELLS).cast("int")
    cells = B.kept(cells.withColumn("bucket", F.pmod(F.xxhash64("term"), buckets).cast("int")).drop("total", "n_terms", "lang_total", "n_sources", "n", "of_lang"), "shares")
    listed = groups.where("n_terms > 0").withColumn("bucket", F.explode(F.sequence(F.lit(0), buckets - 1)))
    pairs = cells.select("lang", "bucket", "source", "term", "p").groupBy("lang", "bucket")
    pairs = pairs.cogroup(listed.select("lang", "bucket", "source", "none", "place").groupBy("lang", "bucket")).applyInPandas(_pairs, PAIRS)
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = B.kept(pairs, "audit-pairs")
    # the result has both ways of each pair, also of languages without terms
    bare = groups.where("n_terms = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    both = both.unionAll(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    both = both.unionAll(bare.select("lang", "source", "item", F.lit(0).cast("long")))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    found = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return both.unionAll(found)
