"""Words of Arrow text columns as numpy spans and hashes, and tables between steps.

A *block* is a run of documents of bounded size that one task handles at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import new_folder

BLOCK_BYTES = 4 << 20
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (32, 9, 10, 11, 12, 13)
NOT_SPACE = ~np.isin(np.arange(256), SPACES)
#: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

LONG_SPAN = 512
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts lineage for good."""
    spark = df.sparkSession
    folder = new_folder(spark, purpose)
    df.write.partitionBy(*partition_by).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, name: str, n: int) -> DataFrame:
    """Rows of blocks as a table in the shared folder, bucketed by block: joins by block leave them where they are."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, "block").option("path", new_folder(spark, name)).format("parquet").saveAsTable(name)
    return spark.table(name)


def shares(df: DataFrame, size, per_share: int, least: int = 1) -> int:
    """How many shares of about ``per_share`` a table has, by the sum of ``size``."""
    total = df.agg(F.sum(size).alias("n")).first().n or 0
    return max(least, -(-int(total) // per_share))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column one after the other, and where each row starts.

    Nulls count as empty. There is one start more than rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def blocks(
    batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about ``size`` bytes of text or of one longer row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            used = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, used + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches as dicts, one at a time: no more than one is copied."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            yield {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """What is written inside passes wide rows to Python in batches of about this size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spans(
    data: np.ndarray, starts: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and where each row's words start in these lists."""
    word = is_word[data]
    n = len(word)
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    before[starts[starts < n]] = False
    first = np.flatnonzero(word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after[starts[starts > 0] - 1] = False
    last = np.flatnonzero(word & ~after) + 1
    return first, last, np.searchsorted(first, starts)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers, one to one."""
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def hash_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes at a step."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, np.uint64, buffer=padded.data, strides=(1,))
    left = (last - first).astype(np.int64)
    h = (left.astype(np.uint64) + np.uint64(1)) * _ODD
    long = np.flatnonzero(left > LONG_SPAN)
    for i in long:
        h[i] = xxhash.xxh3_64_intdigest(data[first[i] : last[i]].tobytes())
    if len(long):
        left[long] = 0
    active, at = np.flatnonzero(left > 0), None
    at, left = first[active], left[active]
    while len(active):
        x = eight[at] & _FIRST_BYTES[np.minimum(left, 8)]
        y = (h[active] ^ x) * _ODD
        h[active] = y ^ (y >> np.uint64(29))
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    return mix(h)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of ``n`` neighbours; one for each possible start."""
    size = max(0, len(hashes) - n + 1)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = (h ^ hashes[k : k + size]) * _ODD
        h ^= h >> np.uint64(31)
    return mix(h)


def pack(numbers: np.ndarray) -> bytes:
    """The numbers compressed, their bytes of equal weight together."""
    planes = numbers.view(np.uint8).reshape(len(numbers), numbers.dtype.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Ascending 64-bit integers, as differences."""
    return pack(np.diff(numbers, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def share_of(hashes: np.ndarray, n_shares: int) -> np.ndarray:
    """Which of ``n_shares`` ranges of hashes each one is in; ascends with the hash."""
    return ((hashes >> np.uint64(40)) * np.uint64(n_shares) >> np.uint64(24)).astype(np.int64)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For every item the row it belongs to, from the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
