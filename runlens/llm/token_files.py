"""Token files: documents as token ids, compressed by a Re-Pair grammar per shard.

A shard holds the ids of a run of documents in ascending order of doc_id. Pairs of
neighbouring symbols that occur often are replaced by new symbols, round by round, and
no pair reaches over a document's end. The file keeps the rules, the length that each
symbol expands to, where each document's symbols start, and the symbols; so any document
or range of ids is decoded from a part of the symbols alone.

Texts are encoded by the given tokenizer file of the ``tokenizers`` library, without
special tokens; each document is closed by ``end_id``. Of a tokenizer that drops
white space and treats words apart by it on their own, which is tried on texts with all kinds of it, each distinct word
of the corpus is encoded once: blocks of documents ask the shares of the words' hashes and
put the answers together. Any other encodes whole texts. A null text is an empty one. Documents without an id come first;
rows with equal ids follow each other by their texts.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.llm import blocks as B
from runlens.llm.files import read_file, write_file
from runlens.session import new_folder

END_ID = 2
ROUNDS = 4
#: A pair is replaced if it occurs this often in its shard.
FREQUENT = 8
BLOCK_BYTES = 4 << 20
SHARE_BYTES = 8 << 20

MAGIC = b"RPAIR001"
BLOCKS = "block long, ids array<long>, has_id array<boolean>, n_words array<long>, n_bytes long, codes binary, words binary"
TABLE_BITS = 18


class CorruptShard(ValueError):
    """A token file that is cut off, altered or not one at all."""


def replace_pairs(ids: np.ndarray, last: np.ndarray, rounds: int, frequent: int):
    """Re-Pair in rounds: (symbols, place of each document's last symbol, left, right).

    In a round all pairs that occur at least ``frequent`` times compete; where two
    occurrences overlap the more frequent pair wins, and of equal ones the first.
    Symbols from ``base`` = greatest id + 1 on stand for the rules in turn.
    """
    seq = ids.astype(np.int64)
    base = int(seq.max()) + 1 if len(seq) else 0
    left, right = [], []
    next_symbol = base
    for _ in range(rounds):
        if len(seq) < 2:
            break
        key = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:].astype(np.uint64)
        inner = np.ones(len(key), bool)
        inner[last[last < len(key)]] = False
        # the ids of a first round often fit half a key, which sorts twice as fast
        small = next_symbol <= 1 << 16
        ordered = np.sort((key >> np.uint64(16) | seq[1:].astype(np.uint64)).astype(np.uint32)[inner] if small else key[inner])
        if not len(ordered):
            break
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        counts = np.diff(edge)
        often = counts >= frequent
        pairs, counts = ordered[edge[:-1][often]].astype(np.uint64), counts[often]
        if small:
            pairs = pairs >> np.uint64(16) << np.uint64(32) | pairs & np.uint64(0xFFFF)
        if not len(pairs):
            break
        by_count = np.argsort(-counts, kind="stable")
        pairs = pairs[by_count]
        rank = _find(pairs, key)
        rank[~inner] = len(pairs)
        # an occurrence is replaced if neither neighbour that it overlaps is to be preferred
        chosen = rank < len(pairs)
        chosen[1:] &= rank[1:] < rank[:-1]
        chosen[:-1] &= rank[:-1] <= rank[1:]
        at = np.flatnonzero(chosen)
        used = np.zeros(len(pairs), bool)
        used[rank[at]] = True
        name = np.cumsum(used) - 1 + next_symbol
        left.append((pairs[used] >> np.uint64(32)).astype(np.int64))
        right.append((pairs[used] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        next_symbol += int(used.sum())
        seq[at] = name[rank[at]]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        last = last - np.searchsorted(at + 1, last, side="right")
        seq = seq[stay]
    none = np.zeros(0, np.int64)
    return seq, last, base, np.concatenate([none, *left]), np.concatenate([none, *right])


def _find(pairs: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Index of each key among distinct pairs, their number where it is none of them."""
    bits = max(TABLE_BITS, int(len(pairs) * 2).bit_length())
    shift = np.uint64(64 - bits)

    def slot(x):
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> shift

    out = np.full(len(key), len(pairs), np.int32)
    left, at, todo = np.arange(len(pairs), dtype=np.int32), slot(key), None
    table = np.empty(1 << bits, np.int32)
    while len(left):  # pairs that share a slot wait for the next turn, and so do keys that met another pair there
        table.fill(-1)
        mine = slot(pairs[left])
        table[mine[::-1]] = left[::-1]
        got = table[at if todo is None else at[todo]]
        filled = np.flatnonzero(got >= 0)
        got = got[filled]
        filled = filled if todo is None else todo[filled]
        same = pairs[got] == key[filled]
        out[filled[same]] = got[same]
        todo = filled[~same]
        left = left[table[mine] != left]
    return out


def shard(ids: np.ndarray, n_tokens: np.ndarray, doc_ids: np.ndarray, has_id: np.ndarray, rounds: int = ROUNDS, frequent: int = FREQUENT) -> bytes:
    """The file of the documents whose ids follow each other, ``n_tokens`` each."""
    last = np.cumsum(n_tokens) - 1
    if len(n_tokens) and n_tokens.min() < 1:
        raise ValueError("a document has one id at least, its end")
    symbols, last, base, left, right = replace_pairs(ids, last, rounds, frequent)
    lengths = _lengths(base, left, right)
    parts = [
        B.pack(doc_ids.astype(np.int64)),
        B.pack(has_id.astype(np.uint8)),
        B.pack(n_tokens.astype(np.int64)),
        B.pack(np.diff(last, prepend=-1).astype(np.int64)),
        B.pack(left.astype(np.uint32)),
        B.pack(right.astype(np.uint32)),
        B.pack(lengths.astype(np.uint32)),
        B.pack(symbols.astype(np.uint32)),
    ]
    head = struct.pack("<QQQ", base, len(n_tokens), int(n_tokens.sum())) + struct.pack("<8Q", *map(len, parts))
    body = head + b"".join(parts)
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def _lengths(base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids that each rule expands to; a rule uses ids and earlier rules only."""
    out = np.zeros(len(left), np.int64)
    todo = np.arange(len(left))
    while len(todo):
        a, b = left[todo] - base, right[todo] - base
        a = np.where(a < 0, 1, out[np.maximum(a, 0)])
        b = np.where(b < 0, 1, out[np.maximum(b, 0)])
        ready = (a > 0) & (b > 0)
        out[todo[ready]] = (a + b)[ready]
        todo = todo[~ready]
    return out


class Shard:
    """A token file, opened: whole, by document or by range of ids."""

    def __init__(self, data):
        data = memoryview(data)
        if len(data) < 100 or bytes(data[:8]) != MAGIC:
            raise CorruptShard("no token file")
        if zlib.crc32(data[12:]) != struct.unpack("<I", data[8:12])[0]:
            raise CorruptShard("checksum differs")
        self.base, n_docs, n_ids = struct.unpack("<QQQ", data[12:36])
        sizes = struct.unpack("<8Q", data[36:100])
        cuts = np.cumsum([100, *sizes])
        kinds = [np.int64, np.uint8, np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint32]
        parts = [B.unpack(data[a:b], k) for a, b, k in zip(cuts[:-1], cuts[1:], kinds)]
        self.doc_ids, self.has_id, self.n_tokens, n_symbols, left, right, lengths, self.symbols = parts
        self.has_id = self.has_id.astype(bool)
        self.left, self.right = left.astype(np.int64), right.astype(np.int64)
        self.lengths = np.concatenate([np.zeros(0, np.int64), lengths.astype(np.int64)])
        self.symbol_starts = np.concatenate([[0], np.cumsum(n_symbols)])
        self.starts = np.concatenate([[0], np.cumsum(self.n_tokens)])
        if len(self.doc_ids) != n_docs or self.starts[-1] != n_ids or self.symbol_starts[-1] != len(self.symbols):
            raise CorruptShard("counts differ")

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        seq = symbols.astype(np.int64)
        while True:
            rule = seq - self.base
            made = rule >= 0
            if not made.any():
                return seq.astype(np.uint32)
            at = np.flatnonzero(made)
            rule = rule[at]
            seq = np.repeat(seq, made + 1)
            at += np.arange(len(at))
            seq[at], seq[at + 1] = self.left[rule], self.right[rule]

    def all(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from its own symbols alone."""
        return self._expand(self.symbols[self.symbol_starts[k] : self.symbol_starts[k + 1]])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``, found by the symbols' lengths."""
        sizes = np.where(self.symbols < self.base, 1, 0).astype(np.int64)
        made = self.symbols >= self.base
        sizes[made] = self.lengths[self.symbols[made].astype(np.int64) - self.base]
        ends = np.cumsum(sizes)
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self._expand(self.symbols[a:b])[start - before : stop - before]


def _strings(letters: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Words of the given sizes that stand one after the other."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    small = ends[-1] < 1 << 31
    buffers = [None, pa.py_buffer(ends.astype(np.int32 if small else np.int64)), pa.py_buffer(letters)]
    return pa.Array.from_buffers(pa.string() if small else pa.large_string(), len(sizes), buffers)


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of every word, and the words of each row."""
    data, starts = B.text_bytes(column)
    first, last, offsets = B.spans(data, starts, B.NOT_SPACE)
    coded = _strings(data[B.NOT_SPACE[data]], last - first).dictionary_encode()
    n_words = np.diff(offsets).astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), n_words


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << 32
    for batch in B.blocks(batches, size=BLOCK_BYTES):
        column = batch.column("text")
        distinct, codes, n_words = _words(column)
        data, starts = B.text_bytes(distinct)
        # words in the order of their shares, so that an answer needs no keys
        order = np.argsort(B.hash_spans(data, starts[:-1], starts[1:]), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        data, starts = B.text_bytes(distinct.take(pa.array(order)))
        ids = batch.column("doc_id")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([at], pa.int64()),
                pa.array([pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)], pa.list_(pa.int64())),
                pa.array([ids.is_valid().to_numpy(zero_copy_only=False)], pa.list_(pa.bool_())),
                pa.array([n_words], pa.list_(pa.int64())),
                pa.array([int(starts[-1])], pa.int64()),
                pa.array([B.pack(place[codes].astype(np.uint32))], pa.binary()),
                pa.array([zstandard.compress(np.insert(data, starts[1:-1], 32).tobytes(), 1)], pa.binary()),
            ],
            ["block", "ids", "has_id", "n_words", "n_bytes", "codes", "words"],
        )
        at += 1


def _unpacked(words: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words with a space between each two: their bytes, and where each starts and ends."""
    text = zstandard.decompress(words)
    if not text:
        return text, np.zeros(0, np.int64), np.zeros(0, np.int64)
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    return text, np.concatenate([[0], spaces + 1]), np.append(spaces, len(text))


def _ask(n_shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text, first, last = _unpacked(row["words"])
                share = B.share_of(B.hash_spans(np.frombuffer(text, np.uint8), first, last), n_shares)
                cuts = np.searchsorted(share, np.arange(n_shares + 1))
                for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if a < b:
                        rows.append((s, row["block"], zstandard.compress(text[first[a] : last[b - 1]], 1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int32(), pa.int64(), pa.binary()])],
                ["share", "block", "words"],
            )

    return run


def encode_words(tokenizer, words: list[str], group: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word and where they start: words are encoded many at a time, told apart by their places."""
    texts = [" ".join(words[k : k + group]) for k in range(0, len(words), group)]
    ids, counts = [], []
    for k in range(0, len(texts), 100):
        for n, found in enumerate(tokenizer.encode_batch(texts[k : k + 100], add_special_tokens=False), k):
            own = words[n * group : (n + 1) * group]
            ends = np.cumsum([len(w) + 1 for w in own])
            places = np.array([a for a, _ in found.offsets], np.int64)
            counts.append(np.bincount(np.searchsorted(ends, places, side="right"), minlength=len(own)))
            ids.append(np.array(found.ids, np.uint32))
    counts = np.concatenate([np.zeros(0, np.int64), *counts])
    return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum(counts)])


def _pieces(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    n = int(size.sum())
    kind = np.int32 if max(n, len(values)) < 1 << 31 else np.int64
    at = np.repeat((first - (np.cumsum(size) - size)).astype(kind), size)
    at += np.arange(n, dtype=kind)
    return values[at]


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The tokenizer, opened once in each worker."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def _encode(path: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tokenizer = _tokenizer(path)
        asked = [_unpacked(x) for x in rows["words"]]
        cuts = np.cumsum([0] + [len(first) for _, first, _ in asked])
        letters = np.frombuffer(b"".join(text for text, _, _ in asked), np.uint8)
        coded = _strings(letters[letters != 32], np.concatenate([last - first for _, first, last in asked])).dictionary_encode()
        del asked, letters
        ids, starts = encode_words(tokenizer, coded.dictionary.to_pylist())
        of = coded.indices.to_numpy()
        size = np.diff(starts)
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            mine = of[a:b]
            out.append((B.pack(size[mine].astype(np.uint32)), B.pack(_pieces(ids, starts[mine], size[mine]))))
        return pd.DataFrame(
            {
                "block": rows["block"].to_numpy(),
                "share": int(rows["share"].iloc[0]),
                "sizes": [x[0] for x in out],
                "ids": [x[1] for x in out],
            }
        )

    return run


#: Texts that a tokenizer must encode as their words, one after the other, to be given words alone.
PROBES = ("a b", " a", "a ", "a  b", "it's so", "x\ty\nz\r\n", "1 2", "\u00e9 \u00fc", "a. b, (c) d", "\x0ba\x0c")


def words_alone(tokenizer) -> bool:
    """Whether the ids of a text are those of its words."""

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    return all(ids(p) == [x for word in p.split() for x in ids(word)] for p in PROBES)


def _write_whole(path: str, folder: str, end_id: int, rounds: int, frequent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        block = TaskContext.get().partitionId() << 32
        for batch in B.blocks(batches, size=BLOCK_BYTES):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            found = [np.array([*x.ids, end_id], np.uint32) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
            n_tokens, ids = np.array([len(x) for x in found], np.int64), batch.column("doc_id")
            doc_ids, has_id = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
            data = shard(np.concatenate(found), n_tokens, doc_ids, has_id, rounds, frequent)
            name = write_file(folder, f"shard-{block:016x}", data)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (block, name, len(n_tokens), int(n_tokens.sum()), len(data))],
                ["block", "path", "n_docs", "n_ids", "n_bytes"],
            )
            block += 1

    return run


FILES = "block long, path string, n_docs long, n_ids long, n_bytes long"


def _write(folder: str, end_id: int, rounds: int, frequent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            answers = sorted(row["answers"] or [], key=lambda a: a["share"])
            none = np.zeros(0, np.uint32)
            size = np.concatenate([none, *[B.unpack(a["sizes"], np.uint32) for a in answers]]).astype(np.int64)
            known = np.concatenate([none, *[B.unpack(a["codes"], np.uint32) for a in answers]])
            # one more word, the end of a document
            first = np.append(np.cumsum(size) - size, len(known))
            size, known = np.append(size, 1), np.append(known, np.uint32(end_id))
            n_words = np.asarray(row["n_words"], np.int64)
            ends = np.cumsum(n_words + 1) - 1
            word = np.full(int((n_words + 1).sum()), len(size) - 1, np.int64)
            inner = np.ones(len(word), bool)
            inner[ends] = False
            word[inner] = B.unpack(row["codes"], np.uint32)
            ids = _pieces(known, first[word], size[word])
            n_tokens = np.diff(np.cumsum(size[word])[ends], prepend=0)
            data = shard(ids, n_tokens, np.asarray(row["ids"], np.int64), np.asarray(row["has_id"], bool), rounds, frequent)
            path = write_file(folder, f"shard-{row['block']:016x}", data)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (row["block"], path, len(n_tokens), len(ids), len(data))],
                ["block", "path", "n_docs", "n_ids", "n_bytes"],
            )

    return run


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, rounds: int = ROUNDS, frequent: int = FREQUENT
) -> DataFrame:
    """Encode the documents into token files; returns the list of files.

    (block, path, n_docs, n_ids, n_bytes): in the order of ``block`` they hold the
    documents in ascending order of doc_id.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_shares = B.shares(docs, F.octet_length("text"), SHARE_BYTES)
    ordered = docs.repartitionByRange(max(n_shares // 2, 1), "doc_id").sortWithinPartitions("doc_id", "text")
    folder = new_folder(spark, "tokens")
    if not words_alone(_tokenizer(tokenizer)):
        return B.kept(ordered.mapInArrow(_write_whole(tokenizer, folder, end_id, rounds, frequent), FILES), "token-files")
    blocks = B.bucketed(ordered.mapInArrow(_blocks, BLOCKS), "token_blocks", min(n_shares, 4096))
    asked = blocks.select("block", "words").mapInArrow(_ask(n_shares), "share int, block long, words binary")
    answers = asked.groupBy("share").applyInPandas(_encode(tokenizer), "block long, share int, sizes binary, ids binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("share", "sizes", F.col("ids").alias("codes"))).alias("answers"))
    rows = blocks.drop("words").join(answers, "block", "left")
    files = rows.mapInArrow(_write(folder, end_id, rounds, frequent), FILES)
    return B.kept(files, "token-files")


def placed(files: DataFrame) -> DataFrame:
    """The files with ``start``, the ids in all files before: first over the tasks that wrote them, then within each."""
    files = files.withColumn("part", F.shiftright("block", 32))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row a task
    parts = parts.select("part", before.alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    return files.withColumn("inside", inside).join(parts, "part").withColumn("start", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in B.rows(batches):
        s = Shard(read_file(row["path"]))
        ids = np.ascontiguousarray(s.all(), "<u4")
        if len(ids) != s.starts[-1]:
            raise CorruptShard("expands to another number of ids")
        data = ids.view(np.uint8)
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(s.starts[:-1].tolist(), s.starts[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(s.doc_ids, mask=~s.has_id),
                pa.array(row["start"] + s.starts[:-1]),
                pa.array(s.n_tokens),
                pa.array(crc, pa.int64()),
            ],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def read_tokens(files: DataFrame) -> DataFrame:
    """Each document of the files: (doc_id, start, n_tokens, ids_crc32)."""
    rows = placed(files).select("path", "start")
    return rows.repartition(B.shares(files, "n_bytes", 4 << 20)).mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
