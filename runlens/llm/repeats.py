"""Repeated byte strings, by column-wise construction of multi-document suffix order.

Removed is each byte of a document that lies in a string of ``length`` bytes which also
starts in a document with a smaller id. Texts are UTF-8 bytes, null is empty, and no
string crosses documents. Documents without an id come after all others and remove
nothing from each other; nor do rows that share an id.

Suffix order is built column by column, one symbol of every string a round, from the
last symbol to the first: the place of each new suffix follows from the rank of its first
symbol in the Burrows-Wheeler transform so far, and transform and common prefixes are
rewritten in one pass. Rounds are as many as the longest string has symbols, so whole
documents are first cut into short strings that hold every window of ``length`` bytes
exactly once: each window belongs to the smallest-hash ``ANCHOR``-gram in it, and a
string is the run of windows of one anchor. Equal windows have equal anchors, so

1. blocks of documents ask which of their anchors another document has as well,
2. they send the strings of these anchors, equal ones once, to the anchor's share,
3. each share builds the suffix order of the strings of every anchor that has different
   ones, and answers with the smallest document of each window.

An anchor with more than ``HOT`` occurrences is split: each window then is a string of its
own, dealt by its own hash. A share holds the strings of about ``SHARE_BYTES`` of text, in
memory, as machine-local files are not to be used; passes over it are sequential.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import blocks as B

LENGTH = 50
ANCHOR = 24
HOT = 1_000_000
BLOCK_BYTES = 2 << 20
SHARE_BYTES = 2 << 20

BLOCKS = (
    "block long, ids array<long>, has_id array<boolean>, n_bytes array<long>, "
    "text binary, first binary, windows binary, anchor binary"
)
ASK = "share int, block long, keys binary, counts binary, several binary"
SEND = "share int, block long, keys binary, lengths binary, docs binary, strings binary"
ANSWER = "block long, share int, data binary"
NO_ID = np.iinfo(np.int64).max


def cut(data: np.ndarray, starts: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows and anchor's place of every run of windows with one anchor."""
    n, w = len(data), length - anchor + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    smallest = _grams(data, np.arange(n), anchor) & np.uint64(0xFFFFFFFF00000000)
    smallest |= np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        smallest = np.minimum(smallest[:-size], smallest[size:])
        size *= 2
    if size < w:
        smallest = np.minimum(smallest[: size - w], smallest[w - size :])
    ends = np.repeat(starts[1:], np.diff(starts))
    window = np.arange(n)
    window = window[window + length <= ends]
    at = (smallest[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(new)
    return window[head], np.diff(np.append(head, len(window))), at[head]


def _grams(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes (a multiple of eight) from each place on; bytes past the end count as zero."""
    padded = np.zeros(len(data) + size + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + size, np.uint64, buffer=padded.data, strides=(1,))
    whole = len(at) == len(data)
    h = np.zeros(len(at), np.uint64)
    for k in range(0, size, 8):
        h ^= eight[k : k + len(data)] if whole else eight[at + k]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return B.mix(h)


def _blocks(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in B.blocks(batches, size=BLOCK_BYTES):
            data, starts = B.text_bytes(batch.column("text"))
            first, windows, place = cut(data, starts, length, anchor)
            ids = batch.column("doc_id")
            lists = [
                pa.array([pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)], pa.list_(pa.int64())),
                pa.array([ids.is_valid().to_numpy(zero_copy_only=False)], pa.list_(pa.bool_())),
                pa.array([np.diff(starts)], pa.list_(pa.int64())),
            ]
            blobs = [
                zstandard.compress(data.tobytes(), 1),
                B.pack_sorted(first.astype(np.uint64)),
                B.pack(windows.astype(np.uint32)),
                B.pack((place - first).astype(np.uint32)),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), *lists, *[pa.array([x], pa.binary()) for x in blobs]],
                ["block", "ids", "has_id", "n_bytes", "text", "first", "windows", "anchor"],
            )
            at += 1

    return run


class _Block:
    """A block's bytes, its runs of windows, and the document of each."""

    def __init__(self, row: dict, length: int, anchor: int, n_shares: int):
        self.length, self.n_shares = length, n_shares
        self.data = np.frombuffer(zstandard.decompress(row["text"]), np.uint8)
        self.n_bytes = np.asarray(row["n_bytes"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n_bytes)])
        self.ids = np.where(np.asarray(row["has_id"], bool), np.asarray(row["ids"], np.int64), NO_ID)
        self.first = B.unpack_sorted(row["first"]).astype(np.int64)
        self.windows = B.unpack(row["windows"], np.uint32).astype(np.int64)
        self.doc = np.searchsorted(self.starts, self.first, side="right") - 1
        place = self.first + B.unpack(row["anchor"], np.uint32)
        self.key = _grams(self.data, place, anchor)
        self.distinct, self.of = np.unique(self.key, return_inverse=True)

    def ask(self) -> tuple[np.ndarray, ...]:
        """Distinct anchors, their occurrences, and whether several documents here have them."""
        n = len(self.distinct)
        low, high = np.full(n, len(self.ids)), np.full(n, -1)
        np.minimum.at(low, self.of, self.doc)
        np.maximum.at(high, self.of, self.doc)
        return self.distinct, np.bincount(self.of, minlength=n).astype(np.uint32), (low < high).astype(np.uint8)

    def strings(self, answers: list[dict]) -> None:
        """The strings of anchors that other documents have, equal ones once, ordered by share."""
        code = np.zeros(len(self.distinct), np.uint8)
        cuts = np.searchsorted(B.share_of(self.distinct, self.n_shares), np.arange(self.n_shares + 1))
        for a in answers:
            code[cuts[a["share"]] : cuts[a["share"] + 1]] = B.unpack(a["data"], np.uint8)
        code = code[self.of]
        run, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        n = self.windows[hot]
        single = np.repeat(self.first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.concatenate([self.first[run], single])
        size = np.concatenate([self.windows[run], np.ones(len(single), np.int64)]) + self.length - 1
        doc = np.concatenate([self.doc[run], np.repeat(self.doc[hot], n)])
        name = B.hash_spans(self.data, first, first + size)
        key = np.concatenate([self.key[run], name[len(run) :]])
        key &= ~np.uint64(0xFFFFFF)
        # equal strings have equal anchors, so their hash names them within the block
        _, at, self.string = np.unique(name, return_index=True, return_inverse=True)
        order = np.argsort(key[at], kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.string, at = back[self.string], at[order]
        self.run_first, self.run_size, self.run_doc = first, size, doc
        self.s_first, self.s_size, self.s_key = first[at], size[at], key[at]
        self.s_doc = np.full(len(at), NO_ID)
        np.minimum.at(self.s_doc, self.string, self.ids[doc])
        self.s_share = B.share_of(self.s_key, self.n_shares)

    def removed(self, answers: list[dict]) -> np.ndarray:
        """Which bytes lie in a string that starts in a smaller document too."""
        windows = self.s_size - self.length + 1
        ends = np.cumsum(windows)
        smallest = np.full(ends[-1] if len(ends) else 0, NO_ID)
        cuts = np.searchsorted(self.s_share, np.arange(self.n_shares + 1))
        ends = np.concatenate([[0], ends])
        for a in answers:
            low, high = ends[cuts[a["share"]]], ends[cuts[a["share"] + 1]]
            smallest[low:high] = B.unpack(a["data"], np.int64)
        n = windows[self.string]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        seen = smallest[np.repeat(ends[self.string], n) + within]
        start = np.repeat(self.run_first, n) + within
        start = start[seen < np.repeat(self.ids[self.run_doc], n)]
        cover = np.zeros(len(self.data) + 1, np.int32)
        cover[start] += 1
        cover[start + self.length] -= 1
        return np.cumsum(cover[:-1]) > 0


def _rows(block: int, n_shares: int, share: np.ndarray, pack_rows) -> Iterator[tuple]:
    cuts = np.searchsorted(share, np.arange(n_shares + 1))
    for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            yield (s, block, *pack_rows(a, b))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * (len(names) - 2)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _ask(length: int, anchor: int, n_shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            keys, counts, several = _Block(row, length, anchor, n_shares).ask()
            share = B.share_of(keys, n_shares)
            rows = _rows(
                row["block"], n_shares, share,
                lambda a, b: (B.pack_sorted(keys[a:b]), B.pack(counts[a:b]), B.pack(several[a:b])),
            )
            yield _batch(list(rows), ["share", "block", "keys", "counts", "several"])

    return run


def _tell(hot: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Of each asked anchor: 0 one document has it, 1 several, 2 very many occurrences."""
        keys = [B.unpack_sorted(x) for x in rows["keys"]]
        cuts = np.cumsum([0] + [len(x) for x in keys])
        counts = np.concatenate([B.unpack(x, np.uint32) for x in rows["counts"]])
        several = np.concatenate([B.unpack(x, np.uint8) for x in rows["several"]])
        distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
        docs = np.bincount(of, 1 + several, len(distinct))
        code = (docs > 1).astype(np.uint8) + ((docs > 1) & (np.bincount(of, counts, len(distinct)) > hot))
        code = code[of].astype(np.uint8)
        return pd.DataFrame(
            {
                "block": rows["block"].to_numpy(),
                "share": int(rows["share"].iloc[0]),
                "data": [B.pack(code[a:b]) for a, b in zip(cuts[:-1], cuts[1:])],
            }
        )

    return run


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after the other."""
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return data[at]


def _send(length: int, anchor: int, n_shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            b = _Block(row, length, anchor, n_shares)
            b.strings(row["told"] or [])
            rows = _rows(
                row["block"], n_shares, b.s_share,
                lambda i, j: (
                    B.pack_sorted(b.s_key[i:j]),
                    B.pack(b.s_size[i:j].astype(np.uint32)),
                    B.pack(b.s_doc[i:j]),
                    zstandard.compress(_gather(b.data, b.s_first[i:j], b.s_size[i:j]).tobytes(), 1),
                ),
            )
            yield _batch(list(rows), ["share", "block", "keys", "lengths", "docs", "strings"])

    return run


def suffix_order(data: np.ndarray, first: np.ndarray, size: np.ndarray, most: int):
    """Burrows-Wheeler transform and common prefixes (up to ``most``) of a collection of strings.

    Returns (transform with 0 for a string's end and else 1 + the symbol's rank, common
    prefix of each suffix and the one before it). One symbol of each string is inserted
    per round, the last one first.
    """
    m = len(first)
    symbols = np.zeros(256, bool)
    symbols[data] = True
    code = np.cumsum(symbols).astype(np.uint8)  # UTF-8 has under 255 different bytes
    text = code[data]
    last = first + size - 1
    active = np.arange(m)
    row = np.arange(m)
    bwt = text[last]
    common = np.zeros(m, np.uint8)
    for t in range(1, int(size.max()) + 1):
        more = size[active] >= t
        active, row = active[more], row[more]
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
        rank[order] = np.arange(n, dtype=rank.dtype)
        shift = m - int(np.searchsorted(bwt[order], 0, side="right"))
        at = rank[row]
        # the new suffix and its successor get a new common prefix with the one before them
        touched = np.zeros(n + 1, bool)
        touched[at] = touched[at + 1] = True
        touched = np.flatnonzero(touched[:n])
        touched = touched[touched > 0]
        left, right = order[touched - 1], order[touched]
        same = bwt[left] == bwt[right]
        touched, left, right = touched[same], left[same], right[same]
        if len(touched):
            edges = np.stack([left + 1, right + 1], 1).reshape(-1)
            padded = np.append(common, np.uint8(0))
            shared = np.minimum(np.minimum.reduceat(padded, edges)[::2].astype(np.int64) + 1, most)
        new = at + shift
        old = np.ones(n + len(active), bool)
        old[new] = False
        longer = size[active] > t
        next_symbol = np.where(longer, text[np.maximum(last[active] - t, 0)], 0)
        grown = np.empty(len(old), np.uint8)
        grown[old], grown[new] = bwt, next_symbol
        prefixes = np.empty(len(old), np.uint8)
        prefixes[old], prefixes[new] = common, 0
        if len(touched):
            prefixes[touched + shift] = shared
        bwt, common, row = grown, prefixes, new
    return bwt, common


def _places(bwt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Row of every suffix, by string and then from the whole string on, by walking back from the ends."""
    m = len(size)
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[order] = np.arange(len(bwt))
    step += m - int((bwt == 0).sum())
    ends = np.cumsum(size)
    out = np.empty(ends[-1], np.int64)
    active, row = np.arange(m), np.arange(m)
    for t in range(1, int(size.max()) + 1):
        more = size[active] >= t
        active, row = active[more], step[row[more]]
        out[ends[active] - t] = row
    return out


def _smallest(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """For each window of each string the smallest document that has it."""
        keys = [B.unpack_sorted(x) for x in rows["keys"]]
        cuts = np.cumsum([0] + [len(x) for x in keys])
        key = np.concatenate(keys)
        size = np.concatenate([B.unpack(x, np.uint32) for x in rows["lengths"]]).astype(np.int64)
        docs = np.concatenate([B.unpack(x, np.int64) for x in rows["docs"]])
        data = np.frombuffer(b"".join(zstandard.decompress(x) for x in rows["strings"]), np.uint8)
        first = np.cumsum(size) - size
        name = B.hash_spans(data, first, first + size)
        order = np.lexsort((name, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (name[order][1:] != name[order][:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        lead = order[new]
        low = np.full(len(lead), NO_ID)
        np.minimum.at(low, of, docs)
        # of the distinct strings those whose anchor has another one, in the order of their anchors
        k = key[lead]
        other = np.zeros(len(k), bool)
        same = k[1:] == k[:-1]
        other[1:] |= same
        other[:-1] |= same
        windows = size[lead] - length + 1
        ends = np.concatenate([[0], np.cumsum(windows)])
        smallest = np.repeat(low, windows)
        some = np.flatnonzero(other)
        if len(some):
            s_size, s_windows = size[lead[some]], windows[some]
            text = _gather(data, first[lead[some]], s_size)
            s_first = np.cumsum(s_size) - s_size
            bwt, common = suffix_order(text, s_first, s_size, length)
            place = _places(bwt, s_size)
            group = np.cumsum(common < length)
            start = np.repeat(s_first - (np.cumsum(s_windows) - s_windows), s_windows) + np.arange(s_windows.sum())
            group = group[place[start]]
            least = np.full(int(group.max()) + 1, NO_ID)
            np.minimum.at(least, group, np.repeat(low[some], s_windows))
            at = np.repeat(ends[some] - (np.cumsum(s_windows) - s_windows), s_windows) + np.arange(s_windows.sum())
            smallest[at] = least[group]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            mine = of[a:b]
            out.append(B.pack(_gather(smallest, ends[mine], windows[mine])))
        return pd.DataFrame({"block": rows["block"].to_numpy(), "share": int(rows["share"].iloc[0]), "data": out})

    return run


def _cleaned(length: int, anchor: int, n_shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            b = _Block(row, length, anchor, n_shares)
            b.strings(row["told"] or [])
            gone = b.removed(row["smallest"] or [])
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            starts = b.starts[:-1][b.n_bytes > 0]
            rise[starts] = gone[starts]
            kept = b.data[~gone]
            n_gone = np.concatenate([[0], np.cumsum(gone)])[b.starts]
            n_rise = np.concatenate([[0], np.cumsum(rise)])[b.starts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.asarray(row["ids"], np.int64), mask=~np.asarray(row["has_id"], bool)),
                    pa.array(b.n_bytes),
                    pa.array(np.diff(n_gone)),
                    pa.array(np.diff(n_rise)),
                    pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), len(b.n_bytes), [None, pa.py_buffer((b.starts - n_gone).astype(np.int64)), pa.py_buffer(kept)]
                    ).cast(pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def _by_block(answers: DataFrame, name: str) -> DataFrame:
    """A block's answers in one value; about as large as the block."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("share", "data")).alias(name))


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """Each document's bytes without those repeated from smaller ids.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept). ``anchor`` is a multiple of eight, at most ``length``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_shares = B.shares(docs, F.octet_length("text"), SHARE_BYTES)
    blocks = B.bucketed(docs.mapInArrow(_blocks(length, anchor), BLOCKS), "repeat_blocks", min(n_shares, 4096))
    asked = blocks.mapInArrow(_ask(length, anchor, n_shares), ASK)
    told = B.kept(asked.groupBy("share").applyInPandas(_tell(hot), ANSWER), "repeat-anchors")
    rows = blocks.join(_by_block(told, "told"), "block", "left")
    sent = rows.mapInArrow(_send(length, anchor, n_shares), SEND)
    smallest = B.kept(sent.groupBy("share").applyInPandas(_smallest(length), ANSWER), "repeat-windows")
    rows = rows.join(_by_block(smallest, "smallest"), "block", "left")
    return rows.mapInArrow(
        _cleaned(length, anchor, n_shares), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
