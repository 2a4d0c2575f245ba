"""Language-model scores from a probabilistic suffix tree over words.

The tree's contexts are the last words before a word: none (the root), one, two, up
to ``depth``. The root has add-one smoothed word frequencies. A context s seen C
times gives a next word w, seen c times after it, the probability

    P(w | s) = max(c - 1, 0) / C + rest(s) * P(w | parent of s),

rest(s) being the mass that this leaves over. The context is retained if it was seen
at least twice and its distribution diverges from its parent's by at least
``DIVERGENCE`` bits. A text's score uses at every word the longest retained suffix of
what precedes it; before the first word stand start marks, after the last comes an end
mark. Contexts are of ``depth`` words at most; within that limit the tree grows with the corpus, uncapped.

Words are runs of anything but ASCII white space, with A-Z lower-cased, counted by
64-bit hashes; a context and its next word by 36 + 28 bits. A null text is an empty
one. Documents without an id are trained on. Repeated rows count as often as they occur.

Steps: documents become blocks of word codes, written bucketed by block, so that joins
with answers move no blocks. For each level, a block asks every share of the hashes for
its distinct pairs of context and word; the share adds them up, tests the contexts and
answers every block. Contexts that hold a thousandth of all words (1,000 at most) are
split over all shares by the next word, and their sums are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import blocks as B

DEPTH = 2
DIVERGENCE = 0.1
HOT_SHARE = 1 / 1000
HELD_OUT_OF, HELD_OUT = 7, 2
BLOCK_BYTES = 8 << 20

SYMBOL_BITS = np.uint64(28)
_SYMBOL = (np.uint64(1) << SYMBOL_BITS) - np.uint64(1)
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0x2545F4914F6CDD1D)

BLOCKS = "block long, ids array<long>, has_id array<boolean>, held array<boolean>, n_words array<long>, words binary, codes binary"
REQUEST = "share int, block long, keys binary, counts binary, parents binary"
ANSWER = "block long, share int, context long, n long, mass double, gain double, counts binary, rest binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << 32
    for batch in B.blocks(batches, size=BLOCK_BYTES):
        data, starts = B.text_bytes(batch.column("text"))
        data = B.LOWER[data]
        first, last, offsets = B.spans(data, starts, B.NOT_SPACE)
        words, codes = np.unique(B.hash_spans(data, first, last), return_inverse=True)
        ids = batch.column("doc_id")
        lists = [
            pc.fill_null(ids, 0).to_numpy(zero_copy_only=False),
            ids.is_valid().to_numpy(zero_copy_only=False),
            batch.column("held").to_numpy(zero_copy_only=False),
            np.diff(offsets),
        ]
        kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64())]
            + [pa.array([x], pa.list_(k)) for x, k in zip(lists, kinds)]
            + [pa.array([B.pack_sorted(words)], pa.binary())]
            + [pa.array([B.pack(codes.astype(np.uint32))], pa.binary())],
            ["block", "ids", "has_id", "held", "n_words", "words", "codes"],
        )
        at += 1


class _Block:
    """One block's tokens, each document's words and its end mark, with what is known of them."""

    def __init__(self, row: dict, total: int, n_shares: int, unknown: float):
        self.total, self.n_shares, self.unknown = total, n_shares, unknown
        self.n_tokens = np.asarray(row["n_words"], np.int64) + 1
        self.held = np.asarray(row["held"], bool)
        self.ends = np.cumsum(self.n_tokens) - 1
        self.words = B.unpack_sorted(row["words"])
        n = int(self.n_tokens.sum())
        self.is_end = np.zeros(n, bool)
        self.is_end[self.ends] = True
        self.code = np.full(n, len(self.words), np.int64)
        self.code[~self.is_end] = B.unpack(row["codes"], np.uint32)
        self.train = ~np.repeat(self.held, self.n_tokens)
        self.place = np.arange(n) - np.repeat(self.ends + 1 - self.n_tokens, self.n_tokens)

    def word_request(self) -> tuple[np.ndarray, np.ndarray]:
        seen = self.code[self.train & ~self.is_end]
        return self.words, np.bincount(seen, minlength=len(self.words)).astype(np.uint32)

    def learn_words(self, counts: np.ndarray, n_trained_docs: int) -> None:
        self.counts = np.append(counts, n_trained_docs)[self.code].astype(np.int64)
        self.prob = (self.counts + 1) * self.unknown

    def level(self, k: int, repeated: np.ndarray | None) -> None:
        """Keys of the pairs of the last ``k`` words and the next, of places whose context may be retained."""
        hashes = np.append(self.words, _END)[self.code]
        n, context = len(hashes), np.zeros(len(hashes), np.uint64)
        for back in range(1, k + 1):
            before = np.full(n, _START)
            before[back:] = hashes[:-back] if back < n else hashes[:0]
            before[self.place < back] = _START
            context = B.mix(context * _PAIR ^ before)
        size = np.zeros(n, np.int64)  # how often the context was seen
        size[1:] = (self.counts if k == 1 else repeated)[:-1]
        size[self.place == 0] = self.trained_docs
        self.size = size
        self.asked = np.flatnonzero(size >= 2)
        symbol = B.mix(hashes + _PAIR) >> (np.uint64(64) - SYMBOL_BITS)
        symbol = np.where(self.counts >= 2, np.maximum(symbol, np.uint64(1)), np.uint64(0))
        key = (context & ~_SYMBOL) | symbol
        self.keys, first, self.of = np.unique(key[self.asked], return_index=True, return_inverse=True)
        self.key_size = size[self.asked][first]
        self.key_parent = self.prob[self.asked][first]
        hot = self.key_size >= HOT_SHARE * self.total
        spread = np.where(hot, B.mix(self.keys), self.keys)
        self.share = B.share_of(spread, self.n_shares)
        self.order = np.argsort(self.share, kind="stable")
        self.hot = hot

    def take_level(self, answers: list[dict], hot: dict[int, float]) -> np.ndarray:
        """Update the probabilities by a level's answers; returns how often each place's pair was seen, if twice or more."""
        counts, rest = np.zeros(len(self.keys), np.int64), np.ones(len(self.keys), np.float32)
        cuts = np.searchsorted(self.share[self.order], np.arange(self.n_shares + 1))
        for a in answers:
            at = self.order[cuts[a["share"]] : cuts[a["share"] + 1]]
            counts[at] = B.unpack(a["counts"], np.uint32)
            rest[at] = B.unpack(a["rest"], np.float32)
        at = np.flatnonzero(self.hot)
        context = (self.keys[at] & ~_SYMBOL).view(np.int64)
        rest[at] = [hot.get(c, 1) for c in context.tolist()]
        own = self.of
        kept = rest[own] < 1
        add = np.maximum(counts[own] - 1, 0) / np.maximum(self.size[self.asked], 1)
        p = self.prob[self.asked]
        self.prob[self.asked] = np.where(kept, add + rest[own] * p, p)
        seen = np.zeros(len(self.code), np.int64)
        seen[self.asked] = counts[own]
        return seen


def _requests(block: int, keys, counts, parents, share, n_shares) -> pa.RecordBatch:
    """One row a share; ``share`` ascends."""
    cuts = np.searchsorted(share, np.arange(n_shares + 1))
    rows = [
        (s, block, B.pack_sorted(keys[a:b]), B.pack(counts[a:b]), B.pack(parents[a:b]))
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
        if a < b
    ]
    names = ["share", "block", "keys", "counts", "parents"]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names
    )


def _ask_words(n_shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            b = _Block(row, 1, n_shares, 0.0)
            keys, counts = b.word_request()
            share = B.share_of(keys, n_shares)
            yield _requests(row["block"], keys, counts, np.zeros(len(keys), np.uint8), share, n_shares)

    return run


def _gathered(rows: pd.DataFrame):
    """All pairs that the blocks ask one share about: distinct keys, sums, a parent, and each block's places among them."""
    keys = [B.unpack_sorted(x) for x in rows["keys"]]
    cuts = np.cumsum([0] + [len(x) for x in keys])
    counts = np.concatenate([B.unpack(x, np.uint32) for x in rows["counts"]])
    parents = np.concatenate([B.unpack(x, np.uint8) for x in rows["parents"]])
    distinct, first, of = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    sums = np.bincount(of, counts, len(distinct)).astype(np.int64)
    return distinct, sums, parents[first], [of[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _answers(rows: pd.DataFrame, share: int, places, counts, rest) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "block": rows["block"].to_numpy(),
            "share": share,
            "context": 0,
            "n": 0,
            "mass": 0.0,
            "gain": 0.0,
            "counts": [B.pack(counts[p].astype(np.uint32)) for p in places],
            "rest": [B.pack(rest[p].astype(np.float32)) for p in places],
        }
    )


def _count_words(rows: pd.DataFrame) -> pd.DataFrame:
    """How often each asked word was trained on; one more row, of block -1, has the number of words that were."""
    share = int(rows["share"].iloc[0])
    _, sums, _, places = _gathered(rows)
    out = _answers(rows, share, places, sums, np.zeros(len(sums)))
    about = {"block": -1, "share": share, "context": 0, "n": int((sums > 0).sum()), "mass": 0.0, "gain": 0.0, "counts": b"", "rest": b""}
    return pd.concat([out, pd.DataFrame([about])])


def _divergence(mass, gain, size):
    """Bits between a context's next-word distribution and its parent's, from sums over its repeated words."""
    left = 1 - mass / size
    return (gain - mass * np.log2(size)) / size + np.where(left > 0, left * np.log2(np.maximum(left, 1e-300)), 0)


def _test_contexts(hot_size: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        share = int(rows["share"].iloc[0])
        keys, sums, parents, places = _gathered(rows)
        context = keys & ~_SYMBOL
        # hot contexts are here in part only: one of their keys tells so by its parent's top bit
        hot = parents >= 128
        again = (sums >= 2) & ((keys & _SYMBOL) > 0)
        sums_again = np.where(again, sums, 0)
        minus = (sums_again - again).astype(float)
        gain = minus * (np.log2(np.maximum(minus, 1)) + (parents & 127) / 3.0)
        names, start, of = np.unique(context, return_index=True, return_inverse=True)
        size = np.bincount(of, sums, len(names))
        mass, gain = np.bincount(of, minus, len(names)), np.bincount(of, gain, len(names))
        is_hot = np.bincount(of, hot, len(names)) > 0
        keep = ~is_hot & (mass > 0)
        keep[keep] = _divergence(mass[keep], gain[keep], size[keep]) >= DIVERGENCE
        rest = np.ones(len(names))
        rest[keep] = 1 - mass[keep] / size[keep]
        out = _answers(rows, share, places, sums_again, rest[of])
        at = np.flatnonzero(is_hot)
        about = pd.DataFrame(
            {"block": -1, "share": share, "context": names[at].view(np.int64), "n": size[at].astype(np.int64), "mass": mass[at], "gain": gain[at], "counts": b"", "rest": b""}
        )
        return pd.concat([out, about]) if len(at) else out

    return run


def _by_block(answers: DataFrame, level: int) -> DataFrame:
    """A block's answers of a level in one value; no more than the block has distinct pairs."""
    rows = answers.where("block >= 0").groupBy("block")
    return rows.agg(F.collect_list(F.struct("share", "counts", "rest")).alias(f"level{level}"))


def _replay(row: dict, known: dict, levels: int) -> _Block:
    """A block with the answers of all levels so far taken in."""
    b = _Block(row, known["total"], known["n_shares"], known["unknown"])
    b.trained_docs = known["docs"]
    share = B.share_of(b.words, b.n_shares)
    cuts = np.searchsorted(share, np.arange(b.n_shares + 1))
    counts = np.zeros(len(b.words), np.int64)
    for a in row["level0"] or []:
        counts[cuts[a["share"]] : cuts[a["share"] + 1]] = B.unpack(a["counts"], np.uint32)
    b.learn_words(counts, known["docs"])
    b.base = b.prob.copy()
    seen = None
    for k in range(1, levels + 1):
        b.level(k, seen)
        seen = b.take_level(row[f"level{k}"] or [], known["hot"][k])
    b.seen = seen
    return b


def _ask_pairs(known: dict, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            b = _replay(row, known, level - 1)
            b.level(level, b.seen)
            counts = np.bincount(b.of, b.train[b.asked], len(b.keys)).astype(np.uint32)
            parents = np.minimum(np.round(-np.log2(b.key_parent) * 3), 127).astype(np.uint8) + 128 * b.hot.astype(np.uint8)
            o = b.order
            yield _requests(row["block"], b.keys[o], counts[o], parents[o], b.share[o], b.n_shares)

    return run


def _score(known: dict, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            b = _replay(row, known, depth)
            start = b.ends + 1 - b.n_tokens
            ids = pa.array(np.asarray(row["ids"], np.int64), mask=~np.asarray(row["has_id"], bool))
            known_words = (b.counts > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(b.held),
                    pa.array(b.n_tokens),
                    pa.array(np.add.reduceat(known_words, start)),
                    pa.array(np.full(len(start), known["total"], np.int64)),
                    pa.array(np.add.reduceat(np.log10(b.base), start)),
                    pa.array(np.add.reduceat(np.log10(b.prob), start)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def scores(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Each document's log10 probability by the word frequencies and by the suffix tree.

    Trained on the documents whose ``crc32(doc_id)`` leaves another remainder by 7 than 2.
    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % HELD_OUT_OF
    docs = docs.withColumn("held", remainder == HELD_OUT)
    n_blocks = B.shares(docs, F.octet_length("text"), BLOCK_BYTES)
    blocks = B.bucketed(docs.mapInArrow(_blocks, BLOCKS), "lm_blocks", min(n_blocks, 4096))

    trained = blocks.select(F.explode(F.arrays_zip("held", "n_words")).alias("d")).where("not d.held")
    size = trained.agg(F.count("*").alias("docs"), F.sum("d.n_words").alias("words")).first()
    total = (size.words or 0) + size.docs
    asked = blocks.mapInArrow(_ask_words(n_blocks), REQUEST)
    answers = B.kept(asked.groupBy("share").applyInPandas(_count_words, ANSWER), "lm-words")
    distinct = answers.where("block = -1").agg(F.sum("n").alias("n")).first().n or 0
    distinct += size.docs > 0
    known = {"docs": size.docs, "total": total, "n_shares": n_blocks, "unknown": 1 / (total + distinct + 1), "hot": {}}

    rows = blocks.join(_by_block(answers, 0), "block", "left")
    for level in range(1, depth + 1):
        asked = rows.mapInArrow(_ask_pairs(known, level), REQUEST)
        answers = asked.groupBy("share").applyInPandas(_test_contexts(HOT_SHARE * total), ANSWER)
        answers = B.kept(answers, "lm-pairs")
        hot = answers.where("block = -1").groupBy("context")
        hot = hot.agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.sum("gain").alias("gain")).where("mass > 0")
        known["hot"][level] = {
            r.context: 1 - r.mass / r.n
            for r in hot.collect()  # 1,000 contexts at most
            if _divergence(np.float64(r.mass), np.float64(r.gain), np.float64(r.n)) >= DIVERGENCE
        }
        rows = rows.join(_by_block(answers, level), "block", "left")
    return rows.mapInArrow(
        _score(dict(known), depth),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
