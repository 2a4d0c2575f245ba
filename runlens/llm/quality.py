"""Quality rules: repetition counts, and divergence from the document's language.

Each language, however small, gets two reference histograms, counted over all its
documents: the classes of its characters, and its common words (each at least a
two-hundredth of its words) with all other words as one bin. A document's own
histograms are compared with these by the Jensen-Shannon distance (square root of
the divergence in bits, 0 to 1). Short texts say little: a distance counts only from
a least number of characters or words on, and its limit is wider the shorter the text.
Documents without a language (null or empty) are a group with a reference like any
other; as they may be of many languages, each is also compared with the language whose
common words it uses most, among those sent to every task, and the nearer one counts.

Words are runs of anything but ASCII white space. Null and empty texts have none
and fail the base rule. Repeated rows are judged each for itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import blocks as B
from runlens.session import staging

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WORDS = 5
#: A common word's least share of its language: bounds a reference.
COMMON_SHARE = 1 / 200
#: References sent to every task, of the largest languages; those of the others are joined with their documents.
BROADCAST_LANGUAGES = 1_000
#: Languages whose sizes are sent to every task; beyond it they are joined by a shuffle.
BROADCAST_SIZES = 100_000
#: Least length for each comparison, its limit for long texts, and what a text of n adds to the limit: widen / sqrt(n).
CLASS_GUARD, CLASS_LIMIT, CLASS_WIDEN = 200, 0.16, 3.0
WORD_GUARD, WORD_LIMIT, WORD_WIDEN = 50, 0.20, 2.0
#: Text for which the words are counted in one task.
SHARE_BYTES = 16 << 20

CLASSES = ("lower", "upper", "other letter", "digit", "space", "line end", "comma or stop", "symbol", "other punctuation", "control")


def _byte_class(b: int) -> int:
    c = chr(b)
    if b >= 128:
        return 2
    if c.isalpha():
        return 0 if c.islower() else 1
    if c.isdigit():
        return 3
    if c == "\n":
        return 5
    if b in B.SPACES:
        return 4
    if c in ",.":
        return 6
    if c in "#*$%&|<>":
        return 7
    return 8 if 33 <= b < 127 else 9


_CLASS = np.array([_byte_class(b) for b in range(256)])
_CHARACTER = np.array([not 128 <= b < 192 for b in range(256)])
_SYMBOL = _CLASS == 7


def _classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Characters of each class in each row."""
    n, k = len(starts) - 1, len(CLASSES)
    keep = _CHARACTER[data]
    at = B.row_of(starts)[keep] * k + _CLASS[data[keep]]
    return np.bincount(at, minlength=n * k).reshape(n, k)


def _count(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[starts[1:]] - sums[starts[:-1]]


def _languages(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(pc.fill_null(batch.column("lang"), "").to_pylist(), object)


def _statistics(n_shares: int):
    """Per block: characters by class of each language (share -1), and its words by share of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.blocks(batches):
            data, starts = B.text_bytes(batch.column("text"))
            first, last, offsets = B.spans(data, starts, B.NOT_SPACE)
            words = B.hash_spans(data, first, last)
            row, classes = B.row_of(offsets), _classes(data, starts)
            names, code = np.unique(_languages(batch), return_inverse=True)
            out: list[tuple] = []
            for i, name in enumerate(names.tolist()):
                own, counts = np.unique(words[code[row] == i], return_counts=True)
                sums = classes[code == i].sum(axis=0)
                out.append((name, -1, int(counts.sum()), sums.astype(np.int64).tobytes(), b""))
                share = own % np.uint64(n_shares)
                order = np.argsort(share, kind="stable")
                own, counts, share = own[order], counts[order].astype(np.uint32), share[order]
                cuts = np.searchsorted(share, np.arange(n_shares + 1))
                for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if a < b:
                        out.append((name, s, 0, counts[a:b].tobytes(), own[a:b].tobytes()))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("lang", "share", "n_words", "counts", "words"), x)) for x in out],
                pa.schema([("lang", pa.string()), ("share", pa.int32()), ("n_words", pa.int64()), ("counts", pa.binary()), ("words", pa.binary())]),
            )

    return run


def _common(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one share of the hashes, the words common in each language."""
    words = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["words"]])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["counts"]]).astype(np.int64)
    names, first, code = np.unique(rows["lang"].to_numpy(object), return_index=True, return_inverse=True)
    limit = rows["size"].to_numpy()[first] * COMMON_SHARE
    of = np.repeat(code, [len(x) // 8 for x in rows["words"]])
    order = np.lexsort((words, of))
    of, words = of[order], words[order]
    new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (words[1:] != words[:-1])))
    sums = np.add.reduceat(counts[order], new)
    of, words = of[new], words[new]
    at = np.flatnonzero(sums >= limit[of])
    return pd.DataFrame({"lang": names[of[at]], "word": words[at].view(np.int64), "n": sums[at]})


Reference = tuple[np.ndarray, np.ndarray, np.ndarray]


def references(docs: DataFrame) -> tuple[dict[str, Reference], DataFrame | None]:
    """By language ('' for none): shares of character classes, hashes of common words, shares of these and of the rest.

    The largest languages' references, and a table of all others' (lang, size, classes, words) if there are more.
    A reference has at most 200 words.
    """
    with staging(docs.sparkSession, "statistics") as folder:  # all that is kept of it is written or collected here
        found = B.kept(_references(docs, folder), "references")
    large = found.orderBy(F.desc("size"), "lang").limit(BROADCAST_LANGUAGES).collect()
    refs = {r.lang: _reference(r.size, r.classes, r.words) for r in large}
    if found.count() == len(large):
        return refs, None
    return refs, found.where(~F.col("lang").isin(list(refs)))


def _references(docs: DataFrame, folder: str) -> DataFrame:
    n_bytes = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    stats = docs.select("lang", "text").mapInArrow(
        _statistics(-(-n_bytes // SHARE_BYTES) or 1),
        "lang string, share int, n_words long, counts binary, words binary",
    )
    stats.write.parquet(folder)
    stats = docs.sparkSession.read.schema(stats.schema).parquet(folder)
    heads = stats.where("share = -1")
    sizes = heads.groupBy("lang").agg(F.sum("n_words").alias("size"))
    classes = heads.select("lang", "counts").mapInArrow(_unpacked, "lang string, place int, n long")
    classes = classes.groupBy("lang", "place").agg(F.sum("n").alias("n")).groupBy("lang")
    classes = classes.agg(F.collect_list(F.struct("place", "n")).alias("classes"))
    # without the hint the statistics would be shuffled by language as well
    near = F.broadcast(sizes) if sizes.count() <= BROADCAST_SIZES else sizes
    words = stats.where("share >= 0").join(near, "lang").select("lang", "share", "size", "counts", "words").groupBy("share")
    words = words.applyInPandas(_common, "lang string, word long, n long")
    words = words.groupBy("lang").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    return sizes.join(classes, "lang").join(words, "lang", "left").select("lang", "size", "classes", "words")


def _reference(size: int, classes: list, words: list | None) -> Reference:
    by_class = np.zeros(len(CLASSES))
    for c in classes:
        by_class[c["place"]] = c["n"]
    hashes = np.array([w["word"] for w in words or ()], np.int64).view(np.uint64)
    counts = np.array([w["n"] for w in words or ()], float)
    order = np.argsort(hashes)
    counts = np.append(counts[order], size - counts.sum())
    return by_class / max(1, by_class.sum()), hashes[order], counts / max(1, size)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [np.frombuffer(x, np.int64) for x in batch.column("counts").to_pylist()]
        k = len(CLASSES)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang").take(pa.array(np.repeat(np.arange(len(counts)), k))),
                pa.array(np.tile(np.arange(k, dtype=np.int32), len(counts))),
                pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64)),
            ],
            ["lang", "place", "n"],
        )


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to a distribution; 0 for rows without counts."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum((left + right) / 2, 0)), 0)


def _repeats(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Words of each row inside windows of ``n`` words that the row has twice or more."""
    size = len(words)
    cover = np.zeros(size + 1, np.int64)
    if size >= n:
        row = B.row_of(offsets)
        start = np.flatnonzero(row[: size - n + 1] == row[n - 1 :])
        key = B.mix(B.windows(words, n)[start] + B.mix(row[start].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        cover[start[twice]] += 1
        np.subtract.at(cover, start[twice] + n, 1)
    return _count(np.cumsum(cover[:-1]) > 0, offsets)


def _duplicate_lines(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines of each row that have a word and equal an earlier line of the row."""
    first, last, offsets = B.spans(data, starts, np.arange(256) != 10)
    sums = np.concatenate([[0], np.cumsum(B.NOT_SPACE[data])])
    worded = sums[last] > sums[first]
    row = B.row_of(offsets)[worded]
    key = B.mix(B.hash_spans(data, first[worded], last[worded]) + B.mix(row.astype(np.uint64)))
    _, at = np.unique(key, return_index=True)
    n = len(starts) - 1
    return np.bincount(row, minlength=n) - np.bincount(row[at], minlength=n)


def _distances(classes: np.ndarray, words: np.ndarray, row: np.ndarray, ref: Reference) -> np.ndarray:
    """Distances of rows by classes and by words; ``row`` says which row each word is in."""
    by_class, common, shares = ref
    n, k = len(classes), len(common) + 1
    at = np.searchsorted(common, words)
    known = at < len(common)
    known[known] = common[at[known]] == words[known]
    bins = np.bincount(row * k + np.where(known, at, k - 1), minlength=n * k).reshape(n, k)
    return np.stack([distance(classes, by_class), distance(bins, shares)])


def _likeliest(words: np.ndarray, row: np.ndarray, n: int, hashes: np.ndarray, of: np.ndarray, n_refs: int) -> np.ndarray:
    """For each row the reference whose common words it uses most; ``hashes`` ascend, ``of`` are their references."""
    out = np.zeros(n, np.int64)
    ends = np.searchsorted(row, np.arange(n + 1))
    first, last = np.searchsorted(hashes, words), np.searchsorted(hashes, words, side="right")
    for i in range(n):
        a, many = first[ends[i] : ends[i + 1]], (last - first)[ends[i] : ends[i + 1]]
        places = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(many.sum())
        out[i] = np.argmax(np.bincount(of[places], minlength=n_refs))
    return out


def _judge(refs: dict, carry: list[str], name: str, joined: str | None = None):
    """``joined`` names a column with the reference of documents whose language is not in ``refs``."""
    named = [x for x in refs if x != ""]
    hashes = np.concatenate([np.zeros(0, np.uint64), *(refs[x][1] for x in named)])
    order = np.argsort(hashes, kind="stable")
    hashes, of = hashes[order], np.repeat(np.arange(len(named)), [len(refs[x][1]) for x in named])[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.blocks(batches):
            data, starts = B.text_bytes(batch.column("text"))
            first, last, offsets = B.spans(data, starts, B.NOT_SPACE)
            words = B.hash_spans(data, first, last)
            row, n = B.row_of(offsets), batch.num_rows
            n_words = np.diff(offsets)
            repeat = _repeats(words, offsets, REPEAT_WORDS)
            base = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
            classes = _classes(data, starts)
            far = np.zeros((2, n))
            lang = _languages(batch)
            names, code = np.unique(lang, return_inverse=True)
            by_lang = np.argsort(code[row], kind="stable")
            cuts = np.searchsorted(code[row][by_lang], np.arange(len(names) + 1))
            place = np.zeros(n, np.int64)
            for i, own in enumerate(names.tolist()):
                mine, at = np.flatnonzero(code == i), by_lang[cuts[i] : cuts[i + 1]]
                place[mine] = np.arange(len(mine))
                own_words, own_row = words[at], place[row[at]]
                ref = refs.get(own) or _reference(**batch.column(joined)[int(mine[0])].as_py())
                far[:, mine] = _distances(classes[mine], own_words, own_row, ref)
                if own or not named:
                    continue
                like = _likeliest(own_words, own_row, len(mine), hashes, of, len(named))
                for j in np.unique(like):
                    some = like == j
                    inside = some[own_row]
                    to = _distances(classes[mine[some]], own_words[inside], (np.cumsum(some) - 1)[own_row[inside]], refs[named[j]])
                    nearer = to[1] < far[1, mine[some]]
                    far[:, mine[some][nearer]] = to[:, nearer]
            n_chars = classes.sum(axis=1)
            odd = (n_chars >= CLASS_GUARD) & (far[0] > CLASS_LIMIT + CLASS_WIDEN / np.sqrt(np.maximum(n_chars, 1)))
            odd |= (n_words >= WORD_GUARD) & (far[1] > WORD_LIMIT + WORD_WIDEN / np.sqrt(np.maximum(n_words, 1)))
            out = {
                "n_words": n_words,
                "word_chars": _count(_CHARACTER[data] & B.NOT_SPACE[data], starts),
                "n_symbols": _count(_SYMBOL[data], starts),
                "n_dup_lines": _duplicate_lines(data, starts),
                "n_repeat_words": repeat,
                "base_failed": base,
                "class_distance": far[0],
                "word_distance": far[1],
                "kept": ~(base | odd),
            }
            verdict = pa.StructArray.from_arrays([pa.array(x) for x in out.values()], list(out))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [verdict], [*carry, name])

    return run


VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, class_distance double, word_distance double, kept boolean"
)


def judged(docs: DataFrame, name: str = "verdict") -> DataFrame:
    """The documents with all their columns and one more, ``name``: a struct of counts, distances and ``kept``.

    A column of that name is replaced.
    """
    carry = [c for c in docs.columns if c != name]
    types = dict(docs.dtypes)
    docs = docs.withColumns({c: F.col(c).cast("string") for c in ("text", "lang")})
    refs, others = references(docs)
    schema = ", ".join([f"`{c}` {'string' if c in ('text', 'lang') else types[c]}" for c in carry])
    fields = VERDICT.replace(" ", ":").replace(",:", ", ")
    schema = f"{schema}, `{name}` struct<{fields}>"
    docs = docs.select(*carry)
    if others is None:
        return docs.mapInArrow(_judge(refs, carry, name), schema)
    joined, other = (f"{x}_{uuid.uuid4().hex}" for x in ("reference", "lang"))
    others = others.select(F.col("lang").alias(other), F.struct("size", "classes", "words").alias(joined))
    own = F.coalesce("lang", F.lit(""))
    large = docs.where(own.isin(list(refs))).mapInArrow(_judge(refs, carry, name), schema)
    small = docs.where(~own.isin(list(refs)))
    small = small.join(others, F.coalesce(small["lang"], F.lit("")) == others[other]).select(*carry, joined)
    return large.union(small.mapInArrow(_judge(refs, carry, name, joined), schema))


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, distances, base_failed, kept) of each document; ``docs`` needs text and lang."""
    return judged(docs.select("doc_id", "text", "lang")).select("doc_id", "verdict.*")
