"""Repairing the structure of conversations by dynamic programming over a grammar.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Each turn is
kept (free), given the other of the roles user and assistant (2) or deleted (3), and empty turns of these
roles may be inserted anywhere (2). Blank turns and repeated ones must go; a truncated turn
that stays costs 1. Of the cheapest ways the one whose edits' initials (D, I, K, R) come
first in ASCII is taken; these initials are the audit.

A turn is a symbol: its role's class and its fault. A symbol moves the automaton of the
pattern between four states, so it is a matrix of costs, and a sequence is the min-plus product
of its symbols' matrices. Every entry carries its audit as a rope. Sequences are cut into
chunks of at most ``CHUNK`` turns; the *distinct* chunks of all conversations are compressed by Re-Pair, and
each rule's matrix is made once from the two it consists of. A chunk is the product over what its grammar
leaves of it; chunks of one conversation are joined in order. So a conversation of any
length is spread over tasks, and one that thousands share is solved once.

Inserts stand before the turn they precede, so all audits of an entry have as many other
letters and end in one: none is the beginning of another, and the least of two stays the
least whatever follows. Long ropes are compared by 61-bit hashes of their beginnings.

The hash of the repaired text has no parallel form: a conversation's texts go through one
task, in order and one batch at a time, never held together.

Turns go by ``turn``, nulls first, those of one turn in the order of their SHA-256. Null roles and texts
are one space; a null conversation is one like any other. Empty roles and those with other
initials cannot be kept. Empty tables give no rows; other columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm import blocks as B

SPACE = " \t\n\x0b\x0c\r"
CHUNK_BITS = 12
#: Symbols of distinct chunks that share a grammar in a task.
GRAMMAR_SYMBOLS = 1 << 18
SALTS = 8

CLASSES = "suax"  # system, user, assistant, any other
SOUND, CUT, GONE = "suax", "SUAX", "0123"  # a symbol of each class: sound, truncated, to be deleted
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Inserts that lead from one to another:
INSERTS = {(0, 0): 0, (0, 2): 1, (0, 3): 2, (1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 2): 0, (2, 3): 1, (3, 3): 0, (3, 2): 1}
STEPS = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)], "x": []}
ENTRIES = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
_AT = {e: k for k, e in enumerate(ENTRIES)}
PATHS = [[(_AT[i, k], _AT[k, j]) for k in range(4) if (i, k) in _AT and (k, j) in _AT] for i, j in ENTRIES]
#: Inserts after the last turn that make each state a good end.
ENDS = {0: 0, 1: 2, 2: 1, 3: 0}

# -- ropes: (length, hash, text, None) or (length, hash, left, right)

MOD, BASE = (1 << 61) - 1, 911_382_323
LEAF = 512


def _hash(text: str) -> int:
    h = 0
    for c in text.encode():
        h = (h * BASE + c) % MOD
    return h


def leaf(text: str) -> tuple:
    return len(text), _hash(text), text, None


def join(a: tuple, b: tuple) -> tuple:
    if not a[0] or not b[0]:
        return b if not a[0] else a
    n, h = a[0] + b[0], (a[1] * pow(BASE, b[0], MOD) + b[1]) % MOD
    if n <= LEAF and a[3] is None and b[3] is None:
        return n, h, a[2] + b[2], None
    return n, h, a, b


def text_of(rope: tuple) -> str:
    parts, todo = [], [rope]
    while todo:
        r = todo.pop()
        if r[3] is None:
            parts.append(r[2])
        else:
            todo += [r[3], r[2]]
    return "".join(parts)


def _beginning(rope: tuple, k: int) -> int:
    """Hash of the first ``k`` letters."""
    h = 0
    while k < rope[0]:
        _, _, left, right = rope
        if right is None:
            return (h * pow(BASE, k, MOD) + _hash(left[:k])) % MOD
        if k <= left[0]:
            rope = left
        else:
            h, k, rope = (h * pow(BASE, left[0], MOD) + left[1]) % MOD, k - left[0], right
    return (h * pow(BASE, rope[0], MOD) + rope[1]) % MOD


def _letter(rope: tuple, k: int) -> str:
    while rope[3] is not None:
        if k < rope[2][0]:
            rope = rope[2]
        else:
            k, rope = k - rope[2][0], rope[3]
    return rope[2][k]


def less(a: tuple, b: tuple) -> bool:
    """Whether rope ``a`` comes before ``b``."""
    if a[3] is None and b[3] is None:
        return a[2] < b[2]
    if a[:2] == b[:2]:
        return False
    low, high = 0, min(a[0], b[0])
    while low < high:  # the longest common beginning
        k = (low + high + 1) // 2
        low, high = (k, high) if _beginning(a, k) == _beginning(b, k) else (low, k - 1)
    if low == min(a[0], b[0]):
        return a[0] < b[0]
    return _letter(a, low) < _letter(b, low)


# -- matrices: for each of ENTRIES (cost, rope) or None

def _best(options: list[tuple]) -> tuple | None:
    best = None
    for cost, rope in options:
        if best is None or cost < best[0] or cost == best[0] and less(rope, best[1]):
            best = cost, rope
    return best


def symbol_matrix(symbol: str) -> list:
    """What one turn does: inserts before it, then one edit of it."""
    edits = [(j, j, DELETE, "D") for j in range(4)]
    if symbol not in GONE:
        more = TRUNCATED if symbol in CUT else 0
        edits += [(i, j, KEEP + more, "K") for i, j in STEPS[symbol.lower()]]
        edits += [(i, j, REROLE + more, "R") for role in "ua" for i, j in STEPS[role]]
    found = {e: [] for e in ENTRIES}
    for (i, k), n in INSERTS.items():
        for a, j, cost, letter in edits:
            if a == k:
                found[i, j].append((INSERT * n + cost, leaf("I" * n + letter)))
    return [_best(found[e]) for e in ENTRIES]


def times(a: list, b: list) -> list:
    """The min-plus product, audits joined."""
    out = []
    for paths in PATHS:
        options = []
        least = None
        for p, q in paths:
            x, y = a[p], b[q]
            if x is not None and y is not None:
                cost = x[0] + y[0]
                if least is None or cost < least:
                    least, options = cost, [(x[1], y[1])]
                elif cost == least:
                    options.append((x[1], y[1]))
        out.append(_best([(least, join(*o)) for o in options]))
    return out


def solution(matrix: list) -> tuple[int, str]:
    """The cheapest cost and the audit of a whole conversation."""
    options = []
    for end, n in ENDS.items():
        entry = matrix[_AT[0, end]]
        if entry is not None:
            options.append((entry[0] + INSERT * n, join(entry[1], leaf("I" * n))))
    cost, rope = _best(options)
    return cost, text_of(rope)


NOTHING = [(0, leaf("")) if i == j else None for i, j in ENTRIES]

# -- Re-Pair


def grammar(sequences: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sequences with pairs replaced until none occurs twice, and the rules (left, right).

    Symbol ``base`` + k stands for rule k, which uses symbols below its own. In each round
    all pairs that occur twice or more compete: where two overlap the more frequent one is
    replaced, and every other one in a run of equal ones.
    """
    sizes = np.array([len(s) for s in sequences], np.int64)
    seq = np.concatenate([np.zeros(0, np.int64), *sequences]).astype(np.int64)
    row = np.repeat(np.arange(len(sequences)), sizes)
    left, right, n_rules = [], [], 0
    while len(seq) > 1:
        key = seq[:-1] << 32 | seq[1:]
        inner = row[:-1] == row[1:]
        pairs, of, counts = np.unique(key, return_inverse=True, return_counts=True)
        if not inner.all():
            counts = np.bincount(of[inner], minlength=len(pairs))
        # the rank of each occurrence's pair; len(pairs) where it is not to be replaced
        rank = np.empty(len(pairs), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(pairs))
        rank[counts < 2] = len(pairs)
        rank = np.where(inner, rank[of], len(pairs))
        at = np.arange(len(rank))
        start = np.r_[True, rank[1:] != rank[:-1]]
        run = at - np.maximum.accumulate(np.where(start, at, 0))
        rank[run % 2 == 1] = len(pairs)
        chosen = rank < len(pairs)
        chosen[1:] &= rank[1:] < rank[:-1]
        chosen[:-1] &= np.r_[rank, len(pairs)][:-2] < np.r_[rank, len(pairs)][1:-1]
        at = np.flatnonzero(chosen)
        if not len(at):
            break
        used, name = np.unique(of[at], return_inverse=True)
        left.append(pairs[used] >> 32)
        right.append(pairs[used] & 0xFFFFFFFF)
        seq[at] = base + n_rules + name
        n_rules += len(used)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, row = seq[stay], row[stay]
    none = np.zeros(0, np.int64)
    cuts = np.searchsorted(row, np.arange(1, len(sequences)))
    parts = np.split(seq, cuts) if sequences else []
    return parts, np.concatenate([none, *left]), np.concatenate([none, *right])


SYMBOLS = SOUND + CUT + GONE
_CODE = {s: k for k, s in enumerate(SYMBOLS)}


def _class(code: int) -> str:
    return CLASSES[code % 4]


def solve(chunks: list[str]) -> list[tuple]:
    """For each chunk its matrix, and (first class, last class, illegal neighbours)."""
    codes = [np.array([_CODE[s] for s in c], np.int64) for c in chunks]
    parts, left, right = grammar(codes, len(SYMBOLS))
    known = [(symbol_matrix(s), (_class(k), _class(k), 0)) for k, s in enumerate(SYMBOLS)]

    def both(a, b):
        (m, (f, x, n)), (o, (y, l, k)) = a, b
        return times(m, o), (f, l, n + k + (x + y not in LEGAL))

    for a, b in zip(left.tolist(), right.tolist()):
        known.append(both(known[a], known[b]))
    out = []
    for part in parts:
        whole = None
        for s in part.tolist():
            whole = known[s] if whole is None else both(whole, known[s])
        out.append(whole)
    return out


SOLVED = "seq string, costs array<long>, audits array<string>, first string, last string, illegal long"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(chunks):
        rows = []
        for c, (matrix, ends) in zip(chunks, solve(chunks)):
            costs = [None if e is None else e[0] for e in matrix]
            rows.append((c, costs, [None if e is None else text_of(e[1]) for e in matrix], *ends))
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64()]
        names = ["seq", "costs", "audits", "first", "last", "illegal"]
        for k in range(0, len(rows), 256):
            part = rows[k : k + 256]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(kinds)], names)

    held, size = [], 0
    for batch in batches:
        for c in batch.column("seq").to_pylist():
            held.append(c)
            size += len(c)
            if size >= GRAMMAR_SYMBOLS:
                yield from flush(held)
                held, size = [], 0
    if held:
        yield from flush(held)


# -- tables


def prepared(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with nulls of the last two as one space."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text)


def damage(rows: DataFrame) -> DataFrame:
    """Turns damaged by a checksum of their place: (conv_id, turn, role, text, dropped); dropped ones stay as marks."""
    rows = prepared(rows)
    conv_id, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.concat(conv_id, F.lit(":"), turn)
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), kind.alias("kind"))
    again = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("copy", F.explode(again)).select("conv_id", "turn", "role", "text", "dropped")


def _digest() -> Column:
    """Equal for turns of equal role and text only."""
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return F.unhex(F.sha2(whole, 256))


def chunks(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, seq, blank, duplicate, truncated): symbols of turns in order, at most 2 ** ``CHUNK_BITS`` a row."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    marks = turns.select(
        "conv_id",
        "turn",
        _digest().alias("digest"),
        F.substr("role", F.lit(1), F.lit(1)).alias("initial"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("digest")]
    ordered = marks.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = B.kept(ordered.withColumn("place", F.monotonically_increasing_id()).drop("turn"), "turn-marks")
    # equal turns of a conversation: all but the first repeat it
    again = ordered.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d"))
    again = again.agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    ordered = ordered.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    twice = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), "b").when(twice, "d").when(F.col("cut"), "t").otherwise("")
    kind = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.when(F.col("initial") == "", "x").otherwise(F.col("initial"))), F.lit(0)), F.lit(4))
    ordered = ordered.withColumns({"fault": fault, "kind": kind})
    symbols = F.when(F.col("fault").isin("b", "d"), GONE).when(F.col("fault") == "t", CUT).otherwise(SOUND)
    turn = F.struct("place", F.substr(symbols, F.col("kind"), F.lit(1)).alias("symbol"))

    def count(f: str, name: str) -> Column:
        return F.sum((F.col("fault") == f).cast("long")).alias(name)

    found = ordered.groupBy("conv_id", F.shiftright("place", CHUNK_BITS).alias("chunk")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), count("b", "blank"), count("d", "duplicate"), count("t", "truncated")
    )
    seq = F.array_join(F.transform("turns", lambda t: t["symbol"]), "")
    return B.kept(found.withColumn("seq", seq).drop("turns"), "turn-chunks")


def solved_chunks(found: DataFrame) -> DataFrame:
    """The chunks with their matrices; each distinct sequence is solved once."""
    solved = B.kept(found.select("seq").distinct().mapInArrow(_solved, SOLVED), "turn-matrices")
    # a sequence that many conversations have is joined in several places
    solved = solved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = found.withColumn("salt", F.pmod(F.xxhash64("conv_id", "chunk"), F.lit(SALTS)).cast("int"))
    return found.join(solved, ["seq", "salt"]).drop("salt", "seq")


SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
TURNS = "conv_id long, place long, edit string, role string, text string"


class _Conversation:
    """One conversation as it streams by: first its chunks, then its turns."""

    def __init__(self, conv_id):
        self.conv_id, self.matrix, self.last, self.illegal = conv_id, NOTHING, None, 0
        self.faults = [0, 0, 0]
        self.cost, self.audit, self.at, self.out = 0, None, 0, 0
        self.low = self.high = self.before = None
        self.n_turns, self.next_role, self.digest = 0, "user", hashlib.sha256()

    def chunk(self, row: dict) -> None:
        matrix = [None if c is None else (c, leaf(a)) for c, a in zip(row["costs"], row["audits"])]
        self.matrix = times(self.matrix, matrix)
        self.illegal += row["illegal"] + (self.last is not None and self.last + row["first"] not in LEGAL)
        self.last = row["last"]
        self.faults = [n + row[c] for n, c in zip(self.faults, ("blank", "duplicate", "truncated"))]

    def _put(self, edit: str, role: str, text: str) -> tuple:
        self.digest.update(f"{chr(10) if self.out else ''}{role}:{text}".encode())
        self.next_role = "assistant" if role[:1] == "u" else "user"
        self.out += 1
        return self.conv_id, self.out - 1, edit, role, text

    def _inserted(self) -> Iterator[tuple]:
        if self.audit is None:
            self.cost, self.audit = solution(self.matrix)
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._put("I", self.next_role, "")

    def turn(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        if turn is not None:
            self.n_turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._put(edit, role if edit == "K" else self.next_role, text)

    def end(self) -> Iterator[tuple]:
        yield from self._inserted()

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        return self.conv_id, gaps, *self.faults, self.illegal, self.cost, self.audit, self.digest.hexdigest()


def _stream(turns: bool):
    """Conversations one after the other; gives their repaired turns, or a summary each."""
    names = [c.split()[0] for c in (TURNS if turns else SUMMARY).split(", ")]
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in (TURNS if turns else SUMMARY).split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    def results(batches):
        now = None
        for row in B.rows(batches):
            if now is None or row["conv_id"] != now.conv_id:
                if now is not None:
                    yield from finished(now)
                now = _Conversation(row["conv_id"])
            if row["costs"] is not None:
                now.chunk(row)
            elif not row["dropped"]:
                for done in now.turn(row["turn"], row["role"], row["text"]):
                    if turns:
                        yield done
        if now is not None:
            yield from finished(now)

    def finished(c):
        for done in c.end():
            if turns:
                yield done
        if not turns:
            yield c.summary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for done in results(batches):
            held.append(done)
            size += sum(len(x) for x in done if isinstance(x, str))
            if len(held) == 1000 or size > 1 << 20:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    return run


def _repaired(rows: DataFrame, turns: bool) -> DataFrame:
    found = solved_chunks(chunks(rows.where("not dropped")))
    # dropped turns go first of all, so that a conversation that lost all of them is still met
    texts = rows.withColumns({"digest": _digest(), "kind": F.when(F.col("dropped"), 0).otherwise(2)})
    both = texts.withColumn("text", F.when(~F.col("dropped"), F.col("text")))
    both = both.unionByName(found.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    order = [F.asc_nulls_first("conv_id"), F.asc("kind"), F.asc("chunk"), F.asc_nulls_first("turn"), F.asc("digest")]
    both = both.repartition("conv_id").sortWithinPartitions(*order).drop("digest", "kind", "chunk")
    return both.mapInArrow(_stream(turns), TURNS if turns else SUMMARY)


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of (conv_id, turn, role, text, dropped) rows: its faults, its repair's cost, audit and hash.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).
    """
    with B.small_batches(rows.sparkSession):
        return B.kept(_repaired(rows, turns=False), "repairs")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: (conv_id, place, edit, role, text), K kept, R of another role, I inserted."""
    with B.small_batches(rows.sparkSession):
        return B.kept(_repaired(rows, turns=True), "repaired-turns")
