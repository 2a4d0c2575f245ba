"""Secrets in texts: patterns for known forms, and tests of randomness for unknown ones.

Base kinds are found by pattern, leftmost and without overlaps; a match that is too short is
dropped and nothing shorter is tried inside it:

    assign  a name such as password or api_key, = or :, and a value of 12 characters or more
    access  AKIA and capitals or digits, 18 characters or more
    hex     16 hexadecimal digits in lower case, or more

Every other run of letters, digits and ``+/_=-`` is a candidate of kind ``random`` if it is in
an encoding, the smallest alphabet that has all its characters (with one digit and one letter at
least), and long enough to carry ``LEAST_BITS`` in it. Three tests ask whether its characters could be drawn from that
alphabet by chance: a chi-squared test of uniformity over as many bins as its length allows,
a test of the number of runs in the alphabet's upper and lower half, and one of the
correlation of neighbours. Fisher's method joins their p-values, with
Brown's correction since the last two depend on each other. Of a run that fails, the longest part
between signs is tested, so that a prefix hides nothing.

A chance string has a uniform p-value, ordinary text one near 0. So among the candidates of
an encoding and a class of lengths the chance strings number about twice those above one half,
and of those reported from a threshold on, the rest is false. The threshold is the least of
a hundred steps, ``LEAST_P`` at least, at which no more than the share ``FALSE`` is, with a margin for
small numbers. Lengths are classed by powers of two. The counts behind the thresholds are those of
the whole table, copies of a string counted once; they are a few hundred numbers.

Null is an empty text. Every row is judged for itself. Candidates that overlap a base
span are not reported again. Runs of any length are tested whole, in linear time. Places are code points, ends
exclusive. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import blocks as B

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    ("(?:%s)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % "|".join(
        [*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")]
    )).encode()
)
ACCESS = re.compile(b"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings, from the smallest alphabet to the greatest.
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base32 lower": LOWER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64 url": UPPER + LOWER + DIGITS + "-_",
}
_SETS = {name: sum(1 << ord(c) for c in letters) for name, letters in ENCODINGS.items()}
_INDEX = {}
for _name, _letters in ENCODINGS.items():
    _INDEX[_name] = np.full(256, -1, np.int64)
    _INDEX[_name][[ord(c) for c in _letters]] = np.arange(len(_letters))

CANDIDATE = np.isin(np.arange(256), [ord(c) for c in UPPER + LOWER + DIGITS + "+/_=-"])
HEX = np.isin(np.arange(256), [ord(c) for c in ENCODINGS["hex"]])
_LETTER = np.isin(np.arange(256), [ord(c) for c in UPPER + LOWER])
_DIGIT = np.isin(np.arange(256), [ord(c) for c in DIGITS])
LEAST_RUN = 16
LEAST_BITS = 96
FALSE = 0.05
LEAST_P = 0.01
#: Of neighbours' products of signs and of values, the squared correlation is 9/16; so is the covariance, over 4, of
#: these tests' logarithms, and Fisher's sum is 1 + 2 * 4 * 9/16 / 12 times as spread as that of independent tests (Brown).
SCALE = 1 + 2 * 4 * 9 / 16 / 12
STEPS = 100
#: Standard deviations that the number of chance strings may be greater than estimated.
SPREAD = 2


def _upper_chi2(x: float, df: float) -> float:
    """Probability of a chi-squared value of ``x`` or more, by Wilson and Hilferty's cube root."""
    spread = 2 / (9 * df)
    return 0.5 * math.erfc(((x / df) ** (1 / 3) - (1 - spread)) / math.sqrt(2 * spread))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(index: np.ndarray, size: int) -> float:
    """The p-value of symbols 0 to ``size`` - 1 being drawn by chance, from three tests."""
    n = len(index)
    bins = max(2, min(size, n // 8))
    bin_of = np.arange(size) * bins // size
    expected = np.bincount(bin_of, minlength=bins) * (n / size)
    seen = np.bincount(bin_of[index], minlength=bins)
    uniform = _upper_chi2(float(((seen - expected) ** 2 / expected).sum()), bins - 1)
    half = index >= size // 2
    turns = int((half[1:] != half[:-1]).sum())
    runs = _two_sided(max(0.0, abs(turns - (n - 1) / 2) - 0.5) / math.sqrt((n - 1) / 4))
    around = (index - (size - 1) / 2) / math.sqrt((size * size - 1) / 12)
    serial = _two_sided(float((around[1:] * around[:-1]).sum()) / math.sqrt(n - 1))
    x = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial))
    return _upper_chi2(x / SCALE, 6 / SCALE)


def encoding(run: np.ndarray) -> str | None:
    """The smallest alphabet of the run's bytes; None without a letter and a digit, or without one that fits."""
    seen = np.bincount(run, minlength=256) > 0
    if not (seen & _LETTER).any() or not (seen & _DIGIT).any():
        return None
    bits = sum(1 << int(b) for b in np.flatnonzero(seen))
    return next((name for name, letters in _SETS.items() if not bits & ~letters), None)


def _tested(text: np.ndarray, a: int, b: int) -> tuple | None:
    """(start, kind, end, encoding, p) of a run that is in an encoding and long enough."""
    while b > a and text[b - 1] == 61:  # padding
        b -= 1
    name = encoding(text[a:b])
    if not name or (b - a) * math.log2(len(ENCODINGS[name])) < LEAST_BITS:
        return None
    return a, 3, b, name, randomness(_INDEX[name][text[a:b]], len(ENCODINGS[name]))


def _candidate(text: np.ndarray, a: int, b: int) -> tuple | None:
    """The run as a whole, or its longest part between signs where only that may be chance, as after a prefix."""
    whole = _tested(text, a, b)
    if whole and whole[4] >= LEAST_P:
        return whole
    cuts = np.r_[a - 1, a + np.flatnonzero(~_LETTER[text[a:b]] & ~_DIGIT[text[a:b]]), b]
    k = int(np.argmax(np.diff(cuts)))
    return (_tested(text, int(cuts[k]) + 1, int(cuts[k + 1])) if len(cuts) > 2 else None) or whole


def _base(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of assignments and access keys."""
    out = []
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    small = text.lower()
    if any(name in small for name in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= LEAST_VALUE]
    return out


SPANS = "array<struct<kind:string,start:long,end:long,encoding:string,p:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("p", pa.float64())]))


def _spans(text: np.ndarray, hexes: list[tuple], runs: list[tuple]) -> list[dict]:
    """All spans of one text, those of kind random with their encoding and p-value, in code points."""
    found = _base(text.tobytes()) + [(a, 2, b) for a, b in hexes]
    base = sorted(found)
    for a, b in runs:
        if any(x < b and a < y for x, _, y in base):
            continue
        tested = _candidate(text, a, b)
        if tested:
            found.append(tested)
    if not found:
        return []
    found.sort(key=lambda s: s[:2])
    begins = np.cumsum((text & 0xC0) != 0x80)  # code points up to and with a byte
    point = lambda at: int(begins[at - 1]) if at else 0
    names = ("encoding", "p")
    return [{"kind": KINDS[s[1]], "start": point(s[0]), "end": point(s[2])} | dict(zip(names, s[3:] or (None, None))) for s in found]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in B.blocks(batches):
        data, starts = B.text_bytes(batch.column("text"))

        def long_runs(members: np.ndarray, least: int):
            first, last, _ = B.spans(data, starts, members)
            keep = np.flatnonzero(last - first >= least)
            row = np.searchsorted(starts, first[keep], side="right") - 1
            by_row = {}
            for r, a, b in zip(row.tolist(), first[keep].tolist(), last[keep].tolist()):
                by_row.setdefault(r, []).append((a - int(starts[r]), b - int(starts[r])))
            return by_row

        hexes, runs = long_runs(HEX, LEAST_HEX), long_runs(CANDIDATE, LEAST_RUN)
        spans = [_spans(data[a:b], hexes.get(k, []), runs.get(k, [])) for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist()))]
        columns = [batch.column(c) for c in batch.schema.names if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, _SPANS)], [*names, "spans"])


def thresholds(histogram: dict[tuple[str, int], dict[int, int]]) -> dict[tuple[str, int], float]:
    """The least p-value reported in each class, from counts of p-values in hundredths."""
    out = {}
    for group, counts in histogram.items():
        upper = sum(n for step, n in counts.items() if step >= STEPS // 2) + 1
        chance = 2 * (upper + SPREAD * math.sqrt(upper))
        for step in range(round(LEAST_P * STEPS), STEPS // 2 + 1):
            reported = sum(n for s, n in counts.items() if s >= step)
            if reported - chance * (1 - step / STEPS) <= FALSE * reported:
                break
        out[group] = step / STEPS
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans: array of (kind, start, end, encoding, p)), by start and then by kind."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    found = B.kept(docs.mapInArrow(_scan, f"doc_id {kind}, spans {SPANS}"), "secret-spans")
    one = found.select(F.explode(F.filter("spans", lambda s: s["kind"] == "random")).alias("s"))
    one = one.select("s.encoding", (F.col("s.end") - F.col("s.start")).alias("n"), "s.p").distinct()  # copies have equal p-values
    length = F.least(F.length(F.bin("n")), F.lit(16))
    step = F.least(F.floor(F.col("p") * STEPS), F.lit(STEPS - 1)).cast("int")
    # encodings x 16 classes x 100 steps at most
    counts = one.groupBy("encoding", length.alias("length"), step.alias("step")).count().collect()
    histogram = {}
    for r in counts:
        histogram.setdefault((r.encoding, r.length), {})[r.step] = r["count"]
    least = thresholds(histogram)
    if not least:
        return found
    limit = F.create_map(*[F.lit(x) for (name, bits), p in sorted(least.items()) for x in (f"{name} {bits}", p)])

    def reported(s):
        bits = F.least(F.length(F.bin(s["end"] - s["start"])), F.lit(16)).cast("string")
        wanted = F.floor(s["p"] * STEPS) >= F.round(F.try_element_at(limit, F.concat_ws(" ", s["encoding"], bits)) * STEPS)
        return (s["kind"] != "random") | F.coalesce(wanted, F.lit(False))

    return found.withColumn("spans", F.filter("spans", reported))
