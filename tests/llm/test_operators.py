"""Each operator against a brute-force version on awkward rows, and its parts by themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.llm import (
    blocks,
    chat,
    dartminhash,
    decontaminate,
    lm_score,
    mixing,
    pii,
    quality,
    repeats,
    token_files,
    warc,
)

public_tokenizers = pytest.importorskip("public_tokenizers")
SEED = random.Random(11)
VOCABULARY = [w for w in "the of and to river stone quick lantern über naïve ČAJ 漢字 o'clock x1 2,5 — don't".split()]


def sentence(n):
    return " ".join(SEED.choice(VOCABULARY) for _ in range(n))


PASSAGE = sentence(60)
BASE = [f"{w}{i % 40}" for i, w in enumerate(sentence(120).split())]


def near(changes):
    words = list(BASE)
    for k in SEED.sample(range(len(words)), changes):
        words[k] = f"new{SEED.random()}"
    return " ".join(words)


def texts():
    out = [None, "", " \t\n\x0b ", "one", "one two", "one  two", "a b c d", "end.\n\nend.\nend.\n"]
    out += [sentence(SEED.randint(1, 90)) for _ in range(25)]
    out += [PASSAGE, f"before {PASSAGE} after", f"{PASSAGE}\n{PASSAGE}", PASSAGE[:49], PASSAGE[:50], PASSAGE[:51]]
    out += [" ".join(BASE)] * 30 + [near(SEED.randint(1, 8)) for _ in range(30)]
    out += ["z" * 70_000, "w " * 20_000, sentence(5_000), "    \u0085", "<|endoftext|> a <|startoftext|>b", "Å é"]
    return out


DOCS = [(i, t, SEED.choice(["en", "de", None]), SEED.choice(["src1", "src10", "src2", "Ä", None]), 1) for i, t in enumerate(texts())]
DOCS += [DOCS[40], DOCS[40], (None, "no id " + PASSAGE, "en", "src1", None), (None, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = (
    "block", "share", "node", "key", "keys", "size", "n", "copies", "bucket", "band", "bands", "kept", "n_words", "held",
    "ids", "rate", "taken", "verdict", "spans", "label", "a", "b", "terms", "items", "target", "s", "doc", "words", "row",
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(DOCS, SCHEMA).repartition(5)
    return rows.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    """Rows of documents with an id that no other row has."""
    counts = Counter(r["doc_id"] for r in rows)
    return {r["doc_id"]: r for r in rows if r["doc_id"] is not None and counts[r["doc_id"]] == 1}


TEXT = {i: t or "" for i, t, *_ in DOCS if i is not None}
REPEATED = DOCS[40][0]


# -- words and hashes

def test_spans_and_hashes_agree_with_plain_splitting():
    import pyarrow as pa

    rows = [t for _, t, *_ in DOCS]
    data, starts = blocks.text_bytes(pa.array(rows, pa.string()))
    first, last, offsets = blocks.spans(data, starts, blocks.NOT_SPACE)
    words = [bytes(data[a:b]) for a, b in zip(first, last)]
    assert [words[a:b] for a, b in zip(offsets[:-1], offsets[1:])] == [(t or "").encode().split() for t in rows]
    hashes = blocks.hash_spans(data, first, last)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))


def test_packing_returns_the_numbers():
    numbers = np.array([3, 7, 7, 2**63 + 5], np.uint64)
    assert (blocks.unpack_sorted(blocks.pack_sorted(numbers)) == numbers).all()
    assert len(blocks.unpack(blocks.pack(numbers[:0]), np.uint64)) == 0


# -- 1 scoring

def tree_scores(rows):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [(i, (t or "").encode().translate(lower).split() + [None]) for i, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens]
    train = [t for (_, t), h in zip(tokens, held) if not h]
    count = Counter(w for t in train for w in t)
    total, distinct = sum(count.values()), len(count)

    def before(t, j, k):
        return tuple(t[j - b] if j >= b else 0 for b in range(1, k + 1))

    tree = {}

    def prob(h, w):
        if not h:
            return (count[w] + 1) / (total + distinct + 1)
        p = prob(h[:-1], w)
        if h not in tree:
            return p
        size, rest, after = tree[h]
        return max(after.get(w, 0) - 1, 0) / size + rest * p

    for k in (1, 2):
        after = {}
        for t in train:
            for j, w in enumerate(t):
                after.setdefault(before(t, j, k), Counter())[w] += 1
        for h, f in after.items():
            size = sum(f.values())
            again = {w: n for w, n in f.items() if n >= 2}
            mass = sum(n - 1 for n in again.values())
            if not mass:
                continue
            gain = sum((n - 1) * (math.log2(n - 1) + round(-math.log2(prob(h[:-1], w)) * 3) / 3) for w, n in again.items())
            rest = 1 - mass / size
            if (gain - mass * math.log2(size)) / size + (rest * math.log2(rest) if rest else 0) >= lm_score.DIVERGENCE:
                tree[h] = size, rest, f
    for (i, t), h in zip(tokens, held):
        base = sum(math.log10(prob((), w)) for w in t)
        yield i, h, len(t), sum(count[w] > 0 for w in t), total, base, sum(math.log10(prob(before(t, j, 2), w)) for j, w in enumerate(t))


@pytest.mark.parametrize("hot", [lm_score.HOT_SHARE, 1e-9])
def test_scores(docs, monkeypatch, hot):
    monkeypatch.setattr(lm_score, "HOT_SHARE", hot)
    got = sorted(map(tuple, lm_score.scores(docs).collect()), key=str)
    want = sorted(tree_scores(DOCS), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-3)


def test_held_out_text_is_predicted_better_than_by_frequencies(spark):
    rows = [(i, sentence(40) + " " + PASSAGE) for i in range(200)]
    found = lm_score.scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert found and all(r.score > 0.7 * r.base_score for r in found)


# -- 2 archives

PAGES = [(i, f"http://x/{i} ä%\r\nq", t) for i, t in enumerate(["a" * 1000, "a" * 1000, "b" * 999, "b" * 999, None, "", "é" * 500, "<p>" * 9_000])]
PAGES += [(20, None, "c" * 2000), (20, "u", "c" * 2000), (3_000_000_000_000, "u", "a" * 1000), (None, "u", "a" * 1000), (None, None, None)]


def test_archives_return_the_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    found = warc.read_archives(warc.write_archives(pages)).collect()
    got = Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found)
    largest = {}
    for i, _, html in PAGES:
        p = (html or "").encode()
        if i is not None and len(p) >= 1000:
            largest[p] = max(largest.get(p, i), i)
    want = Counter()
    for i, url, html in PAGES:
        p = (html or "").encode()
        to = largest.get(p) if largest.get(p) != i else None
        want[(i, url, len(p), hashlib.sha1(p).hexdigest(), "revisit" if to is not None else "response", to)] += 1
    assert got == want
    kept = {(r.page_id, r.payload) for r in found if r.record_type == "response"}
    assert kept == {(i, (h or "").encode()) for i, _, h in PAGES if largest.get((h or "").encode(), i) == i}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def record(**fields):
    page = {"page_id": 1, "url": "u", "payload": b"text " * 50, "refers_to": None} | fields
    page["digest"] = hashlib.sha1(page["payload"]).hexdigest()
    return warc._record(page, warc.DATE)


def test_dictionary_is_loaded_compressed_or_not():
    import struct

    import zstandard

    records = [record(page_id=i, payload=f"<p>{sentence(30)}</p>".encode()) for i in range(300)]
    data = warc.archive(records)
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC
    assert [r for _, r in warc.frames(data)] == records
    size = struct.unpack("<I", data[4:8])[0]
    assert size
    small = zstandard.compress(data[8 : 8 + size])
    again = struct.pack("<II", warc.DICTIONARY_MAGIC, len(small)) + small + data[8 + size :]
    assert [r for _, r in warc.frames(again)] == records


def test_broken_archives_are_refused():
    data = warc.archive([record(), record(page_id=2)])
    for bad in (b"", data[:4], data[:-1], b"\0" + data[1:], data[:-9] + b"\xff" + data[-8:]):
        with pytest.raises(warc.WarcError):
            [warc.parse(r) for _, r in warc.frames(bad)]
    good = record()
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"Date"), (b"Content-Length: 3", b"Content-Length: 4"), (b"text text", b"text best"), (b"sha1:", b"md5:"), (b": response", b": other")):
        assert old in good
        with pytest.raises(warc.WarcError):
            warc.parse(good.replace(old, new, 1))


# -- 3 repeated strings

def removed(rows, length):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = {}, Counter()
    for i, t, *_ in order:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], i)
    for i, t, *_ in order:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] != i:
                gone[k : k + length] = True
        runs = len(re.findall(b"\1+", gone.tobytes()))
        out[(i, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone]))] += 1
    return out


@pytest.mark.parametrize(("length", "anchor", "hot"), [(50, 24, repeats.HOT), (50, 24, 3), (24, 8, repeats.HOT)])
def test_repeated_strings(docs, length, anchor, hot):
    got = repeats.without_repeats(docs, length, anchor, hot).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)
    assert got == removed(DOCS, length)


def test_suffix_order_agrees_with_sorting():
    strings = [bytes(SEED.choice(b"abc") for _ in range(SEED.randint(5, 30))) for _ in range(40)] + [b"aaaaaaa"] * 3
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    bwt, common = repeats.suffix_order(data, np.cumsum(size) - size, size, 255)
    suffixes = sorted(((s[k:], j, s[k - 1 : k] if k else b"") for j, s in enumerate(strings) for k in range(len(s) + 1)), key=lambda x: (x[0], x[1]))
    codes = {b"": 0} | {bytes([c]): r for r, c in enumerate(sorted(set(data.tolist())), 1)}
    # equal suffixes of different strings may stand in either order, so compare their groups
    def groups(values):
        out, at = [], 0
        while at < len(suffixes):
            to = at
            while to < len(suffixes) and suffixes[to][0] == suffixes[at][0]:
                to += 1
            out.append(sorted(values[at:to]))
            at = to
        return out

    assert groups(bwt.tolist()) == groups([codes[c] for _, _, c in suffixes])
    shared = [0] + [next((k for k, (a, b) in enumerate(zip(x[0], y[0])) if a != b), min(len(x[0]), len(y[0]))) for x, y in zip(suffixes, suffixes[1:])]
    assert common.tolist() == shared


# -- 4 mixing

def level_targets(size, weights, total):
    """Shares by weight, what is above twice a source's size handed on until none is."""
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = total * sum(size.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * size[s]}
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = 2 * size[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix_meets_its_targets(docs):
    got = mixing.mix(docs).collect()
    size = Counter()
    for _, t, _, source, _ in DOCS:
        size[source] += len((t or "").encode().split())
    want = level_targets(size, mixing.WEIGHTS, mixing.TOTAL)
    taken, longest = Counter(), Counter()
    for r in got:
        longest[r.source] = max(longest[r.source], r["size"])
        assert (r.source_size, r.target) == (size[r.source], pytest.approx(want[r.source]))
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[r.source] += r.taken
    assert len(got) == len(DOCS)
    for s in size:
        assert abs(taken[s] - want[s]) <= max(20, longest[s] / 2)
    assert Counter(map(tuple, mixing.mix(docs.repartition(3)).collect())) == Counter(map(tuple, got))


def test_longer_documents_are_tilted_one_way(spark):
    rows = [(i, "w " * SEED.randint(1, 400), f"s{i % 3}") for i in range(3000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for s in ("s0", "s1", "s2"):
        rates = [r.rate for r in found.where(F.col("source") == s).orderBy("size").collect()]
        assert rates == sorted(rates) or rates == sorted(rates, reverse=True)
    sums = found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(r.taken == pytest.approx(r.target, rel=1e-3) for r in sums)


# -- 5 personal data

def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            yield kind, m.start(), m.end()


def test_personal_data(spark):
    rows = [None, "", "a@b.co_x@d.com", "1.2.3.4.5.6.7.8", "00255.1.1.01 256.1.1.1", "4111 1111-1111 1111", "4111-1111-1111-1111-4"]
    rows += ["😀 a@b.co +1 (555) 010-9999.", "1 " * 5_000, "a" * 100_000 + "@b.co", "1" * 30_000, "." * 10_000, "@" * 3_000, "1.1.1.1" * 500, "a@b.c " * 500]
    for letters in ("a1.@+- ()%4é", "12.- 9+"):
        rows += ["".join(SEED.choice(letters) for _ in range(SEED.randint(1, 60))) for _ in range(800)]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    for r in pii.personal_data(frame.repartition(8)).collect():
        got = [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE]
        assert got == list(base_spans(r.text)), r.text[:200]


def test_context_and_checksums_decide(spark):
    rows = ["DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 01", "my ssn 123-45-6789", "part 123-45-6789", "ssn 000-45-6789"]
    found = pii.personal_data(spark.createDataFrame([(t,) for t in rows], "text string")).collect()
    assert [[s.kind for s in r.spans] for r in found] == [["iban"], [], ["ssn"], [], []]
    scored = pii.personal_data(spark.createDataFrame([("call +1 555 010 99",), ("+1 555 010 99",)], "text string")).collect()
    assert scored[0].spans[0].score > scored[1].spans[0].score


def test_accounts_before_other_words_and_context_on_both_sides(spark):
    iban, spaced = "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"
    rows = [f"{iban} Please pay", f"IBAN {iban} BIC X", f"to {spaced} BIC COBADEFFXXX 12", f"{iban} {spaced} 2024 OK", f"AB12 {iban}.", f"GB12 {spaced} A", f"{iban}a", f"{iban[:-1]}3 Please"]
    rows += ["x" * 70 + f" {iban} " + "Y" * 70, f"é😀 {spaced} É"]
    want = [[m.span() for m in re.finditer(f"(?<![A-Za-z0-9])({iban}|{spaced})(?![A-Za-z0-9])", t)] for t in rows]
    assert sum(map(len, want)) == 9
    found = pii.personal_data(spark.createDataFrame([(t,) for t in rows], "text string")).collect()
    assert [[(s.start, s.end) for s in r.spans if s.kind == "iban"] for r in found] == want
    rows = ["123-45-6789 is my SSN", "ssn 123-45-6789, 987-65-4321", "ssn" + " " * 38 + "123-45-6789", "123-45-6789" + " " * 38 + "ssn", "123-45-6789 ssn 000-45-6789"]
    found = pii.personal_data(spark.createDataFrame([(t,) for t in rows], "text string")).collect()
    assert [sum(s.kind == "ssn" for s in r.spans) for r in found] == [1, 2, 0, 0, 1]


# -- 6 decontamination

ITEMS = [("b", PASSAGE), (None, sentence(12)), ("a", "one two"), ("c", ""), ("d", None), ("e", "one  TWO."), ("f", " ".join(BASE[20:45])), ("a", "one two")]


def hits(rows, items, size=10):
    word = re.compile(rb"[0-9a-z\x80-\xff]+")

    def words(t):
        lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        return word.findall((t or "").encode().translate(lower))

    wanted = {}
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wanted.setdefault(tuple(w[k : k + size]), set()).add(item or "")
    for i, t, *_ in rows:
        w, hit, named = words(t), set(), set()
        for n in {len(g) for g in wanted}:
            for k in range(len(w) - n + 1):
                found = wanted.get(tuple(w[k : k + n]))
                if found:
                    hit.update(range(k, k + n))
                    named |= found
        yield i, len(w), len(hit), len(named), ",".join(sorted(named)), bool(hit)


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_TERMS, 0])
def test_benchmark_passages(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", bound)
    items = spark.createDataFrame(ITEMS, "item_id string, text string").withColumn("terms", F.lit(1))
    got = Counter(map(tuple, decontaminate.contamination(docs, items).collect()))
    assert got == Counter(hits(DOCS, ITEMS))


def test_proximity(spark):
    rows = spark.createDataFrame([(1, "red green blue"), (2, "red x green y blue"), (3, "red x y green z blue"), (4, "green red"), (5, "red"), (6, "green blue")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "red green blue")], "item_id string, text string")
    found = {slop: {r.doc_id for r in decontaminate.contamination(rows, items, slop=slop).where("contaminated").collect()} for slop in (0, 2)}
    assert found == {0: {1}, 2: {1, 2}} or found == {0: {1}, 2: {1, 2, 3}}


# -- 7 quality

def counts(text):
    t = text or ""
    words = [w.decode() for w in t.encode().split()]
    lines, seen, again = t.split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            again += line in seen
            seen.add(line)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered), failed


def test_quality_counts(docs):
    got = quality.quality(docs).collect()
    assert Counter((r.doc_id, *tuple(r)[1:7]) for r in got) == Counter((i, *counts(t)) for i, t, *_ in DOCS)
    assert not any(r.kept and r.base_failed for r in got)


def test_divergence_rejects_odd_texts_and_keeps_clean_ones(spark):
    common = ["the", "of", "and", "to", "in", "is", "it", "was", "for", "on"]

    def clean(n):
        return " ".join(SEED.choice(common) if SEED.random() < 0.5 else "".join(SEED.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    rows = [(i, clean(SEED.randint(60, 200)), "en") for i in range(200)]
    rows += [(1000, " ".join("#%$*|" for _ in range(9)) + " " + " ".join(f"{SEED.random()}" for _ in range(300)), "en"), (1001, clean(12), "en"), (1002, "zq " * 4 + clean(200).upper(), None)]
    found = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[i].kept for i in range(200)) and not found[1000].kept and found[1000].class_distance > 0.4
    assert found[1001].kept and found[1002].kept  # too short to tell, and a language without reference


def test_the_verdict_keeps_its_name_whatever_languages_a_task_has(spark):
    schema = "doc_id long, text string, lang string"
    nameless = [(i, sentence(80), None) for i in range(20)]
    assert len(quality.judged(spark.createDataFrame(nameless, schema), "verdict").select("verdict.kept").collect()) == 20
    rows = [(i, sentence(80), "en") for i in range(300)] + [(900, sentence(12), "xx")] + nameless
    refs, _ = quality.references(spark.createDataFrame(rows, schema).repartition(4, "lang"))
    typed = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())])
    for part in (rows[:300], rows[300:301], rows[301:]):
        batch = pa.RecordBatch.from_pylist([dict(zip(typed.names, r)) for r in part], typed)
        (out,) = quality._judge(refs, ["doc_id"], "verdict")(iter([batch]))
        assert out.schema.names == ["doc_id", "verdict"]
    frame = spark.createDataFrame(rows, schema).repartition(4, "lang").sortWithinPartitions("lang")
    assert quality.quality(frame).count() == len(rows)


@pytest.mark.parametrize("bound", [quality.BROADCAST_LANGUAGES, 2])
def test_divergence_judges_small_languages_and_none(spark, monkeypatch, bound):
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", bound)
    common = {"en": "the of and to in is it was for on", "xx": "ka lo mi ne po ru sa te vu zi", "yy": "bra cro dri fru gla kle pli sno tru wri"}

    def clean(name, n):
        return " ".join(SEED.choice(common[name].split()) if SEED.random() < 0.6 else "".join(SEED.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    junk = " ".join("#%$*|" + str(k) for k in range(90))
    rows = [(i, clean("en", 9_000), "en") for i in range(300)]
    rows += [(1000 + i, clean(lang, 90), lang) for lang in ("xx", "yy") for i in range(12)]
    rows += [(2000 + i, clean(lang, 90), none) for lang, none in (("en", None), ("en", "")) for i in range(10)]
    rows += [(3000 + i, junk, lang) for i, lang in enumerate(("xx", "yy", None, ""))]
    found = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert not r.base_failed and r.kept == (r.doc_id < 3000), r


def test_jensen_shannon_distance():
    q = np.array([0.5, 0.5, 0.0])
    assert quality.distance(np.array([[1, 1, 0], [0, 0, 9], [0, 0, 0]]), q).tolist() == pytest.approx([0, 1, 0])


# -- 8 near duplicates

def classes(rows, least=0.8):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    of = list(range(len(rows)))

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] == sets[y] or both >= least * len(sets[x] | sets[y]) - 1e-9:
                of[top(x)] = top(y)
    groups = {}
    for x in range(len(rows)):
        groups.setdefault(top(x), []).append(x)
    out = Counter()
    for members in groups.values():
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        for m in members:
            out[(rows[m][0], min(ids) if ids else None, len(members))] += 1
    return out


@pytest.mark.parametrize(("members", "bound"), [(dartminhash.BLOCK_MEMBERS, dartminhash.BROADCAST_IDS), (4, 0)])
def test_near_duplicates(spark, docs, monkeypatch, members, bound):
    monkeypatch.setattr(dartminhash, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(dartminhash, "BROADCAST_IDS", bound)
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in dartminhash.near_duplicates(docs).collect())
    assert got == classes(DOCS)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 2**63, 300, dtype=np.uint64)
    one, two = rng.uniform(0.1, 4, 300), rng.uniform(0.1, 4, 300)
    two[:150] = one[:150]
    row = np.repeat([0, 1], 300)
    sig = dartminhash.signatures(row, np.concatenate([elements] * 2), np.concatenate([one, two]), 2, 2048)
    want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.05)
    same = dartminhash.signatures(np.zeros(300, int), elements, np.ones(300), 1, 64)
    assert (same == dartminhash.signatures(np.zeros(300, int), elements, None, 1, 64)).all()


# -- 9 token files

def test_token_files(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    files = token_files.write_tokens(docs, path)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(files).collect()), key=lambda r: r[1])
    tokenizer = Tokenizer.from_file(path)
    start, want = 0, []
    for i, t, *_ in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_random_access_and_damage():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 12, 5_000).astype(np.uint32)
    ids[1000:1400] = 3
    sizes = rng.integers(1, 60, 400)
    sizes = sizes[np.cumsum(sizes) < 5_000]
    sizes = np.append(sizes, 5_000 - sizes.sum())
    data = token_files.shard(ids, sizes, np.arange(len(sizes)), np.ones(len(sizes), bool), rounds=12, frequent=3)
    s = token_files.Shard(data)
    assert len(s.left) > 20 and len(s.symbols) < 3_500
    assert (s.all() == ids).all()
    for k in range(len(sizes)):
        assert (s.document(k) == ids[s.starts[k] : s.starts[k + 1]]).all()
    for a, b in ((0, 5_000), (17, 18), (990, 1500), (4_999, 5_000)):
        assert (s.ids(a, b) == ids[a:b]).all()
    for bad in (data[:50], data[:-1], b"x" + data[1:], data[:200] + bytes([data[200] ^ 1]) + data[201:]):
        with pytest.raises(token_files.CorruptShard):
            token_files.Shard(bad)


# -- 10 chat

MARKS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[END]", "[ROLE]", "[/ROLE]", "\\", "<\\s>", "[\\\\INST]", "$1", "\n", "", "é😀"]


def test_chat_round_trip(spark):
    rows = []
    for conv in [*range(40), None]:
        for turn in range(SEED.randint(1, 9)):
            role = SEED.choice(["user", "assistant", "system", "tool", "[/ROLE]x", "", None])
            rows.append((conv, SEED.choice([turn, turn, None]), role, SEED.choice([None, "".join(SEED.choice(MARKS) for _ in range(6))])))
    rows += [rows[0], rows[0], (99, 0, "assistant", "x" * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("blocks", F.lit(1))
    found = chat.format_conversations(frame).withColumn("turns", chat.read_turns(F.col("formatted")))
    found = found.withColumn("learnt", chat.learnt_text(F.col("formatted"), F.col("loss"))).collect()
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in found} == want
    assert {r.conv_id: r.learnt for r in found} == {c: "".join(t for role, t in x if role == "assistant") for c, x in want.items()}


# -- all

def test_empty_tables(spark, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    items = spark.createDataFrame([], "item_id long, text string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for found in (
        lm_score.scores(empty),
        repeats.without_repeats(empty),
        mixing.mix(empty),
        pii.personal_data(empty),
        decontaminate.contamination(empty, items),
        quality.quality(empty),
        dartminhash.near_duplicates(empty),
        token_files.read_tokens(token_files.write_tokens(empty, path)),
        chat.format_conversations(turns),
    ):
        assert found.count() == 0


def test_empty_benchmark(spark, docs):
    items = spark.createDataFrame([(1, None), (2, "  ")], "item_id long, text string")
    found = decontaminate.contamination(docs, items)
    assert found.count() == len(DOCS) and found.where("contaminated").count() == 0
