"""Near-duplicate documents by DartMinHash signatures and a banded join.

Every element of a weighted set is hashed into a stream of darts: a Poisson
process over weight and rank in which each dart also names a coordinate. A set
keeps the darts that fall inside its elements' weights, and of each coordinate
the one of least rank. Ranks need only be followed up to ``(ln k + 2) / weight``
for all ``k`` coordinates to be hit, so a signature costs one hash an element and
about ``k (ln k + 2)`` darts, whatever the size of the set.

Two documents are *linked* if the sets of their five-word shingles have a Jaccard
similarity of at least 0.8. Candidates share a band of four coordinates (of 32
bands: a link is missed with a probability under 1e-7); each is checked on whole
shingle sets. A class is what links connect.

Words are runs of anything but ASCII white space. A text of one to four words has
one shingle, of all its words; texts without words (null, empty) have none and
form one class. Documents without an id are members like any other, but never the
one that names a class unless no member has an id. Repeated rows are copies.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import blocks as B

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
#: Ids sent to every executor to pick candidate texts; beyond it they are joined.
BROADCAST_IDS = 2_000_000
#: Members of one leader that a task compares among themselves, or with as many others.
BLOCK_MEMBERS = 1_000

_STEP = np.uint64(0xA24BAED4963EE407)
_COORDINATE = np.uint64(0x9FB21C651E98DF25)
_WEIGHT = np.uint64(0xD1B54A32D192ED03)


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1), from the top 53 bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(
    row: np.ndarray, element: np.ndarray, weight: np.ndarray | None, n_rows: int, k: int
) -> np.ndarray:
    """For each row's weighted set the ids of the earliest darts, ``k`` a row.

    ``weight`` is positive, None for ones. Rows without elements get zeros.
    """
    layer = np.zeros(len(row), np.int64)
    if weight is not None:
        layers = np.ceil(weight).astype(np.int64)
        pick = np.repeat(np.arange(len(row)), layers)
        layer = np.arange(len(pick)) - np.repeat(np.cumsum(layers) - layers, layers)
        total = np.bincount(row, weight, n_rows)
        row, element, weight = row[pick], element[pick], weight[pick]
    else:
        total = np.bincount(row, minlength=n_rows).astype(float)
    seed = B.mix(element + layer.astype(np.uint64) * _WEIGHT)
    winner = np.zeros(n_rows * k, np.uint64)
    todo, reach = total > 0, np.log(k) + 2
    while todo.any():
        limit = np.where(todo, reach / np.maximum(total, 1e-300), 0)
        best = np.full(n_rows * k, np.inf)
        at = np.flatnonzero(todo[row])
        rank, slots, ranks, ids = np.zeros(len(at)), [], [], []
        thrown = 0
        while len(at):
            thrown += 1
            dart = B.mix(seed[at] ^ np.array(thrown, np.uint64) * _STEP)
            rank = rank - np.log(_uniform(dart)) / k
            near = rank <= limit[row[at]]
            at, rank, dart = at[near], rank[near], dart[near]
            hit = slice(None)
            if weight is not None:
                hit = layer[at] + _uniform(B.mix(dart ^ _WEIGHT)) < weight[at]
            slot = row[at[hit]] * k + (B.mix(dart[hit] ^ _COORDINATE) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, slot, rank[hit])
            slots.append(slot)
            ranks.append(rank[hit])
            ids.append(dart[hit])
        slot, rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(ids)
        first = rank == best[slot]
        hit_all = np.isfinite(best).reshape(n_rows, k).all(axis=1)
        done = todo & hit_all
        first &= done[slot // k]
        winner[slot[first]] = dart[first]
        todo &= ~hit_all
        reach *= 2
    return winner.reshape(n_rows, k)


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, by row; and the rows' offsets."""
    data, starts = B.text_bytes(column)
    first, last, offsets = B.spans(data, starts, B.NOT_SPACE)
    hashes = B.hash_spans(data, first, last)
    n_words = np.diff(offsets)
    row = B.row_of(offsets)
    within = np.arange(len(hashes)) - offsets[:-1][row]
    rows, found = [], []
    whole = within[: max(0, len(hashes) - words + 1)] + words <= n_words[row[: max(0, len(hashes) - words + 1)]]
    rows.append(row[: len(whole)][whole])
    found.append(B.windows(hashes, words)[whole])
    for n in range(1, words):
        short = np.flatnonzero(n_words == n)
        if len(short):
            rows.append(short)
            found.append(B.windows(hashes, n)[offsets[short]])
    row, found = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((found, row)) if len(rows) > 1 else np.argsort(found, kind="stable")
    if len(rows) == 1:
        order = order[np.argsort(row[order], kind="stable")]
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    row, found = row[new], found[new]
    return row, found, np.searchsorted(row, np.arange(len(column) + 1))


def _nodes(found: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """128 bits that name each row's set of shingles."""
    n = len(offsets) - 1
    out = np.zeros((n, 2), np.uint64)
    for side, salt in enumerate((np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xAEF17502108EF2D9))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mix(found ^ salt), dtype=np.uint64)])
        out[:, side] = B.mix((sums[offsets[1:]] - sums[offsets[:-1]]) ^ np.diff(offsets).astype(np.uint64))
    return pa.array([x.tobytes() for x in out], pa.binary())


def _sketch(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.blocks(batches):
            row, found, offsets = shingles(batch.column("text"), words)
            n = batch.num_rows
            sig = signatures(row, found, None, n, bands * rows).reshape(n * bands, rows)
            key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), n)
            for r in range(rows):
                key = B.mix(key * _STEP ^ sig[:, r])
            sizes = np.diff(offsets)
            filled = np.where(sizes > 0, bands, 0)
            keys = key.reshape(n, bands)[sizes > 0].reshape(-1).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(filled)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    _nodes(found, offsets),
                    pa.array(sizes.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)),
                ],
                ["doc_id", "node", "n_shingles", "bands"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.blocks(batches):
            _, found, offsets = shingles(batch.column("text"), words)
            sets = [found[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [_nodes(found, offsets), pa.array(sets, pa.binary())], ["node", "shingles"]
            )

    return run


def _against_leader(least: float):
    """Of each (leader, member): whether they are linked, and the shingles that only one of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            linked, sizes, apart = [], [], []
            for a, b in zip(batch.column("set_a"), batch.column("set_b")):
                a = np.frombuffer(a.as_buffer(), np.uint64)
                b = np.frombuffer(b.as_buffer(), np.uint64)
                one = np.setxor1d(a, b, assume_unique=True)
                linked.append(_linked(len(a) + len(b), len(one), least))
                sizes.append(len(b))
                apart.append(one.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(apart, pa.binary())],
                ["a", "b", "linked", "n", "apart"],
            )

    return run


def _linked(both, apart, least: float):
    """Whether sets of together ``both`` elements, ``apart`` of them in one set only, are similar."""
    return (both - apart) >= least * (both + apart) - 1e-9


def _among_members(least: float):
    """Links among the members of one leader, or between two blocks of them, that connect what no other link given here does.

    A member is its difference from the leader, and two members differ in what only one
    of their differences has; so counting common shingles of the differences is exact. All members linked
    with the leader are connected already. So there are fewer links than members.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("b", "ascending")])
        nodes, n = rows["b"].combine_chunks(), rows["n"].to_numpy()
        linked, side = rows["linked"].to_numpy(), rows["side"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["apart"]]
        size = np.array([len(x) for x in sets], np.int64)
        token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, token = np.unique(token, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(token, kind="stable")
        holders, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token))]) if len(token) else np.zeros(1, np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        two_blocks = side[0] != side[-1]
        found_a, found_b = [], []
        label = np.where(linked, -1, np.arange(len(sets)))  # of what is connected so far
        for x in np.flatnonzero(~linked):
            mine = token[at[x] : at[x + 1]]
            first, many = starts[mine], starts[mine + 1] - starts[mine]
            places = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            common = np.bincount(holders[places], minlength=len(sets))
            good = _linked(n[x] + n, size[x] + size - 2 * common, least)
            good[x] = False
            if two_blocks:
                good &= side != side[x]
            good &= label != label[x]
            others, at_first = np.unique(label[good], return_index=True)
            if len(others):
                found_a += [x] * len(others)
                found_b += np.flatnonzero(good)[at_first].tolist()
                label[np.isin(label, others)] = label[x]
        return pa.table({"a": nodes.take(pa.array(found_a, pa.int64())), "b": nodes.take(pa.array(found_b, pa.int64()))})

    return run


def _compared(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (leader, member) with their whole shingle sets held against each other."""
    pairs = B.kept(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = B.kept(nodes.join(reps, "node").select(F.col("rep").alias("doc_id"), "node"), "wanted")
    ids = wanted.select("doc_id").distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(words), "node binary, shingles binary")
    sets = B.kept(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    found = pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b")
    return B.kept(found.mapInArrow(_against_leader(least), "a binary, b binary, linked boolean, n long, apart binary"), "compared")


def _more_links(compared: DataFrame, least: float) -> DataFrame:
    """Links among members of a leader that not all of them are linked with."""
    of = compared.groupBy("a").agg(F.count("*").alias("members"), F.min("linked").alias("all")).where("members > 1 and not all")
    blocks = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")
    of = of.select("a", blocks.alias("blocks"))
    rows = compared.join(of, "a").withColumn("side", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})
    groups = rows.select("a", "low", "high", "side", "b", "n", "linked", "apart").groupBy("a", "low", "high")
    return groups.applyInArrow(_among_members(least), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """The least node that each linked node is connected with: (node, label).

    Each round takes the least label among neighbours and then that label's own label.
    """
    edges = links.select("a", "b")
    edges = B.kept(edges.union(edges.select("b", "a")).distinct(), "edges")
    now = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    now = B.kept(now, "labels")
    while True:
        near = edges.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
        near = near.agg(F.min("label").alias("seen"))
        low = now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        up = now.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = low.join(up, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("top", "label")).alias("label")
        )
        new = B.kept(new, "labels")
        now = new.select("node", "label")
        if not new.where("old != label").limit(1).count():
            return now


def _classes(docs: DataFrame, words: int, least: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Each document's node, and of each node its least doc_id ``rep`` and its class ``label``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.mapInArrow(_sketch(words, bands, rows), "doc_id long, node binary, n_shingles long, bands array<long>")
    found = B.kept(found, "signatures")
    reps = found.groupBy("node").agg(F.min("doc_id").alias("rep"))

    member = found.select(F.explode("bands").alias("band"), "node")
    short = F.conv(F.hex(F.substring("node", 1, 7)), 16, 10).cast("long")
    shared = member.select("band", short.alias("short")).groupBy("band")
    shared = shared.agg(F.min("short").alias("low"), F.max("short").alias("high")).where("low != high")
    member = B.kept(member.join(shared.select("band"), "band").distinct(), "members")

    sizes = member.groupBy("band").agg(F.count("*").alias("size"))
    shared_with = member.join(sizes, "band").groupBy("node").agg(F.sum("size").alias("weight"))
    leader = member.join(shared_with, "node").groupBy("band")
    leader = leader.agg(F.max(F.struct("weight", "node"))["node"].alias("a"))
    pairs = member.join(leader, "band").where("node != a").select("a", F.col("node").alias("b")).distinct()
    with B.small_batches(docs.sparkSession):
        compared = _compared(pairs, docs, reps, words, least)
        more = B.kept(_more_links(compared, least), "links")
    labels = components(compared.where("linked").select("a", "b").union(more))

    of = reps.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return found, B.kept(of, "classes")


def _with_node(carry: list[str], node: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.blocks(batches):
            _, found, offsets = shingles(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([*map(batch.column, carry), _nodes(found, offsets)], [*carry, node])

    return run


def one_of_each(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each class, with all its columns: of the least doc_id, of none only if no member has one.

    Among rows of that doc_id the node decides, then a hash of the row: the choice
    is the same each time, and a doc_id that several classes hold leaves a row in each.
    """
    _, named = _classes(docs, words, least, bands, rows)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node"))
    first = named.groupBy("label").agg(first.alias("first")).select("first.rep", "first.node")
    node, key, other = (f"{x}_{uuid.uuid4().hex}" for x in ("node", "key", "key"))
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + [f"`{node}` binary"])
    found = docs.mapInArrow(_with_node(docs.columns, node, words), schema)

    def named_by(doc_id: str, of: str):  # one key without nulls: the rows are moved once
        return F.concat(F.hex(of), F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")))

    found = found.withColumn(key, named_by("doc_id", node)).drop(node)
    found = found.join(first.select(named_by("rep", "node").alias(other)), F.col(key) == F.col(other), "left_semi")
    row = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64(*docs.columns), F.xxhash64("text")))
    return found.groupBy(key).agg(row.alias(other)).select(f"{other}.*")


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    least: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row a document: (doc_id, class_id, class_size, n_shingles).

    ``class_id`` is the least doc_id of its class. Copies are one node of the link
    graph. In each bucket of a band only the node that shares most buckets, its leader,
    is compared with the others. Members that are not linked with their leader are then
    compared among themselves, by their differences from it and in blocks. So a large
    group of near copies costs one comparison a member, and no pair is left out.
    """
    found, named = _classes(docs, words, least, bands, rows)
    classes = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    sizes = found.groupBy("node").count().join(named, "node").groupBy("label").agg(F.sum("count").alias("class_size"))
    out = named.join(classes, "label").join(sizes, "label").select("node", "class_id", "class_size")
    return found.join(out, "node").select("doc_id", "class_id", "class_size", "n_shingles")
