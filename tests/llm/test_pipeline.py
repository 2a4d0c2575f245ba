"""The pipeline's stages, each over what the one before has kept, against brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import mixing, quality

from test_operators import BASE, ITEMS, PASSAGE, SCHEMA, classes, hits, near, public_tokenizers, sentence

ROWS = [(i, sentence(60), "en", f"s{i % 3}", i) for i in range(30)]
ROWS += [(100 + i, near(i % 6), None, "s1", None) for i in range(12)] + [(200 + i, ROWS[i][1], "en", "s0", 1) for i in range(6)]
ROWS += [(300, sentence(20) + " " + PASSAGE, "en", "s2", 1), (301, None, "en", "s2", 1), (302, "too short", None, None, 1), (303, " ".join(BASE), None, None, 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, ROWS
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        got = out.collect()
        if name == "quality rules":
            kept = {r.doc_id for r in quality.quality(docs).collect() if r.kept}
            want = [r for r in rows if r[0] in kept]
            assert kept and 301 not in kept and 302 not in kept
        elif name == "near duplicates":
            want = [r for r in rows if any(c[0] == c[1] == r[0] for c in classes(rows))]
            assert len(want) < len(rows)
        elif name == "decontamination":
            bad = {h[0] for h in hits(rows, ITEMS) if h[5]}
            want = [r for r in rows if r[0] not in bad]
            assert bad
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            want = [r for r in rows for _ in range(copies[r[0]])]
            words = sum(len(r[1].split()) for r in rows)
            assert sum(len(r[1].split()) for r in want) == pytest.approx(1.5 * words, rel=0.1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            start, want = 0, []
            for i, t, *_ in sorted(rows):
                ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
                want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
                start += len(ids)
            assert sorted(map(tuple, got)) == sorted(want)
            break
        assert out.columns == columns
        assert Counter(map(tuple, got)) == Counter(want)
        docs, rows = out, [tuple(r) for r in got]


def test_stages_carry_columns_of_any_name(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    names = ("copies", "mixed_id", "bad_id", "kept", "n_words", "copy", "row", "class_id", "verdict")
    docs = docs.withColumns({c: F.lit("own") for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert out.where(" and ".join(f"{c} = 'own'" for c in names)).count() == out.count() > 0


def test_repeated_and_missing_ids_keep_their_texts(spark, folder):
    same = [(1, sentence(60), "en", "s0", 1)]
    rows = same * 3 + [(1, sentence(60), "en", "s0", 1), (2, same[0][1], "en", "s1", 2)]
    rows += [(None, sentence(60), "en", "s0", 1) for _ in range(4)] + [(None, same[0][1], "en", "s1", 1)]
    rows += [(None, sentence(20) + " " + PASSAGE, "en", "s2", 1), (3, sentence(20) + " " + PASSAGE, "en", "s2", 1), (3, sentence(60), "en", "s0", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    (_, unique), (_, clean), (_, mixed) = corpus_pipeline.STAGES[1:4]
    left = unique(spark, docs, folder).collect()
    want = [r for k, r in enumerate(rows) if k not in (1, 2, 4, 9)]
    assert Counter(map(tuple, left)) == Counter(want)
    left = clean(spark, spark.createDataFrame(left, SCHEMA), folder).collect()
    want = [r for r in want if PASSAGE not in r[1]]
    assert Counter(map(tuple, left)) == Counter(want)
    copies = Counter(tuple(r) for r in mixed(spark, spark.createDataFrame(left, SCHEMA), folder).collect())
    assert sum(copies.values()) <= mixing.MOST * len(want) and set(copies) <= set(want)
    assert sum(len(r[1].split()) * n for r, n in copies.items()) == pytest.approx(1.5 * sum(len(r[1].split()) for r in want), rel=0.1)


def test_empty_documents(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
