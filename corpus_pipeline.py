"""From raw documents to token files: five stages, each over all the one before has kept.

Every stage takes the documents its predecessor returned, read again from Parquet. From
the second stage on, rows that share a doc_id and a text are one document; rows
with the same doc_id, or none, but different texts are different documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import dartminhash, decontaminate, mixing, quality, token_files
from runlens.llm.blocks import kept, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "word_bpe_49k.json"
VERDICT = "quality rules' verdict"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judged(docs, VERDICT).where(F.col(VERDICT)["kept"]).select(*docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies; repeated and missing ids do not matter."""
    return dartminhash.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    own = F.xxhash64("doc_id", "text")
    found = decontaminate.contamination(docs.select(own.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, own == bad["bad_id"], "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a row a copy; not at all where that is never."""
    row, own, again = (f"{x}_{uuid.uuid4().hex}" for x in ("row", "own", "again"))
    twice = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(again)).count().where("count > 1").select(again)
    twice = kept(twice, "repeated-ids")
    if twice.count() <= dartminhash.BROADCAST_IDS:  # else the texts are shuffled once more
        twice = F.broadcast(twice)
    rows = docs.select(F.struct(*docs.columns).alias(row)).join(twice, F.col(row)["doc_id"] == twice[again], "left")
    text_id = F.xxhash64(F.col(row)["doc_id"], F.col(row)["text"])  # where the doc_id does not name one text
    plain = F.col(row)["doc_id"].isNotNull() & F.col(again).isNull()
    rows = rows.select(row, F.when(plain, F.col(row)["doc_id"].cast("long")).otherwise(text_id).alias(own))
    ids = rows.select(f"{row}.*", own).withColumn("doc_id", F.col(own)).drop(own)
    taken = mixing.mix(ids).where("copies > 0").select(F.col("doc_id").alias("mixed_id"), "copies")
    rows = rows.join(taken, rows[own] == taken["mixed_id"])
    return rows.select(row, F.explode(F.sequence(F.lit(1), taken["copies"]))).select(f"{row}.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, written to files and read back."""
    return token_files.read_tokens(token_files.write_tokens(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality rules", good),
    ("near duplicates", unique),
    ("decontamination", clean),
    ("mixing", mixed),
    ("token files", tokens),
]
#: Shingle links and token ids are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
