"""A training corpus in five stages: toxicity, near duplicates, contamination, secrets, packing.

Each stage takes the documents that the one before it left, and all but the last return rows with the columns of
documents. Toxic documents go; one document of each group of near duplicates stays; contaminated documents go; secrets
are replaced by a mark inside their documents; what is left is packed into sequences. Null ids are kept by every stage
(they are no near duplicates of anything), null texts too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, near_duplicates, packing, secrets, toxicity
from docloom.llm.common import Scratch, stored, table

BROADCAST_ROWS = 1_000_000  # of at most 16 bytes each


def _bounded(frame: DataFrame) -> DataFrame:
    """The frame, to be broadcast if a count shows that it is small."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    scored = toxicity.with_score(docs.select(F.struct(*names).alias("row"), "text"), model)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; of equal rows with one id, one."""
    scratch = Scratch(spark)
    judged = near_duplicates.near_duplicates(docs, scratch).where("not kept and doc_id is not null")
    gone = stored(judged.select("doc_id").distinct(), "gone")
    scratch.clear()
    kept = docs.join(_bounded(gone), "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = stored(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    judged = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    bad = stored(judged.select("doc_id", "fp").distinct(), "contaminated")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    same = rows["id"].eqNullSafe(bad["doc_id"]) & (rows["hash"] == bad["fp"])
    return rows.join(_bounded(bad), same, "left_anti").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the toxicity model nor the packing. tests/llm compares which documents the stages drop, and what
#: they mask, with plain versions; the packing is compared in the tests of its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data directory; each stage is written and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.clear(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
