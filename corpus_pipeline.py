"""From raw documents to segmented training text, in five stages.

Quality filter, exact and near deduplication, benchmark decontamination, then
SentencePiece encoding.  Every stage reads what the one before kept, over whole
texts; all but the last return the columns of ``documents``.  Learned judgements
and fingerprints cannot be said in SQL, so there is no SQL for the whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echogrid.llm import decontaminate, exact_dedup, near_dedup, quality, segment
from echogrid.session import shared_dir

PIECES = "piece_bpe_32k.model"


def _passed(docs: DataFrame, judged: DataFrame, verdict: Column) -> DataFrame:
    """The columns of ``docs`` where ``verdict`` holds; it names what ``judged`` has after them v0, v1 and so on, whatever their names."""
    n = len(docs.columns)
    private = judged.toDF(*[f"c{i}" for i in range(n)], *[f"v{i}" for i in range(len(judged.columns) - n)])
    return private.filter(verdict).select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects; it learns from the labelled rows among ``docs``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _passed(docs, quality.score(docs, model, docs.columns), F.col("v1") == 1)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the largest doc_id."""
    return exact_dedup.survivors(docs)


def _keyed(docs: DataFrame) -> DataFrame:
    """``key``, the id (null last) and a digest of the text, and ``text``: rows equal in both are judged alike."""
    digest = F.unhex(F.md5("text"))
    return docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("digest")).alias("key"), "text")


def _with_keys(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose key is among ``keys``, or is not."""
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.unhex(F.md5("text")).alias("row_digest"))
    chosen = keys.select("key.*").distinct().toDF("key_none", "key_id", "key_digest")
    same = F.col("row_id").eqNullSafe(F.col("key_id")) & F.col("row_digest").eqNullSafe(F.col("key_digest"))
    return held.join(chosen, same, how).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash, keep one text: the one with the smallest doc_id, null last, then the smallest digest.

    Rows equal in id and text, which the stage before leaves once, stay or go together.
    """
    grouped = near_dedup.groups(_keyed(docs), "key")
    return _with_keys(docs, grouped.filter(F.col("id") == F.col("component_id")).select(F.col("id").alias("key")), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more is benchmark passages; texts are indexed under their keys and travel no further."""
    judged = decontaminate.judge(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["key"])
    return _with_keys(docs, judged.filter("contaminated").select("key"), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with the scores of its best segmentations."""
    pieces = segment.read_model(public_tokenizers.path(PIECES))
    return segment.encode(docs, pieces, ["doc_id", "lang", "source"]).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids", "scores", "round_trip")


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
