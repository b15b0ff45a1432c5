"""From raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as Parquet before the next one
reads it: quality classifier, near-duplicates, benchmark decontamination, secret scan, SentencePiece encoding. The first
four keep the columns of ``documents`` and drop rows; the last one returns the tokens of what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import decontaminate, minhash_dedup, pieces, quality_classifier, secret_scan
from tramline.llm.shared import forget, stored

#: Words of a shingle for near-duplicates; op1's own query has four.
SHINGLE = 5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _dropped(docs: DataFrame, verdicts: DataFrame, key: str, of_text: Column) -> DataFrame:
    """Rows without those whose id and text are among ``verdicts`` (doc_id, ``key``); null ids count as equal."""
    bad = verdicts.select(F.col("doc_id").alias("_id"), F.col(key).alias("_key")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (of_text == F.col("_key")), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier predicts as label 0; it learns from the labelled documents among these."""
    model = quality_classifier.learn(docs, quality_classifier.training_labels(spark, sf_dir))
    return quality_classifier.kept(docs, model).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: that with the least id, or one of those without an id. Repeated rows are kept once."""
    found = minhash_dedup.near_duplicates(docs, SHINGLE)
    once = docs.select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return _dropped(once, found.where(~F.col("chosen")), "raw", F.xxhash64(F.col("text").cast("string")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a credential that isn't a widely copied example."""
    found = secret_scan.scan(docs, strict=True)
    live = F.col("n_assign") + F.col("n_access") + F.col("n_hex") - F.col("n_example") + F.col("n_live") > 0
    return _dropped(docs.select(*COLUMNS), found.where(live), "text_key", F.sha1(F.coalesce("text", F.lit(""))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left."""
    return pieces.encoded(docs)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("sentencepiece", tokens),
]
#: The classifier and the token ids can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; a stage's table goes once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        now = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        docs = before = now
    return docs
