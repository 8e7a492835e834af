"""A training-data pipeline: each stage takes the documents its predecessor kept.

Defined cases, for all stages: rows without an id, with a shared id, repeated rows, null and empty texts, null languages and sources are documents like
others. A null or empty text is what the quality classifier makes of it, has no lines, is alike to no other text but one without words, has size 0 and no
token. Very long texts are read whole, in pieces. Of near copies with equal ids the one of the smaller content hash stays. Extra columns are
kept, whatever their names; a stage adds and drops none but the last. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import lines, mixing, quality, shingles, simhash
from threadloom.llm.queries import encoded, word_bpe
from threadloom.session import spread, stage_path

# Bytes of text in a block of the last stage: its workers share an executor that four stages have filled, and more of the disk is free than in ``op4_bpe``.
BPE_BLOCK_BYTES = 8 << 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained quality classifier keeps; no given label is read."""
    return quality.keep_good(docs, quality.fit(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeats of lines that are on many sites."""
    cleaned = lines.dedup_lines(docs).drop("n_lines", "n_removed")
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cleaned


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, whose five-word shingles have a similarity of at least 0.8.

    SimHash fingerprints of at most three bits' difference are the first candidates (``simhash.links``). They stand for texts far more alike than
    0.8, so ``shingles`` adds candidates and checks every link exactly; ``simhash`` keeps one document of each group.
    """
    return simhash.keep_one(docs, shingles.components)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.take(spread(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, and digests of the ids and of the decoded text, of every document taken."""
    return encoded(docs, word_bpe(), BPE_BLOCK_BYTES)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("BPE", bpe_stage),
]

# No SQL states the classifier, the fingerprints or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = stage_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
