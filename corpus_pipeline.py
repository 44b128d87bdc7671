"""The corpus pipeline: five stages over ``documents``, each written and reread as the next one's input.

Toxicity drops what it rejects, near-dedup keeps one document of each near-duplicate group,
PII masks personal data, mixing repeats and drops documents towards its sources' target
weights, and packing lays the tokens into windows. A stage drops no other rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadframe.llm import mixing, nearcopies, packing, pii, queries, toxicity
from spreadframe.shared import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; models as in op4."""
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 0").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy group: the one with its smallest doc_id.

    SimHash fingerprints as in op10 give the first links, each checked: texts link at a Jaccard similarity of 0.8 or more over
    shingles of five words; an exact pass adds the links that fingerprints miss.
    """
    return nearcopies.near_copy_groups(docs, shingle=5).where("kept").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with personal data masked; n_chars follows the text where it changed."""
    masked = docs.withColumn("_masked", pii.redact(F.col("text")))
    changed = ~F.col("_masked").eqNullSafe(F.col("text"))
    return masked.select(*(F.col("_masked").alias(c) if c == "text" else F.when(changed, F.length("_masked").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    mixed = mixing.mix_sources(docs)
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in its window."""
    return packing.pack_documents(docs, queries.tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has neither XXH64 nor the trained models; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
