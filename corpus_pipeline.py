"""From raw documents to packed training sequences: five stages, each one operator over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import quality
from leafmill.llm.decontam import decontaminate
from leafmill.llm.minhash import near_duplicates
from leafmill.llm.packing import pack_documents
from leafmill.llm.secrets import redact
from leafmill.llm.store import stored

#: The vocabulary file of the last stage.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the list learned from the labels."""
    rules = quality.learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept, stats, failed = (quality.free_name(docs, c) for c in ("kept", "stats", "base_failed"))
    return quality.judge(docs, rules, into=kept, stats=stats, failed=failed).filter(F.col(kept)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group that links at 0.8 of five-word shingles join."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which ten consecutive words of a benchmark item stand."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=quality.free_name(docs, "contamination"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents and replaces each secret in their texts by a mark; n_chars follows the texts."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences and places there."""
    return pack_documents(docs, VOCABULARY)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("benchmark_decontamination", benchmark_decontamination), ("secret_scans", secret_scans), ("best_fit_packing", best_fit_packing)]

#: SQL can express neither the learned rules nor the components nor the packing; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
