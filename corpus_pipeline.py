"""Corpus pipeline: quality rules, near-duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
``documents``. Each works on all that its predecessor kept; the quality rules also read the
quality labels beside the documents, from which they learn what a bad vote means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetscope.llm import mixing, packing, quality, secrets, simhash
from fleetscope.runtime import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules reject go; ``sf_dir`` None means no labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet") if sf_dir else None
    return quality.keep_good(docs, labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: SimHash of five-word shingles, 5 bits."""
    return simhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return secrets.redact(docs, secrets.train_on_documents(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, in shards; sources weigh 1, 2, 3, repeating."""
    return mixing.write_order(docs, mixing.plan(docs, weight=lambda k, _: k % 3 + 1))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences of 1024."""
    found = packing.pieces(docs, "byte_bpe_50k.json", end_id=2, size=1024)
    return packing.pack(found, 1024)


STAGES = [
    ("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("secret_scan", secret_scan),
    ("source_mixing", source_mix), ("best_fit_packing", packed_sequences),
]
# SQL expresses neither the learned quality verdicts, the hashes of the mix nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
