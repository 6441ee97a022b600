"""A training corpus from raw documents: filtered, deduplicated, mixed and packed.

Every stage is one operator over all rows its predecessor kept; results are stored as Parquet
in the shared folder between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoview.llm import catalog, common, exact, mixing, neardup, packing, quality
from chronoview.session import staged


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the quality rules reject go."""
    common.prepare(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal texts the row with the largest doc_id stays."""
    common.prepare(spark)
    return exact.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near-duplicates one document stays."""
    common.prepare(spark)
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every document comes as often as the mix takes it."""
    common.prepare(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: pieces of the documents placed in sequences of 2048 tokens."""
    common.prepare(spark)
    return packing.pack(docs, catalog.WORDS)


STAGES = [
    ("quality_rules", filter_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# Registers, tokenizers and the packing plan are outside SQL; tests hold run() against
# a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole table of documents."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
