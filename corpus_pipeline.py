"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.byte_bpe import stage_byte_bpe
from quire.llm.common import scratch
from quire.llm.decontaminate import stage_decontaminate
from quire.llm.near_dedup import stage_near_dedup
from quire.llm.quality_rules import stage_quality_rules
from quire.llm.secrets import stage_secret_scan

STAGES = [
    ("quality_rules", stage_quality_rules),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("secret_scan", stage_secret_scan),
    ("byte_bpe", stage_byte_bpe),
]
#: No SQL has the merges of a byte-level vocabulary; tests/llm compares the rows of run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over documents. Each stage's rows are in the shared folder, so the next one starts from files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
