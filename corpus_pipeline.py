"""Five stages from raw documents to packed sequences. Each takes what the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm import language_id, packing, secret_scan, simhash, weak_supervision
from quillgrid.llm.common import cut_lineage, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", weak_supervision.stage),
    ("language_id", language_id.stage),
    ("simhash_near_dedup", simhash.stage),
    ("secret_scans", secret_scan.stage),
    ("packing", packing.stage),
]

#: SQL can't express expectation-maximisation, fingerprints' components or column generation.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each result written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
