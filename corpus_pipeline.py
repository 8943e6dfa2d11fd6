"""From raw documents to tokens: quality rules, near-dedup, decontamination, secret scan, encoding.

Each stage works on all that the one before kept. Its result is written as Parquet to the
shared folder and read again, so a lost executor repeats one stage's tasks only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from greenlattice.llm import bpe, decontaminate, near_dedup, quality_rules, secrets
from greenlattice.llm.common import keep, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules.stage),  # documents that the rules reject go
    ("near_dedup", near_dedup.stage),  # one document of each group stays
    ("decontaminate", decontaminate.stage),  # documents with a benchmark item go
    ("secrets", secrets.stage),  # secrets in texts are replaced by their kind
    ("encode", bpe.stage),  # doc_id, n_tokens, ids, digest of the decoded text
]

#: SQL can say neither sketches, nor edit distance over windows, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
