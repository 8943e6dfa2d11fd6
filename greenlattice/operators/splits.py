"""Deterministic splits and folds by a fixed scatter order of the row id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from greenlattice.functions.numeric import scatter_key
from greenlattice.operators.ranking import ROWS_PER_BUCKET, rank_values, row_position, values_at_positions


def train_test_labels(df: DataFrame, row_id: str, test_share: float = 0.2, validation_share: float = 0.0,
                      out: str = "split", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Label rows test / validation / train: the first rows of the scatter order are test.

    The scatter order has no ties, so one or two order statistics turn the whole split
    into a filter; nothing is sorted or shuffled by row.
    """
    keyed = df.withColumn("_key", scatter_key(F.col(row_id)))
    n = keyed.count()
    n_test = math.ceil(n * test_share)
    n_validation = math.ceil((n - n_test) * validation_share) if validation_share else 0
    ends = [e for e in (n_test - 1, n_test + n_validation - 1) if 0 <= e < n]
    cut = values_at_positions(keyed, "_key", ends, rows_per_bucket) if ends else {}
    label: Column = F.lit("train")
    if n_validation and n_test + n_validation - 1 in cut:
        label = F.when(F.col("_key") <= F.lit(cut[n_test + n_validation - 1]), "validation").otherwise(label)
    if n_test and n_test - 1 in cut:
        label = F.when(F.col("_key") <= F.lit(cut[n_test - 1]), "test").otherwise(label)
    return keyed.withColumn(out, label).drop("_key")


def kfold(df: DataFrame, row_id: str, k: int = 5, out: str = "fold",
          rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Shuffled folds of near-equal size: contiguous blocks of the scatter order."""
    keyed = df.withColumn("_key", scatter_key(F.col(row_id)))
    n = keyed.count()
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    ends, total = [], 0
    for s in sizes[:-1]:
        total += s
        ends.append(total - 1)
    cut = values_at_positions(keyed, "_key", [e for e in ends if e >= 0], rows_per_bucket)
    fold: Column = F.lit(k - 1)
    for i in range(k - 2, -1, -1):
        if ends[i] in cut:
            fold = F.when(F.col("_key") <= F.lit(cut[ends[i]]), F.lit(i)).otherwise(fold)
    return keyed.withColumn(out, fold.cast("int")).drop("_key")


def stratified_kfold(df: DataFrame, row_id: str, label: str, k: int = 5, out: str = "fold",
                     rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Folds that deal out each class in scatter order; a dominant class is ranked in buckets."""
    keyed = df.withColumn("_key", scatter_key(F.col(row_id)))
    ranks = rank_values(keyed, "_key", [label], rows_per_bucket=rows_per_bucket).select(label, "_key", "below")
    return keyed.join(ranks, [label, "_key"]).select(*df.columns, (F.col("below") % k).cast("int").alias(out))


def time_series_block(df: DataFrame, time: str, row_id: str, k: int = 5, out: str = "block",
                      rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Block 0..k in time order: fold i tests on block i + 1 and trains on all earlier blocks.

    Each of the last k blocks holds n // (k + 1) rows, the first takes the rest.
    """
    n = df.count()
    size = n // (k + 1)
    first = n - size * k
    placed = row_position(df, time, row_id, "_position", rows_per_bucket=rows_per_bucket)
    block = F.when(F.col("_position") < first, F.lit(0)).otherwise(
        F.floor((F.col("_position") - first) / F.lit(max(size, 1))) + 1)
    return placed.withColumn(out, block.cast("int")).drop("_position")


def time_series_fold(df: DataFrame, fold: int, block: str = "block") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(block) <= fold), df.where(F.col(block) == fold + 1)


def downsample(df: DataFrame, row_id: str, limit: int | None = None) -> DataFrame:
    """All rows, or the first ``limit`` of the scatter order if one is asked for."""
    return df if limit is None else df.orderBy(scatter_key(F.col(row_id))).limit(limit)
