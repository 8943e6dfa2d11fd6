"""Ranks and row positions of a whole table without a single-task sort.

A plain window over an unpartitioned (or one hot) group sends all its rows to one task.
Here rows are first counted per distinct value (combined map-side, so ties cannot pile
up), values are cut into near-equal buckets at sketched split points, and every bucket is
ordered on its own. A row's rank is its rank inside the bucket plus the rows in lower
buckets, a prefix sum over at most ``MAX_BUCKETS`` rows per group.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

ROWS_PER_BUCKET = 50_000
MAX_BUCKETS = 65_536  # beyond 3 * 10^9 rows buckets grow, and their sorts spill


def _number(df: DataFrame, column: str) -> Column:
    """A double that never falls where ``column`` rises; days for a date."""
    value = F.col(column)
    return (F.unix_date(value) if isinstance(df.schema[column].dataType, T.DateType) else value).cast("double")


def split_points(df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Inner split points that cut ``column`` into buckets of about ``rows_per_bucket`` rows.

    The sketch only balances the buckets; results never depend on its accuracy.
    """
    rows = df.agg(F.count(column)).first()[0]
    buckets = min(MAX_BUCKETS, rows // rows_per_bucket + 1)
    if buckets < 2:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(_number(df, column), probs, 10 * buckets)).first()[0]
    return sorted(set(found or []))


def with_bucket(df: DataFrame, column: str, splits: list[float], out: str = "_bucket") -> DataFrame:
    """Add the bucket number of a non-NULL ``column``."""
    if not splits:
        return df.withColumn(out, F.lit(0))
    edges = [float("-inf"), *splits, float("inf")]
    keyed = df.withColumn("_sort_key", _number(df, column) + 0.0)  # -0.0 must not fall below 0.0
    cut = Bucketizer(splits=edges, inputCol="_sort_key", outputCol=out, handleInvalid="keep")
    return cut.transform(keyed).drop("_sort_key").withColumn(out, F.col(out).cast("int"))


def rank_values(df: DataFrame, value: str, groups: list[str] | tuple[str, ...] = (),
                weights: dict[str, Column] | None = None,
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per (groups, value): ``ties`` equal rows and ``below`` smaller rows in the group.

    ``weights`` adds further summed columns per distinct value. NULL values take no part.
    """
    groups = list(groups)
    present = df.where(F.col(value).isNotNull())
    extra = [F.sum(expr).alias(name) for name, expr in (weights or {}).items()]
    counts = present.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("ties"), *extra)
    splits = split_points(present, value, rows_per_bucket)
    inside = W.partitionBy(*(groups or [F.lit(0)])).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    if not splits:
        return counts.withColumn("below", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    counts = with_bucket(counts, value, splits)
    lower = W.partitionBy(*(groups or [F.lit(0)])).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (counts.groupBy(*groups, "_bucket").agg(F.sum("ties").alias("_rows"))
               .withColumn("_offset", F.coalesce(F.sum("_rows").over(lower), F.lit(0))).drop("_rows"))
    inside = W.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("_inside", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    condition = placed["_bucket"] == offsets["_bucket"]
    for g in groups:
        condition = condition & placed[g].eqNullSafe(offsets[g])
    joined = placed.join(offsets, condition)
    kept = [placed[c] for c in (*groups, value, "ties", *(weights or {}))]
    return joined.select(*kept, (placed["_inside"] + offsets["_offset"]).alias("below"))


def average_rank(df: DataFrame, value: str, out: str, groups: list[str] | tuple[str, ...] = (),
                 descending: bool = False, percent: bool = False,
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the average rank of ``value`` (ties share their mean rank), or its share of the group.

    A NULL value has a NULL rank.
    """
    groups = list(groups)
    ranks = rank_values(df, value, groups, rows_per_bucket=rows_per_bucket)
    sizes = ranks.groupBy(*groups).agg(F.sum("ties").alias("_n"))
    if groups:
        ranks = ranks.join(sizes, groups)
        total = F.col("_n")
    else:
        total = F.lit(sizes.first()[0])
    ascending = F.col("below") + (F.col("ties") + 1) / 2.0
    rank = (total + 1) - ascending if descending else ascending
    if percent:
        rank = rank / total
    ranks = ranks.select(*groups, value, rank.cast("double").alias(out))
    return df.join(ranks, [*groups, value], "left").select(*df.columns, out)


def row_position(df: DataFrame, value: str, tiebreak: str, out: str,
                 groups: list[str] | tuple[str, ...] = (),
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the 0-based position of each row ordered by (value, tiebreak) within its group.

    ``tiebreak`` must be unique within equal values; ranking it inside the tie keeps a
    value shared by a large part of the table spread over many tasks.
    """
    groups = list(groups)
    major = (rank_values(df, value, groups, rows_per_bucket=rows_per_bucket)
             .select(*groups, value, F.col("below").alias("_major")))
    minor = (rank_values(df, tiebreak, [*groups, value], rows_per_bucket=rows_per_bucket)
             .select(*groups, value, tiebreak, F.col("below").alias("_minor")))
    placed = df.join(major, [*groups, value]).join(minor, [*groups, value, tiebreak])
    return placed.select(*[F.col(c) for c in df.columns],
                         (F.col("_major") + F.col("_minor")).cast("bigint").alias(out))


def values_at_positions(df: DataFrame, value: str, positions: list[int],
                        rows_per_bucket: int = ROWS_PER_BUCKET) -> dict[int, float]:
    """The values at the given 0-based sorted positions (exact order statistics).

    Only buckets that hold a wanted position are ordered; at most one row per position
    reaches the driver.
    """
    wanted = sorted(set(positions))
    present = df.where(F.col(value).isNotNull()).select(value)
    splits = split_points(present, value, rows_per_bucket)
    bucketed = with_bucket(present, value, splits)
    sizes = {r[0]: r[1] for r in bucketed.groupBy("_bucket").count().collect()}  # at most MAX_BUCKETS rows
    local: dict[int, list[int]] = {}
    start = 0
    offsets: dict[int, int] = {}
    for bucket in sorted(sizes):
        offsets[bucket] = start
        local[bucket] = [p for p in wanted if start <= p < start + sizes[bucket]]
        start += sizes[bucket]
    needed = [b for b in sizes if local[b]]
    if not needed:
        return {}
    counts = (bucketed.where(F.col("_bucket").isin(needed)).groupBy("_bucket", value)
              .agg(F.count(F.lit(1)).alias("ties")))
    inside = W.partitionBy("_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("_below", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    spark = df.sparkSession
    starts = spark.createDataFrame([(b, offsets[b]) for b in needed], "_bucket int, _start bigint")  # at most MAX_BUCKETS rows
    placed = placed.join(starts, "_bucket").withColumn("_first", F.col("_start") + F.col("_below"))
    # A row holds a wanted position when more of them lie at or before its end than before it.
    marks = [float(p) for p in wanted]
    placed = placed.withColumns({"_a": F.col("_first") - 0.5, "_z": F.col("_first") + F.col("ties") - 0.5})
    placed = with_bucket(with_bucket(placed, "_a", marks, "_before"), "_z", marks, "_upto")
    found: dict[int, float] = {}
    for row in placed.where(F.col("_upto") > F.col("_before")).collect():
        base = offsets[row["_bucket"]] + row["_below"]
        for p in local[row["_bucket"]]:
            if base <= p < base + row["ties"]:
                found[p] = row[value]
    return found
