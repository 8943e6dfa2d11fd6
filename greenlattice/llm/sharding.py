"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows each source partition sends to each shard is drawn exactly (a multivariate
hypergeometric law with the partition sizes and the shard sizes as margins). Every
partition permutes its rows and cuts them by its row of the matrix; every shard permutes
what it got. The result is a uniform permutation whose shards differ by one row at most.

Only (columns asked for, partition, two random numbers) are stored and shuffled. A shard
is permuted in slices, so no task holds a whole shard. The stored numbers make the result
the same when a lost task runs again.

Nulls: a null text counts no bytes and has the checksum of no bytes; null ids are rows
like others. Equal rows are placed independently. An empty table gives an empty result.
Law: ``rows`` (counts at most one apart); nothing is promised for another shard count.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from greenlattice.llm.common import keep, query, small, table, text_of

SHARDS = 24
SLICE_ROWS = 50_000  # rows of a shard that one task permutes


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - at_mode
    down = up = mode
    p_down = p_up = at_mode
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def matrix(sizes: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows per (partition, shard): margins are ``sizes`` and shard sizes one apart at most."""
    rng = random.Random(seed)
    total = sum(sizes)
    open_places = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    drawn = []
    for size in sizes:
        row, places, draws = [], sum(open_places), size
        for s, good in enumerate(open_places):
            k = hypergeometric(rng, good, places - good, draws)
            places -= good
            draws -= k
            row.append(k)
        open_places = [g - k for g, k in zip(open_places, row)]
        drawn.append(row)
    return drawn


def shuffle_to_shards(df: DataFrame, n_shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """``df`` with shard and slot (gapless from 0 within the shard), both uniform."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 at least")
    spark = df.sparkSession
    source = keep(df.withColumns({"_part": F.spark_partition_id(), "_first": F.rand(seed), "_second": F.rand(seed + 1),
                                  "_line": F.monotonically_increasing_id()}))
    # one row per input partition and per shard reach the driver, whatever the row count
    sizes = [(r["_part"], r["n"]) for r in source.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()]
    drawn = matrix([n for _, n in sizes], n_shards, seed)
    ends = []
    for (part, _), row in zip(sizes, drawn):
        upto, out = 0, []
        for k in row:
            upto += k
            out.append(upto)
        ends.append((part, out))
    cuts = spark.createDataFrame(ends, T.StructType([T.StructField("_cut_part", T.IntegerType()),
                                                     T.StructField("_ends", T.ArrayType(T.LongType()))]))
    local = F.row_number().over(Window.partitionBy("_part").orderBy("_first", "_line"))
    placed = (source.withColumn("_at", local).join(small(cuts), F.col("_part") == F.col("_cut_part"))
              .withColumn("shard", F.expr("int(size(filter(_ends, e -> e < _at)))"))
              .drop("_at", "_ends", "_cut_part"))
    per_shard = sum(n for _, n in sizes) // n_shards + 1
    slices = per_shard // SLICE_ROWS + 1
    placed = keep(placed.withColumn("_slice", F.expr(f"int(least(floor(_second * {slices}), {slices - 1}))")))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n"))
              .select(F.col("shard").alias("_to"), F.col("_slice").alias("_of"),
                      F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = F.row_number().over(Window.partitionBy("shard", "_slice").orderBy("_second", "_line"))
    return (placed.withColumn("_in", inside)
            .join(starts, (F.col("shard") == F.col("_to")) & (F.col("_slice") == F.col("_of")))
            .withColumn("slot", (F.col("_start") + F.col("_in") - 1).cast("long"))
            .drop("_part", "_first", "_second", "_line", "_slice", "_in", "_to", "_of", "_start"))


# The two windows over counts above hold one row per (shard, slice), not per document.


def write_shards(df: DataFrame, path: str, n_shards: int = SHARDS, seed: int = 7) -> None:
    """Write one folder per shard, rows in slot order within each file."""
    shuffle_to_shards(df, n_shards, seed).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", (F.octet_length(text_of()) + 8).cast("long").alias("size"),
                         F.crc32(text_of().cast("binary")).alias("text_crc32"))
    return shuffle_to_shards(narrow).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
