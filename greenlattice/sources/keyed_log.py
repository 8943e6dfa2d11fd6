"""A keyed table kept as small deltas: upserts cost as much as their batch, reads merge by version.

Layout below the table's folder::

    delta/version=7/bucket=3/part-*   the rows of batch 7 whose key hashes to bucket 3
    base/version=9/bucket=3/part-*    one row per key of bucket 3, as of version 9

A batch replaces its own version when it is written again, so a replayed batch changes nothing.
Compaction merges the buckets that have gathered enough deltas and leaves all others alone. A version
counts once its writer has committed it (its ``_SUCCESS`` file).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

BUCKETS = 64
VERSION, BUCKET = "_version", "_bucket"


@dataclass(frozen=True)
class KeyedLog:
    """The table at ``path`` with one row per ``keys``; of rows of one batch the one with the greatest ``order`` counts.

    Ties are decided by the other columns, the greatest first, so every engine and replay agrees. Rows
    with a NULL key share it. ``buckets`` is fixed when the table is begun.
    """

    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    buckets: int = BUCKETS

    # ------------------------------------------------------------ writing

    def append(self, rows: DataFrame, version: int) -> None:
        """Write one batch as ``version``; the same version again replaces it."""
        placed = self._newest(rows.withColumn(VERSION, F.lit(version).cast("long"))).withColumn(BUCKET, self._bucket())
        self._write(placed, "delta", version)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row per key, the newest; combined map-side before the shuffle."""
        rest = [c for c in rows.columns if c not in (*self.keys, VERSION, *self.order)]
        last = F.max(F.struct(VERSION, *self.order, *rest)).alias("_last")
        found = rows.groupBy(*self.keys).agg(last)
        return found.select(*[F.col(c) if c in self.keys else F.col(f"_last.{c}").alias(c) for c in rows.columns])

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        named = rows.withColumnRenamed(BUCKET, "bucket").drop(VERSION)
        named.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/version={version}")

    # ------------------------------------------------------------ reading

    def state(self, spark: SparkSession) -> tuple[list[int], dict[int, int]]:
        """Committed versions of deltas, and the newest base version of each compacted bucket."""
        bases: dict[int, int] = {}
        for version in self._versions(spark, "base"):
            for bucket in _numbers(spark, f"{self.path}/base/version={version}", "bucket="):
                bases[bucket] = max(version, bases.get(bucket, -1))
        return self._versions(spark, "delta"), bases

    def _versions(self, spark: SparkSession, kind: str) -> list[int]:
        found = _numbers(spark, f"{self.path}/{kind}", "version=")
        return [v for v in found if _exists(spark, f"{self.path}/{kind}/version={v}/_SUCCESS")]

    def _rows(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """All rows that a read has to merge, with their version and bucket: bases, and deltas newer than them."""
        deltas, bases = self.state(spark)
        stored = T.StructType([*schema, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])
        base_of = F.coalesce(F.element_at(_literal_map(bases), F.col("bucket")), F.lit(-1).cast("long")) if bases else F.lit(-1).cast("long")
        out = spark.createDataFrame([], stored)
        least = min(bases.values()) if len(bases) == self.buckets else -1
        live = [f"{self.path}/delta/version={v}" for v in deltas if v > least]
        if live:
            out = spark.read.schema(stored).option("basePath", f"{self.path}/delta").parquet(*live).where(F.col("version") > base_of)
        if bases:
            used = [f"{self.path}/base/version={v}" for v in sorted(set(bases.values()))]
            read = spark.read.schema(stored).option("basePath", f"{self.path}/base").parquet(*used)
            out = out.unionByName(read.where(F.col("version") == base_of))
        return out.withColumnsRenamed({"version": VERSION, "bucket": BUCKET})

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """One row per key: that of the greatest version."""
        return self._newest(self._rows(spark, schema).drop(BUCKET)).select(*schema.fieldNames())

    # ------------------------------------------------------------ upkeep

    def compact(self, spark: SparkSession, schema: T.StructType, deltas: int = 8) -> list[int]:
        """Merge every bucket with at least ``deltas`` deltas since its base into a new base; returns those buckets."""
        versions, bases = self.state(spark)
        if not versions:
            return []
        waiting: dict[int, int] = {}
        for v in versions:
            for bucket in _numbers(spark, f"{self.path}/delta/version={v}", "bucket="):
                waiting[bucket] = waiting.get(bucket, 0) + (v > bases.get(bucket, -1))
        due = sorted(b for b, n in waiting.items() if n >= deltas)
        if due:
            rows = self._rows(spark, schema).where(F.col(BUCKET).isin(due)).drop(BUCKET)
            self._write(self._newest(rows).withColumn(BUCKET, self._bucket()), "base", max(versions))
        return due

    def vacuum(self, spark: SparkSession) -> list[int]:
        """Remove deltas of which every bucket is in a base already; returns their versions. No read may be under way."""
        versions, bases = self.state(spark)
        gone = [v for v in versions if all(bases.get(b, -1) >= v for b in _numbers(spark, f"{self.path}/delta/version={v}", "bucket="))]
        for v in gone:
            fs, place = _place(spark, f"{self.path}/delta/version={v}")
            fs.delete(place, True)
        return gone


def _literal_map(values: dict[int, int]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(b) for b in values]), F.array(*[F.lit(v).cast("long") for v in values.values()]))


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers behind ``prefix`` in the names of a folder's entries, sorted."""
    fs, place = _place(spark, folder)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit())
