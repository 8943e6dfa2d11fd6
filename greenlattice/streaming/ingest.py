"""Incremental versions of the row-wise operators on Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from greenlattice.operators.models import Model
from greenlattice.operators.scoring import with_model_features
from greenlattice.session import shared_dir
from greenlattice.sources.keyed_log import KeyedLog


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType,
                 files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder whose name matches, as an unbounded table."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_to_table(stream: DataFrame, path: str | None = None, mode: str = "append",
                 checkpoint: str | None = None) -> tuple[DataFrame, str]:
    """Drain the available input into a parquet table and read it back."""
    spark = stream.sparkSession
    base = shared_dir(spark)
    path = path or f"{base}/stream-{uuid.uuid4().hex}"
    checkpoint = checkpoint or f"{base}/offsets-{uuid.uuid4().hex}"
    query: StreamingQuery = (stream.writeStream.format("parquet").outputMode(mode)
                             .option("path", path).option("checkpointLocation", checkpoint)
                             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), path


def run_complete(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Drain a running aggregate: each batch replaces the result table."""
    spark = stream.sparkSession
    base = shared_dir(spark)
    path = path or f"{base}/totals-{uuid.uuid4().hex}"

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = (stream.writeStream.outputMode("complete").foreachBatch(replace)
             .option("checkpointLocation", checkpoint or f"{base}/offsets-{uuid.uuid4().hex}")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    try:
        stored = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001 - no input at all made no batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], stream.schema)
    newest = stored.agg(F.max("epoch")).first()[0]
    return stored.where(F.col("epoch") == newest).drop("epoch")


def run_updates(stream: DataFrame, keys: list[str], path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Drain a windowed aggregate in update mode: state ends with the watermark, and a key's last update counts.

    Late rows behind the watermark are not counted, as in any bounded-state stream.
    """
    spark = stream.sparkSession
    base = shared_dir(spark)
    path = path or f"{base}/updates-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = (stream.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint or f"{base}/offsets-{uuid.uuid4().hex}")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    try:
        stored = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001 - no input at all made no batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], stream.schema)
    rest = [c for c in stream.columns if c not in keys]
    last = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in stream.columns])


def with_event_time(df: DataFrame, column: str, lateness: str) -> DataFrame:
    """Watermark on ``column`` as a zoned timestamp (a zone-less one cannot carry it)."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def daily_totals(df: DataFrame, time: str, keys: list[str], value: str, lateness: str = "1 day") -> DataFrame:
    """Tumbling one-day windows with a bound on late rows."""
    timed = with_event_time(df, time, lateness)
    grouped = timed.groupBy(F.window(time, "1 day").alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.to_date("w.start").alias("day"), *keys, "n", "total")


def monthly_means(df: DataFrame, time: str, keys: list[str], values: list[str]) -> DataFrame:
    """Month means as a running aggregate (months are no fixed-length window)."""
    return df.groupBy(*keys, F.trunc(F.to_date(time), "MM").alias("month")).agg(*[F.avg(v).alias(v) for v in values])


def closed_months(df: DataFrame, time: str, keys: list[str], values: list[str], open_months: int = 1) -> DataFrame:
    """Means of calendar months that have passed, for append mode: state holds open months only.

    Months are no fixed-length window, so the end of a row's month is the event time. A month
    closes, is given out once and leaves the state when a row of the month ``open_months`` + 1
    later has been seen in an earlier batch; rows of closed months are dropped as late.
    """
    if not 0 <= open_months <= 10:
        raise ValueError("open_months must be between 0 and 10")
    end = F.add_months(F.trunc(F.to_date(time), "MM"), 1).cast("timestamp")
    timed = df.withColumn("_end", end).withWatermark("_end", f"{31 * open_months + 1} days")
    means = timed.groupBy("_end", *keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])
    return means.select(*keys, F.add_months(F.to_date("_end"), -1).alias("month"), "n", *values)


def upsert_stream(stream: DataFrame, log: KeyedLog, checkpoint: str | None = None, first_version: int | None = None) -> StreamingQuery:
    """Drain a stream into a keyed log: each micro-batch is one version, a replayed one replaces itself.

    Without a checkpoint of its own the stream begins after the log's last version; a stream that
    goes on with its checkpoint has to name the first version it began with (0 by default).
    """
    spark = stream.sparkSession
    last = log.state(spark)[0][-1:]
    first = first_version if first_version is not None else last[0] + 1 if last and checkpoint is None else 0
    checkpoint = checkpoint or f"{shared_dir(spark)}/offsets-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        log.append(batch, first + epoch)

    query = (stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def deduplicate(df: DataFrame, keys: list[str], time: str, lateness: str = "1 day") -> DataFrame:
    """First row per key, with state kept only as long as late copies may arrive."""
    return with_event_time(df, time, lateness).dropDuplicatesWithinWatermark(keys)


def score_stream(points: DataFrame, features: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """Incoming points joined to a static feature grid and scored."""
    joined = points.join(features, keys, "left")
    return model.predict(with_model_features(joined, model.features))


def append_log(stream: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Append each batch under its own id, so a batch replayed after a failure replaces itself."""
    base = shared_dir(stream.sparkSession)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = (stream.writeStream.outputMode("append").foreachBatch(write)
             .option("checkpointLocation", checkpoint or f"{base}/offsets-{uuid.uuid4().hex}")
             .trigger(availableNow=True).start())
    query.awaitTermination()
