"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "greenlattice", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume.

    AQE is what sizes shuffle partitions, splits skewed join partitions and turns a
    shuffled join into a broadcast one once the real size of a side is known.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a single-process session (a test) that names none may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="greenlattice-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage_path(spark: SparkSession) -> str:
    """A new path below the application's own folder, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return f"{folder}/stage-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where several passes read the same joined result: the passes then scan pruned
    columns of a table instead of repeating the joins, and a lost executor only repeats
    scans.
    """
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
