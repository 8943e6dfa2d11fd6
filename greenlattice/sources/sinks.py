"""Result tables, GeoJSON, listings and the append-only logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from greenlattice.operators.zones import zone_feature


def write_processed(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Write a processed table (parquet by default, or csv with a header / json)."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unsupported output format {fmt}")
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_results(spark: SparkSession, results: dict, path: str) -> None:
    """A nested result dict as one JSON document (numbers already plain)."""
    rows = [(json.dumps(results, default=float, sort_keys=True),)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


def write_geojson_zones(zones: DataFrame, path: str) -> None:
    """Zones (x0, y0, x1, y1, risk_level, risk_score) as one Feature per line."""
    feature = zone_feature(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"),
                           risk_level=F.col("risk_level"), risk_score=F.col("risk_score"))
    zones.select(feature.alias("value")).write.mode("overwrite").text(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, path, kind, size, modified) of files below a folder; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
             .load(path).select("path", "modificationTime", "length"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "path", F.element_at(F.split(name, r"\."), -1).alias("kind"),
                        F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def write_evaluation_report(comparison: DataFrame, best: DataFrame, path: str) -> None:
    """One JSON document: the best model with its metric and all comparison rows."""
    spark = comparison.sparkSession
    rows = [r.asDict() for r in comparison.collect()]  # one row per model
    top = best.first().asDict()
    write_results(spark, {"best": top, "models": rows, "n_models": len(rows)}, path)


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    """Saved models below a folder: name, kind, path, size (bytes of all files) and modified; of contents only the metadata is read."""
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").text(folder)
             .select("value", F.input_file_name().alias("file")).where(F.col("file").contains("/metadata/"))
             .where(F.get_json_object("value", "$.kind").isNotNull()))
    named = lines.select(F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.kind").alias("kind"),
                         F.regexp_extract("file", r"^[a-z]+:/*(/.*)/metadata/", 1).alias("path"))
    files = list_files(spark, folder).select(F.regexp_extract("path", r"^[a-z]+:/*(/.*?)/(pipeline|metadata)/", 1).alias("path"), "size", "modified")
    sizes = files.groupBy("path").agg(F.sum("size").alias("size"), F.max("modified").alias("modified"))
    return named.join(sizes, "path", "left").select("name", "kind", "path", "size", "modified")


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> dict[str, str]:
    """Result tables (comparison, importance, cross-validation, ...) by name below one folder; returns their paths."""
    return {name: write_processed(df, f"{folder}/{name}.{fmt}", fmt) for name, df in tables.items()}


def run_summary(spark: SparkSession, folder: str) -> dict:
    """Number, bytes and newest change of the files below a folder, by kind: what a run has left."""
    rows = list_files(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
                                                       F.max("modified").cast("string").alias("newest")).collect()  # a row per kind of file
    return {"files": sum(r["files"] for r in rows), "bytes": sum(r["bytes"] for r in rows),
            "kinds": {r["kind"]: {"files": r["files"], "bytes": r["bytes"], "newest": r["newest"]} for r in rows}}


def append_predictions(scored: DataFrame, path: str, model_version: str, features: list[str], created_at=None) -> None:
    """Append scored rows to the prediction log, partitioned by day."""
    stamp = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
    rows = scored.where(F.col("error").isNull()).select(
        "latitude", "longitude", F.col("risk_score").alias("predicted_risk"), F.col("confidence").alias("confidence_score"),
        F.lit(model_version).alias("model_version"), F.to_json(F.struct(*features)).alias("features"),
        stamp.alias("created_at")).withColumn("day", F.to_date("created_at"))
    rows.write.mode("append").partitionBy("day").parquet(path)


def rows_to_insert(fresh: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Fresh rows whose key is not stored yet; of fresh rows with one key the least."""
    return one_per_key(fresh, key).join(existing.select(key).distinct(), key, "left_anti").select(*fresh.columns)


def one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """The least row (by all columns, key first) of each key, combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    least = rows.groupBy(key).agg(F.min(F.struct(key, *rest)).alias("_row"))
    return least.select(*[F.col(f"_row.{c}").alias(c) for c in rows.columns])


def insert_if_absent(fresh: DataFrame, path: str, key: str) -> int:
    """Append one row for each unseen key to the parquet table at ``path``; returns how many.

    The source runs once: the rows are counted while they are written.
    """
    spark = fresh.sparkSession
    try:
        existing = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001 - only a missing table counts as empty
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = one_per_key(fresh, key)
    else:
        rows = rows_to_insert(fresh, existing, key)
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def upsert(fresh: DataFrame, path: str, key: str) -> str:
    """A new version of the table at ``path`` with the fresh row of each key that has one.

    Returns the folder of the version; ``path`` itself holds one folder per version, so a
    reader never sees a table that is being written.
    """
    spark = fresh.sparkSession
    fresh = one_per_key(fresh, key)
    version = latest_version(spark, path)
    if version is not None:
        old = spark.read.parquet(f"{path}/version={version}")
        fresh = old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh)
    target = f"{path}/version={0 if version is None else version + 1}"
    fresh.write.parquet(target)
    return target


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest committed version below ``path``; None if there is none."""
    try:
        found = list_files(spark, path, "part-*").select(
            F.regexp_extract("path", r"/version=(\d+)/", 1).cast("int").alias("v")).agg(F.max("v")).first()[0]
    except Exception as error:  # noqa: BLE001 - only a missing table counts as empty
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return found


def append_feedback(feedback: DataFrame, path: str) -> None:
    feedback.write.mode("append").parquet(path)
