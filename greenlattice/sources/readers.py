"""Readers by file kind. Schemas are given, never inferred by an extra pass over text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from greenlattice.functions.numeric import nan_to_null
from greenlattice.operators.spatial_join import valid_polygons
from greenlattice.operators.validate import validate_climate, validate_occurrence
from greenlattice.schemas import CLIMATE_SCHEMA, OCCURRENCE_SCHEMA

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
Reader = Callable[[SparkSession, str, T.StructType | None], DataFrame]


def _csv(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    reader = spark.read.option("header", True)
    if schema is None:
        raise ValueError("a csv file needs a schema")
    return reader.schema(schema).csv(path)


def _json(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def _parquet(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def _geojson(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    return read_geojson_polygons(spark, path, schema)


READERS: dict[str, Reader] = {".csv": _csv, ".json": _json, ".parquet": _parquet, ".geojson": _geojson}


def load_data_file(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a file or folder by its extension; missing values become NULL."""
    for ending, reader in READERS.items():
        if path.rstrip("/").lower().endswith(ending):
            return nan_to_null(reader(spark, path, schema))
    raise ValueError(f"unsupported file format: {path}")


def read_climate_csv(spark: SparkSession, path: str, schema: T.StructType = CLIMATE_SCHEMA) -> DataFrame:
    """Climate CSV through the full climate validation."""
    return validate_climate(load_data_file(spark, path, schema))


def read_occurrence_csv(spark: SparkSession, path: str, schema: T.StructType = OCCURRENCE_SCHEMA) -> DataFrame:
    return validate_occurrence(load_data_file(spark, path, schema))


def read_geojson_polygons(spark: SparkSession, path: str, properties: T.StructType | None = None,
                          lines: bool = True) -> DataFrame:
    """Polygon features to (ring, properties...): outer rings, closed, empty ones dropped.

    ``lines`` is one feature per line (splittable); otherwise whole FeatureCollection files.
    """
    properties = properties or T.StructType([T.StructField("landuse_type", T.StringType())])
    geometry = T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])
    feature = T.StructType([T.StructField("geometry", geometry), T.StructField("properties", properties)])
    if lines:
        features = spark.read.schema(feature).json(path)
    else:
        whole = T.StructType([T.StructField("features", T.ArrayType(feature))])
        features = spark.read.schema(whole).option("multiLine", True).json(path).select(
            F.explode("features").alias("f")).select("f.*")
    ring = F.transform(F.col("geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    shaped = features.where(F.col("geometry.type") == "Polygon").select(ring.alias("ring"), "properties.*")
    return valid_polygons(shaped)


def parse_rings(df: DataFrame, text: str, out: str = "ring") -> DataFrame:
    """``x y, x y, ...`` ring text (the inside of a polygon's WKT) to ARRAY<STRUCT<x, y>>."""
    pairs = F.transform(F.split(F.trim(F.col(text)), r"\s*,\s*"), lambda p: F.split(p, r"\s+"))
    return df.withColumn(out, F.transform(
        pairs, lambda xy: F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))))


def training_set(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored training table where it exists, else the one ``build`` plans, stored first."""
    try:
        return spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001 - only a missing table is built
        if "PATH_NOT_FOUND" not in str(error):
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)
