"""Rasterising values of points and polygons onto a fixed grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from greenlattice.operators import ring_edges
from greenlattice.session import materialize

Bounds = tuple[float, float, float, float]


def rasterize(points: DataFrame, value: str, order_key: str, bounds: Bounds, resolution: float) -> DataFrame:
    """Long raster (row, col, value): rows count from the top, empty cells are 0.

    Where several points share a cell the one with the greatest ``order_key`` wins.
    Values are single precision.
    """
    width, height = raster_size(bounds, resolution)
    return _filled(_point_cells(points, value, order_key, bounds, resolution), points.sparkSession, width, height)


def rasterize_shapes(shapes: DataFrame, value: str, order_key: str, bounds: Bounds, resolution: float,
                     ring_column: str = "ring") -> DataFrame:
    """As ``rasterize`` for rows with a closed ring (cells whose centre is inside) or, where that is NULL, a point.

    Polygons are filled by scan lines: edges meet the centre lines of raster rows, sorted meeting
    points bound the spans. The shape with the greatest ``order_key`` wins a cell; most
    covered cells are reduced before the shuffle. Shapes without ring and place burn nothing.
    """
    min_lon, _, _, max_lat = bounds
    width, height = raster_size(bounds, resolution)
    keyed = materialize(shapes.withColumn("_shape", F.monotonically_increasing_id()))
    rings = keyed.where(F.size(ring_column) > 0)
    spans = ring_edges.burned_spans(rings.select("_shape", ring_column), ring_column, "_shape", min_lon, max_lat, resolution, width, height)
    filled = spans.join(rings.select("_shape", F.col(value).cast("float").alias("value"), F.col(order_key).alias("_order")), "_shape").select(
        "row", F.explode(F.sequence("_from", "_to")).alias("col"), "value", "_order")
    if {"longitude", "latitude"} <= set(shapes.columns):
        filled = filled.unionByName(_point_cells(keyed.where(F.col(ring_column).isNull()), value, order_key, bounds, resolution))
    return _filled(filled, shapes.sparkSession, width, height)


def raster_size(bounds: Bounds, resolution: float) -> tuple[int, int]:
    min_lon, min_lat, max_lon, max_lat = bounds
    return int((max_lon - min_lon) / resolution), int((max_lat - min_lat) / resolution)


def _point_cells(points: DataFrame, value: str, order_key: str, bounds: Bounds, resolution: float) -> DataFrame:
    min_lon, _, _, max_lat = bounds
    width, height = raster_size(bounds, resolution)
    step = F.lit(float(resolution))
    col = F.floor((F.col("longitude") - F.lit(min_lon)) / step).cast("int")
    row = F.floor((F.lit(max_lat) - F.col("latitude")) / step).cast("int")
    cells = points.select(row.alias("row"), col.alias("col"), F.col(value).cast("float").alias("value"), F.col(order_key).alias("_order"))
    return cells.where((F.col("row").between(0, height - 1)) & (F.col("col").between(0, width - 1)))


def _filled(burned: DataFrame, spark, width: int, height: int) -> DataFrame:
    """The whole raster with the last value of each burned cell."""
    last = burned.groupBy("row", "col").agg(F.max_by("value", "_order").alias("value"))
    cells = spark.range(width * height).select(
        F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return cells.join(last, ["row", "col"], "left").withColumn("value", F.coalesce(F.col("value"), F.lit(0.0).cast("float")))
