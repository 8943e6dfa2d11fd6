"""Risk zones and heatmaps over lattices, and their GeoJSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from greenlattice.functions.risk import radial_decay, risk_category
from greenlattice.operators.grid import expand_requests


def closed_form_zones(requests: DataFrame, low: float = 0.33, high: float = 0.66) -> DataFrame:
    """Cells of every request scored at their centre by distance from the request's centre."""
    nodes = expand_requests(requests, inclusive=False)
    res = F.col("resolution")
    score = radial_decay(F.col("latitude") + res / 2.0, F.col("longitude") + res / 2.0,
                         (F.col("min_lat") + F.col("max_lat")) / 2.0, (F.col("min_lon") + F.col("max_lon")) / 2.0)
    return nodes.withColumns({
        "x0": F.col("longitude"), "y0": F.col("latitude"),
        "x1": F.col("longitude") + res, "y1": F.col("latitude") + res, "risk_score": score,
    }).withColumn("risk_level", risk_category(F.col("risk_score"), low, high))


def centred_zones(scored: DataFrame, resolution: float, score: str = "risk_score") -> DataFrame:
    """Squares of side ``resolution`` centred on scored points, low to high."""
    half = F.lit(resolution / 2.0)
    return (scored.withColumns({
        "x0": F.col("longitude") - half, "y0": F.col("latitude") - half,
        "x1": F.col("longitude") + half, "y1": F.col("latitude") + half})
        .withColumn("risk_level", risk_category(F.col(score)))
        .where(F.col("risk_level").isNotNull()))


def zone_feature(x0: Column, y0: Column, x1: Column, y1: Column, **properties: Column) -> Column:
    """One GeoJSON Feature per zone as a JSON string."""
    point = lambda x, y: F.array(x, y)
    ring = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties")))


def point_feature(lon: Column, lat: Column, **properties: Column) -> Column:
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties")))
