"""Regular longitude/latitude lattices and cells.

Bounds are always (min_lon, min_lat, max_lon, max_lat). Node values follow the usual
floating range rule: ``min + i * ((min + step) - min)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Bounds = tuple[float, float, float, float]


def node_count(low: float, high: float, step: float, inclusive: bool = True) -> int:
    """Nodes of a range from low to high; an inclusive range ends at high + step, open."""
    stop = high + step if inclusive else high
    return max(0, math.ceil((stop - low) / step))


def _node_count(low: Column, high: Column, step: Column, inclusive: bool) -> Column:
    stop = high + step if inclusive else high
    return F.greatest(F.ceil((stop - low) / step), F.lit(0)).cast("bigint")


def _node(low: Column, step: Column, index: Column) -> Column:
    return low + index * ((low + step) - low)


def create_grid(spark: SparkSession, bounds: Bounds, resolution: float, inclusive: bool = True) -> DataFrame:
    """All lattice nodes of one rectangle as (ix, iy, longitude, latitude)."""
    min_lon, min_lat, max_lon, max_lat = bounds
    nx = node_count(min_lon, max_lon, resolution, inclusive)
    ny = node_count(min_lat, max_lat, resolution, inclusive)
    step = F.lit(float(resolution))
    ids = spark.range(nx * ny)
    ix, iy = (F.col("id") % nx), F.floor(F.col("id") / nx).cast("bigint")
    return ids.select(ix.alias("ix"), iy.alias("iy"),
                      _node(F.lit(float(min_lon)), step, ix).alias("longitude"),
                      _node(F.lit(float(min_lat)), step, iy).alias("latitude"))


def expand_requests(requests: DataFrame, inclusive: bool = True) -> DataFrame:
    """All lattice nodes of every request row (min_lon, min_lat, max_lon, max_lat, resolution).

    Longitude and latitude indexes are exploded one after the other, so the rows of a very
    fine request are spread again before the second step.
    """
    res = F.col("resolution")
    counted = (requests
               .withColumn("_nx", _node_count(F.col("min_lon"), F.col("max_lon"), res, inclusive))
               .withColumn("_ny", _node_count(F.col("min_lat"), F.col("max_lat"), res, inclusive))
               .where((F.col("_nx") > 0) & (F.col("_ny") > 0)))
    by_row = counted.withColumn("iy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ny") - 1)))
    nodes = by_row.withColumn("ix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nx") - 1)))
    return nodes.select(*requests.columns, "ix", "iy",
                        _node(F.col("min_lon"), res, F.col("ix")).alias("longitude"),
                        _node(F.col("min_lat"), res, F.col("iy")).alias("latitude"))


def ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed box ring as ARRAY<STRUCT<x, y>>."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))


def create_cells(nodes: DataFrame) -> DataFrame:
    """Boxes between neighbouring nodes, named ``cell_{i}_{j}`` (i along longitude).

    ``nodes`` needs ix, iy, longitude, latitude and the columns resolution and max_lon /
    max_lat of its request; the last node of either axis starts no cell.
    """
    res = F.col("resolution")
    nx = _node_count(F.col("min_lon"), F.col("max_lon"), res, True)
    ny = _node_count(F.col("min_lat"), F.col("max_lat"), res, True)
    x1, y1 = F.col("longitude") + res, F.col("latitude") + res
    return nodes.where((F.col("ix") < nx - 1) & (F.col("iy") < ny - 1)).withColumns({
        "cell_id": F.concat(F.lit("cell_"), F.col("ix"), F.lit("_"), F.col("iy")),
        "x0": F.col("longitude"), "y0": F.col("latitude"), "x1": x1, "y1": y1,
        "ring": ring(F.col("longitude"), F.col("latitude"), x1, y1)})


def extent(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> Bounds | None:
    """Bounding rectangle of a point table, or None when it has no points."""
    row = df.agg(F.min(lon), F.min(lat), F.max(lon), F.max(lat)).first()
    return None if row[0] is None else tuple(float(v) for v in row)


def snap(value: Column, origin: float, step: float) -> Column:
    """Integer index of the cell [origin + i*step, origin + (i+1)*step) a value falls in."""
    return F.floor((value - F.lit(float(origin))) / F.lit(float(step))).cast("bigint")
