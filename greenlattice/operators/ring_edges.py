"""Polygons as rows of edges: point tests by crossing parity, scan lines, and exact disc areas.

A ring of very many corners does not fit beside every point or cell it is compared with. Here its
edges are rows; a point meets those of its own latitude band only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

EDGES_PER_BAND = 8
BAND_FACTOR = 4.0


def edge_array(ring: Column) -> Column:
    """The edges of a closed ring ARRAY<STRUCT<x, y>> as ARRAY<STRUCT<ax, ay, bx, by>>."""
    return F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))),
                      lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def sloped_edges(shapes: DataFrame, ring_column: str, *kept: str | Column) -> DataFrame:
    """One row per edge that is not horizontal (those cross no line of equal latitude), with the columns ``kept``."""
    rows = shapes.select(*kept, F.explode(edge_array(F.col(ring_column))).alias("_e"))
    return rows.select("*", *[F.col(f"_e.{c}").alias(f"_{c}") for c in ("ax", "ay", "bx", "by")]).drop("_e").where("_ay <> _by")


def crossing(y: Column) -> Column:
    """Where the edge of this row meets latitude ``y``; NULL unless it spans it (lower end included)."""
    ax, ay, bx, by = (F.col(f"_{c}") for c in ("ax", "ay", "bx", "by"))
    return F.when((ay <= y) != (by <= y), ax + F.try_divide((y - ay) * (bx - ax), by - ay))


def _band(y: str | Column, height: Column) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    return F.floor(F.try_divide(y - F.col("_y0"), height)).cast("bigint")


def _height(level: Column) -> Column:
    return F.col("_h") * F.pow(F.lit(BAND_FACTOR), level)


def band_height(ring_column: str) -> Column:
    """Height of a ring's lowest bands, so that its edges spread evenly over about a band per ``EDGES_PER_BAND``; the row has its box."""
    edges = F.size(ring_column) - 1
    return (F.col("_y1") - F.col("_y0")) / F.greatest(F.ceil(edges / EDGES_PER_BAND), F.lit(1))


def banded_edges(shapes: DataFrame, key: str, ring_column: str) -> DataFrame:
    """(key, _level, _band, edge): every edge in the latitude bands it spans.

    ``shapes`` carry the box's ``_y0`` and the band height ``_h``. Bands of level n are
    4**n times as high, and an edge uses the first level on which it spans five at most.
    """
    edges = sloped_edges(shapes, ring_column, key, "_y0", "_h")
    tall = F.abs(F.col("_by") - F.col("_ay"))
    level = F.ceil(F.log(BAND_FACTOR, F.greatest(F.try_divide(tall, F.col("_h") * BAND_FACTOR), F.lit(1.0)))).cast("int")
    leveled = edges.withColumn("_level", level)
    height = _height(F.col("_level"))
    low, high = _band(F.least("_ay", "_by"), height), _band(F.greatest("_ay", "_by"), height)
    return leveled.withColumn("_band", F.explode(F.sequence(low, high))).select(key, "_level", "_band", "_ax", "_ay", "_bx", "_by")


def looking(pairs: DataFrame, levels: DataFrame, key: str) -> DataFrame:
    """Candidate pairs (``_pair``, key, ``_x``, ``_y``, ``_y0``, ``_h``) once per level of their ring, with the band they fall into."""
    return (pairs.join(levels, key).withColumn("_level", F.explode("_levels"))
            .withColumn("_band", _band("_y", _height(F.col("_level")))).drop("_levels", "_y0", "_h"))


def odd_crossings(met: DataFrame) -> DataFrame:
    """``_pair`` of the pairs whose point has an odd number of edges to its right."""
    right = F.col("_x") < crossing(F.col("_y"))
    return met.where(right).groupBy("_pair").agg((F.count(F.lit(1)) % 2).alias("_odd")).where("_odd = 1").select("_pair")


# ---------------------------------------------------------------- scan lines

def burned_spans(shapes: DataFrame, ring_column: str, key: str, min_lon: float, max_lat: float, resolution: float,
                 width: int, height: int) -> DataFrame:
    """(key, row, _from, _to): the raster columns of each row whose centres lie inside a shape.

    Edges are met with the centre lines of the rows they span; the sorted meeting points of a shape
    and a row bound its spans pairwise. A centre on a left or lower border is inside.
    """
    step, top, left = (F.lit(float(v)) for v in (resolution, max_lat, min_lon))
    edges = sloped_edges(shapes, ring_column, key)

    def line(y: Column) -> Column:
        return (top - y) / step - 0.5

    first = F.greatest(F.floor(line(F.greatest("_ay", "_by"))) - 1, F.lit(0))
    last = F.least(F.ceil(line(F.least("_ay", "_by"))) + 1, F.lit(height - 1))
    rows = edges.where(first <= last).withColumn("row", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    met = rows.withColumn("_at", crossing(top - (F.col("row") + 0.5) * step)).where("_at is not null")
    lines = met.groupBy(key, "row").agg(F.sort_array(F.collect_list("_at")).alias("_ats"))
    at = F.col("_ats")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(at) / 2).cast("int") - 1), lambda i: F.struct(at[i * 2].alias("x0"), at[i * 2 + 1].alias("x1")))
    spans = lines.select(key, "row", F.explode(pairs).alias("_s"))

    def first_centre(x: Column) -> Column:
        """The first column whose centre is at ``x`` or right of it."""
        guess = F.ceil((x - left) / step - 0.5).cast("int")
        centre = lambda c: left + (c + 0.5) * step
        return F.when(centre(guess - 1) >= x, guess - 1).when(centre(guess) < x, guess + 1).otherwise(guess)

    begin = F.greatest(first_centre(F.col("_s.x0")), F.lit(0))
    end = F.least(first_centre(F.col("_s.x1")) - 1, F.lit(width - 1))
    return spans.select(key, "row", begin.alias("_from"), end.alias("_to")).where("_from <= _to")


# ---------------------------------------------------------------- discs

def disc_overlap(ring: Column, x: Column, y: Column, radius: float) -> Column:
    """Area that a simple closed ring shares with the disc of ``radius`` about (x, y), in closed form.

    Each edge adds the signed area between itself and the centre: a triangle where it runs
    inside of the circle, a sector where it runs outside. All edges of a batch are worked on at once.
    A missing coordinate makes the area NULL.
    """
    return F.arrow_udf(_disc_overlaps(float(radius) ** 2), "double")(ring, x, y)


def _disc_overlaps(square: float):
    def run(ring: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(ring), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        corners, ends = ring.flatten(), np.cumsum(sizes)
        begins = np.ones(len(corners), bool)  # corners that an edge begins at: all but the last of a ring
        begins[ends[sizes > 0] - 1] = False
        at = np.flatnonzero(begins)
        own = np.repeat(np.arange(len(sizes)), sizes)[at]

        def numbers(values: pa.Array) -> np.ndarray:
            return pc.cast(values, pa.float64()).to_numpy(zero_copy_only=False)

        px, py = (numbers(pc.struct_field(corners, n)) for n in ("x", "y"))
        cx, cy = numbers(x)[own], numbers(y)[own]
        dx, dy = px[at + 1] - px[at], py[at + 1] - py[at]
        qx, qy = px[at + 1] - cx, py[at + 1] - cy
        px, py = px[at] - cx, py[at] - cy
        a, b, c = dx * dx + dy * dy, px * dx + py * dy, px * px + py * py - square
        root = np.sqrt(np.maximum(b * b - a * c, 0.0))
        # Shares of the edge at which it enters and leaves the circle; equal if it stays outside.
        s, t = (np.clip(np.divide(v, a, out=np.zeros_like(a), where=a != 0), 0.0, 1.0) for v in (-b - root, -b + root))
        sx, sy, tx, ty = px + dx * s, py + dy * s, px + dx * t, py + dy * t

        def sector(mx: np.ndarray, my: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
            return square * np.arctan2(mx * ny - my * nx, mx * nx + my * ny)

        area = sector(px, py, sx, sy) + (sx * ty - sy * tx) + sector(tx, ty, qx, qy)
        total = np.abs(np.bincount(own, weights=area, minlength=len(sizes))) / 2.0
        lacking = np.isnan(total) | pc.is_null(ring).to_numpy(zero_copy_only=False)
        return pa.array(total, pa.float64(), mask=lacking)
    return run


def disc_area(radius: float) -> float:
    return math.pi * radius * radius
