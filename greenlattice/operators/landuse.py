"""Land-cover pixels, codes and shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from greenlattice.schemas import LANDUSE_TYPES


def landuse_type(code: Column) -> Column:
    names = F.create_map(*[x for k, v in LANDUSE_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("unknown"))


def decode_raster(pixels: DataFrame, x0: float, y0: float, dx: float, dy: float, nodata: int | None = None,
                  bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Pixels (row, col, code) to places at pixel centres with the decoded type.

    (x0, y0) is the upper-left corner, dy is negative for rows running south.
    """
    placed = pixels.select(
        (F.lit(x0) + (F.col("col") + 0.5) * F.lit(dx)).alias("longitude"),
        (F.lit(y0) + (F.col("row") + 0.5) * F.lit(dy)).alias("latitude"),
        F.col("code").alias("landuse_code"), landuse_type(F.col("code")).alias("landuse_type"))
    if nodata is not None:
        placed = placed.where(F.col("landuse_code") != nodata)
    if bounds:
        placed = placed.where(F.col("longitude").between(bounds[0], bounds[2])
                              & F.col("latitude").between(bounds[1], bounds[3]))
    return placed


def normalise_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale shares down to a total of 1 where they add up to more."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    return df.withColumns({c: F.when(total > 1.0, F.col(c) / total).otherwise(F.col(c)) for c in columns})
