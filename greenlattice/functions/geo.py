"""Coordinate predicates, distances and lattice keys as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from greenlattice.schemas import EARTH_RADIUS_KM


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """True only for a present latitude in [-90, 90] and longitude in [-180, 180]."""
    inside = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(inside, F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the arcsine argument is held at 1 for antipodal rounding."""
    half_dlat = F.radians(lat2 - lat1) / 2.0
    half_dlon = F.radians(lon2 - lon1) / 2.0
    sin_lat, sin_lon = F.sin(half_dlat), F.sin(half_dlon)
    chord = sin_lat * sin_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sin_lon * sin_lon
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.least(F.sqrt(chord), F.lit(1.0)))


def lattice_index(value: Column, origin: float, step: float) -> Column:
    """Integer lattice key of a coordinate that lies on (or next to) a lattice node."""
    return F.round((value - F.lit(origin)) / F.lit(step)).cast("bigint")


class SphereCells:
    """Latitude bands cut into longitude cells no narrower than a search radius.

    A band is at least one radius high. Within a band the cell width is the longest
    longitude span the radius can reach there, so two points within the radius always
    lie in bands that touch and, measured with the same band's cells, in cells that
    touch. Longitude cells wrap at the antimeridian; bands next to a pole are one cell.
    """

    def __init__(self, radius_km: float):
        if radius_km <= 0:
            raise ValueError("radius_km must be positive")
        self.angle = radius_km / EARTH_RADIUS_KM
        self.band_height = min(math.degrees(self.angle) * (1 + 1e-9), 180.0)

    def band(self, lat: Column) -> Column:
        return F.floor((lat + 90.0) / F.lit(self.band_height)).cast("bigint")

    def cells_in_band(self, band: Column) -> Column:
        low = F.abs((band - 1) * F.lit(self.band_height) - 90.0)
        high = F.abs((band + 2) * F.lit(self.band_height) - 90.0)
        widest = F.greatest(low, high)
        reach = F.lit(math.sin(min(self.angle, math.pi / 2))) / F.cos(F.radians(F.least(widest, F.lit(89.999999))))
        count = F.floor(F.lit(360.0) / (F.degrees(F.asin(F.least(reach, F.lit(1.0)))) * (1 + 1e-9)))
        return F.when((widest >= 89.999999) | (reach >= 1.0), F.lit(1)).otherwise(
            F.greatest(count, F.lit(1))).cast("bigint")

    def cell(self, lon: Column, band: Column) -> Column:
        cells = self.cells_in_band(band)
        return F.pmod(F.floor((lon + 180.0) / 360.0 * cells).cast("bigint"), cells)

    def neighbour_cells(self, lon: Column, band: Column) -> Column:
        """Array of the cells of ``band`` that may hold a point within the radius."""
        cells = self.cells_in_band(band)
        own = self.cell(lon, band)
        return F.array_distinct(F.array(
            F.pmod(own - 1 + cells, cells), own, F.pmod(own + 1, cells)))
