"""The working set: monthly climate with land use and biodiversity, keyed by lattice cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from greenlattice.functions.geo import lattice_index
from greenlattice.operators.climate import aggregate_monthly
from greenlattice.operators.species import species_metrics
from greenlattice.plans.registry import with_
from greenlattice.plans.spatial_queries import METRICS_BODY, SITE_PLACE_SQL, km
from greenlattice.plans.validation_queries import MONTHLY_SQL
from greenlattice.session import materialize
from greenlattice.sources import tables as t

LAND = ["forest_cover", "agricultural_area", "urban_area", "water_bodies", "elevation", "slope",
        "population_density", "road_density"]
SPECIES = ["species_count", "endemic_species", "threatened_species", "species_diversity", "threat_index"]
CLIMATE = ["temperature", "precipitation", "humidity", "wind_speed"]

COMBINED_CTES = [
    MONTHLY_SQL, t.LANDCELL_SQL, SITE_PLACE_SQL, t.OCCURRENCE_SQL,
    METRICS_BODY.format(p="place", km=km("place", "occurrence"), r="10e0"),
    "keyed AS (SELECT CAST(round((longitude-72e0)/1e-1) AS BIGINT) AS ix, CAST(round((latitude-15e0)/1e-1) AS BIGINT) AS iy, "
    + ", ".join(SPECIES) + " FROM metrics)",
    "combined AS (SELECT (CAST(year(obs_date) AS BIGINT)*12 + month(obs_date))*5600 + iy*80 + ix AS row_id, "
    "monthly.latitude AS latitude, monthly.longitude AS longitude, obs_date, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*CLIMATE, *LAND, *SPECIES])
    + " FROM monthly LEFT JOIN (SELECT ix, iy, " + ", ".join(LAND) + " FROM landcell) l USING (ix, iy) "
    "LEFT JOIN keyed USING (ix, iy))",
]
COMBINED_SQL = with_(*COMBINED_CTES)


def build_combined(spark: SparkSession, d: str, radius_km: float = 10.0) -> DataFrame:
    """Lazily planned: monthly climate, left-joined to land use and species metrics, gaps 0."""
    monthly = aggregate_monthly(t.climate_daily(spark, d), ["ix", "iy"])
    land = t.landuse_cells(spark, d).select("ix", "iy", *LAND)
    metrics = species_metrics(t.occurrence(spark, d), t.sites(spark, d), radius_km)
    keyed = metrics.select(lattice_index(F.col("longitude"), t.LON0, t.STEP).alias("ix"),
                           lattice_index(F.col("latitude"), t.LAT0, t.STEP).alias("iy"), *SPECIES)
    joined = monthly.join(land, ["ix", "iy"], "left").join(keyed, ["ix", "iy"], "left").fillna(0)
    return joined.select(
        ((F.year("obs_date").cast("bigint") * 12 + F.month("obs_date")) * 5600 + F.col("iy") * 80 + F.col("ix")).alias("row_id"),
        (F.lit(t.LAT0) + F.col("iy") * t.STEP).alias("latitude"), (F.lit(t.LON0) + F.col("ix") * t.STEP).alias("longitude"),
        "obs_date", *CLIMATE, *LAND, *SPECIES)


def combined(spark: SparkSession, d: str) -> DataFrame:
    """The working set, joined from the tables as they are and stored once for the passes of one query."""
    return materialize(build_combined(spark, d))
