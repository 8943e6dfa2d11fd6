"""The ecological working tables as views over the given parquet tables.

Every table is a projection of whole source tables (no row is left out), so scans prune to
the columns a query uses. ``*_SQL`` is the same definition as a common table expression
for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The study lattice (degrees) that table keys are spread over.
LON0, LAT0, STEP, NX, NY = 72.0, 15.0, 0.1, 80, 70

def _cte(name: str, columns: list[str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(columns)} FROM {source})"


CLIMATE_COLUMNS = [
    "l_orderkey",
    "l_linenumber",
    "CAST(((l_suppkey*1499)%5600)%80 AS BIGINT) AS ix",
    "CAST(floor(((l_suppkey*1499)%5600)/80e0) AS BIGINT) AS iy",
    "15e0 + CAST(floor(((l_suppkey*1499)%5600)/80e0) AS DOUBLE)*1e-1 AS latitude",
    "72e0 + CAST(((l_suppkey*1499)%5600)%80 AS DOUBLE)*1e-1 AS longitude",
    "CAST(l_shipdate AS DATE) AS obs_date",
    "10e0 + l_quantity*6e-1 AS temperature",
    "l_extendedprice/1e4 - 5e-1 AS precipitation",
    "CASE WHEN l_orderkey%50=0 THEN NULL ELSE 30e0 + l_quantity*15e-1 + l_tax*1e2 END AS humidity",
    "l_discount*150e0 - 1e0 AS wind_speed",
]
CLIMATE_SQL = _cte("climate", CLIMATE_COLUMNS, "lineitem")

LANDUSE_COLUMNS = [
    "p_partkey AS land_id",
    "p_type AS cover_name",
    "CAST(((p_partkey*1499)%5600)%80 AS BIGINT) AS ix",
    "CAST(floor(((p_partkey*1499)%5600)/80e0) AS BIGINT) AS iy",
    "15e0 + CAST(floor(((p_partkey*1499)%5600)/80e0) AS DOUBLE)*1e-1 AS latitude",
    "72e0 + CAST(((p_partkey*1499)%5600)%80 AS DOUBLE)*1e-1 AS longitude",
    "CAST(1+p_partkey%6 AS INT) AS landuse_code",
    "((p_partkey*31)%60)/1e2 AS forest_cover",
    "((p_partkey*17)%25)/1e2 AS agricultural_area",
    "(p_size%12)/1e2 AS urban_area",
    "((p_partkey*7)%4)/1e2 AS water_bodies",
    "p_retailprice - 5e2 AS elevation",
    "CAST(p_size AS DOUBLE) AS slope",
    "(p_partkey*13)%997*1e0 AS population_density",
    "((p_partkey*11)%83)/1e1 AS road_density",
]
LANDUSE_SQL = _cte("landuse", LANDUSE_COLUMNS, "part")

# One row per cell: shares averaged, the lowest land-use code kept as the primary one.
LANDCELL_SQL = LANDUSE_SQL + """, landcell AS (SELECT ix, iy,
  min(latitude) AS latitude, min(longitude) AS longitude, min(landuse_code) AS landuse_code,
  avg(forest_cover) AS forest_cover, avg(agricultural_area) AS agricultural_area,
  avg(urban_area) AS urban_area, avg(water_bodies) AS water_bodies,
  avg(elevation) AS elevation, avg(slope) AS slope,
  avg(population_density) AS population_density, avg(road_density) AS road_density
FROM landuse GROUP BY ix, iy)"""

OCCURRENCE_COLUMNS = [
    "event_id AS occ_id",
    "ts AS observed_at",
    "concat('Species ', CAST((event_id*37+user_id)%60 AS VARCHAR(10))) AS species_name",
    "15e0 + CAST((event_id*7919)%7000 AS DOUBLE)/1e3 AS latitude",
    "72e0 + CAST((event_id*6151+user_id*13)%8000 AS DOUBLE)/1e3 AS longitude",
    "CASE WHEN event_id%100<40 THEN 'LC' WHEN event_id%100<60 THEN 'NT' WHEN event_id%100<75 THEN 'VU' WHEN event_id%100<85 THEN 'EN' WHEN event_id%100<93 THEN 'CR' WHEN event_id%100<98 THEN 'EW' ELSE 'EX' END AS conservation_status",
    "((event_id*37+user_id)%60)%10=0 AS is_endemic",
    "event_type AS basis_of_record",
]
OCCURRENCE_SQL = _cte("occurrence", OCCURRENCE_COLUMNS, "events")

BOUNDARY_COLUMNS = [
    "CAST(n_nationkey AS BIGINT) AS region_id",
    "n_name AS region",
    "72e0+(n_nationkey%5)*16e-1 AS x0",
    "15e0+CAST(floor(n_nationkey/5e0) AS DOUBLE)*14e-1 AS y0",
    "72e0+(n_nationkey%5)*16e-1+16e-1 AS x1",
    "15e0+CAST(floor(n_nationkey/5e0) AS DOUBLE)*14e-1+14e-1 AS y1",
]
BOUNDARY_SQL = _cte("boundary", BOUNDARY_COLUMNS, "nation")

SITE_COLUMNS = [
    "s_suppkey AS site_id",
    "15e0 + CAST(floor(((s_suppkey*1499)%5600)/80e0) AS DOUBLE)*1e-1 AS latitude",
    "72e0 + CAST(((s_suppkey*1499)%5600)%80 AS DOUBLE)*1e-1 AS longitude",
]
SITE_SQL = _cte("site", SITE_COLUMNS, "supplier")

# Rectangular requests (bounds and lattice step), one per supplier.
REQUEST_COLUMNS = [
    "s_suppkey AS request_id",
    "72e0 + CAST((s_suppkey*37)%60 AS DOUBLE)*1e-1 AS min_lon",
    "15e0 + CAST((s_suppkey*23)%50 AS DOUBLE)*1e-1 AS min_lat",
    "72e0 + CAST((s_suppkey*37)%60 AS DOUBLE)*1e-1 + CAST(1+s_suppkey%4 AS DOUBLE)*25e-2 AS max_lon",
    "15e0 + CAST((s_suppkey*23)%50 AS DOUBLE)*1e-1 + CAST(1+s_suppkey%3 AS DOUBLE)*25e-2 AS max_lat",
    "125e-3 AS resolution",
]
REQUEST_SQL = _cte("request", REQUEST_COLUMNS, "supplier")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _view(spark: SparkSession, folder: str, source: str, columns: list[str]) -> DataFrame:
    return table(spark, folder, source).selectExpr(*columns)


def climate_daily(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "lineitem", CLIMATE_COLUMNS)


def landuse(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "part", LANDUSE_COLUMNS)


def landuse_cells(spark: SparkSession, folder: str) -> DataFrame:
    shares = ["forest_cover", "agricultural_area", "urban_area", "water_bodies",
              "elevation", "slope", "population_density", "road_density"]
    return landuse(spark, folder).groupBy("ix", "iy").agg(
        F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"),
        F.min("landuse_code").alias("landuse_code"), *[F.avg(c).alias(c) for c in shares])


def occurrence(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "events", OCCURRENCE_COLUMNS)


def boundary(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "nation", BOUNDARY_COLUMNS)


def sites(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "supplier", SITE_COLUMNS)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "supplier", REQUEST_COLUMNS)
