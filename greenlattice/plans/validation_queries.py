"""Validation, filtering and cleaning over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from greenlattice.functions.geo import valid_coordinates
from greenlattice.functions.numeric import nan_to_null, tidy
from greenlattice.operators import clean, spatial_join, validate
from greenlattice.operators.impute import impute_nearest_rows
from greenlattice.operators.quantiles import exact_quantiles
from greenlattice.plans.registry import R, RA, query, with_
from greenlattice.schemas import CLIMATE_VARIABLES
from greenlattice.sources import tables as t

SHIFTED = "CASE WHEN occ_id % 97 = 0 THEN latitude + 200e0 WHEN occ_id % 89 = 0 THEN NULL ELSE latitude END"
SHIFTED_SQL = t.OCCURRENCE_SQL + f""", shifted AS (SELECT occ_id, {SHIFTED} AS latitude, longitude,
  CASE WHEN occ_id % 41 = 0 THEN '   ' WHEN occ_id % 43 = 0 THEN NULL
       ELSE concat(' ', species_name, '  ') END AS species_name,
  CASE WHEN occ_id % 31 = 0 THEN 'XX' WHEN occ_id % 37 = 0 THEN NULL ELSE conservation_status END AS conservation_status,
  is_endemic, basis_of_record FROM occurrence)"""


def shifted(spark, d):
    """Occurrences with out-of-range and missing latitudes, blank names and unknown statuses."""
    return t.occurrence(spark, d).selectExpr(
        "occ_id", f"{SHIFTED} AS latitude", "longitude",
        "CASE WHEN occ_id % 41 = 0 THEN '   ' WHEN occ_id % 43 = 0 THEN NULL "
        "ELSE concat(' ', species_name, '  ') END AS species_name",
        "CASE WHEN occ_id % 31 = 0 THEN 'XX' WHEN occ_id % 37 = 0 THEN NULL "
        "ELSE conservation_status END AS conservation_status", "is_endemic", "basis_of_record")


VALID_SQL = "coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false)"


@query("coordinate_validity", with_(SHIFTED_SQL) + f"""
SELECT basis_of_record, CAST(count(*) AS BIGINT) AS records,
  CAST(sum(CASE WHEN {VALID_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS valid_records
FROM shifted GROUP BY basis_of_record""")
def coordinate_validity(spark, d):
    ok = valid_coordinates(F.col("latitude"), F.col("longitude"))
    return shifted(spark, d).groupBy("basis_of_record").agg(
        F.count(F.lit(1)).alias("records"), F.sum(ok.cast("bigint")).alias("valid_records"))


@query("coordinate_filter", with_(SHIFTED_SQL) + f"SELECT occ_id, {RA('latitude', 'longitude')} FROM shifted WHERE {VALID_SQL}")
def coordinate_filter(spark, d):
    return tidy(validate.drop_invalid_coordinates(shifted(spark, d)).select("occ_id", "latitude", "longitude"))


BAD_REQUEST_SQL = t.REQUEST_SQL + """, asked AS (SELECT request_id, min_lon,
  CASE WHEN request_id % 7 = 0 THEN max_lat + 1e0 ELSE min_lat END AS min_lat,
  CASE WHEN request_id % 11 = 0 THEN NULL WHEN request_id % 13 = 0 THEN 200e0 ELSE max_lon END AS max_lon,
  max_lat, CASE WHEN request_id % 5 = 0 THEN 2e0 ELSE resolution END AS resolution FROM request)"""


@query("request_bounds_check", with_(BAD_REQUEST_SQL) + """
SELECT request_id, CASE
  WHEN min_lon IS NULL OR min_lat IS NULL OR max_lon IS NULL OR max_lat IS NULL THEN 'bounds need four values'
  WHEN NOT (min_lat BETWEEN -90 AND 90 AND max_lat BETWEEN -90 AND 90) THEN 'latitude out of range'
  WHEN NOT (min_lon BETWEEN -180 AND 180 AND max_lon BETWEEN -180 AND 180) THEN 'longitude out of range'
  WHEN min_lat >= max_lat THEN 'min_lat must be below max_lat'
  WHEN min_lon >= max_lon THEN 'min_lon must be below max_lon'
  WHEN NOT (resolution > 0 AND resolution <= 1) THEN 'resolution out of range' END AS error
FROM asked""")
def request_bounds_check(spark, d):
    asked = t.requests(spark, d).selectExpr(
        "request_id", "min_lon", "CASE WHEN request_id % 7 = 0 THEN max_lat + 1e0 ELSE min_lat END AS min_lat",
        "CASE WHEN request_id % 11 = 0 THEN NULL WHEN request_id % 13 = 0 THEN 200e0 ELSE max_lon END AS max_lon",
        "max_lat", "CASE WHEN request_id % 5 = 0 THEN 2e0 ELSE resolution END AS resolution")
    error = validate.bounds_error(*[F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat", "resolution")])
    return asked.select("request_id", error.alias("error"))


RULES_SQL = t.CLIMATE_SQL + f""", ruled AS (SELECT l_orderkey, l_linenumber, latitude, longitude, obs_date, temperature,
  greatest(precipitation, 0e0) AS precipitation,
  CASE WHEN humidity IS NOT NULL THEN least(greatest(humidity, 0e0), 1e2) END AS humidity,
  greatest(wind_speed, 0e0) AS wind_speed FROM climate WHERE {VALID_SQL})"""


def sequential(source: str, columns: list[str], bounds: str, keep: str) -> str:
    """CTE chain: bounds of one column on the rows the earlier columns left."""
    parts, previous = [], source
    for i, c in enumerate(columns):
        parts.append(f"b{i} AS (SELECT {bounds.format(c=c)} FROM {previous}), "
                     f"s{i} AS (SELECT {previous}.* FROM {previous}, b{i} WHERE {keep.format(c=c)})")
        previous = f"s{i}"
    return ", ".join(parts)


TRIM_BOUNDS = "quantile_cont({c}, 1e-2) AS lo, quantile_cont({c}, 99e-2) AS hi"
IQR_BOUNDS = ("quantile_cont({c}, 25e-2) - 15e-1*(quantile_cont({c}, 75e-2)-quantile_cont({c}, 25e-2)) AS lo, "
              "quantile_cont({c}, 75e-2) + 15e-1*(quantile_cont({c}, 75e-2)-quantile_cont({c}, 25e-2)) AS hi")
BETWEEN = "{c} >= lo AND {c} <= hi"
CLIMATE_OUT = "l_orderkey, l_linenumber, " + RA(*CLIMATE_VARIABLES)


@query("climate_row_rules", with_(RULES_SQL) + f"SELECT {CLIMATE_OUT} FROM ruled")
def climate_row_rules(spark, d):
    return tidy(validate.climate_row_rules(t.climate_daily(spark, d)).select(
        "l_orderkey", "l_linenumber", *CLIMATE_VARIABLES))


@query("climate_validated", with_(RULES_SQL, sequential("ruled", CLIMATE_VARIABLES, TRIM_BOUNDS, BETWEEN))
       + f"SELECT {CLIMATE_OUT} FROM s3")
def climate_validated(spark, d):
    return tidy(validate.validate_climate(t.climate_daily(spark, d)).select(
        "l_orderkey", "l_linenumber", *CLIMATE_VARIABLES))


@query("occurrence_validated", with_(SHIFTED_SQL) + f"""
SELECT occ_id, trim(species_name) AS species_name, {RA('latitude', 'longitude')},
  CASE WHEN conservation_status IN ('LC','NT','VU','EN','CR','EW','EX') THEN conservation_status ELSE 'LC' END
    AS conservation_status, is_endemic
FROM shifted WHERE {VALID_SQL} AND length(trim(species_name)) > 0""")
def occurrence_validated(spark, d):
    return tidy(validate.validate_occurrence(shifted(spark, d), "2024-01-01").select(
        "occ_id", "species_name", "latitude", "longitude", "conservation_status", "is_endemic"))


POLYGON_SQL = """shape AS (SELECT c_custkey, 72e0 + CAST((c_custkey*97)%7000 AS DOUBLE)/1e3 AS x,
  15e0 + CAST((c_custkey*61)%6000 AS DOUBLE)/1e3 AS y, CAST(1+c_custkey%5 AS DOUBLE)*5e-2 AS w,
  CAST(c_custkey%4 AS DOUBLE)*5e-2 AS h FROM customer)"""


def raw_polygons(spark, d):
    """Quadrilaterals with an open ring; those of height 0 have no area."""
    shape = t.table(spark, d, "customer").selectExpr(
        "c_custkey", "72e0 + CAST((c_custkey*97)%7000 AS DOUBLE)/1e3 AS x",
        "15e0 + CAST((c_custkey*61)%6000 AS DOUBLE)/1e3 AS y", "CAST(1+c_custkey%5 AS DOUBLE)*5e-2 AS w",
        "CAST(c_custkey%4 AS DOUBLE)*5e-2 AS h")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    return shape.select("c_custkey", F.array(
        corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x + w * 0.5, y + h)).alias("ring"))


@query("polygon_validation", with_(POLYGON_SQL) + f"""
SELECT c_custkey, CAST(5 AS BIGINT) AS ring_size, {R('h*w*75e-2')} AS area FROM shape WHERE h > 0""")
def polygon_validation(spark, d):
    ok = spatial_join.valid_polygons(raw_polygons(spark, d))
    return tidy(ok.select("c_custkey", F.size("ring").cast("bigint").alias("ring_size"),
                          spatial_join.ring_area(F.col("ring")).alias("area")))


DOUBLED_SQL = t.CLIMATE_SQL + """, doubled AS (SELECT latitude, longitude, obs_date, temperature, humidity FROM climate
  UNION ALL SELECT latitude, longitude, obs_date, temperature, humidity FROM climate)"""


def doubled(spark, d):
    one = t.climate_daily(spark, d).select("latitude", "longitude", "obs_date", "temperature", "humidity")
    return one.unionByName(one)


@query("row_concatenation", with_(DOUBLED_SQL) + f"""
SELECT latitude AS lat_key, CAST(count(*) AS BIGINT) AS n, {R('avg(temperature)')} AS temperature
FROM doubled GROUP BY latitude""")
def row_concatenation(spark, d):
    return doubled(spark, d).groupBy(F.col("latitude").alias("lat_key")).agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("temperature")).alias("temperature"))


def _r(col):
    from greenlattice.functions.numeric import rounded
    return rounded(col)


@query("data_quality_summary", with_(DOUBLED_SQL) + """
SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(5 AS BIGINT) AS total_columns,
  CAST(sum(CASE WHEN humidity IS NULL THEN n ELSE 0 END) AS BIGINT) AS missing_values,
  CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, 'observer' AS missing_columns, false AS is_valid
FROM (SELECT latitude, longitude, obs_date, temperature, humidity, count(*) AS n FROM doubled GROUP BY ALL)""")
def data_quality_summary(spark, d):
    return validate.quality_summary(doubled(spark, d), ["latitude", "longitude", "observer"])


@query("data_quality_report", with_(SHIFTED_SQL) + f"""
, n AS (SELECT count(*) AS total FROM shifted)
SELECT column_name, data_type, CAST(missing AS BIGINT) AS missing_count,
  round(missing * 1e2 / total, 2) AS missing_pct, CAST(total AS BIGINT) AS total_rows
FROM n, (SELECT 'latitude' AS column_name, 'double' AS data_type, count(*) - count(latitude) AS missing FROM shifted
  UNION ALL SELECT 'longitude', 'double', count(*) - count(longitude) FROM shifted
  UNION ALL SELECT 'species_name', 'string', count(*) - count(species_name) FROM shifted
  UNION ALL SELECT 'conservation_status', 'string', count(*) - count(conservation_status) FROM shifted)""")
def data_quality_report(spark, d):
    return validate.quality_report(shifted(spark, d).select(
        "latitude", "longitude", "species_name", "conservation_status"))


@query("duplicates_and_bad_places", with_(SHIFTED_SQL) + f"""
, cells AS (SELECT round(longitude, 1) AS x, conservation_status, count(*) AS n,
  sum(CASE WHEN {VALID_SQL} THEN 0 ELSE 1 END) AS bad FROM shifted GROUP BY ALL)
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(sum(bad) AS BIGINT) AS coordinate_issues FROM cells""")
def duplicates_and_bad_places(spark, d):
    bad = (~valid_coordinates(F.col("latitude"), F.col("longitude"))).cast("bigint")
    cells = shifted(spark, d).groupBy(F.round("longitude", 1).alias("x"), "conservation_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(bad).alias("bad"))
    return cells.agg(F.sum(F.col("n") - 1).alias("duplicate_rows"), F.sum("bad").alias("coordinate_issues"))


@query("completeness_report", with_(t.CLIMATE_SQL) + f"""
SELECT CAST(count(*) AS BIGINT) AS rows, {R('(count(latitude)+count(longitude)+count(temperature)+count(humidity))*1e2/(count(*)*4)')} AS completeness_pct,
  CAST(sum(CASE WHEN {VALID_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS valid_coordinates,
  CAST(sum(CASE WHEN temperature BETWEEN -50 AND 60 THEN 1 ELSE 0 END) AS BIGINT) AS temperature_in_range,
  CAST(sum(CASE WHEN humidity BETWEEN 0 AND 100 THEN 1 ELSE 0 END) AS BIGINT) AS humidity_in_range
FROM climate""")
def completeness_report(spark, d):
    table = t.climate_daily(spark, d).select("latitude", "longitude", "temperature", "humidity")
    return tidy(validate.completeness(table, {"temperature": (-50.0, 60.0), "humidity": (0.0, 100.0)}))


@query("first_row_per_place", with_(t.CLIMATE_SQL) + f"""
, once AS (SELECT DISTINCT l_orderkey, l_linenumber, latitude, longitude, temperature FROM climate),
numbered AS (SELECT *, row_number() OVER (PARTITION BY latitude, longitude
  ORDER BY l_orderkey, l_linenumber, temperature) AS i FROM once)
SELECT l_orderkey, l_linenumber, {RA('latitude', 'longitude', 'temperature')} FROM numbered WHERE i = 1""")
def first_row_per_place(spark, d):
    table = t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", "latitude", "longitude", "temperature")
    return tidy(clean.remove_duplicates(table.unionByName(table), order=["l_orderkey", "l_linenumber"]))


@query("drop_missing_target", with_(t.CLIMATE_SQL) + f"""
SELECT latitude AS lat_key, longitude AS lon_key, CAST(count(*) AS BIGINT) AS n, {R('avg(humidity)')} AS humidity
FROM climate WHERE humidity IS NOT NULL GROUP BY latitude, longitude""")
def drop_missing_target(spark, d):
    return t.climate_daily(spark, d).dropna(subset=["humidity"]).groupBy(
        F.col("latitude").alias("lat_key"), F.col("longitude").alias("lon_key")).agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("humidity")).alias("humidity"))


GAPPY = ("CASE WHEN land_id % 10 < 6 THEN NULL ELSE slope END AS sparse_slope, "
         "CASE WHEN land_id % 4 = 0 THEN NULL ELSE elevation END AS elevation, "
         "CASE WHEN land_id % 9 = 0 THEN NULL ELSE cover_name END AS cover_name, forest_cover, "
         "CASE WHEN land_id % 15 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN land_id % 17 = 0 THEN CAST('NaN' AS DOUBLE) "
         "ELSE road_density END AS road_density")
GAPPY_SQL = t.LANDUSE_SQL + f", gappy AS (SELECT land_id, {GAPPY} FROM landuse)"


def gappy(spark, d):
    """Land-use rows with missing slopes (60 %), elevations (25 %), names (11 %) and infinities."""
    return t.landuse(spark, d).selectExpr("land_id", *[
        "CASE WHEN land_id % 10 < 6 THEN NULL ELSE slope END AS sparse_slope",
        "CASE WHEN land_id % 4 = 0 THEN NULL ELSE elevation END AS elevation",
        "CASE WHEN land_id % 9 = 0 THEN NULL ELSE cover_name END AS cover_name", "forest_cover",
        "CASE WHEN land_id % 15 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN land_id % 17 = 0 THEN CAST('NaN' AS DOUBLE) "
        "ELSE road_density END AS road_density"])


@query("drop_sparse_columns", with_(GAPPY_SQL) + f"SELECT land_id, {RA('elevation', 'forest_cover')}, cover_name FROM gappy")
def drop_sparse_columns(spark, d):
    return tidy(clean.drop_sparse_columns(gappy(spark, d).drop("road_density")))


@query("fill_most_frequent", with_(GAPPY_SQL) + """
SELECT land_id, coalesce(cover_name, (SELECT cover_name FROM gappy WHERE cover_name IS NOT NULL
  GROUP BY cover_name ORDER BY count(*) DESC, cover_name LIMIT 1)) AS cover_name FROM gappy""")
def fill_most_frequent(spark, d):
    return clean.fill_most_frequent(gappy(spark, d), ["cover_name"]).select("land_id", "cover_name")


@query("fill_median", with_(GAPPY_SQL) + f"""
SELECT land_id, {R('coalesce(elevation, (SELECT quantile_cont(elevation, 5e-1) FROM gappy))')} AS elevation FROM gappy""")
def fill_median(spark, d):
    return tidy(clean.fill_median(gappy(spark, d), ["elevation"]).select("land_id", "elevation"))


@query("fill_infinite", with_(GAPPY_SQL) + f"""
SELECT land_id, {R('CASE WHEN isnan(road_density) OR isinf(road_density) THEN 0 ELSE road_density END')} AS road_density
FROM gappy""")
def fill_infinite(spark, d):
    return tidy(clean.fill_zero_infinite(gappy(spark, d), ["road_density"]).select("land_id", "road_density"))


@query("fill_defaults", with_(GAPPY_SQL) + f"""
SELECT land_id, {R('coalesce(elevation, 25e0)')} AS elevation, {R('forest_cover')} AS forest_cover, 1e0 AS species_count FROM gappy""")
def fill_defaults(spark, d):
    filled = clean.fill_defaults(gappy(spark, d), {"elevation": 25.0, "forest_cover": 0.5, "species_count": 1.0})
    return tidy(filled.select("land_id", "elevation", "forest_cover", "species_count"))


@query("fill_missing_policy", with_(GAPPY_SQL) + f"""
SELECT land_id, {R('coalesce(elevation, (SELECT quantile_cont(elevation, 5e-1) FROM gappy))')} AS elevation,
  {R('forest_cover')} AS forest_cover, coalesce(cover_name, (SELECT cover_name FROM gappy WHERE cover_name IS NOT NULL
  GROUP BY cover_name ORDER BY count(*) DESC, cover_name LIMIT 1)) AS cover_name FROM gappy""")
def fill_missing_policy(spark, d):
    return tidy(clean.handle_missing(gappy(spark, d).drop("road_density"), row_id="land_id"))


@query("fill_year_median", with_(t.OCCURRENCE_SQL) + f"""
, y AS (SELECT occ_id, CASE WHEN occ_id % 6 = 0 THEN NULL ELSE 2000 + occ_id % 25 END AS yr FROM occurrence)
SELECT occ_id, {R('coalesce(yr, (SELECT quantile_cont(yr, 5e-1) FROM y))')} AS yr FROM y""")
def fill_year_median(spark, d):
    years = t.occurrence(spark, d).selectExpr(
        "occ_id", "CASE WHEN occ_id % 6 = 0 THEN NULL ELSE 2000 + occ_id % 25 END AS yr")
    return tidy(clean.fill_median(years, ["yr"]))


KNN_COLUMNS = ["latitude", "longitude", "temperature", "precipitation", "humidity", "wind_speed"]


@query("nearest_row_imputation", with_(t.CLIMATE_SQL) + f"""
, c AS (SELECT l_orderkey*10 + l_linenumber AS row_id, {', '.join(KNN_COLUMNS)} FROM climate),
need AS (SELECT * FROM c WHERE humidity IS NULL), have AS (SELECT * FROM c WHERE humidity IS NOT NULL),
d AS (SELECT need.row_id, have.row_id AS donor, have.humidity AS h,
  {' + '.join(f'(need.{c}-have.{c})*(need.{c}-have.{c})' for c in KNN_COLUMNS if c != 'humidity')} AS d2
  FROM need, have),
best AS (SELECT row_id, list_avg(list_transform(min(struct_pack(d := d2*6e0/5, id := donor, v := h), 5), lambda x: x.v)) AS humidity
  FROM d GROUP BY row_id)
SELECT c.row_id, {R('coalesce(c.humidity, best.humidity)')} AS humidity FROM c LEFT JOIN best USING (row_id)""")
def nearest_row_imputation(spark, d):
    table = t.climate_daily(spark, d).selectExpr("l_orderkey*10 + l_linenumber AS row_id", *KNN_COLUMNS)
    return tidy(impute_nearest_rows(table, KNN_COLUMNS, "row_id").select("row_id", "humidity"))


SENSOR = [f"CASE WHEN (p_partkey*{m}) % 20 = {r} THEN NULL ELSE CAST((p_partkey*{w}) % {n} AS DOUBLE)/1e1 END AS {c}" for c, m, r, w, n in (
    ("a", 7, 0, 7919, 997), ("b", 11, 1, 104729, 1009), ("c", 13, 2, 1299709, 1013), ("d", 17, 3, 15485863, 503), ("e", 19, 4, 86028121, 257))]
GAPS = ["a", "b", "c", "d", "e"]


@query("nearest_row_imputation_gaps", with_(f"s AS (SELECT p_partkey, {', '.join(SENSOR)} FROM part)",
       "need AS (SELECT *, unnest(['a', 'b', 'c', 'd', 'e']) AS gap FROM s)",
       f"""d AS (SELECT n.p_partkey, gap, h.p_partkey AS donor, CASE gap {' '.join(f"WHEN '{c}' THEN h.{c}" for c in GAPS)} END AS v,
  ({' + '.join(f'coalesce((n.{c}-h.{c})*(n.{c}-h.{c}), 0)' for c in GAPS)})*5e0/({' + '.join(f'CASE WHEN n.{c}-h.{c} IS NULL THEN 0 ELSE 1 END' for c in GAPS)}) AS d2
  FROM need n, s h WHERE CASE gap {' '.join(f"WHEN '{c}' THEN n.{c} IS NULL AND h.{c} IS NOT NULL" for c in GAPS)} END)""",
       """best AS (SELECT p_partkey, gap, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, gap ORDER BY d2, donor) AS i FROM d WHERE d2 IS NOT NULL) WHERE i <= 5 GROUP BY ALL)""") + f"""
SELECT s.p_partkey, {', '.join(R(f"coalesce(s.{c}, max(CASE WHEN gap = '{c}' THEN v END), (SELECT avg({c}) FROM s))") + f' AS {c}' for c in GAPS)}
FROM s LEFT JOIN best USING (p_partkey) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY s.p_partkey, " + ", ".join(f"s.{c}" for c in GAPS)))
def nearest_row_imputation_gaps(spark, d):
    """Sensor-like rows: every column lacks a twentieth of its values, none is complete."""
    table = t.table(spark, d, "part").selectExpr("p_partkey", *SENSOR)
    return tidy(impute_nearest_rows(table, GAPS, "p_partkey"))


@query("outliers_iqr", with_(t.CLIMATE_SQL, sequential("climate", CLIMATE_VARIABLES, IQR_BOUNDS, BETWEEN))
       + f"SELECT {CLIMATE_OUT} FROM s3")
def outliers_iqr(spark, d):
    return tidy(clean.remove_outliers_iqr(t.climate_daily(spark, d), CLIMATE_VARIABLES).select(
        "l_orderkey", "l_linenumber", *CLIMATE_VARIABLES))


@query("outliers_zscore", with_(t.CLIMATE_SQL, "priced AS (SELECT l_orderkey, l_linenumber, temperature, exp(precipitation/2e0) AS rain FROM climate)",
                                sequential("priced", ["temperature", "rain"], "avg({c}) AS m, stddev_pop({c}) AS s",
                                           "abs(({c}-m)/s) < 3"))
       + f"SELECT l_orderkey, l_linenumber, {RA('temperature', 'rain')} FROM s1")
def outliers_zscore(spark, d):
    priced = t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", "temperature",
                                              F.exp(F.col("precipitation") / 2.0).alias("rain"))
    return tidy(clean.remove_outliers_zscore(priced, ["temperature", "rain"]))


@query("standardise_types", with_(t.OCCURRENCE_SQL) + f"""
SELECT occ_id, {R('latitude')} AS lat_text, species_name,
  CASE WHEN occ_id % 8 = 0 THEN true WHEN occ_id % 8 = 1 THEN false WHEN occ_id % 8 = 2 THEN true
       WHEN occ_id % 8 = 3 THEN false WHEN occ_id % 8 = 4 THEN NULL WHEN occ_id % 8 = 5 THEN NULL
       WHEN occ_id % 8 = 6 THEN true ELSE false END AS is_endemic FROM occurrence""")
def standardise_types(spark, d):
    text = t.occurrence(spark, d).select(
        "occ_id", F.format_string("%.3f", "latitude").alias("lat_text"), "species_name",
        F.element_at(F.array(*[F.lit(x) for x in ("True", "false", "Yes", "no", "TRUE", "y", "1", "0")]),
                     (F.col("occ_id") % 8 + 1).cast("int")).alias("is_endemic"))
    return tidy(clean.standardise_types(text))


@query("known_range_filter", with_(t.CLIMATE_SQL) + f"""
SELECT {CLIMATE_OUT} FROM climate WHERE temperature BETWEEN -50 AND 60 AND precipitation BETWEEN 0 AND 1000
  AND humidity BETWEEN 0 AND 100 AND wind_speed BETWEEN 0 AND 200""")
def known_range_filter(spark, d):
    return tidy(clean.filter_known_ranges(t.climate_daily(spark, d)).select(
        "l_orderkey", "l_linenumber", *CLIMATE_VARIABLES))


MONTHLY_SQL = t.CLIMATE_SQL + """, monthly AS (SELECT ix, iy, CAST(date_trunc('month', obs_date) AS DATE) AS obs_date,
  min(latitude) AS latitude, min(longitude) AS longitude, avg(temperature) AS temperature,
  coalesce(sum(precipitation), 0e0) AS precipitation, avg(humidity) AS humidity, avg(wind_speed) AS wind_speed
  FROM climate GROUP BY ix, iy, date_trunc('month', obs_date))"""

CLEAN_COLUMNS = ["temperature", "precipitation", "wind_speed"]


@query("clean_dataset", with_(MONTHLY_SQL, "c AS (SELECT ix, iy, obs_date, temperature, precipitation, wind_speed FROM monthly)",
                              sequential("c", CLEAN_COLUMNS, IQR_BOUNDS, BETWEEN))
       + f"""SELECT ix, iy, obs_date, {RA(*CLEAN_COLUMNS)} FROM s2 WHERE temperature BETWEEN -50 AND 60
  AND precipitation BETWEEN 0 AND 1000 AND wind_speed BETWEEN 0 AND 200""")
def clean_dataset(spark, d):
    from greenlattice.operators.climate import aggregate_monthly
    monthly = aggregate_monthly(t.climate_daily(spark, d), ["ix", "iy", "latitude", "longitude"])
    table = monthly.select(F.col("ix").cast("string"), F.col("iy").cast("string"), "latitude", "longitude",
                           "obs_date", *CLEAN_COLUMNS)
    cleaned = clean.clean_dataset(table, key_columns=["ix", "iy", "obs_date"])
    return tidy(cleaned.select(F.col("ix").cast("bigint"), F.col("iy").cast("bigint"), "obs_date", *CLEAN_COLUMNS))


#: Monthly rows with gaps of every kind that the policy tells apart.
GAP_COLUMNS = {"row_id": "ix*1000000 + iy*10000 + (year(obs_date)-1990)*12 + month(obs_date)", "zone": "CASE WHEN (ix+iy) % 9 = 0 THEN NULL ELSE concat('z', CAST(ix % 4 AS STRING)) END",
               "latitude": "latitude", "longitude": "longitude",
               "temperature": "CASE WHEN (ix*7+iy*3+month(obs_date)) % 5 = 0 THEN NULL ELSE temperature END",
               "wind_speed": "CASE WHEN (ix*11+iy*5+month(obs_date)) % 20 = 3 THEN NULL ELSE wind_speed END",
               "elevation": "CAST((ix*31+iy*17) % 100 AS DOUBLE)/1e1",
               "precipitation": "CASE WHEN (ix+iy+month(obs_date)) % 5 < 3 THEN NULL ELSE precipitation END"}


@query("clean_dataset_gaps", with_(MONTHLY_SQL, f"""g AS (SELECT {', '.join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in GAP_COLUMNS.items())} FROM monthly)""",
       """f AS (SELECT row_id, coalesce(zone, (SELECT zone FROM g WHERE zone IS NOT NULL GROUP BY zone ORDER BY count(*) DESC, zone LIMIT 1)) AS zone,
  coalesce(temperature, (SELECT quantile_cont(temperature, 5e-1) FROM g)) AS temperature, wind_speed, elevation, latitude, longitude FROM g)""",
       f"""d AS (SELECT n.row_id, h.row_id AS donor, h.wind_speed AS w, {' + '.join(f'(n.{c}-h.{c})*(n.{c}-h.{c})' for c in ('latitude', 'longitude', 'temperature', 'elevation'))} AS d2
  FROM f n, f h WHERE n.wind_speed IS NULL AND h.wind_speed IS NOT NULL)""",
       """best AS (SELECT row_id, avg(w) AS w FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d2, donor) AS i FROM d) WHERE i <= 5 GROUP BY row_id)""",
       "c AS (SELECT f.row_id, zone, temperature, coalesce(wind_speed, w) AS wind_speed, elevation FROM f LEFT JOIN best USING (row_id))",
       sequential("c", ["temperature", "wind_speed", "elevation"], IQR_BOUNDS, BETWEEN)) + f"""
SELECT row_id, zone, {RA('temperature', 'wind_speed', 'elevation')} FROM s2 WHERE temperature BETWEEN -50 AND 60 AND wind_speed BETWEEN 0 AND 200""")
def clean_dataset_gaps(spark, d):
    """The cleaning chain on rows with gaps: text by its most frequent value, a sparse column dropped, a median, the nearest rows."""
    from greenlattice.operators.climate import aggregate_monthly
    monthly = aggregate_monthly(t.climate_daily(spark, d), ["ix", "iy", "latitude", "longitude"])
    table = monthly.selectExpr(*[f"{e} AS {c}" for c, e in GAP_COLUMNS.items()])
    cleaned = clean.clean_dataset(table, row_id="row_id", key_columns=["row_id"])
    return tidy(cleaned.select("row_id", "zone", "temperature", "wind_speed", "elevation"))


@query("label_encoding", with_(t.OCCURRENCE_SQL) + """
SELECT occ_id, conservation_status, CAST(dense_rank() OVER (ORDER BY conservation_status) - 1 AS INT)
  AS conservation_status_code FROM occurrence""")
def label_encoding(spark, d):
    table = t.occurrence(spark, d).select("occ_id", "conservation_status")
    return clean.LabelEncoder(["conservation_status"]).fit(table).transform(table)


@query("feature_range_check", with_(t.CLIMATE_SQL) + f"""
, train AS (SELECT * FROM climate WHERE obs_date < DATE '1999-01-01'),
fresh AS (SELECT temperature, precipitation, wind_speed*13e-1 AS wind_speed FROM climate WHERE obs_date >= DATE '1999-01-01'),
r AS (SELECT 'temperature' AS feature, (SELECT min(temperature) FROM train) AS low, (SELECT max(temperature) FROM train) AS high,
   (SELECT min(temperature) FROM fresh) AS seen_low, (SELECT max(temperature) FROM fresh) AS seen_high
 UNION ALL SELECT 'precipitation', (SELECT min(precipitation) FROM train), (SELECT max(precipitation) FROM train),
   (SELECT min(precipitation) FROM fresh), (SELECT max(precipitation) FROM fresh)
 UNION ALL SELECT 'wind_speed', (SELECT min(wind_speed) FROM train), (SELECT max(wind_speed) FROM train),
   (SELECT min(wind_speed) FROM fresh), (SELECT max(wind_speed) FROM fresh))
SELECT feature, {RA('low', 'high', 'seen_low', 'seen_high')},
  seen_low >= low - (high-low)*1e-1 AND seen_high <= high + (high-low)*1e-1 AS within FROM r""")
def feature_range_check(spark, d):
    names = ["temperature", "precipitation", "wind_speed"]
    table = t.climate_daily(spark, d)
    cut = F.lit("1999-01-01").cast("date")
    train = table.where(F.col("obs_date") < cut)
    fresh = table.where(F.col("obs_date") >= cut).withColumn("wind_speed", F.col("wind_speed") * 1.3)
    return tidy(validate.check_feature_ranges(fresh, validate.feature_ranges(train, names)))


@query("nan_to_null", with_(GAPPY_SQL) + """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN isnan(road_density) THEN 0 ELSE 1 END) AS BIGINT) AS present FROM gappy""")
def nan_to_null_query(spark, d):
    return nan_to_null(gappy(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.count("road_density").alias("present"))


@query("table_quantiles", with_(t.CLIMATE_SQL) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(p, 3)} AS prob, {R(f'(SELECT quantile_cont({c}, {p}) FROM climate)')} AS value"
    for c in CLIMATE_VARIABLES for p in ("1e-2", "25e-2", "5e-1", "75e-2", "99e-2")))
def table_quantiles(spark, d):
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    found = exact_quantiles(t.climate_daily(spark, d), {c: probs for c in CLIMATE_VARIABLES})
    rows = [(c, p, v) for c in CLIMATE_VARIABLES for p, v in zip(probs, found[c])]
    return tidy(spark.createDataFrame(rows, "feature string, prob double, value double"))
