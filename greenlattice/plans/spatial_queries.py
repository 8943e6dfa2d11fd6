"""Grids, spatial joins, rasters and land-use products."""

from __future__ import annotations

from pyspark.sql import functions as F

from greenlattice.functions.geo import haversine_km, lattice_index
from greenlattice.functions.numeric import rounded, tidy
from greenlattice.functions.risk import radial_decay, risk_category
from greenlattice.operators import grid, landuse, raster, spatial_join, species, stats
from greenlattice.operators.climate import aggregate_monthly, daily_weather
from greenlattice.plans.registry import R, RA, query, with_
from greenlattice.plans.validation_queries import MONTHLY_SQL
from greenlattice.schemas import CLIMATE_VARIABLES
from greenlattice.sources import tables as t

HAVERSINE = ("2e0*6371e0*asin(least(sqrt(pow(sin(radians({b}.latitude-{a}.latitude)/2e0),2) + "
             "cos(radians({a}.latitude))*cos(radians({b}.latitude))*"
             "pow(sin(radians({b}.longitude-{a}.longitude)/2e0),2)), 1e0))")


def km(a: str, b: str) -> str:
    return HAVERSINE.format(a=a, b=b)


# ---------------------------------------------------------------- grids

NODES_SQL = t.REQUEST_SQL + """, node AS (SELECT request_id, min_lon, min_lat, max_lon, max_lat, resolution,
  ix, iy, min_lon + ix*((min_lon+resolution)-min_lon) AS longitude, min_lat + iy*((min_lat+resolution)-min_lat) AS latitude
  FROM (SELECT *, unnest(range(CAST(ceil((max_lon+resolution-min_lon)/resolution) AS BIGINT))) AS ix FROM
    (SELECT *, unnest(range(CAST(ceil((max_lat+resolution-min_lat)/resolution) AS BIGINT))) AS iy FROM request)))"""


@query("grid_nodes_of_requests", with_(NODES_SQL) + f"SELECT request_id, ix, iy, {RA('longitude', 'latitude')} FROM node")
def grid_nodes_of_requests(spark, d):
    return tidy(grid.expand_requests(t.requests(spark, d)).select("request_id", "ix", "iy", "longitude", "latitude"))


@query("grid_cells_of_requests", with_(NODES_SQL) + f"""
SELECT request_id, concat('cell_', CAST(ix AS VARCHAR), '_', CAST(iy AS VARCHAR)) AS cell_id,
  {R('longitude')} AS x0, {R('latitude')} AS y0, {R('longitude+resolution')} AS x1, {R('latitude+resolution')} AS y1
FROM node WHERE ix < ceil((max_lon+resolution-min_lon)/resolution) - 1 AND iy < ceil((max_lat+resolution-min_lat)/resolution) - 1""")
def grid_cells_of_requests(spark, d):
    cells = grid.create_cells(grid.expand_requests(t.requests(spark, d)))
    return tidy(cells.select("request_id", "cell_id", "x0", "y0", "x1", "y1"))


@query("grid_over_occurrences", with_(t.OCCURRENCE_SQL) + f"""
, e AS (SELECT min(longitude) AS x0, min(latitude) AS y0, max(longitude) AS x1, max(latitude) AS y1 FROM occurrence),
n AS (SELECT ix, iy, x0, y0 FROM (SELECT *, unnest(range(CAST(ceil((x1+1e-1-x0)/1e-1) AS BIGINT))) AS ix FROM
  (SELECT *, unnest(range(CAST(ceil((y1+1e-1-y0)/1e-1) AS BIGINT))) AS iy FROM e))),
c AS (SELECT CAST(floor((longitude-(SELECT x0 FROM e))/1e-1) AS BIGINT) AS ix,
  CAST(floor((latitude-(SELECT y0 FROM e))/1e-1) AS BIGINT) AS iy, count(*) AS k FROM occurrence GROUP BY ALL)
SELECT ix, iy, {R('x0 + ix*((x0+1e-1)-x0)')} AS longitude, {R('y0 + iy*((y0+1e-1)-y0)')} AS latitude,
  CAST(coalesce(k, 0) AS BIGINT) AS records FROM n LEFT JOIN c USING (ix, iy)""")
def grid_over_occurrences(spark, d):
    occ = t.occurrence(spark, d)
    box = grid.extent(occ)
    nodes = grid.create_grid(spark, box, 0.1)
    counts = occ.groupBy(grid.snap(F.col("longitude"), box[0], 0.1).alias("ix"),
                         grid.snap(F.col("latitude"), box[1], 0.1).alias("iy")).agg(F.count(F.lit(1)).alias("records"))
    return tidy(nodes.join(counts, ["ix", "iy"], "left").fillna({"records": 0}))


@query("point_geometry_table", with_(t.OCCURRENCE_SQL) + f"""
SELECT occ_id, concat('POINT (', CAST(CAST(round(longitude*1e3) AS BIGINT) AS VARCHAR), ' ', CAST(CAST(round(latitude*1e3) AS BIGINT) AS VARCHAR), ')') AS wkt,
  {R('longitude')} AS x, {R('latitude')} AS y, CAST(4326 AS INT) AS srid FROM occurrence""")
def point_geometry_table(spark, d):
    milli = lambda c: F.round(F.col(c) * 1e3).cast("bigint").cast("string")
    return tidy(t.occurrence(spark, d).select(
        "occ_id", F.concat(F.lit("POINT ("), milli("longitude"), F.lit(" "), milli("latitude"), F.lit(")")).alias("wkt"),
        F.col("longitude").alias("x"), F.col("latitude").alias("y"), F.lit(4326).alias("srid")))


# ---------------------------------------------------------------- joins on the grid

@query("climate_monthly", with_(t.CLIMATE_SQL) + f"""
SELECT {RA('latitude', 'longitude')}, CAST(date_trunc('month', obs_date) AS DATE) AS obs_date,
  {R('avg(temperature)')} AS temperature, {R('coalesce(sum(precipitation), 0e0)')} AS precipitation,
  {R('avg(humidity)')} AS humidity, {R('avg(wind_speed)')} AS wind_speed
FROM climate GROUP BY climate.latitude, climate.longitude, date_trunc('month', obs_date)""")
def climate_monthly(spark, d):
    return tidy(aggregate_monthly(t.climate_daily(spark, d)))


@query("climate_landuse_join", with_(MONTHLY_SQL, t.LANDCELL_SQL) + f"""
SELECT monthly.ix, monthly.iy, obs_date, {R('temperature')} AS temperature, {R('forest_cover')} AS forest_cover,
  {R('urban_area')} AS urban_area FROM monthly LEFT JOIN landcell USING (ix, iy)""")
def climate_landuse_join(spark, d):
    monthly = aggregate_monthly(t.climate_daily(spark, d), ["ix", "iy"])
    land = t.landuse_cells(spark, d).select("ix", "iy", "forest_cover", "urban_area")
    return tidy(monthly.join(land, ["ix", "iy"], "left").select(
        "ix", "iy", "obs_date", "temperature", "forest_cover", "urban_area"))


@query("region_prediction_join", with_(t.BOUNDARY_SQL) + f"""
, score AS (SELECT n_name AS region, avg(c_acctbal)/1e4 AS risk_score FROM customer JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name)
SELECT region, {RA('x0', 'y0', 'risk_score')} FROM boundary LEFT JOIN score USING (region)""")
def region_prediction_join(spark, d):
    nation = t.table(spark, d, "nation")
    score = (t.table(spark, d, "customer").groupBy("c_nationkey").agg(
        F.sum("c_acctbal").alias("s"), F.count("c_acctbal").alias("n"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("region")).agg((F.sum("s") / F.sum("n") / 1e4).alias("risk_score")))
    return tidy(t.boundary(spark, d).join(score, "region", "left").select("region", "x0", "y0", "risk_score"))


@query("region_choropleth", with_(t.BOUNDARY_SQL, t.OCCURRENCE_SQL) + f"""
SELECT region, CAST(count(occ_id) AS BIGINT) AS records,
  {R("avg(CASE conservation_status WHEN 'LC' THEN 0 WHEN 'NT' THEN 1 WHEN 'VU' THEN 2 WHEN 'EN' THEN 3 WHEN 'CR' THEN 4 WHEN 'EW' THEN 5 WHEN 'EX' THEN 6 END)/6e0")} AS risk_score
FROM boundary LEFT JOIN occurrence ON longitude >= x0 AND longitude < x1 AND latitude >= y0 AND latitude < y1 GROUP BY region""")
def region_choropleth(spark, d):
    packed = t.occurrence(spark, d).groupBy("longitude", "latitude").agg(
        F.count(F.lit(1)).alias("n"), F.sum(species.iucn_score(F.col("conservation_status"))).alias("score"))
    found = spatial_join.points_in_polygons(packed, region_shapes(spark, d), how="right")
    return tidy(found.groupBy("region").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("records"),
        (F.sum("score") / F.sum("n") / 6.0).alias("risk_score")))


def region_shapes(spark, d):
    box = t.boundary(spark, d)
    return box.select("region_id", "region", grid.ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("ring"))


@query("region_lookup", with_(t.BOUNDARY_SQL) + f"""
SELECT c_custkey, region_id, {RA('x0', 'y0', 'x1', 'y1')} FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN boundary ON lower(region) = lower(n_name)""")
def region_lookup(spark, d):
    asked = t.table(spark, d, "customer").join(
        t.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.lower("n_name").alias("wanted"))
    box = t.boundary(spark, d).withColumn("wanted", F.lower("region"))
    return tidy(asked.join(box, "wanted").select("c_custkey", "region_id", "x0", "y0", "x1", "y1"))


@query("points_within_regions", with_(t.BOUNDARY_SQL, t.OCCURRENCE_SQL) + """
SELECT occ_id, region_id FROM occurrence JOIN boundary ON longitude >= x0 AND longitude < x1 AND latitude >= y0 AND latitude < y1""")
def points_within_regions(spark, d):
    points = t.occurrence(spark, d).select("occ_id", "longitude", "latitude")
    return spatial_join.points_in_polygons(points, region_shapes(spark, d)).select("occ_id", "region_id")


@query("points_left_of_triangles", with_("""tri AS (SELECT s_suppkey, 72e0 + CAST((s_suppkey*97)%70 AS DOUBLE)*1e-1 AS x,
  15e0 + CAST((s_suppkey*61)%60 AS DOUBLE)*1e-1 AS y FROM supplier)""", t.OCCURRENCE_SQL) + """
SELECT occ_id, s_suppkey FROM occurrence LEFT JOIN tri
  ON latitude >= y AND latitude < y + 5e-1 AND longitude >= x AND longitude < x + (5e-1 - (latitude - y))""")
def points_left_of_triangles(spark, d):
    """Right triangles of side half a degree, points without one kept."""
    tri = t.table(spark, d, "supplier").selectExpr(
        "s_suppkey", "72e0 + CAST((s_suppkey*97)%70 AS DOUBLE)*1e-1 AS x", "15e0 + CAST((s_suppkey*61)%60 AS DOUBLE)*1e-1 AS y")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("x"), F.col("y")
    shapes = tri.select("s_suppkey", F.array(
        corner(x, y), corner(x + 0.5, y), corner(x, y + 0.5), corner(x, y)).alias("ring"))
    points = t.occurrence(spark, d).select("occ_id", "longitude", "latitude")
    return spatial_join.points_in_polygons(points, shapes, how="left").select("occ_id", "s_suppkey")


@query("radius_pairs", with_(t.SITE_SQL, t.OCCURRENCE_SQL) + f"""
SELECT site_id, occ_id, {R(km('site', 'occurrence'))} AS distance_km FROM site, occurrence
WHERE {km('site', 'occurrence')} <= 10e0""")
def radius_pairs(spark, d):
    occ = t.occurrence(spark, d).select("occ_id", "latitude", "longitude")
    return spatial_join.radius_join(t.sites(spark, d), occ, 10.0, digits=6).select("site_id", "occ_id", "distance_km")


@query("radius_pairs_outer", with_(t.SITE_SQL, t.OCCURRENCE_SQL) + f"""
SELECT site_id, CAST(count(occ_id) AS BIGINT) AS n, {R(f'min(CASE WHEN occ_id IS NOT NULL THEN {km("site", "occurrence")} END)')} AS closest
FROM site LEFT JOIN occurrence ON {km('site', 'occurrence')} <= 3e0 GROUP BY site_id""")
def radius_pairs_outer(spark, d):
    occ = t.occurrence(spark, d).select("occ_id", "latitude", "longitude")
    found = spatial_join.radius_join(t.sites(spark, d), occ, 3.0, how="left")
    return tidy(found.groupBy("site_id").agg(F.count("occ_id").alias("n"), F.min("distance_km").alias("closest")))


METRICS_BODY = """
near AS (SELECT {p}.latitude, {p}.longitude, species_name, conservation_status, is_endemic
  FROM {p}, occurrence WHERE {km} <= {r}),
counts AS (SELECT latitude, longitude, species_name, count(*) AS c FROM near GROUP BY ALL),
tot AS (SELECT latitude, longitude, sum(c) AS n FROM counts GROUP BY ALL),
div AS (SELECT counts.latitude, counts.longitude, -sum(c*1e0/n*ln(c*1e0/n)) AS h FROM counts
  JOIN tot ON counts.latitude = tot.latitude AND counts.longitude = tot.longitude GROUP BY ALL),
agg AS (SELECT latitude, longitude, count(DISTINCT species_name) AS species_count,
  count(DISTINCT CASE WHEN is_endemic THEN species_name END) AS endemic_species,
  count(DISTINCT CASE WHEN conservation_status IN ('VU','EN','CR') THEN species_name END) AS threatened_species,
  avg(CASE conservation_status WHEN 'LC' THEN 0 WHEN 'NT' THEN 1 WHEN 'VU' THEN 2 WHEN 'EN' THEN 3
      WHEN 'CR' THEN 4 WHEN 'EW' THEN 5 WHEN 'EX' THEN 6 END)/6e0 AS threat_index FROM near GROUP BY ALL),
metrics AS (SELECT {p}.latitude, {p}.longitude, CAST(coalesce(species_count, 0) AS BIGINT) AS species_count,
  CAST(coalesce(endemic_species, 0) AS BIGINT) AS endemic_species,
  CAST(coalesce(threatened_species, 0) AS BIGINT) AS threatened_species,
  greatest(coalesce(h, 0e0), 0e0) AS species_diversity, coalesce(threat_index, 0e0) AS threat_index
  FROM {p} LEFT JOIN agg ON {p}.latitude = agg.latitude AND {p}.longitude = agg.longitude
  LEFT JOIN div ON {p}.latitude = div.latitude AND {p}.longitude = div.longitude)"""
SITE_PLACE_SQL = t.SITE_SQL + ", place AS (SELECT DISTINCT latitude, longitude FROM site)"
SITE_METRICS_SQL = with_(SITE_PLACE_SQL, t.OCCURRENCE_SQL, METRICS_BODY.format(p="place", km=km("place", "occurrence"), r="10e0"))
METRIC_OUT = (RA("latitude", "longitude") + ", species_count, endemic_species, threatened_species, "
              + RA("species_diversity", "threat_index"))


@query("species_metrics_sites", SITE_METRICS_SQL + f"SELECT {METRIC_OUT} FROM metrics")
def species_metrics_sites(spark, d):
    return tidy(species.species_metrics(t.occurrence(spark, d), t.sites(spark, d), 10.0))


GRID_PLACE_SQL = t.OCCURRENCE_SQL + """, e AS (SELECT min(longitude) AS x0, min(latitude) AS y0, max(longitude) AS x1, max(latitude) AS y1 FROM occurrence),
place AS (SELECT x0 + ix*((x0+1e-1)-x0) AS longitude, y0 + iy*((y0+1e-1)-y0) AS latitude
 FROM (SELECT *, unnest(range(CAST(ceil((x1+1e-1-x0)/1e-1) AS BIGINT))) AS ix FROM
  (SELECT *, unnest(range(CAST(ceil((y1+1e-1-y0)/1e-1) AS BIGINT))) AS iy FROM e)))"""


@query("species_metrics_grid", with_(GRID_PLACE_SQL, METRICS_BODY.format(p="place", km=km("place", "occurrence"), r="5e0"))
       + f"SELECT {METRIC_OUT} FROM metrics")
def species_metrics_grid(spark, d):
    occ = t.occurrence(spark, d)
    nodes = grid.create_grid(spark, grid.extent(occ), 0.1)
    return tidy(species.species_metrics(occ, nodes, 5.0))


@query("biodiversity_hotspots", SITE_METRICS_SQL + f"""
, scored AS (SELECT *, species_count*4e-1 + endemic_species*3e-1 + species_diversity*2e-1 + threatened_species*1e-1 AS biodiversity_score FROM metrics),
hot AS (SELECT * FROM scored WHERE biodiversity_score >= (SELECT quantile_cont(biodiversity_score, 9e-1) FROM scored) - 1e-12)
SELECT {METRIC_OUT}, {R('biodiversity_score')} AS biodiversity_score,
  CAST(rank() OVER (ORDER BY biodiversity_score DESC) + (count(*) OVER (PARTITION BY biodiversity_score) - 1)/2e0 AS DOUBLE) AS hotspot_rank
FROM hot""")
def biodiversity_hotspots(spark, d):
    metrics = species.species_metrics(t.occurrence(spark, d), t.sites(spark, d), 10.0)
    return tidy(species.biodiversity_hotspots(metrics))


@query("buffer_statistics", with_(t.SITE_SQL, t.OCCURRENCE_SQL) + f"""
SELECT site_id, CAST(count(event_value) AS BIGINT) AS count, {R('coalesce(sum(event_value), 0e0)', 4)} AS sum, {R('avg(event_value)')} AS mean
FROM site LEFT JOIN (SELECT occurrence.*, value AS event_value FROM occurrence JOIN events ON occ_id = event_id) o
  ON sqrt((site.latitude-o.latitude)*(site.latitude-o.latitude) + (site.longitude-o.longitude)*(site.longitude-o.longitude)) <= 25e-2
GROUP BY site_id""")
def buffer_statistics(spark, d):
    occ = t.table(spark, d, "events").selectExpr(*t.OCCURRENCE_COLUMNS, "value AS event_value")
    out = spatial_join.buffer_analysis(t.sites(spark, d), "site_id", occ, "event_value", 0.25)
    return out.select("site_id", "count", rounded(F.col("sum"), 4).alias("sum"), rounded(F.col("mean")).alias("mean"))


@query("nearest_site_per_occurrence", with_(t.SITE_SQL, t.OCCURRENCE_SQL) + f"""
, d AS (SELECT occ_id, min(struct_pack(d2 := (o.longitude-s.longitude)*(o.longitude-s.longitude) + (o.latitude-s.latitude)*(o.latitude-s.latitude),
  id := site_id)) AS b FROM occurrence o, site s GROUP BY occ_id)
SELECT occ_id, b.id AS site_id, {R('sqrt(b.d2)')} AS distance_deg FROM d""")
def nearest_site_per_occurrence(spark, d):
    return tidy(spatial_join.nearest_site(t.occurrence(spark, d), "occ_id", t.sites(spark, d), "site_id"))


@query("discrete_voronoi", with_(GRID_PLACE_SQL, t.SITE_SQL) + f"""
, d AS (SELECT p.latitude, p.longitude, min(struct_pack(d2 := (p.longitude-s.longitude)*(p.longitude-s.longitude) + (p.latitude-s.latitude)*(p.latitude-s.latitude),
  id := site_id)) AS b FROM place p, site s GROUP BY ALL)
SELECT b.id AS site_id, CAST(count(*) AS BIGINT) AS cells, {R('avg(sqrt(b.d2))')} AS mean_distance, {R('max(sqrt(b.d2))')} AS reach FROM d GROUP BY b.id""")
def discrete_voronoi(spark, d):
    """Grid nodes over the occurrences assigned to their nearest site: one region per site."""
    box = grid.extent(t.occurrence(spark, d))
    nodes = grid.create_grid(spark, box, 0.1).withColumn("node_id", F.col("iy") * 100000 + F.col("ix"))
    owner = spatial_join.nearest_site(nodes, "node_id", t.sites(spark, d), "site_id")
    return tidy(owner.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("cells"), F.avg("distance_deg").alias("mean_distance"),
        F.max("distance_deg").alias("reach")))


@query("location_features", with_(t.LANDCELL_SQL, t.OCCURRENCE_SQL) + f"""
, d AS (SELECT occ_id, min(struct_pack(d2 := (o.longitude-s.longitude)*(o.longitude-s.longitude) + (o.latitude-s.latitude)*(o.latitude-s.latitude),
  id := s.iy*100000 + s.ix)) AS b FROM occurrence o, landcell s GROUP BY occ_id)
SELECT occ_id, {RA('forest_cover', 'urban_area', 'water_bodies', 'population_density')}, {R('sqrt(b.d2)')} AS distance_deg
FROM d JOIN landcell s ON s.iy*100000 + s.ix = b.id""")
def location_features(spark, d):
    """Feature lookup for request points: the nearest cell of the feature grid."""
    cells = t.landuse_cells(spark, d).withColumn("cell_key", F.col("iy") * 100000 + F.col("ix"))
    points = t.occurrence(spark, d).select("occ_id", "longitude", "latitude")
    near = spatial_join.nearest_site(points, "occ_id", cells, "cell_key")
    return tidy(near.join(cells, "cell_key").select(
        "occ_id", "forest_cover", "urban_area", "water_bodies", "population_density", "distance_deg"))


SNAP_SQL = """CAST(round((longitude-72e0)/1e-1) AS BIGINT) AS ix, CAST(round((latitude-15e0)/1e-1) AS BIGINT) AS iy"""


@query("snapped_features", with_(t.LANDCELL_SQL, t.OCCURRENCE_SQL, f"snap AS (SELECT occ_id, {SNAP_SQL} FROM occurrence)") + f"""
SELECT occ_id, {R('coalesce(forest_cover, 0e0)')} AS forest_cover, {R('coalesce(urban_area, 0e0)')} AS urban_area, forest_cover IS NOT NULL AS has_data
FROM snap LEFT JOIN landcell USING (ix, iy)""")
def snapped_features(spark, d):
    """Equi-join on the snapped lattice key; a place without data gets 0 and a flag."""
    points = t.occurrence(spark, d).select(
        "occ_id", lattice_index(F.col("longitude"), 72.0, 0.1).alias("ix"), lattice_index(F.col("latitude"), 15.0, 0.1).alias("iy"))
    cells = t.landuse_cells(spark, d).select("ix", "iy", "forest_cover", "urban_area")
    joined = points.join(cells, ["ix", "iy"], "left").withColumn("has_data", F.col("forest_cover").isNotNull())
    return tidy(joined.fillna(0.0, ["forest_cover", "urban_area"]).select("occ_id", "forest_cover", "urban_area", "has_data"))


COVER_SQL = """cover AS (SELECT c_custkey, 72e0 + CAST((c_custkey*97)%7000 AS DOUBLE)/1e3 AS x0,
  15e0 + CAST((c_custkey*61)%6000 AS DOUBLE)/1e3 AS y0, CASE c_custkey%5 WHEN 0 THEN 'forest' WHEN 1 THEN 'agricultural'
  WHEN 2 THEN 'urban' WHEN 3 THEN 'water' ELSE 'barren' END AS landuse_type FROM customer)"""


def cover_boxes(spark, d):
    cover = t.table(spark, d, "customer").selectExpr(
        "c_custkey", "72e0 + CAST((c_custkey*97)%7000 AS DOUBLE)/1e3 AS x0", "15e0 + CAST((c_custkey*61)%6000 AS DOUBLE)/1e3 AS y0",
        "CASE c_custkey%5 WHEN 0 THEN 'forest' WHEN 1 THEN 'agricultural' WHEN 2 THEN 'urban' WHEN 3 THEN 'water' ELSE 'barren' END AS landuse_type")
    x, y = F.col("x0"), F.col("y0")
    return cover.select("c_custkey", "landuse_type", grid.ring(x, y, x + 0.3, y + 0.3).alias("ring"))


#: Signed area between a disc of radius 0.1 and the edges (px, py) + t (dx, dy) of a ring, about the disc's centre.
DISC_SQL = """edge AS (SELECT unnest([0, 1, 1, 0]) AS ex, unnest([0, 0, 1, 1]) AS ey, unnest([1, 0, -1, 0]) AS sx, unnest([0, 1, 0, -1]) AS sy),
pq AS (SELECT place.latitude, place.longitude, landuse_type, c_custkey, x0 + ex*3e-1 - longitude AS px, y0 + ey*3e-1 - latitude AS py, sx*3e-1 AS dx, sy*3e-1 AS dy
  FROM place JOIN cover ON x0 <= longitude + 1e-1 AND x0 + 3e-1 >= longitude - 1e-1 AND y0 <= latitude + 1e-1 AND y0 + 3e-1 >= latitude - 1e-1, edge),
abc AS (SELECT *, dx*dx + dy*dy AS a, px*dx + py*dy AS b, px*px + py*py - 1e-2 AS c FROM pq),
st AS (SELECT *, least(greatest((-b - sqrt(greatest(b*b - a*c, 0e0)))/a, 0e0), 1e0) AS s, least(greatest((-b + sqrt(greatest(b*b - a*c, 0e0)))/a, 0e0), 1e0) AS t FROM abc),
uv AS (SELECT *, px + s*dx AS ux, py + s*dy AS uy, px + t*dx AS vx, py + t*dy AS vy, px + dx AS qx, py + dy AS qy FROM st),
part AS (SELECT latitude, longitude, landuse_type, c_custkey, abs(sum(1e-2*atan2(px*uy - py*ux, px*ux + py*uy) + ux*vy - uy*vx + 1e-2*atan2(vx*qy - vy*qx, vx*qx + vy*qy)))/2e0 AS area
  FROM uv GROUP BY ALL)"""


@query("landuse_overlap", with_(COVER_SQL, SITE_PLACE_SQL, DISC_SQL) + f"""
SELECT {R('place.latitude')} AS latitude, {R('place.longitude')} AS longitude,
  {', '.join(R(f"least(coalesce(sum(CASE WHEN landuse_type = '{n}' THEN area END), 0e0)/(pi()*1e-2), 1e0)") + ' AS ' + n for n in ('forest', 'agricultural', 'urban', 'water'))}
FROM place LEFT JOIN part ON place.latitude = part.latitude AND place.longitude = part.longitude GROUP BY place.latitude, place.longitude""")
def landuse_overlap(spark, d):
    return tidy(spatial_join.landuse_overlap(t.sites(spark, d), cover_boxes(spark, d), ["forest", "agricultural", "urban", "water"], radius_deg=0.1))


@query("points_in_star_rings", with_(t.OCCURRENCE_SQL, """star AS (SELECT n_nationkey AS star_id, 72e0 + CAST((n_nationkey*37)%70 AS DOUBLE)*1e-1 AS cx, 15e0 + CAST((n_nationkey*23)%60 AS DOUBLE)*1e-1 AS cy FROM nation)""",
       """near AS (SELECT occ_id, star_id, longitude, latitude, cx, cy FROM occurrence JOIN star ON abs(longitude-cx) < 1.3e0 AND abs(latitude-cy) < 1.3e0)""",
       """side AS (SELECT *, unnest(range(720)) AS i FROM near)""",
       """ab AS (SELECT occ_id, star_id, longitude AS x, latitude AS y, cx + cos(2e0*pi()*i/720e0)*(1e0 + (i%2)*2e-1) AS ax, cy + sin(2e0*pi()*i/720e0)*(1e0 + (i%2)*2e-1) AS ay,
  cx + cos(2e0*pi()*((i+1)%720)/720e0)*(1e0 + ((i+1)%2)*2e-1) AS bx, cy + sin(2e0*pi()*((i+1)%720)/720e0)*(1e0 + ((i+1)%2)*2e-1) AS "by" FROM side)""") + """
SELECT occ_id, star_id FROM ab WHERE (ay <= y) <> ("by" <= y) AND x < ax + (y - ay)*(bx - ax)/("by" - ay) GROUP BY occ_id, star_id HAVING count(*) % 2 = 1""")
def points_in_star_rings(spark, d):
    """Jagged rings of 720 corners: edges in latitude bands, crossings by parity."""
    star = t.table(spark, d, "nation").selectExpr("n_nationkey AS star_id", "72e0 + CAST((n_nationkey*37)%70 AS DOUBLE)*1e-1 AS cx",
                                                  "15e0 + CAST((n_nationkey*23)%60 AS DOUBLE)*1e-1 AS cy")

    def corner(i):
        reach, angle = 1.0 + (i % 2) * 0.2, F.lit(2.0) * F.pi() * (i % 720) / 720.0
        return F.struct((F.col("cx") + F.cos(angle) * reach).alias("x"), (F.col("cy") + F.sin(angle) * reach).alias("y"))

    rings = star.select("star_id", F.transform(F.sequence(F.lit(0), F.lit(720)), corner).alias("ring"))
    points = t.occurrence(spark, d).select("occ_id", "longitude", "latitude")
    return spatial_join.points_in_polygons(points, rings).select("occ_id", "star_id")


# ---------------------------------------------------------------- sources re-aimed at landed tables

@query("raster_pixels_to_table", """WITH px AS (SELECT p_partkey, CAST(floor(p_partkey/100e0) AS BIGINT) AS r, p_partkey%100 AS c, CAST(p_partkey%8 AS INT) AS code FROM part)
SELECT """ + RA('longitude', 'latitude') + """, landuse_code, CASE landuse_code WHEN 1 THEN 'forest' WHEN 2 THEN 'agricultural' WHEN 3 THEN 'urban'
  WHEN 4 THEN 'water' WHEN 5 THEN 'grassland' WHEN 6 THEN 'barren' ELSE 'unknown' END AS landuse_type
FROM (SELECT 72e0 + (c+5e-1)*1e-1 AS longitude, 22e0 + (r+5e-1)*-1e-1 AS latitude, code AS landuse_code FROM px WHERE code <> 0)
WHERE longitude BETWEEN 73e0 AND 81e0 AND latitude BETWEEN 15e0 AND 22e0""")
def raster_pixels_to_table(spark, d):
    pixels = t.table(spark, d, "part").selectExpr(
        "CAST(floor(p_partkey/100e0) AS BIGINT) AS row", "p_partkey%100 AS col", "CAST(p_partkey%8 AS INT) AS code")
    return tidy(landuse.decode_raster(pixels, 72.0, 22.0, 0.1, -0.1, nodata=0, bounds=(73.0, 15.0, 81.0, 22.0)))


@query("daily_weather_spine", with_(t.CLIMATE_SQL) + f"""
, req AS (SELECT s_suppkey AS request_id, CAST(((s_suppkey*1499)%5600)%80 AS BIGINT) AS ix,
  CAST(floor(((s_suppkey*1499)%5600)/80e0) AS BIGINT) AS iy, DATE '1997-03-01' AS a, DATE '1997-03-01' + CAST(s_suppkey%20 AS INT) AS b FROM supplier),
spine AS (SELECT request_id, ix, iy, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS obs_date FROM req),
daily AS (SELECT ix, iy, obs_date, avg(temperature) AS temperature, avg(precipitation) AS precipitation FROM climate GROUP BY ALL)
SELECT request_id, obs_date, {RA('temperature', 'precipitation')} FROM spine LEFT JOIN daily USING (ix, iy, obs_date)""")
def daily_weather_spine(spark, d):
    req = t.table(spark, d, "supplier").selectExpr(
        "s_suppkey AS request_id", "CAST(((s_suppkey*1499)%5600)%80 AS BIGINT) AS ix",
        "CAST(floor(((s_suppkey*1499)%5600)/80e0) AS BIGINT) AS iy",
        "DATE '1997-03-01' AS start_date", "date_add(DATE '1997-03-01', CAST(s_suppkey%20 AS INT)) AS end_date")
    return tidy(daily_weather(req, t.climate_daily(spark, d)).select("request_id", "obs_date", "temperature", "precipitation"))


# ---------------------------------------------------------------- rasters, zones, heatmaps

@query("rasterized_risk", with_(t.OCCURRENCE_SQL) + """
, p AS (SELECT occ_id, CAST(floor((22e0-latitude)/2e-1) AS INT) AS "row", CAST(floor((longitude-72e0)/2e-1) AS INT) AS col,
  CAST((occ_id%1000)/1e3 AS FLOAT) AS v FROM occurrence),
b AS (SELECT "row", col, arg_max(v, occ_id) AS v FROM p WHERE "row" BETWEEN 0 AND 34 AND col BETWEEN 0 AND 39 GROUP BY ALL),
c AS (SELECT CAST(floor(i/40e0) AS INT) AS "row", CAST(i%40 AS INT) AS col FROM range(1400) r(i))
SELECT c."row", c.col, """ + R("coalesce(b.v, 0)") + """ AS value FROM c LEFT JOIN b ON c."row" = b."row" AND c.col = b.col""")
def rasterized_risk(spark, d):
    points = t.occurrence(spark, d).withColumn("risk", (F.col("occ_id") % 1000) / 1e3)
    return tidy(raster.rasterize(points, "risk", "occ_id", (72.0, 15.0, 80.0, 22.0), 0.2))


@query("rasterized_shapes", with_(COVER_SQL, t.OCCURRENCE_SQL, """c AS (SELECT CAST(floor(i/80e0) AS INT) AS "row", CAST(i%80 AS INT) AS col,
  72e0 + (CAST(i%80 AS DOUBLE) + 5e-1)*1e-1 AS x, 22e0 - (floor(i/80e0) + 5e-1)*1e-1 AS y FROM range(5600) r(i))""",
       """tri AS (SELECT s_suppkey, 72e0 + CAST((s_suppkey*97)%70 AS DOUBLE)*1e-1 + 3e-2 AS x0, 15e0 + CAST((s_suppkey*61)%60 AS DOUBLE)*1e-1 + 3e-2 AS y0 FROM supplier)""",
       """hit AS (SELECT "row", col, c_custkey AS k, CAST((c_custkey%100)/1e2 AS FLOAT) AS v FROM c JOIN cover ON x >= x0 + 2e-2 AND x < x0 + 32e-2 AND y >= y0 + 2e-2 AND y < y0 + 32e-2
  UNION ALL SELECT "row", col, 1000000 + s_suppkey, CAST((s_suppkey%50)/5e1 AS FLOAT) FROM c JOIN tri ON y >= y0 AND y < y0 + 1e0 AND x >= x0 AND x < x0 + (1e0 - (y - y0))
  UNION ALL SELECT CAST(floor((22e0-latitude)/1e-1) AS INT), CAST(floor((longitude-72e0)/1e-1) AS INT), 2000000 + occ_id, CAST(9e-1 AS FLOAT) FROM occurrence WHERE occ_id % 40 = 0)""") + """
SELECT c."row", c.col, """ + R("coalesce(v, 0)") + """ AS value FROM c LEFT JOIN (SELECT "row", col, arg_max(v, k) AS v FROM hit GROUP BY ALL) h ON c."row" = h."row" AND c.col = h.col""")
def rasterized_shapes(spark, d):
    """Boxes, then triangles, then points burned onto one raster; later ones win."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("x0"), F.col("y0")
    none = [F.lit(None).cast("double").alias(c) for c in ("longitude", "latitude")]
    boxes = t.table(spark, d, "customer").selectExpr("c_custkey", "72e0 + CAST((c_custkey*97)%7000 AS DOUBLE)/1e3 AS x0", "15e0 + CAST((c_custkey*61)%6000 AS DOUBLE)/1e3 AS y0").select(
        F.col("c_custkey").alias("k"), ((F.col("c_custkey") % 100) / 100.0).alias("v"), grid.ring(x + 0.02, y + 0.02, x + 0.32, y + 0.32).alias("ring"), *none)
    triangles = t.table(spark, d, "supplier").selectExpr(
        "s_suppkey", "72e0 + CAST((s_suppkey*97)%70 AS DOUBLE)*1e-1 + 3e-2 AS x0", "15e0 + CAST((s_suppkey*61)%60 AS DOUBLE)*1e-1 + 3e-2 AS y0").select(
        (F.col("s_suppkey") + 1_000_000).alias("k"), ((F.col("s_suppkey") % 50) / 50.0).alias("v"),
        F.array(corner(x, y), corner(x + 1.0, y), corner(x, y + 1.0), corner(x, y)).alias("ring"), *none)
    seen = t.occurrence(spark, d).where("occ_id % 40 = 0").select(
        (F.col("occ_id") + 2_000_000).alias("k"), F.lit(0.9).alias("v"), F.lit(None).cast(boxes.schema["ring"].dataType).alias("ring"), "longitude", "latitude")
    shapes = boxes.unionByName(triangles).unionByName(seen)
    return tidy(raster.rasterize_shapes(shapes, "v", "k", (72.0, 15.0, 80.0, 22.0), 0.1))


DECAY_SQL = "least(greatest(exp(-3e0*sqrt(({y}-(min_lat+max_lat)/2e0)*({y}-(min_lat+max_lat)/2e0) + ({x}-(min_lon+max_lon)/2e0)*({x}-(min_lon+max_lon)/2e0))), 0e0), 1e0)"
CATEGORY_SQL = "CASE WHEN {s} < {a} THEN 'low' WHEN {s} < {b} THEN 'medium' ELSE 'high' END"


@query("closed_form_heatmap", with_(NODES_SQL) + f"""
SELECT request_id, {RA('longitude', 'latitude', 'risk_score')}, {CATEGORY_SQL.format(s='risk_score', a='33e-2', b='66e-2')} AS risk_category
FROM (SELECT *, {DECAY_SQL.format(x='longitude', y='latitude')} AS risk_score FROM node)""")
def closed_form_heatmap(spark, d):
    nodes = grid.expand_requests(t.requests(spark, d))
    score = radial_decay(F.col("latitude"), F.col("longitude"), (F.col("min_lat") + F.col("max_lat")) / 2.0,
                         (F.col("min_lon") + F.col("max_lon")) / 2.0)
    return tidy(nodes.withColumn("risk_score", score).select(
        "request_id", "longitude", "latitude", "risk_score", risk_category(F.col("risk_score"), 0.33, 0.66).alias("risk_category")))


@query("closed_form_risk_zones", with_(t.REQUEST_SQL, """node AS (SELECT request_id, min_lon, min_lat, max_lon, max_lat, resolution, ix, iy,
  min_lon + ix*((min_lon+resolution)-min_lon) AS longitude, min_lat + iy*((min_lat+resolution)-min_lat) AS latitude
  FROM (SELECT *, unnest(range(CAST(ceil((max_lon-min_lon)/resolution) AS BIGINT))) AS ix FROM
    (SELECT *, unnest(range(CAST(ceil((max_lat-min_lat)/resolution) AS BIGINT))) AS iy FROM request)))""") + f"""
SELECT request_id, {R('longitude')} AS x0, {R('latitude')} AS y0, {R('longitude+resolution')} AS x1, {R('latitude+resolution')} AS y1,
  {R('s')} AS risk_score, {CATEGORY_SQL.format(s='s', a='4e-1', b='7e-1')} AS risk_level
FROM (SELECT *, {DECAY_SQL.format(x='(longitude+resolution/2e0)', y='(latitude+resolution/2e0)')} AS s FROM node)""")
def closed_form_risk_zones(spark, d):
    from greenlattice.operators.zones import closed_form_zones
    zones = closed_form_zones(t.requests(spark, d), 0.4, 0.7)
    return tidy(zones.select("request_id", "x0", "y0", "x1", "y1", "risk_score", "risk_level"))


# ---------------------------------------------------------------- distances and extents

@query("site_distances", with_(t.SITE_SQL) + f"""
, c AS (SELECT avg(latitude) AS latitude, avg(longitude) AS longitude FROM site)
SELECT site_id, {R(km('site', 'c'))} AS distance_km FROM site, c""")
def site_distances(spark, d):
    table = t.sites(spark, d)
    lat, lon = table.agg(F.avg("latitude"), F.avg("longitude")).first()
    return tidy(table.select("site_id", haversine_km(
        F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)).alias("distance_km")))


@query("spatial_extent", with_(t.OCCURRENCE_SQL) + f"""
SELECT {R('min(longitude)')} AS min_x, {R('min(latitude)')} AS min_y, {R('max(longitude)')} AS max_x, {R('max(latitude)')} AS max_y,
  {R('(max(longitude)-min(longitude))*(max(latitude)-min(latitude))')} AS area_degrees FROM occurrence""")
def spatial_extent(spark, d):
    return tidy(stats.spatial_extent(t.occurrence(spark, d)))


@query("point_density", with_(t.OCCURRENCE_SQL) + """
SELECT CAST(floor(latitude/25e-2) AS BIGINT) AS cy, CAST(floor(longitude/25e-2) AS BIGINT) AS cx, CAST(count(*) AS BIGINT) AS n
FROM occurrence GROUP BY ALL""")
def point_density(spark, d):
    return stats.density_grid(t.occurrence(spark, d), 0.25)
