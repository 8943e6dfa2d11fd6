"""Features, risk scores, scaling, selection over the working set."""

from __future__ import annotations

from pyspark.sql import functions as F

from greenlattice.functions import risk
from greenlattice.functions.numeric import rounded, tidy
from greenlattice.operators import features, ranking, scaling, selection, stats
from greenlattice.operators.species import iucn_name, iucn_score
from greenlattice.plans.combined import CLIMATE, COMBINED_CTES, COMBINED_SQL, LAND, SPECIES, build_combined, combined
from greenlattice.plans.registry import R, RA, query, with_
from greenlattice.schemas import CLIMATE_VARIABLES, LANDUSE_SHARES, SPECIES_COUNTS
from greenlattice.sources import tables as t

COUNTS = ["species_count", "endemic_species", "threatened_species"]


@query("combined_table", COMBINED_SQL + f"""SELECT row_id, obs_date, {', '.join(COUNTS)},
  {RA('latitude', 'longitude', *CLIMATE, *LAND, 'species_diversity', 'threat_index')} FROM combined""")
def combined_table(spark, d):
    return tidy(build_combined(spark, d))


HAV_C = ("2e0*6371e0*asin(least(sqrt(pow(sin(radians(clat-latitude)/2e0),2) + cos(radians(latitude))*cos(radians(clat))*"
         "pow(sin(radians(clon-longitude)/2e0),2)), 1e0))")
BIN = "CAST(least(greatest(ceil(({c}-{lo})/(({hi}-{lo})/10e0))-1, 0), 9) AS INT)"
SPATIAL = {
    "distance_from_center": HAV_C, "lat_squared": "latitude*latitude", "lon_squared": "longitude*longitude",
    "lat_lon_product": "latitude*longitude", "distance_to_north": "lat1-latitude", "distance_to_south": "latitude-lat0",
    "distance_to_east": "lon1-longitude", "distance_to_west": "longitude-lon0"}
SPATIAL_CTE = (
    "sf AS (SELECT avg(latitude) AS clat, avg(longitude) AS clon, min(latitude) AS lat0, max(latitude) AS lat1, "
    "min(longitude) AS lon0, max(longitude) AS lon1 FROM combined), f1 AS (SELECT combined.*, "
    + ", ".join(f"{e} AS {n}" for n, e in SPATIAL.items())
    + f", {BIN.format(c='latitude', lo='lat0', hi='lat1')} AS lat_bin, {BIN.format(c='longitude', lo='lon0', hi='lon1')} AS lon_bin"
    + " FROM combined, sf)")
D = "obs_date"
TEMPORAL_INT = {
    f"{D}_year": "year(obs_date)", f"{D}_month": "month(obs_date)", f"{D}_day": "day(obs_date)",
    f"{D}_dayofyear": "dayofyear(obs_date)", f"{D}_weekday": "isodow(obs_date)-1", f"{D}_quarter": "quarter(obs_date)",
    f"{D}_days_since_start": "date_diff('day', (SELECT min(obs_date) FROM combined), obs_date)"}
TEMPORAL = {
    f"{D}_month_sin": "sin(2*pi()*month(obs_date)/12)", f"{D}_month_cos": "cos(2*pi()*month(obs_date)/12)",
    f"{D}_day_sin": "sin(2*pi()*dayofyear(obs_date)/365)", f"{D}_day_cos": "cos(2*pi()*dayofyear(obs_date)/365)"}
TEMPORAL_CTE = ("f2 AS (SELECT f1.*, " + ", ".join(f"CAST({e} AS INT) AS {n}" for n, e in TEMPORAL_INT.items()) + ", "
                + ", ".join(f"{e} AS {n}" for n, e in TEMPORAL.items()) + " FROM f1)")
INTERACTION = {
    "temp_precip_interaction": "temperature*precipitation", "humidity_temp_interaction": "humidity*temperature",
    "forest_urban_ratio": "forest_cover/(urban_area+1e-3)", "ag_forest_ratio": "agricultural_area/(forest_cover+1e-3)",
    "species_forest_interaction": "species_count*forest_cover"}
INTERACTION_CTE = "f3 AS (SELECT f2.*, " + ", ".join(f"{e} AS {n}" for n, e in INTERACTION.items()) + " FROM f2)"
LAND_SUM = "(forest_cover+agricultural_area+urban_area+water_bodies)"
MM = "({c}-(SELECT min({c}) FROM combined))/((SELECT max({c}) FROM combined)-(SELECT min({c}) FROM combined))"
AGGREGATION = {
    "total_developed_area": LAND_SUM, "natural_area_ratio": f"(forest_cover+water_bodies)/({LAND_SUM}+1e-3)",
    "climate_favorability_index": "(" + "+".join(MM.format(c=c) for c in ("temperature", "precipitation", "humidity")) + ")/3e0",
    "total_species_richness": "CAST(species_count+endemic_species+threatened_species AS DOUBLE)",
    "endemic_ratio": "endemic_species/(species_count+1e-3)"}
AGGREGATION_CTE = "f4 AS (SELECT f3.*, " + ", ".join(f"{e} AS {n}" for n, e in AGGREGATION.items()) + " FROM f3)"
STRESS = "+".join(f"abs({c}-(SELECT quantile_cont({c}, 5e-1) FROM combined))/(SELECT stddev_samp({c}) FROM combined)"
                  for c in ("temperature", "precipitation"))
ECOLOGICAL = {
    "habitat_quality_index": "forest_cover*6e-1+water_bodies*3e-1-urban_area*4e-1",
    "fragmentation_index": "urban_area/(forest_cover+1e-3)", "climate_stress_index": STRESS,
    "threat_ratio": "threatened_species/(species_count+1e-3)", "human_pressure_index": "urban_area*7e-1+agricultural_area*3e-1"}
ECOLOGICAL_CTE = "f5 AS (SELECT f4.*, " + ", ".join(f"{e} AS {n}" for n, e in ECOLOGICAL.items()) + " FROM f4)"
NUMERIC = [*CLIMATE, *LAND, *SPECIES, *SPATIAL, "lat_bin", "lon_bin", *TEMPORAL_INT, *TEMPORAL, *INTERACTION, *AGGREGATION, *ECOLOGICAL]
STATISTICS = ["feature_mean", "feature_std", "feature_min", "feature_max", "feature_range", "feature_cv"]


def statistics_cte(source: str, columns: list[str], out: str) -> str:
    vals = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in columns) + "]"
    return (f"{out}0 AS (SELECT {source}.*, list_avg({vals}) AS feature_mean, list_stddev_samp({vals}) AS feature_std, "
            f"list_min({vals}) AS feature_min, list_max({vals}) AS feature_max FROM {source}), "
            f"{out} AS (SELECT *, feature_max-feature_min AS feature_range, feature_std/(feature_mean+1e-3) AS feature_cv FROM {out}0)")


@query("spatial_features", with_(*COMBINED_CTES, SPATIAL_CTE) + f"SELECT row_id, lat_bin, lon_bin, {RA(*SPATIAL)} FROM f1")
def spatial_features(spark, d):
    out = features.spatial_features(combined(spark, d).select("row_id", "latitude", "longitude"))
    return tidy(out.drop("latitude", "longitude"))


@query("temporal_features", with_(*COMBINED_CTES, SPATIAL_CTE, TEMPORAL_CTE)
       + f"SELECT row_id, {', '.join(TEMPORAL_INT)}, {RA(*TEMPORAL)} FROM f2")
def temporal_features(spark, d):
    return tidy(features.temporal_features(combined(spark, d).select("row_id", "obs_date"), "obs_date").drop("obs_date"))


@query("interaction_features", COMBINED_SQL + "SELECT row_id, " + ", ".join(f"{R(e)} AS {n}" for n, e in INTERACTION.items()) + " FROM combined")
def interaction_features(spark, d):
    return tidy(features.interaction_features(combined(spark, d)).select("row_id", *INTERACTION))


@query("aggregation_features", COMBINED_SQL + "SELECT row_id, " + ", ".join(f"{R(e)} AS {n}" for n, e in AGGREGATION.items()) + " FROM combined")
def aggregation_features(spark, d):
    return tidy(features.aggregation_features(combined(spark, d)).select("row_id", *AGGREGATION))


@query("ecological_features", COMBINED_SQL + "SELECT row_id, " + ", ".join(f"{R(e)} AS {n}" for n, e in ECOLOGICAL.items()) + " FROM combined")
def ecological_features(spark, d):
    return tidy(features.ecological_features(combined(spark, d)).select("row_id", *ECOLOGICAL))


@query("statistical_features", with_(*COMBINED_CTES, statistics_cte("combined", [*CLIMATE, *LAND, *SPECIES], "s"))
       + f"SELECT row_id, {RA(*STATISTICS)} FROM s")
def statistical_features(spark, d):
    return tidy(features.statistical_features(combined(spark, d), [*CLIMATE, *LAND, *SPECIES]).select("row_id", *STATISTICS))


@query("engineered_features", with_(*COMBINED_CTES, SPATIAL_CTE, TEMPORAL_CTE, INTERACTION_CTE, AGGREGATION_CTE, ECOLOGICAL_CTE,
                                    statistics_cte("f5", NUMERIC, "f6"))
       + f"SELECT row_id, lat_bin, lon_bin, {', '.join(TEMPORAL_INT)}, "
       + RA(*SPATIAL, *TEMPORAL, *INTERACTION, *AGGREGATION, *ECOLOGICAL, *STATISTICS) + " FROM f6")
def engineered_features(spark, d):
    table = combined(spark, d).withColumnRenamed("row_id", "id")  # id columns are no features
    out = features.engineer_features(table).withColumnRenamed("id", "row_id")
    return tidy(out.drop("latitude", "longitude", "obs_date", *CLIMATE, *LAND, *SPECIES))


@query("polynomial_features", COMBINED_SQL + "SELECT row_id, " + ", ".join(
    f'{R(e)} AS "{n}"' for n, e in {
        "temperature": "temperature", "forest_cover": "forest_cover", "urban_area": "urban_area",
        "temperature^2": "temperature*temperature", "temperature forest_cover": "temperature*forest_cover",
        "temperature urban_area": "temperature*urban_area", "forest_cover^2": "forest_cover*forest_cover",
        "forest_cover urban_area": "forest_cover*urban_area", "urban_area^2": "urban_area*urban_area"}.items()) + " FROM combined")
def polynomial_features(spark, d):
    table = combined(spark, d).select("row_id", "temperature", "forest_cover", "urban_area")
    return tidy(features.polynomial_features(table, ["temperature", "forest_cover", "urban_area"], 2))


BIO = "(species_count*5e-1+endemic_species*3e-1+threatened_species*2e-1)"
THREAT = ("((1-forest_cover)*3e-1 + urban_area*25e-2 + population_density/(SELECT max(population_density) FROM combined)*25e-2 "
          "+ threatened_species/(species_count+1e0)*2e-1)")
EXPLORATION = {
    "temp_forest_interaction": "temperature*forest_cover", "precip_forest_interaction": "precipitation*forest_cover",
    "humidity_forest_interaction": "humidity*forest_cover", "urban_temp_interaction": "urban_area*temperature",
    "urban_pop_interaction": "urban_area*population_density", "species_temp_interaction": "species_count*temperature",
    "species_precip_interaction": "species_count*precipitation", "non_forest_cover": "1-forest_cover",
    "total_developed": "urban_area+agricultural_area", "natural_area": "forest_cover+water_bodies",
    "endemic_to_total_species": "endemic_species/(species_count+1e0)", "threatened_to_total_species": "threatened_species/(species_count+1e0)",
    "temp_to_precip_ratio": "temperature/(precipitation+1)", "humidity_to_precip_ratio": "humidity/(precipitation+1)",
    "biodiversity_index": BIO, "temperature_stress": "abs(temperature-25)/10",
    "precipitation_anomaly": "abs(precipitation-(SELECT avg(precipitation) FROM combined))/(SELECT stddev_samp(precipitation) FROM combined)",
    "habitat_threat": THREAT, "conservation_priority": f"{BIO}*(1-{THREAT})",
    "habitat_quality": "least(greatest(forest_cover*5e-1+(1-urban_area)*3e-1+water_bodies/3e-1*2e-1, 0), 1)"}


@query("exploration_features", COMBINED_SQL + "SELECT row_id, " + ", ".join(f"{R(e)} AS {n}" for n, e in EXPLORATION.items())
       + " FROM combined")
def exploration_features(spark, d):
    return tidy(features.exploration_features(combined(spark, d)).select("row_id", *EXPLORATION))


# ---------------------------------------------------------------- risk

RISK_CTES = [*COMBINED_CTES,
             f"""parts AS (SELECT combined.*, ({STRESS})/2e0 AS stress, urban_area/(forest_cover+1e-2) AS frag,
  threatened_species/(species_count+1e-2) AS threat FROM combined)""",
             """spans AS (SELECT min(frag) AS f0, max(frag) AS f1, min(threat) AS t0, max(threat) AS t1,
  min(species_diversity) AS d0, max(species_diversity) AS d1 FROM parts)""",
             """rawrisk AS (SELECT parts.*, stress*3e-1 + coalesce((frag-f0)/nullif(f1-f0, 0), 0)*25e-2
  + coalesce((threat-t0)/nullif(t1-t0, 0), 0)*25e-2 + (1-coalesce((species_diversity-d0)/nullif(d1-d0, 0), 0))*2e-1 AS raw FROM parts, spans)""",
             """risk AS (SELECT rawrisk.*, (raw-(SELECT min(raw) FROM rawrisk))/((SELECT max(raw) FROM rawrisk)-(SELECT min(raw) FROM rawrisk))
  AS ecological_risk FROM rawrisk)"""]
RISK_SQL = with_(*RISK_CTES)


def risk_table(spark, d):
    return features.ecological_risk(combined(spark, d))


@query("ecological_risk_target", RISK_SQL + f"SELECT row_id, {R('ecological_risk')} AS ecological_risk FROM risk")
def ecological_risk_target(spark, d):
    return tidy(risk_table(spark, d).select("row_id", "ecological_risk"))


@query("risk_target_by_category", RISK_SQL + f"""
SELECT CASE WHEN ecological_risk < 3e-1 THEN 'low' WHEN ecological_risk < 6e-1 THEN 'medium' ELSE 'high' END AS risk_category,
  CAST(count(*) AS BIGINT) AS rows, {R('avg(ecological_risk)')} AS mean_risk, {R('avg(temperature)')} AS mean_temperature,
  {R('avg(forest_cover)')} AS mean_forest, {R('avg(species_count)')} AS mean_species FROM risk GROUP BY 1""")
def risk_target_by_category(spark, d):
    """Flagship: build the working set from the source tables, score it and summarise."""
    from greenlattice.session import materialize
    scored = features.ecological_risk(materialize(build_combined(spark, d)))
    return tidy(scored.groupBy(risk.risk_category(F.col("ecological_risk")).alias("risk_category")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("ecological_risk").alias("mean_risk"),
        F.avg("temperature").alias("mean_temperature"), F.avg("forest_cover").alias("mean_forest"),
        F.avg("species_count").alias("mean_species")))


@query("risk_categories", with_(t.OCCURRENCE_SQL) + """
, s AS (SELECT occ_id, (occ_id%101)/1e2 AS score FROM occurrence)
SELECT occ_id, CASE WHEN score < 3e-1 THEN 'low' WHEN score < 6e-1 THEN 'medium' ELSE 'high' END AS category,
  CASE WHEN score < 33e-2 THEN 'low' WHEN score < 66e-2 THEN 'medium' ELSE 'high' END AS zone_category,
  CASE WHEN score <= 0 THEN NULL WHEN score <= 33e-2 THEN 'Low' WHEN score <= 66e-2 THEN 'Medium' WHEN score <= 1 THEN 'High' END AS bin_category,
  CASE WHEN score >= 75e-2 THEN 'immediate_action' WHEN score >= 3e-1 THEN 'enhanced_monitoring' ELSE 'maintenance' END AS tier,
  CASE WHEN score > 6e-1 THEN 'red' WHEN score > 3e-1 THEN 'orange' ELSE 'green' END AS colour FROM s""")
def risk_categories(spark, d):
    s = F.col("score")
    table = t.occurrence(spark, d).select("occ_id", ((F.col("occ_id") % 101) / 1e2).alias("score"))
    return table.select("occ_id", risk.risk_category(s).alias("category"), risk.risk_category(s, 0.33, 0.66).alias("zone_category"),
                        risk.risk_bins(s).alias("bin_category"), risk.action_tier(s).alias("tier"),
                        risk.marker_colour(s).alias("colour"))


@query("code_names", with_(t.OCCURRENCE_SQL) + f"""
SELECT conservation_status, CAST(CASE conservation_status WHEN 'LC' THEN 0 WHEN 'NT' THEN 1 WHEN 'VU' THEN 2 WHEN 'EN' THEN 3 WHEN 'CR' THEN 4
  WHEN 'EW' THEN 5 WHEN 'EX' THEN 6 END AS INT) AS score, CASE conservation_status WHEN 'LC' THEN 'Least Concern' WHEN 'NT' THEN 'Near Threatened'
  WHEN 'VU' THEN 'Vulnerable' WHEN 'EN' THEN 'Endangered' WHEN 'CR' THEN 'Critically Endangered' WHEN 'EW' THEN 'Extinct in Wild'
  WHEN 'EX' THEN 'Extinct' END AS name, CAST(count(*) AS BIGINT) AS n FROM occurrence GROUP BY conservation_status""")
def code_names(spark, d):
    s = F.col("conservation_status")
    return t.occurrence(spark, d).groupBy(s).agg(F.count(F.lit(1)).alias("n")).select(
        s, iucn_score(s).alias("score"), iucn_name(s).alias("name"), "n")


TRAIN_RISK = ("least(greatest((1-forest_cover)*3e-1 + urban_area*2e-1 + {t}/10*15e-2 + 1e-1/(species_count+1) "
              "+ population_density/1e3*1e-1, 0), 1)")


@query("training_risk_targets", COMBINED_SQL + f"""SELECT row_id, {R(TRAIN_RISK.format(t='(temperature-25)'))} AS signed_risk,
  {R(TRAIN_RISK.format(t='abs(temperature-25)'))} AS absolute_risk FROM combined""")
def training_risk_targets(spark, d):
    return tidy(combined(spark, d).select("row_id", features.training_risk(True).alias("signed_risk"),
                                          features.training_risk(False).alias("absolute_risk")))


@query("occurrence_risk_proxy", with_(t.OCCURRENCE_SQL) + f"""
, y AS (SELECT occ_id, species_name, CAST(1990 + occ_id%36 AS INT) AS year FROM occurrence),
f AS (SELECT species_name, count(*) AS frequency FROM y GROUP BY ALL),
x AS (SELECT y.*, frequency, greatest(2025-year, 0) AS age FROM y JOIN f USING (species_name)),
s AS (SELECT min(frequency) AS f0, max(frequency) AS f1, min(age) AS a0, max(age) AS a1 FROM x)
SELECT occ_id, CAST(frequency AS BIGINT) AS frequency, {R('1-(frequency-f0)/greatest(f1-f0, 1)')} AS rarity, {R('(age-a0)/greatest(a1-a0, 1)')} AS recency,
  {R('least(greatest((1-(frequency-f0)/greatest(f1-f0, 1))*6e-1 + (age-a0)/greatest(a1-a0, 1)*4e-1, 0), 1)')} AS risk_score FROM x, s""")
def occurrence_risk_proxy(spark, d):
    table = t.occurrence(spark, d).selectExpr("occ_id", "species_name", "CAST(1990 + occ_id%36 AS INT) AS year")
    out = features.occurrence_risk(table, 2025)
    return tidy(out.select("occ_id", "frequency", "rarity", "recency", "risk_score"))


# ---------------------------------------------------------------- scaling

def scale_sql(centre: str, scale: str) -> str:
    parts = []
    for c in CLIMATE_VARIABLES:
        m, s = centre.format(c=c), scale.format(c=c)
        parts.append(f"{R(f'({c}-(SELECT {m} FROM climate))/(SELECT CASE WHEN {s}=0 THEN 1 ELSE {s} END FROM climate)')} AS {c}")
    return with_(t.CLIMATE_SQL) + "SELECT l_orderkey, l_linenumber, " + ", ".join(parts) + " FROM climate"


def _scaled(spark, d, method):
    table = t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", *CLIMATE_VARIABLES)
    return tidy(scaling.fit_scaler(table, method, CLIMATE_VARIABLES).transform(table))


@query("scale_standard", scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, d):
    return _scaled(spark, d, "standard")


@query("scale_minmax", scale_sql("min({c})", "(max({c})-min({c}))"))
def scale_minmax(spark, d):
    return _scaled(spark, d, "minmax")


@query("scale_robust", scale_sql("quantile_cont({c}, 5e-1)", "(quantile_cont({c}, 75e-2)-quantile_cont({c}, 25e-2))"))
def scale_robust(spark, d):
    return _scaled(spark, d, "robust")


@query("scale_inverse", with_(t.CLIMATE_SQL) + f"SELECT l_orderkey, l_linenumber, {RA(*CLIMATE_VARIABLES)} FROM climate")
def scale_inverse(spark, d):
    table = t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", *CLIMATE_VARIABLES)
    fitted = scaling.fit_scaler(table, "robust", CLIMATE_VARIABLES)
    restored = scaling.Scaler.from_table("robust", fitted.table(spark))
    return tidy(restored.inverse(fitted.transform(table)))


@query("scale_fit_train_apply_test", with_(t.CLIMATE_SQL) + f"""
, tr AS (SELECT avg(temperature) AS m, stddev_pop(temperature) AS s FROM climate WHERE obs_date < DATE '1999-01-01')
SELECT l_orderkey, l_linenumber, {R('(temperature-m)/s')} AS temperature FROM climate, tr WHERE obs_date >= DATE '1999-01-01'""")
def scale_fit_train_apply_test(spark, d):
    table = t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", "obs_date", "temperature")
    cut = F.lit("1999-01-01").cast("date")
    fitted = scaling.fit_scaler(table.where(F.col("obs_date") < cut), "standard", ["temperature"])
    return tidy(fitted.transform(table.where(F.col("obs_date") >= cut)).drop("obs_date"))


@query("scale_domain_ranges", with_(t.CLIMATE_SQL) + f"""
, s AS (SELECT min(precipitation) AS p0, max(precipitation) AS p1 FROM climate)
SELECT l_orderkey, l_linenumber, {R('(temperature+10)/(60+1e-8)')} AS temperature, {R('(precipitation-p0)/(p1-p0+1e-8)')} AS precipitation FROM climate, s""")
def scale_domain_ranges(spark, d):
    table = t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", "temperature", "precipitation")
    fitted = scaling.fit_domain_scaler(table, ["temperature", "precipitation"], "minmax", {"temperature": (-10.0, 50.0)})
    return tidy(fitted.transform(table))


@query("min_max_column", with_(t.CLIMATE_SQL) + f"""
SELECT l_orderkey, l_linenumber, {R('(wind_speed-(SELECT min(wind_speed) FROM climate))/(SELECT max(wind_speed)-min(wind_speed) FROM climate)')} AS wind_speed FROM climate""")
def min_max_column(spark, d):
    return tidy(scaling.min_max_column(t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", "wind_speed"), "wind_speed"))


def group_sql(centre: str, scale: str) -> str:
    return with_(t.CLIMATE_SQL) + f""", g AS (SELECT latitude, {centre} AS m, {scale} AS s FROM climate GROUP BY latitude)
SELECT l_orderkey, l_linenumber, {R('(temperature-m)/CASE WHEN s=0 THEN 1 ELSE s END')} AS temperature FROM climate JOIN g USING (latitude)"""


def _grouped(spark, d, method):
    table = t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", "latitude", "temperature")
    return tidy(scaling.normalize_by_groups(table, "latitude", ["temperature"], method).drop("latitude"))


@query("scale_groups_standard", group_sql("avg(temperature)", "stddev_pop(temperature)"))
def scale_groups_standard(spark, d):
    return _grouped(spark, d, "standard")


@query("scale_groups_minmax", group_sql("min(temperature)", "max(temperature)-min(temperature)"))
def scale_groups_minmax(spark, d):
    return _grouped(spark, d, "minmax")


@query("scale_groups_robust", group_sql("quantile_cont(temperature, 5e-1)", "quantile_cont(temperature, 75e-2)-quantile_cont(temperature, 25e-2)"))
def scale_groups_robust(spark, d):
    return _grouped(spark, d, "robust")


SHARES = "[" + ", ".join(repr(i / 999) for i in range(1000)) + "]"


@query("quantile_uniform", with_(t.CLIMATE_SQL) + f"""
, q AS (SELECT unnest(quantile_cont(precipitation, {SHARES})) AS v, unnest({SHARES}) AS p FROM climate),
m AS (SELECT v, min(p) AS p0, max(p) AS p1 FROM q GROUP BY v),
n AS (SELECT v, p0, p1, lead(v) OVER (ORDER BY v) AS v2, lead(p0) OVER (ORDER BY v) AS p2 FROM m)
SELECT l_orderkey, l_linenumber, {R('CASE WHEN precipitation <= (SELECT min(v) FROM m) THEN 0 WHEN precipitation >= (SELECT max(v) FROM m) THEN 1 WHEN precipitation = v THEN (p0+p1)/2 ELSE p1+(p2-p1)*(precipitation-v)/(v2-v) END')} AS precipitation
FROM climate ASOF JOIN n ON precipitation >= v""")
def quantile_uniform(spark, d):
    table = t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", "precipitation")
    return tidy(scaling.fit_quantile_map(table, ["precipitation"]).transform(table))


@query("quantile_normal")
def quantile_normal(spark, d):
    table = t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", "precipitation")
    return tidy(scaling.fit_quantile_map(table, ["precipitation"]).transform(table, "normal"))


@query("log_shift_transform", with_(t.CLIMATE_SQL) + f"""
SELECT l_orderkey, l_linenumber, {R('ln(1+precipitation+(SELECT CASE WHEN min(precipitation)<=0 THEN abs(min(precipitation))+1 ELSE 0 END FROM climate))')} AS precipitation,
  {R('ln(1+temperature)')} AS temperature FROM climate""")
def log_shift_transform(spark, d):
    table = t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", "precipitation", "temperature")
    return tidy(scaling.log_transform(table, ["precipitation", "temperature"]))


@query("power_transform_yeo_johnson")
def power_transform_yeo_johnson(spark, d):
    table = t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", "precipitation", "wind_speed")
    return tidy(scaling.power_transform(table, ["precipitation", "wind_speed"], "yeo-johnson"), 3)


@query("power_transform_box_cox")
def power_transform_box_cox(spark, d):
    table = t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", "temperature")
    return tidy(scaling.power_transform(table, ["temperature"], "box-cox"), 3)


@query("skew_correction")
def skew_correction(spark, d):
    table = combined(spark, d).select(F.col("row_id").alias("id"), "precipitation", "urban_area", "population_density", "species_count")
    return tidy(scaling.handle_skew(table), 3)


# ---------------------------------------------------------------- ranks

@query("percentile_rank", with_(t.CLIMATE_SQL) + f"""
SELECT l_orderkey, l_linenumber, {R('(rank() OVER (ORDER BY temperature) + (count(*) OVER (PARTITION BY temperature)-1)/2e0)/(SELECT count(temperature) FROM climate)')} AS temperature_rank
FROM climate""")
def percentile_rank(spark, d):
    table = t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", "temperature")
    return tidy(ranking.average_rank(table, "temperature", "temperature_rank", percent=True).drop("temperature"))


@query("average_rank_by_place", with_(t.CLIMATE_SQL) + f"""
SELECT l_orderkey, l_linenumber, {R('rank() OVER (PARTITION BY latitude ORDER BY temperature DESC) + (count(*) OVER (PARTITION BY latitude, temperature)-1)/2e0')} AS temperature_rank
FROM climate""")
def average_rank_by_place(spark, d):
    table = t.climate_daily(spark, d).select("l_orderkey", "l_linenumber", "latitude", "temperature")
    return tidy(ranking.average_rank(table, "temperature", "temperature_rank", ["latitude"], descending=True)
                .drop("temperature", "latitude"))


# ---------------------------------------------------------------- selection

SELECT_FEATURES = ["temperature", "precipitation", "forest_cover", "urban_area", "species_count", "population_density", "slope"]


@query("select_k_best", with_(*RISK_CTES) + "SELECT feature, " + R("r*r/(1-r*r)*(n-2)", 3) + " AS score FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, ecological_risk) AS r, count(*) AS n FROM risk" for c in SELECT_FEATURES)
    + ") ORDER BY r*r DESC LIMIT 5")
def select_k_best(spark, d):
    return tidy(selection.select_features(risk_table(spark, d), "ecological_risk", SELECT_FEATURES, 5), 3)


@query("feature_scores", with_(*RISK_CTES) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT {R(f'corr({c}, ecological_risk)')} FROM risk) AS correlation" for c in SELECT_FEATURES))
def feature_scores(spark, d):
    return tidy(stats.correlation_with_target(risk_table(spark, d), "ecological_risk", SELECT_FEATURES).select("feature", "correlation"))


MI_COLUMNS = ["precipitation", "wind_speed"]


def _mi_bin(c: str) -> str:
    cuts = f"list_distinct((SELECT quantile_cont({c}, [1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1]) FROM w))"
    return f"len(list_filter({cuts}, lambda e: {c} > e))"


@query("mutual_information", with_(t.CLIMATE_SQL) + ", w AS (SELECT temperature, precipitation, wind_speed FROM climate), "
       + "b AS (SELECT " + ", ".join(f"{_mi_bin(c)} AS {c}" for c in ["temperature", *MI_COLUMNS]) + " FROM w), "
       + "j AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS tx, temperature AS ty, count(*) AS n FROM b GROUP BY ALL" for c in MI_COLUMNS) + ") "
       + f"""SELECT feature, {R('greatest(sum(n*1e0/total*ln(n*1e0*total/(nx*ny))), 0)')} AS score FROM (SELECT *, sum(n) OVER (PARTITION BY feature, tx) AS nx,
  sum(n) OVER (PARTITION BY feature, ty) AS ny, sum(n) OVER (PARTITION BY feature) AS total FROM j) GROUP BY feature""")
def mutual_information(spark, d):
    return tidy(selection.binned_mutual_information(t.climate_daily(spark, d), "temperature", MI_COLUMNS))


@query("principal_components")
def principal_components(spark, d):
    table = combined(spark, d).select("row_id", "temperature", "humidity", "wind_speed", "forest_cover", "urban_area")
    projected, _ = selection.apply_pca(table, ["temperature", "humidity", "wind_speed", "forest_cover", "urban_area"])
    # Signs are arbitrary: magnitudes are stable.
    return projected.select("row_id", *[rounded(F.abs(c)).alias(c) for c in projected.columns if c != "row_id"])


@query("landuse_share_normalisation", with_(t.LANDUSE_SQL) + ", x AS (SELECT land_id, " + ", ".join(
    f"{c}*{w} AS {c}" for c, w in zip(LANDUSE_SHARES, ("2e0", "3e0", "4e0", "5e0"))) + f""" FROM landuse)
SELECT land_id, {', '.join(R(f'CASE WHEN {LAND_SUM} > 1 THEN {c}/{LAND_SUM} ELSE {c} END') + ' AS ' + c for c in LANDUSE_SHARES)} FROM x""")
def landuse_share_normalisation(spark, d):
    from greenlattice.operators.landuse import normalise_shares
    table = t.landuse(spark, d).select("land_id", *[(F.col(c) * w).alias(c) for c, w in zip(LANDUSE_SHARES, (2.0, 3.0, 4.0, 5.0))])
    return tidy(normalise_shares(table, LANDUSE_SHARES))
