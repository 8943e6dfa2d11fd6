"""Aggregates, rankings, metrics, folds and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from greenlattice.functions import risk
from greenlattice.functions.numeric import rounded, scatter_key, tidy
from greenlattice.operators import metrics, reports, splits, stats
from greenlattice.operators.climate import aggregate_monthly
from greenlattice.plans.combined import COMBINED_SQL, combined
from greenlattice.plans.feature_queries import RISK_CTES, RISK_SQL, risk_table
from greenlattice.plans.registry import R, RA, query, with_
from greenlattice.schemas import CLIMATE_VARIABLES, LANDUSE_SHARES
from greenlattice.sources import tables as t

# ---------------------------------------------------------------- descriptive aggregates


def union_sql(columns, template):
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query("describe_climate", with_(t.CLIMATE_SQL) + union_sql(CLIMATE_VARIABLES, "SELECT '{c}' AS feature, CAST(count({c}) AS BIGINT) AS count, "
       + ", ".join(f"{R(e)} AS {n}" for n, e in {
           "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "q25": "quantile_cont({c}, 25e-2)",
           "q50": "quantile_cont({c}, 5e-1)", "q75": "quantile_cont({c}, 75e-2)", "max": "max({c})"}.items()) + " FROM climate"))
def describe_climate(spark, d):
    return tidy(stats.describe(t.climate_daily(spark, d), CLIMATE_VARIABLES))


LEVEL_SQL = """CASE WHEN abs(skewness) > 2 THEN '{0}' WHEN abs(skewness) > 1 THEN '{1}' WHEN abs(skewness) > 5e-1 THEN '{2}' ELSE '{3}' END"""


@query("distribution_summary", with_(t.LANDUSE_SQL) + f"""
SELECT feature, {RA('mean', 'std', 'min', 'max', 'skewness', 'kurtosis')},
  {LEVEL_SQL.format('highly_skewed', 'moderately_skewed', 'mildly_skewed', 'normal')} AS level,
  {LEVEL_SQL.format('power_transform', 'log_transform', 'quantile_transform', 'standard_scaling')} AS recommendation FROM ("""
       + union_sql(["forest_cover", "urban_area", "rare"], "SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis "
                   "FROM (SELECT *, exp(population_density/2e2) AS rare FROM landuse)") + ")")
def distribution_summary(spark, d):
    table = t.landuse(spark, d).withColumn("rare", F.exp(F.col("population_density") / 200.0))
    return tidy(stats.distribution_summary(table, ["forest_cover", "urban_area", "rare"]))


@query("missing_counts", with_(t.CLIMATE_SQL) + union_sql(CLIMATE_VARIABLES, "SELECT '{c}' AS feature, CAST(count(*)-count({c}) AS BIGINT) AS missing FROM climate"))
def missing_counts(spark, d):
    return stats.missing_counts(t.climate_daily(spark, d).select(*CLIMATE_VARIABLES))


CORR = ["temperature", "precipitation", "forest_cover", "urban_area", "species_count"]


@query("correlation_matrix", COMBINED_SQL + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, " + (R(f"(SELECT corr({a}, {b}) FROM combined)") if a != b else "1e0") + " AS correlation"
    for a in CORR for b in CORR))
def correlation_matrix(spark, d):
    return tidy(stats.correlation_matrix(combined(spark, d), CORR))


@query("linear_trends", COMBINED_SQL + union_sql(["temperature", "precipitation"],
       f"SELECT '{{c}}' AS feature, {R('regr_slope({c}, m)')} AS slope, {R('regr_intercept({c}, m)')} AS intercept "
       "FROM (SELECT temperature, precipitation, year(obs_date)*12+month(obs_date)-24000 AS m FROM combined)"))
def linear_trends(spark, d):
    table = combined(spark, d).withColumn("m", F.year("obs_date") * 12 + F.month("obs_date") - 24000)
    return tidy(stats.linear_trend(table, "m", ["temperature", "precipitation"]))


@query("species_frequency", with_(t.OCCURRENCE_SQL) + "SELECT species_name, CAST(count(*) AS BIGINT) AS n FROM occurrence GROUP BY species_name")
def species_frequency(spark, d):
    return stats.value_counts(t.occurrence(spark, d), "species_name")


@query("occurrence_frequency_join", with_(t.OCCURRENCE_SQL) + "SELECT occ_id, CAST(count(*) OVER (PARTITION BY species_name) AS BIGINT) AS frequency FROM occurrence")
def occurrence_frequency_join(spark, d):
    occ = t.occurrence(spark, d).select("occ_id", "species_name")
    return occ.join(stats.value_counts(occ, "species_name"), "species_name", "left").select("occ_id", F.col("n").alias("frequency"))


@query("status_shares", with_(t.OCCURRENCE_SQL) + f"""SELECT conservation_status, CAST(count(*) AS BIGINT) AS n,
  {R('count(*)*1e2/sum(count(*)) OVER ()')} AS pct FROM occurrence GROUP BY conservation_status""")
def status_shares(spark, d):
    return tidy(stats.shares(t.occurrence(spark, d), "conservation_status"))


@query("status_by_record_kind", with_(t.OCCURRENCE_SQL) + ", c AS (SELECT coalesce(basis_of_record, 'All') AS basis_of_record, coalesce(conservation_status, 'All') AS s, count(*) AS n "
       "FROM occurrence GROUP BY CUBE (basis_of_record, conservation_status)) SELECT basis_of_record, "
       + ", ".join(f"CAST(coalesce(sum(CASE WHEN s = '{v}' THEN n END), 0) AS BIGINT) AS \"{v}\"" for v in ("LC", "NT", "VU", "All")) + " FROM c GROUP BY basis_of_record")
def status_by_record_kind(spark, d):
    return stats.crosstab(t.occurrence(spark, d), "basis_of_record", "conservation_status", ["LC", "NT", "VU"])


@query("temperature_histogram", with_(t.CLIMATE_SQL) + f""", r AS (SELECT min(temperature) AS lo, (max(temperature)-min(temperature))/20 AS w FROM climate)
SELECT CAST(least(floor((temperature-lo)/w), 19) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n, {R('min(lo)+least(floor((temperature-lo)/w), 19)*min(w)')} AS bin_start,
  {R('min(lo)+(least(floor((temperature-lo)/w), 19)+1)*min(w)')} AS bin_end FROM climate, r GROUP BY least(floor((temperature-lo)/w), 19)""")
def temperature_histogram(spark, d):
    return tidy(stats.histogram(t.climate_daily(spark, d), "temperature", 20))


@query("risk_histogram_by_category", RISK_SQL + """, c AS (SELECT *, CASE WHEN ecological_risk < 3e-1 THEN 'low' WHEN ecological_risk < 6e-1 THEN 'medium' ELSE 'high' END AS risk_category,
  (SELECT min(temperature) FROM risk) AS lo, (SELECT (max(temperature)-min(temperature))/15 FROM risk) AS w FROM risk)
SELECT risk_category, CAST(least(floor((temperature-lo)/w), 14) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ALL""")
def risk_histogram_by_category(spark, d):
    table = risk_table(spark, d).withColumn("risk_category", risk.risk_category(F.col("ecological_risk")))
    return stats.histogram(table, "temperature", 15, ["risk_category"]).select("risk_category", "bin", "n")


@query("risk_category_summary", RISK_SQL + "SELECT CASE WHEN ecological_risk < 3e-1 THEN 'low' WHEN ecological_risk < 6e-1 THEN 'medium' ELSE 'high' END AS risk_category, "
       + ", ".join(f"{R(f'avg({c})', 3)} AS {c}_mean, {R(f'stddev_samp({c})', 3)} AS {c}_std" for c in ("temperature", "forest_cover", "urban_area", "species_count", "humidity", "ecological_risk")) + " FROM risk GROUP BY 1")
def risk_category_summary(spark, d):
    table = risk_table(spark, d)
    return tidy(table.groupBy(risk.risk_category(F.col("ecological_risk")).alias("risk_category")).agg(*[x for c in (
        "temperature", "forest_cover", "urban_area", "species_count", "humidity", "ecological_risk") for x in (
        F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]), 3)


@query("box_summary_by_status", with_(t.OCCURRENCE_SQL) + "SELECT conservation_status, " + ", ".join(
    f"{R(f'quantile_cont(latitude, {p})')} AS {n}" for n, p in (("low", "0e0"), ("q1", "25e-2"), ("median", "5e-1"), ("q3", "75e-2"), ("high", "1e0"))) + " FROM occurrence GROUP BY conservation_status")
def box_summary_by_status(spark, d):
    return tidy(stats.box_summary(t.occurrence(spark, d), "conservation_status", "latitude"))


@query("grouped_statistics", with_(t.CLIMATE_SQL) + f"""SELECT ix, iy, CAST(count(humidity) AS BIGINT) AS count, {R('avg(humidity)')} AS mean,
  {R('stddev_samp(humidity)')} AS std, {R('min(humidity)')} AS min, {R('max(humidity)')} AS max FROM climate GROUP BY ix, iy""")
def grouped_statistics(spark, d):
    table = t.climate_daily(spark, d).withColumn("cell", F.struct("ix", "iy"))
    return tidy(stats.grouped_stats(table, "cell", "humidity").select("cell.ix", "cell.iy", "count", "mean", "std", "min", "max"))


@query("overall_statistics", with_(t.CLIMATE_SQL) + f"""SELECT CAST(count(*) AS BIGINT) AS count, {R('avg(humidity)')} AS mean,
  {R('stddev_samp(humidity)')} AS std, {R('min(humidity)')} AS min, {R('max(humidity)')} AS max, {R('median(humidity)')} AS median FROM climate""")
def overall_statistics(spark, d):
    return tidy(stats.overall_stats(t.climate_daily(spark, d), "humidity"))


@query("landuse_composition", with_(t.LANDUSE_SQL) + "SELECT " + ", ".join(f"{R(f'avg({c})')} AS {c}" for c in LANDUSE_SHARES) + " FROM landuse")
def landuse_composition(spark, d):
    return tidy(t.landuse(spark, d).agg(*[F.avg(c).alias(c) for c in LANDUSE_SHARES]))


CONTRAST = ["temperature", "forest_cover", "urban_area", "population_density"]


@query("hotspot_contrast", RISK_SQL + ", q AS (SELECT quantile_cont(ecological_risk, 75e-2) AS cut FROM risk) " + union_sql(CONTRAST,
       f"SELECT '{{c}}' AS feature, {R('avg(CASE WHEN ecological_risk >= cut - 1e-12 THEN {c} END)')} AS hotspot_mean, {R('avg({c})')} AS overall_mean, "
       f"{R('avg(CASE WHEN ecological_risk >= cut - 1e-12 THEN {c} END)-avg({c})')} AS difference FROM risk, q"))
def hotspot_contrast(spark, d):
    return tidy(stats.hotspot_contrast(risk_table(spark, d), "ecological_risk", 75.0, CONTRAST))


@query("key_figures", RISK_SQL + f""", k AS (SELECT avg(ecological_risk) AS avg_risk, sum(CASE WHEN ecological_risk >= 6e-1 THEN 1 ELSE 0 END) AS high_risk,
  avg(species_count) AS avg_species, avg(forest_cover) AS avg_forest FROM risk)
SELECT {RA('avg_risk', 'avg_species', 'avg_forest')}, CAST(high_risk AS BIGINT) AS high_risk, {R('avg_risk-35e-2')} AS avg_risk_delta,
  {R('high_risk-15')} AS high_risk_delta, {R('avg_species-15')} AS avg_species_delta, {R('avg_forest-5e-1')} AS avg_forest_delta FROM k""")
def key_figures(spark, d):
    table = risk_table(spark, d).withColumnRenamed("ecological_risk", "risk_score")
    return tidy(reports.key_figures(table.withColumn("risk_category", risk.risk_category(F.col("risk_score")))))


@query("species_and_climate_figures", COMBINED_SQL + f"""SELECT CAST(sum(species_count) AS BIGINT) AS species_total, {R('avg(species_count)')} AS species_mean,
  CAST(max(species_count) AS BIGINT) AS species_max, {R('avg(temperature)')} AS temperature_mean, {R('avg(precipitation)')} AS precipitation_mean FROM combined""")
def species_and_climate_figures(spark, d):
    return tidy(combined(spark, d).agg(
        F.sum("species_count").alias("species_total"), F.avg("species_count").alias("species_mean"),
        F.max("species_count").alias("species_max"), F.avg("temperature").alias("temperature_mean"),
        F.avg("precipitation").alias("precipitation_mean")))


# ---------------------------------------------------------------- filters, top-k, samples

@query("explorer_filter", RISK_SQL + f"""SELECT row_id, {R('ecological_risk')} AS ecological_risk, species_count, {R('forest_cover')} AS forest_cover
FROM risk WHERE ecological_risk >= 3e-1 AND ecological_risk < 6e-1 AND species_count >= 5 AND forest_cover >= 2e-1""")
def explorer_filter(spark, d):
    table = risk_table(spark, d).withColumn("risk_category", risk.risk_category(F.col("ecological_risk")))
    kept = table.where((F.col("risk_category") == "medium") & (F.col("species_count") >= 5) & (F.col("forest_cover") >= 0.2))
    return tidy(kept.select("row_id", "ecological_risk", "species_count", "forest_cover"))


@query("explorer_count", RISK_SQL + """SELECT CAST(count(*) AS BIGINT) AS matches FROM risk WHERE ecological_risk >= 3e-1 AND ecological_risk < 6e-1 AND species_count >= 5 AND forest_cover >= 2e-1""")
def explorer_count(spark, d):
    return explorer_filter(spark, d).agg(F.count(F.lit(1)).alias("matches"))


@query("top_species_places", COMBINED_SQL + f"SELECT row_id, species_count, {RA('latitude', 'longitude')} FROM combined ORDER BY species_count DESC, row_id LIMIT 10")
def top_species_places(spark, d):
    return tidy(combined(spark, d).orderBy(F.desc("species_count"), "row_id").limit(10).select("row_id", "species_count", "latitude", "longitude"))


@query("top_risk_places", RISK_SQL + f"SELECT row_id, {R('ecological_risk')} AS ecological_risk FROM risk ORDER BY round(ecological_risk, 9) DESC, row_id LIMIT 10")
def top_risk_places(spark, d):
    return tidy(risk_table(spark, d).orderBy(F.desc(F.round("ecological_risk", 9)), "row_id").limit(10).select("row_id", "ecological_risk"))


@query("scatter_sample", with_(t.OCCURRENCE_SQL) + "SELECT occ_id, species_name FROM occurrence ORDER BY (occ_id*2654435761) % 4294967296 LIMIT 1000")
def scatter_sample(spark, d):
    return splits.downsample(t.occurrence(spark, d).select("occ_id", "species_name"), "occ_id", 1000)


@query("latest_records_in_bounds", with_(t.OCCURRENCE_SQL) + f"""SELECT occ_id, species_name, {RA('latitude', 'longitude')} FROM occurrence
WHERE longitude BETWEEN 73e0 AND 78e0 AND latitude BETWEEN 16e0 AND 20e0 AND basis_of_record IN ('view', 'purchase', 'click')""")
def latest_records_in_bounds(spark, d):
    from greenlattice.sources.landed import fetch_occurrences
    return tidy(fetch_occurrences(t.occurrence(spark, d), (73.0, 16.0, 78.0, 20.0), ["view", "purchase", "click"])
                .select("occ_id", "species_name", "latitude", "longitude"))


@query("flattened_records", with_(t.OCCURRENCE_SQL) + f""", j AS (SELECT occ_id, observed_at, species_name, latitude, longitude FROM occurrence)
SELECT occ_id, CASE occ_id%3 WHEN 0 THEN species_name WHEN 1 THEN concat(species_name, ' L.') ELSE 'Unknown' END AS species_name, {RA('latitude', 'longitude')},
  CAST(CASE WHEN occ_id%4 = 0 THEN year(observed_at) WHEN occ_id%4 = 1 THEN year(observed_at) WHEN occ_id%4 = 2 AND occ_id%2 = 0 THEN 2001 ELSE NULL END AS INT) AS year
FROM j WHERE occ_id % 29 <> 0""")
def flattened_records(spark, d):
    """Records landed as JSON text (dates as day, interval, broken or absent) flattened to columns."""
    from greenlattice.sources.landed import flatten_records
    day = F.date_format("observed_at", "yyyy-MM-dd")
    text = t.occurrence(spark, d).select("occ_id", F.to_json(F.struct(
        F.when(F.col("occ_id") % 29 != 0, F.col("latitude")).alias("decimalLatitude"), F.col("longitude").alias("decimalLongitude"),
        F.when(F.col("occ_id") % 3 == 0, F.col("species_name")).alias("species"),
        F.when(F.col("occ_id") % 3 == 1, F.concat("species_name", F.lit(" L."))).alias("scientificName"),
        F.when(F.col("occ_id") % 4 == 0, day).when(F.col("occ_id") % 4 == 1, F.concat(day, F.lit("/2024-12-31")))
        .when(F.col("occ_id") % 4 == 2, F.lit("spring")).alias("eventDate"),
        F.lit("2001").alias("year"))).alias("value"))
    return tidy(flatten_records(text, "value", ["occ_id"]).select("occ_id", "species_name", "latitude", "longitude", "year"))


# ---------------------------------------------------------------- folds

KEY = "(row_id*2654435761) % 4294967296"


@query("train_test_split", COMBINED_SQL + f""", k AS (SELECT row_id, row_number() OVER (ORDER BY {KEY}) AS i, count(*) OVER () AS n FROM combined)
SELECT row_id, CASE WHEN i <= ceil(n*2e-1) THEN 'test' WHEN i <= ceil(n*2e-1) + ceil((n-ceil(n*2e-1))*2e-1) THEN 'validation' ELSE 'train' END AS split FROM k""")
def train_test_split(spark, d):
    return splits.train_test_labels(combined(spark, d).select("row_id"), "row_id", 0.2, 0.2)


@query("kfold_assignment", COMBINED_SQL + f""", k AS (SELECT row_id, row_number() OVER (ORDER BY {KEY}) - 1 AS i, count(*) OVER () AS n FROM combined)
SELECT row_id, CAST(CASE WHEN i < (n%5)*(floor(n/5e0)+1) THEN floor(i/(floor(n/5e0)+1)) ELSE n%5 + floor((i-(n%5)*(floor(n/5e0)+1))/floor(n/5e0)) END AS INT) AS fold FROM k""")
def kfold_assignment(spark, d):
    return splits.kfold(combined(spark, d).select("row_id"), "row_id", 5)


@query("stratified_folds", with_(t.OCCURRENCE_SQL) + """SELECT occ_id, conservation_status, CAST((row_number() OVER (PARTITION BY conservation_status
  ORDER BY (occ_id*2654435761) % 4294967296) - 1) % 5 AS INT) AS fold FROM occurrence""")
def stratified_folds(spark, d):
    return splits.stratified_kfold(t.occurrence(spark, d).select("occ_id", "conservation_status"), "occ_id", "conservation_status", 5)


@query("time_series_folds", COMBINED_SQL + """, k AS (SELECT row_id, row_number() OVER (ORDER BY obs_date, row_id) - 1 AS i, count(*) OVER () AS n FROM combined)
SELECT row_id, CAST(CASE WHEN i < n - floor(n/6e0)*5 THEN 0 ELSE floor((i-(n-floor(n/6e0)*5))/floor(n/6e0)) + 1 END AS INT) AS block FROM k""")
def time_series_folds(spark, d):
    return splits.time_series_block(combined(spark, d).select("row_id", "obs_date"), "obs_date", "row_id", 5).select("row_id", "block")


# ---------------------------------------------------------------- metrics on a deterministic prediction

PRED = "least(greatest(15e-2 + 6e-1*actual + ((row_id%11)-5)/5e1, 0), 1)"
SCORED_CTES = [*RISK_CTES, "act AS (SELECT *, round(ecological_risk, 9) AS actual FROM risk)", f"scored AS (SELECT *, {PRED} AS predicted FROM act)"]
SCORED_SQL = with_(*SCORED_CTES)
CAT = "CASE WHEN {c} < 3e-1 THEN 'low' WHEN {c} < 6e-1 THEN 'medium' ELSE 'high' END"


def scored_table(spark, d):
    """Risk target with a simple closed-form prediction beside it."""
    wobble = ((F.col("row_id") % 11) - 5) / 50.0
    return risk_table(spark, d).withColumn("actual", F.round("ecological_risk", 9)).withColumn(
        "predicted", F.least(F.greatest(F.lit(0.15) + F.col("actual") * 0.6 + wobble, F.lit(0.0)), F.lit(1.0)))


def categorised(spark, d):
    return scored_table(spark, d).withColumns({
        "actual_category": risk.risk_category(F.col("actual")), "predicted_category": risk.risk_category(F.col("predicted"))})


CATEGORISED_SQL = with_(*SCORED_CTES, f"categorised AS (SELECT *, {CAT.format(c='actual')} AS actual_category, {CAT.format(c='predicted')} AS predicted_category FROM scored)")
ERR = "(actual-predicted)"
METRIC_SQL = {
    "mse": f"avg({ERR}*{ERR})", "rmse": f"sqrt(avg({ERR}*{ERR}))", "mae": f"avg(abs({ERR}))",
    "r2": f"1-sum({ERR}*{ERR})/(var_pop(actual)*count(*))", "explained_variance": f"1-var_pop({ERR})/var_pop(actual)",
    "mape_guarded": f"avg(abs({ERR}/(actual+1e-3)))*100"}


@query("regression_metrics", SCORED_SQL + "SELECT CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"{R(e)} AS {n}" for n, e in METRIC_SQL.items())
       + f", {R(f'CASE WHEN sum(CASE WHEN actual = 0 THEN 1 ELSE 0 END) = 0 THEN avg(abs({ERR}/CASE WHEN actual = 0 THEN NULL ELSE actual END))*100 END')} AS mape FROM scored")
def regression_metrics(spark, d):
    return tidy(metrics.regression_metrics(scored_table(spark, d)))


@query("metrics_by_category", CATEGORISED_SQL + f"SELECT actual_category, CAST(count(*) AS BIGINT) AS n, {R(METRIC_SQL['mae'])} AS mae, {R(METRIC_SQL['r2'])} AS r2, {R(METRIC_SQL['mape_guarded'])} AS mape_guarded FROM categorised GROUP BY actual_category")
def metrics_by_category(spark, d):
    return tidy(metrics.regression_metrics(categorised(spark, d), by=["actual_category"], names=["mae", "r2", "mape_guarded"]))


@query("prediction_errors", SCORED_SQL + f"SELECT row_id, {R(ERR)} AS error, {R(f'abs({ERR})')} AS absolute_error FROM scored")
def prediction_errors(spark, d):
    e = F.col("actual") - F.col("predicted")
    return tidy(scored_table(spark, d).select("row_id", e.alias("error"), F.abs(e).alias("absolute_error")))


@query("classification_report", CATEGORISED_SQL + f""", cm AS (SELECT actual_category AS a, predicted_category AS p, count(*) AS n FROM categorised GROUP BY ALL),
cls AS (SELECT coalesce(x.c, y.c) AS class, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits, coalesce(said, 0) AS said
  FROM (SELECT a AS c, sum(n) AS support, sum(CASE WHEN a = p THEN n END) AS hits FROM cm GROUP BY a) x
  FULL JOIN (SELECT p AS c, sum(n) AS said FROM cm GROUP BY p) y ON x.c = y.c),
pr AS (SELECT *, CASE WHEN said > 0 THEN hits*1e0/said ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits*1e0/support ELSE 0 END AS recall FROM cls),
f AS (SELECT *, CASE WHEN precision+recall > 0 THEN 2*precision*recall/(precision+recall) ELSE 0 END AS f1 FROM pr)
SELECT class, {RA('precision', 'recall', 'f1')}, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', {R('sum(hits)*1e0/sum(support)')}, {R('sum(hits)*1e0/sum(support)')}, {R('sum(hits)*1e0/sum(support)')}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', {R('avg(precision)')}, {R('avg(recall)')}, {R('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', {R('sum(precision*support)/sum(support)')}, {R('sum(recall*support)/sum(support)')}, {R('sum(f1*support)/sum(support)')}, CAST(sum(support) AS BIGINT) FROM f""")
def classification_report(spark, d):
    return tidy(metrics.classification_report(categorised(spark, d), "actual_category", "predicted_category"))


@query("confusion_matrix", CATEGORISED_SQL + "SELECT actual_category, predicted_category, CAST(count(*) AS BIGINT) AS n FROM categorised GROUP BY ALL")
def confusion_matrix(spark, d):
    return metrics.confusion(categorised(spark, d), "actual_category", "predicted_category")


@query("confusion_crosstab", CATEGORISED_SQL + ", c AS (SELECT coalesce(actual_category, 'All') AS actual_category, coalesce(predicted_category, 'All') AS s, count(*) AS n "
       "FROM categorised GROUP BY CUBE (actual_category, predicted_category)) SELECT actual_category, "
       + ", ".join(f"CAST(coalesce(sum(CASE WHEN s = '{v}' THEN n END), 0) AS BIGINT) AS \"{v}\"" for v in ("low", "medium", "high", "All")) + " FROM c GROUP BY actual_category")
def confusion_crosstab(spark, d):
    return stats.crosstab(categorised(spark, d), "actual_category", "predicted_category", ["low", "medium", "high"])


@query("roc_auc", SCORED_SQL + f""", x AS (SELECT CASE WHEN actual >= 35e-2 THEN 1 ELSE 0 END AS y, round(predicted, 2) AS s FROM scored),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1)/2e0 AS rk FROM x)
SELECT {R('(sum(CASE WHEN y = 1 THEN rk END) - sum(y)*(sum(y)+1)/2e0)/(sum(y)*1e0*sum(1-y))')} AS auc FROM r""")
def roc_auc(spark, d):
    table = scored_table(spark, d).select((F.col("actual") >= 0.35).cast("int").alias("y"), F.round("predicted", 2).alias("s"))
    return tidy(metrics.binary_auc(table, "y", "s"))


@query("residual_analysis", SCORED_SQL + f"""SELECT CAST(count(*) AS BIGINT) AS n, {R(f'avg({ERR})')} AS mean, {R(f'stddev_pop({ERR})')} AS std,
  {R(f'min({ERR})')} AS min, {R(f'max({ERR})')} AS max, {R(f'sum({ERR}*{ERR})')} AS rss FROM scored""")
def residual_analysis(spark, d):
    return tidy(metrics.residual_analysis(scored_table(spark, d)).select("n", "mean", "std", "min", "max", "rss"))


@query("residual_normality_test")
def residual_normality_test(spark, d):
    return tidy(metrics.residual_analysis(scored_table(spark, d)).select("n", "k2", "p_value", "is_normal"))


@query("residual_histogram", SCORED_SQL + f""", e AS (SELECT {ERR} AS e FROM scored), r AS (SELECT min(e) AS lo, (max(e)-min(e))/30 AS w FROM e)
SELECT CAST(least(floor((e-lo)/w), 29) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM e, r GROUP BY ALL""")
def residual_histogram(spark, d):
    table = scored_table(spark, d).select((F.col("actual") - F.col("predicted")).alias("e"))
    return stats.histogram(table, "e", 30).select("bin", "n")


@query("quantile_quantile_table")
def quantile_quantile_table(spark, d):
    table = scored_table(spark, d).select("row_id", (F.col("actual") - F.col("predicted")).alias("e"))
    return tidy(reports.quantile_quantile(table, "e", "row_id"))


Z = "1.959963984540054e0"
# Large-sample expansion of the t quantile around the normal one.
T_SQL = f"({Z} + ({Z}*{Z}*{Z}+{Z})/(4e0*v) + (5e0*pow({Z},5)+16e0*pow({Z},3)+3e0*{Z})/(96e0*v*v))"


@query("prediction_interval", SCORED_SQL + f""", m AS (SELECT avg({ERR}*{ERR}) AS mse, count(*)-6e0 AS v FROM scored)
SELECT row_id, {R(f'predicted-{T_SQL}*sqrt(mse)')} AS lower, {R(f'predicted+{T_SQL}*sqrt(mse)')} AS upper FROM scored, m""")
def prediction_interval(spark, d):
    table = scored_table(spark, d)
    error = F.col("actual") - F.col("predicted")
    mse, n = table.agg(F.avg(error * error), F.count(F.lit(1))).first()
    return tidy(metrics.prediction_interval(table, "predicted", mse, n, 5).select("row_id", "lower", "upper"))


# ---------------------------------------------------------------- report tables

@query("category_accuracy", CATEGORISED_SQL + f""", c AS (SELECT actual_category AS category, count(*) AS n, sum(CASE WHEN actual_category = predicted_category THEN 1 ELSE 0 END) AS correct FROM categorised GROUP BY ALL)
SELECT category, CAST(n AS BIGINT) AS n, CAST(correct AS BIGINT) AS correct, {R('correct*1e2/n')} AS accuracy_pct FROM c
UNION ALL SELECT 'overall', CAST(sum(n) AS BIGINT), CAST(sum(correct) AS BIGINT), {R('sum(correct)*1e2/sum(n)')} FROM c""")
def category_accuracy(spark, d):
    return tidy(reports.category_accuracy(categorised(spark, d), "actual_category", "predicted_category"))


@query("category_distribution", CATEGORISED_SQL + f""", u AS (SELECT 'actual_category' AS source, actual_category AS category FROM categorised UNION ALL SELECT 'predicted_category', predicted_category FROM categorised)
SELECT source, category, CAST(n AS BIGINT) AS n, {R('n*1e2/sum(n) OVER (PARTITION BY source)')} AS pct FROM (SELECT source, category, count(*) AS n FROM u GROUP BY source, category)""")
def category_distribution(spark, d):
    return tidy(reports.category_distribution(categorised(spark, d), ["actual_category", "predicted_category"]))


@query("conservation_tiers", SCORED_SQL + f"""SELECT CASE WHEN predicted >= 75e-2 THEN 'immediate_action' WHEN predicted >= 3e-1 THEN 'enhanced_monitoring' ELSE 'maintenance' END AS tier,
  CAST(count(*) AS BIGINT) AS locations, {R('avg(forest_cover)')} AS avg_forest, {R('avg(urban_area)')} AS avg_urban, {R('avg(population_density)')} AS avg_population FROM scored GROUP BY 1""")
def conservation_tiers(spark, d):
    return tidy(reports.conservation_tiers(scored_table(spark, d), "predicted"))


@query("high_risk_hotspots", SCORED_SQL + f""", h AS (SELECT * FROM scored WHERE predicted >= (SELECT quantile_cont(predicted, 75e-2) FROM scored))
SELECT row_id, {R('latitude')} AS latitude, {R('longitude')} AS longitude, {R('predicted')} AS predicted, {CAT.format(c='predicted')} AS category FROM h ORDER BY round(h.predicted, 9) DESC, row_id LIMIT 10""")
def high_risk_hotspots(spark, d):
    from greenlattice.operators.quantiles import exact_quantiles
    table = scored_table(spark, d)
    cut = exact_quantiles(table, {"predicted": [0.75]})["predicted"][0]
    hot = table.where(F.col("predicted") >= F.lit(cut)).orderBy(F.desc(F.round("predicted", 9)), "row_id").limit(10)
    return tidy(hot.select("row_id", "latitude", "longitude", "predicted", risk.risk_category(F.col("predicted")).alias("category")))


@query("climate_time_series", with_(t.CLIMATE_SQL) + f"""SELECT obs_date, 'temperature' AS series, {R('avg(temperature)')} AS value FROM climate GROUP BY obs_date
UNION ALL SELECT obs_date, 'precipitation', {R('avg(precipitation)')} FROM climate GROUP BY obs_date""")
def climate_time_series(spark, d):
    return tidy(reports.time_series(t.climate_daily(spark, d), "obs_date", ["temperature", "precipitation"]))


@query("landuse_share_table", with_(t.LANDUSE_SQL) + ", a AS (SELECT " + ", ".join(f"sum({c}) AS {c}" for c in LANDUSE_SHARES) + " FROM landuse) "
       + union_sql(LANDUSE_SHARES, "SELECT '{c}' AS landuse, " + R("{c}*1e2/(forest_cover+agricultural_area+urban_area+water_bodies)") + " AS pct FROM a"))
def landuse_share_table(spark, d):
    totals = t.landuse(spark, d).agg(*[F.sum(c).alias(c) for c in LANDUSE_SHARES])
    whole = sum((F.col(c) for c in LANDUSE_SHARES), F.lit(0.0))
    return tidy(totals.select(*[(F.col(c) * 100.0 / whole).alias(c) for c in LANDUSE_SHARES]).unpivot([], LANDUSE_SHARES, "landuse", "pct"))


@query("variable_pairs", SCORED_SQL + f"SELECT row_id, {RA('temperature', 'precipitation', 'ecological_risk')}, species_count FROM scored")
def variable_pairs(spark, d):
    return tidy(risk_table(spark, d).select("row_id", "temperature", "precipitation", "ecological_risk", "species_count"))


LOG_SQL = SCORED_SQL + f"""SELECT CAST(count(*) AS BIGINT) AS total_predictions, CAST(sum(CASE WHEN obs_date = DATE '1998-05-01' THEN 1 ELSE 0 END) AS BIGINT) AS predictions_today,
  {R('avg(predicted)')} AS average_risk, CAST(sum(CASE WHEN predicted >= 6e-1 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_count,
  {R(f"avg(CASE WHEN {CAT.format(c='actual')} = {CAT.format(c='predicted')} THEN 1e0 ELSE 0 END)")} AS accuracy FROM scored"""


@query("prediction_statistics", LOG_SQL)
def prediction_statistics(spark, d):
    log = categorised(spark, d).select(
        F.col("obs_date").cast("timestamp").alias("created_at"), F.col("predicted").alias("predicted_risk"),
        F.col("actual_category").alias("actual_level"), F.col("predicted_category").alias("predicted_level"))
    return tidy(reports.prediction_statistics(log, "1998-05-01"))


@query("feedback_accuracy", CATEGORISED_SQL + f"""SELECT predicted_category AS predicted_risk_level, CAST(count(*) AS BIGINT) AS n,
  {R('avg(CASE WHEN actual_category = predicted_category THEN 1e0 ELSE 0 END)')} AS accuracy, {R('avg(CASE WHEN row_id%3 = 0 THEN NULL WHEN row_id%3 = 1 THEN 1e0 ELSE 0 END)')} AS helpful_rate FROM categorised GROUP BY 1""")
def feedback_accuracy(spark, d):
    feedback = categorised(spark, d).select(
        F.col("actual_category").alias("actual_risk_level"), F.col("predicted_category").alias("predicted_risk_level"),
        F.when(F.col("row_id") % 3 != 0, F.col("row_id") % 3 == 1).alias("is_helpful"))
    return tidy(reports.feedback_accuracy(feedback))


@query("zone_geometry", SCORED_SQL + f"""SELECT row_id, {CAT.format(c='predicted')} AS risk_level, {R('predicted')} AS risk_score, {R('longitude-5e-2')} AS x0,
  {R('latitude-5e-2')} AS y0, {R('longitude+5e-2')} AS x1, {R('latitude+5e-2')} AS y1 FROM scored""")
def zone_geometry(spark, d):
    from greenlattice.operators.zones import centred_zones
    zones = centred_zones(scored_table(spark, d), 0.1, "predicted")
    return tidy(zones.select("row_id", "risk_level", F.col("predicted").alias("risk_score"), "x0", "y0", "x1", "y1"))


@query("zones_by_level", SCORED_SQL + f"""SELECT {CAT.format(c='predicted')} AS risk_level, CAST(count(*) AS BIGINT) AS zones, {R('avg(predicted)')} AS mean_score FROM scored GROUP BY 1""")
def zones_by_level(spark, d):
    from greenlattice.operators.zones import centred_zones
    zones = centred_zones(scored_table(spark, d), 0.1, "predicted")
    return tidy(zones.groupBy("risk_level").agg(F.count(F.lit(1)).alias("zones"), F.avg("predicted").alias("mean_score"))
                .orderBy(risk.category_order(F.col("risk_level"))))


@query("map_markers", SCORED_SQL + f""", c AS (SELECT (min(latitude)+max(latitude))/2 AS centre_lat, (min(longitude)+max(longitude))/2 AS centre_lon FROM scored)
SELECT row_id, {RA('latitude', 'longitude', 'centre_lat', 'centre_lon')}, CASE WHEN predicted > 6e-1 THEN 'red' WHEN predicted > 3e-1 THEN 'orange' ELSE 'green' END AS colour FROM scored, c""")
def map_markers(spark, d):
    table = scored_table(spark, d)
    box = stats.spatial_extent(table).first()
    return tidy(table.select("row_id", "latitude", "longitude", F.lit((box["min_y"] + box["max_y"]) / 2).alias("centre_lat"),
                             F.lit((box["min_x"] + box["max_x"]) / 2).alias("centre_lon"), risk.marker_colour(F.col("predicted")).alias("colour")))


@query("absent_metric_rows", """WITH have AS (SELECT DISTINCT p_brand AS model_name FROM part WHERE p_size = 50), fresh AS (SELECT p_brand AS model_name, min(p_retailprice) AS rmse FROM part GROUP BY p_brand)
SELECT model_name, """ + R("rmse") + " AS rmse FROM fresh WHERE model_name NOT IN (SELECT model_name FROM have)")
def absent_metric_rows(spark, d):
    from greenlattice.sources.sinks import rows_to_insert
    part = t.table(spark, d, "part")
    have = part.where("p_size = 50").select(F.col("p_brand").alias("model_name"))
    fresh = part.groupBy(F.col("p_brand").alias("model_name")).agg(F.min("p_retailprice").alias("rmse"))
    return tidy(rows_to_insert(fresh, have, "model_name"))


@query("category_names", """SELECT o_orderkey, CASE WHEN o_orderkey%6 = 0 THEN 'Unknown' ELSE concat(upper(substr(o_orderstatus, 1, 1)), lower(substr(o_orderstatus, 2)), '-risk') END AS category FROM orders""")
def category_names(spark, d):
    raw = F.when(F.col("o_orderkey") % 6 != 0, F.concat("o_orderstatus", F.lit("-risk")))
    text = F.coalesce(raw, F.lit("nan"))
    named = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 100)))
    return t.table(spark, d, "orders").select("o_orderkey", F.when(named == "Nan", "Unknown").otherwise(named).alias("category"))


@query("default_feature_fill", with_(t.LANDUSE_SQL) + f"SELECT land_id, {R('forest_cover')} AS forest_cover, {R('CASE WHEN land_id%4 = 0 THEN 0 ELSE elevation END')} AS elevation, 0e0 AS biodiversity FROM landuse")
def default_feature_fill(spark, d):
    from greenlattice.operators.scoring import with_model_features
    table = t.landuse(spark, d).selectExpr("land_id", "forest_cover", "CASE WHEN land_id%4 = 0 THEN NULL ELSE elevation END AS elevation")
    return tidy(with_model_features(table, ["forest_cover", "elevation", "biodiversity"]))


@query("feature_target_split", COMBINED_SQL + f"SELECT row_id, {RA('temperature', 'humidity', 'forest_cover', 'threat_index')} FROM combined")
def feature_target_split(spark, d):
    from greenlattice.functions.numeric import numeric_columns
    table = combined(spark, d).select("row_id", "latitude", "longitude", "temperature", "humidity", "forest_cover", "threat_index")
    features = numeric_columns(table, exclude=["latitude", "longitude", "row_id", "threat_index"])
    return tidy(table.select("row_id", *features, "threat_index"))
