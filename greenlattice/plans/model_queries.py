"""Models, cross-validation, scoring; files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from greenlattice.functions import risk
from greenlattice.functions.numeric import rounded, tidy
from greenlattice.operators import crossval, models, scoring, selection, splits, stats
from greenlattice.plans.combined import COMBINED_SQL
from greenlattice.plans.feature_queries import RISK_CTES, RISK_SQL, risk_table
from greenlattice.plans.registry import R, RA, query, with_
from greenlattice.plans.validation_queries import SHIFTED, SHIFTED_SQL, VALID_SQL, shifted
from greenlattice.session import materialize, shared_dir
from greenlattice.sources import readers, sinks, tables as t
from greenlattice.sources.keyed_log import KeyedLog
from greenlattice.streaming import ingest

FEATURES = ["temperature", "precipitation", "forest_cover", "urban_area", "species_count", "species_diversity"]
TARGET = "ecological_risk"
FOREST = {"n_estimators": 100, "max_depth": 12}
BOOST = {"n_estimators": 100, "max_depth": 6}


def training(spark, d):
    return risk_table(spark, d).select("row_id", "obs_date", "latitude", "longitude", *FEATURES, TARGET)


def split_sets(spark, d):
    parts = materialize(splits.train_test_labels(training(spark, d), "row_id", 0.2))
    return parts.where(F.col("split") == "train"), parts.where(F.col("split") == "test")


def metric_rows(spark, model, train, test):
    rows = []
    for part, data in (("train", train), ("test", test)):
        m = model.evaluate(data)
        rows += [(part, k, None if v is None else float(v)) for k, v in m.items()]
    return tidy(spark.createDataFrame(rows, "part string, metric string, value double"))


def fit_and_measure(spark, d, kind, params=None, degree=1):
    train, test = split_sets(spark, d)
    model = models.fit_model(train, FEATURES, TARGET, kind, params=params, degree=degree, with_metrics=False)
    return metric_rows(spark, model, train, test)


@query("model_random_forest")
def model_random_forest(spark, d):
    return fit_and_measure(spark, d, "random_forest", FOREST)


@query("model_gradient_boosting")
def model_gradient_boosting(spark, d):
    return fit_and_measure(spark, d, "gradient_boosting", BOOST)


@query("model_lasso")
def model_lasso(spark, d):
    return fit_and_measure(spark, d, "lasso", {"alpha": 0.001})


@query("model_elastic_net")
def model_elastic_net(spark, d):
    return fit_and_measure(spark, d, "elastic_net", {"alpha": 0.001, "l1_ratio": 0.5})


@query("model_polynomial_ridge")
def model_polynomial_ridge(spark, d):
    return fit_and_measure(spark, d, "ridge", {"alpha": 1.0}, degree=2)


TWO = """m AS (SELECT count(*) AS n, avg(temperature) AS mx, avg(forest_cover) AS mz, avg(ecological_risk) AS my,
  covar_pop(temperature, temperature)*count(*)+{a} AS xx, covar_pop(forest_cover, forest_cover)*count(*)+{a} AS zz,
  covar_pop(temperature, forest_cover)*count(*) AS xz, covar_pop(temperature, ecological_risk)*count(*) AS xy,
  covar_pop(forest_cover, ecological_risk)*count(*) AS zy FROM risk),
b AS (SELECT *, (xy*zz-zy*xz)/(xx*zz-xz*xz) AS b1, (zy*xx-xy*xz)/(xx*zz-xz*xz) AS b2 FROM m)"""
TWO_OUT = f"""SELECT 'temperature' AS feature, {R('b1')} AS coefficient FROM b UNION ALL SELECT 'forest_cover', {R('b2')} FROM b
UNION ALL SELECT 'intercept', {R('my-b1*mx-b2*mz')} FROM b"""


def two_features(spark, d, kind, params):
    table = training(spark, d).select("temperature", "forest_cover", TARGET)
    model = models.fit_model(table, ["temperature", "forest_cover"], TARGET, kind, params=params, with_metrics=False)
    return tidy(model.coefficients(spark))


@query("model_linear_coefficients", with_(*RISK_CTES, TWO.format(a="0")) + TWO_OUT)
def model_linear_coefficients(spark, d):
    return two_features(spark, d, "linear", {})


@query("model_ridge_coefficients", with_(*RISK_CTES, TWO.format(a="50e0")) + TWO_OUT)
def model_ridge_coefficients(spark, d):
    return two_features(spark, d, "ridge", {"alpha": 50.0})


@query("model_equation")
def model_equation(spark, d):
    model = models.fit_model(training(spark, d), FEATURES, TARGET, "linear", with_metrics=False)
    return spark.createDataFrame([(model.equation(),)], "equation string")


def term(value, name, first):
    sign = f"CASE WHEN {value} > 0 AND NOT ({first}) THEN '+ ' ELSE '' END"
    return f"CASE WHEN abs({value}) > 1e-3 THEN ' ' || {sign} || printf('%.3f', {value}) || '{name}' ELSE '' END"


@query("model_equation_two_features", with_(*RISK_CTES, TWO.format(a="0")) + "SELECT 'y =' || " + " || ".join([
    term("b1", " * temperature", "true"), term("b2", " * forest_cover", "abs(b1) <= 1e-3"),
    term("(my-b1*mx-b2*mz)", "", "abs(b1) <= 1e-3 AND abs(b2) <= 1e-3")]) + " AS equation FROM b")
def model_equation_two_features(spark, d):
    model = models.fit_model(training(spark, d), ["temperature", "forest_cover"], TARGET, "linear", with_metrics=False)
    return spark.createDataFrame([(model.equation(),)], "equation string")


ALPHAS = [10.0 ** (-4 + 6 * i / 49) for i in range(50)]


@query("regularization_path", RISK_SQL + "SELECT alpha, feature, " + R("sxy/(sxx+alpha)") + " AS coefficient, " + R(
    "1-(syy-2*sxy/(sxx+alpha)*sxy+sxy/(sxx+alpha)*sxy/(sxx+alpha)*sxx)/syy") + " AS r2 FROM (SELECT 'temperature' AS feature, "
    "covar_pop(temperature, ecological_risk)*count(*) AS sxy, var_pop(temperature)*count(*) AS sxx, var_pop(ecological_risk)*count(*) AS syy FROM risk), "
    "(SELECT unnest([" + ", ".join(R(repr(a)) for a in ALPHAS) + "]) AS alpha)")
def regularization_path(spark, d):
    return tidy(models.regularization_path(spark, training(spark, d), ["temperature"], TARGET, "ridge", ALPHAS))


@query("lasso_path")
def lasso_path(spark, d):
    return tidy(models.regularization_path(spark, training(spark, d), FEATURES, TARGET, "lasso", ALPHAS))


@query("class_probabilities")
def class_probabilities(spark, d):
    table = training(spark, d).withColumn("level", F.when(F.col(TARGET) < 0.3, 0).when(F.col(TARGET) < 0.6, 1).otherwise(2))
    model = models.fit_classifier(table, FEATURES, "level")
    out = models.predict_proba(model, table)
    return tidy(out.select("row_id", F.col("predicted").cast("int").alias("level"),
                           F.array_max("probabilities").alias("probability")))


SPECS = {"linear": {"kind": "linear"}, "ridge": {"kind": "ridge", "params": {"alpha": 1.0}},
         "random_forest": {"kind": "random_forest", "params": FOREST},
         "gradient_boosting": {"kind": "gradient_boosting", "params": BOOST}}


def compared(spark, d):
    train, test = split_sets(spark, d)
    fitted, failed = models.train_all(train, FEATURES, TARGET, SPECS)
    return models.comparison_table(spark, fitted, test, "linear", failed)


@query("model_comparison")
def model_comparison(spark, d):
    return tidy(compared(spark, d))


@query("best_model")
def best_model(spark, d):
    return tidy(models.best_model(compared(spark, d), "rmse"))


FOLD_SQL = [*RISK_CTES, """kk AS (SELECT temperature AS x, ecological_risk AS y, row_number() OVER (ORDER BY (row_id*2654435761) % 4294967296) - 1 AS i, count(*) OVER () AS n FROM risk)""",
            """ff AS (SELECT x, y, CASE WHEN i < (n%5)*(floor(n/5e0)+1) THEN floor(i/(floor(n/5e0)+1)) ELSE n%5 + floor((i-(n%5)*(floor(n/5e0)+1))/floor(n/5e0)) END AS fold FROM kk)""",
            "fit AS (SELECT g.f AS f, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM ff, (SELECT unnest([0,1,2,3,4]) AS f) g WHERE fold <> g.f GROUP BY g.f)"]


@query("cross_validation_linear", with_(*FOLD_SQL) + f"""SELECT CAST(f AS INT) AS fold, CASE WHEN fold = f THEN 'test' ELSE 'train' END AS part,
  {R('1-sum((y-a-b*x)*(y-a-b*x))/(var_pop(y)*count(*))')} AS r2, {R('avg((y-a-b*x)*(y-a-b*x))')} AS mse, {R('avg(abs(y-a-b*x))')} AS mae
FROM ff, fit GROUP BY f, CASE WHEN fold = f THEN 'test' ELSE 'train' END""")
def cross_validation_linear(spark, d):
    return tidy(crossval.regression_cv(training(spark, d), ["temperature"], TARGET, "row_id", "linear"))


@query("cross_validation_summary")
def cross_validation_summary(spark, d):
    return tidy(crossval.cv_summary(crossval.regression_cv(training(spark, d), FEATURES, TARGET, "row_id", "ridge", {"alpha": 1.0})))


@query("cross_validation_time_series")
def cross_validation_time_series(spark, d):
    return tidy(crossval.regression_cv(training(spark, d), FEATURES, TARGET, "row_id", "linear", cv_type="timeseries", time="obs_date"))


PAIR = ["temperature", "forest_cover"]
SETS = "g AS (SELECT unnest([0,1,2,3,4]) AS f)"
#: Two-feature fit of each training set, from a table tr(f, ..., x, z, y); {a} is the ridge penalty.
PAIR_FIT = """m AS (SELECT {by}, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, covar_pop(x, x)*count(*)+{a} AS xx, covar_pop(z, z)*count(*)+{a} AS zz,
  covar_pop(x, z)*count(*) AS xz, covar_pop(x, y)*count(*) AS xy, covar_pop(z, y)*count(*) AS zy FROM tr GROUP BY {by}),
fit AS (SELECT *, my-b1*mx-b2*mz AS b0 FROM (SELECT *, (xy*zz-zy*xz)/(xx*zz-xz*xz) AS b1, (zy*xx-xy*xz)/(xx*zz-xz*xz) AS b2 FROM m))"""
PAIR_FOLDS = FOLD_SQL[0:len(RISK_CTES)] + [
    FOLD_SQL[-3].replace("temperature AS x,", "row_id, obs_date, temperature AS x, forest_cover AS z,"),
    FOLD_SQL[-2].replace("SELECT x, y,", "SELECT row_id, obs_date, x, z, y, n,")]
WRONG = "(y-b0-b1*x-b2*z)"
PAIR_OUT = (f"SELECT CAST(f AS INT) AS fold, part, {R(f'1-sum({WRONG}*{WRONG})/(var_pop(y)*count(*))')} AS r2, {R(f'sqrt(avg({WRONG}*{WRONG}))')} AS rmse, "
            f"{R(f'-avg(abs({WRONG}))')} AS neg_mae FROM s JOIN fit USING (f) GROUP BY f, part")


@query("cross_validation_ridge_pair", with_(*PAIR_FOLDS, SETS, "tr AS (SELECT * FROM ff, g WHERE fold <> f)", PAIR_FIT.format(by="f", a="5e0"),
       "s AS (SELECT *, CASE WHEN fold = f THEN 'test' ELSE 'train' END AS part FROM ff, g)") + PAIR_OUT)
def cross_validation_ridge_pair(spark, d):
    return tidy(crossval.regression_cv(training(spark, d), PAIR, TARGET, "row_id", "ridge", {"alpha": 5.0}, scorers=["r2", "rmse", "neg_mae"]))


@query("cross_validation_time_series_pair", with_(*PAIR_FOLDS, SETS, "pp AS (SELECT x, z, y, n//6 AS w, n - 5*(n//6) AS h, row_number() OVER (ORDER BY obs_date, row_id) - 1 AS p FROM ff)",
       "bb AS (SELECT x, z, y, CASE WHEN p < h THEN 0 ELSE (p-h)//w + 1 END AS block FROM pp)",
       "tr AS (SELECT * FROM bb, g WHERE block <= f)", PAIR_FIT.format(by="f", a="0e0"),
       "s AS (SELECT *, CASE WHEN block <= f THEN 'train' ELSE 'test' END AS part FROM bb, g WHERE block <= f + 1)") + PAIR_OUT)
def cross_validation_time_series_pair(spark, d):
    return tidy(crossval.regression_cv(training(spark, d), PAIR, TARGET, "row_id", "linear", cv_type="timeseries", time="obs_date",
                                       scorers=["r2", "rmse", "neg_mae"]))


SIZES = "[" + ", ".join(f"{i}e-1" for i in range(1, 11)) + "]"


@query("learning_curve_pair", with_(*PAIR_FOLDS, SETS, "kk2 AS (SELECT x, z, y, fold, CAST((CAST(row_id AS HUGEINT)*2246822519) % 4294967296 AS DOUBLE) AS k FROM ff)",
       f"sz AS (SELECT unnest({SIZES}) AS size, unnest((SELECT quantile_cont(k, {SIZES}) FROM kk2)) AS cut)",
       "tr AS (SELECT * FROM kk2, g, sz WHERE fold <> f AND k <= cut)", PAIR_FIT.format(by="f, size", a="0e0"),
       f"""s AS (SELECT f, size, CASE WHEN fold = f THEN 'v' ELSE 't' END AS part, 1-sum({WRONG}*{WRONG})/(var_pop(y)*count(*)) AS r2
  FROM kk2, sz JOIN fit USING (size) WHERE fold = f OR k <= cut GROUP BY f, size, part)""") + f"""SELECT {R('size')} AS size,
  {R("avg(r2) FILTER (part = 't')")} AS train_mean, {R("stddev_pop(r2) FILTER (part = 't')")} AS train_std,
  {R("avg(r2) FILTER (part = 'v')")} AS validation_mean, {R("stddev_pop(r2) FILTER (part = 'v')")} AS validation_std FROM s GROUP BY size""")
def learning_curve_pair(spark, d):
    return tidy(crossval.learning_curve(training(spark, d), PAIR, TARGET, "row_id", "linear"))


@query("cross_validation_classes")
def cross_validation_classes(spark, d):
    table = training(spark, d).withColumn("level", (F.col(TARGET) >= 0.35).cast("int"))
    return tidy(crossval.classification_cv(table, FEATURES, "level", "row_id", 5, {"n_estimators": 100, "max_depth": 12}))


@query("cross_validation_comparison")
def cross_validation_comparison(spark, d):
    specs = {"linear": {"kind": "linear"}, "ridge": {"kind": "ridge", "params": {"alpha": 10.0}}, "lasso": {"kind": "lasso", "params": {"alpha": 0.001}},
             "elastic_net": {"kind": "elastic_net", "params": {"alpha": 0.001, "l1_ratio": 0.5}},
             "polynomial_ridge": {"kind": "ridge", "params": {"alpha": 1.0}, "degree": 2}}
    return tidy(crossval.compare_by_cv(training(spark, d), FEATURES, TARGET, "row_id", specs))


@query("learning_curve")
def learning_curve(spark, d):
    return tidy(crossval.learning_curve(training(spark, d), FEATURES, TARGET, "row_id", "linear"))


def forest(spark, d):
    table = materialize(training(spark, d))
    return table, models.fit_model(table, FEATURES, TARGET, "random_forest", params=FOREST, with_metrics=False)


@query("feature_importance")
def feature_importance(spark, d):
    _, model = forest(spark, d)
    return tidy(model.importance(spark))


@query("importance_methods")
def importance_methods(spark, d):
    table, model = forest(spark, d)
    corr = stats.correlation_with_target(table, TARGET, FEATURES).select("feature", F.lit("correlation").alias("method"), F.col("strength").alias("score"))
    info = selection.binned_mutual_information(table, TARGET, FEATURES).select("feature", F.lit("mutual_information").alias("method"), "score")
    tree = model.importance(spark).select("feature", F.lit("random_forest").alias("method"), F.col("importance").alias("score"))
    return tidy(corr.unionByName(info).unionByName(tree))


@query("importance_kinds")
def importance_kinds(spark, d):
    """Importance by splits, gain and cover of a forest and of boosting."""
    table, model = forest(spark, d)
    boosted = models.fit_model(table, FEATURES, TARGET, "gradient_boosting", params=BOOST, with_metrics=False)
    rows = [m.importance_by_kind(spark).withColumn("model", F.lit(m.kind)) for m in (model, boosted)]
    return tidy(rows[0].unionByName(rows[1]))


@query("tree_statistics")
def tree_statistics(spark, d):
    _, model = forest(spark, d)
    return tidy(spark.createDataFrame([(k, float(v)) for k, v in model.tree_statistics().items()], "statistic string, value double"))


@query("ensemble_uncertainty")
def ensemble_uncertainty(spark, d):
    table, model = forest(spark, d)
    return tidy(models.tree_spread(model, table).select("row_id", "tree_mean", "tree_std"))


@query("partial_dependence")
def partial_dependence(spark, d):
    table, model = forest(spark, d)
    return tidy(models.partial_dependence(model, table, "forest_cover", 100))


@query("partial_dependence_linear", with_(*RISK_CTES, TWO.format(a="0")) + f"""
, g AS (SELECT DISTINCT forest_cover AS v FROM risk), q AS (SELECT quantile_cont(forest_cover, 5e-2) AS lo, quantile_cont(forest_cover, 95e-2) AS hi FROM risk),
pts AS (SELECT v FROM g WHERE (SELECT count(*) FROM g) <= 100 UNION ALL SELECT lo+(hi-lo)*i/99e0 FROM q, range(100) r(i) WHERE (SELECT count(*) FROM g) > 100)
SELECT {R('v')} AS grid_value, {R('my-b2*mz+b2*v')} AS average FROM pts, b""")
def partial_dependence_linear(spark, d):
    table = training(spark, d)
    model = models.fit_model(table, ["temperature", "forest_cover"], TARGET, "linear", with_metrics=False)
    return tidy(models.partial_dependence(model, table, "forest_cover", 100))


@query("boosting_history")
def boosting_history(spark, d):
    train, test = split_sets(spark, d)
    model = models.fit_model(train, FEATURES, TARGET, "gradient_boosting", params=BOOST, with_metrics=False)
    rows = [(i + 1, a ** 0.5, b ** 0.5) for i, (a, b) in enumerate(zip(
        models.boosting_history(model, train), models.boosting_history(model, test)))]
    return tidy(spark.createDataFrame(rows, "iteration int, train_rmse double, validation_rmse double"))


@query("model_complexity")
def model_complexity(spark, d):
    table, model = forest(spark, d)
    line = models.fit_model(table, FEATURES, TARGET, "lasso", params={"alpha": 0.01}, with_metrics=False)
    rows = [(m.kind, k, float(v)) for m in (model, line) for k, v in models.complexity(m).items() if k != "kind"]
    return tidy(spark.createDataFrame(rows, "kind string, measure string, value double"))


@query("saved_model_scores")
def saved_model_scores(spark, d):
    """Save, load and score: differences between the two models are all zero."""
    table, model = forest(spark, d)
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model.save(path)
    loaded, default = models.load_models(spark, [path])
    a = model.predict(table).select("row_id", F.col("predicted").alias("a"))
    b = loaded[default].predict(table).select("row_id", F.col("predicted").alias("b"))
    return tidy(a.join(b, "row_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest_difference")))


# ---------------------------------------------------------------- scoring

LINEAR_RISK = "least(greatest((1-coalesce(forest_cover, 0))*3e-1 + coalesce(urban_area, 0)*2e-1, 0), 1)"


def land_model(spark, d):
    """Linear model of a target that is exactly linear in two land-use shares."""
    cells = t.landuse_cells(spark, d).select("ix", "iy", "forest_cover", "urban_area", "latitude", "longitude")
    labelled = cells.withColumn("risk", (1 - F.col("forest_cover")) * 0.3 + F.col("urban_area") * 0.2)
    return cells, models.fit_model(labelled, ["forest_cover", "urban_area"], "risk", "linear", with_metrics=False)


def with_keys(points):
    return points.withColumns({"ix": F.round((F.col("longitude") - 72.0) / 0.1).cast("bigint"),
                               "iy": F.round((F.col("latitude") - 15.0) / 0.1).cast("bigint")})


@query("score_batch", with_(SHIFTED_SQL, t.LANDCELL_SQL) + f"""
, p AS (SELECT occ_id, latitude, longitude, {VALID_SQL} AS ok, CAST(round((longitude-72e0)/1e-1) AS BIGINT) AS ix, CAST(round((latitude-15e0)/1e-1) AS BIGINT) AS iy FROM shifted),
s AS (SELECT occ_id, ok, {LINEAR_RISK} AS r FROM p LEFT JOIN (SELECT ix, iy, forest_cover, urban_area FROM landcell) c USING (ix, iy))
SELECT occ_id, CASE WHEN ok THEN {R('r')} END AS risk_score, CASE WHEN ok THEN CASE WHEN r < 3e-1 - 1e-9 THEN 'low' WHEN r < 6e-1 - 1e-9 THEN 'medium' ELSE 'high' END END AS risk_category,
  CASE WHEN ok THEN 8e-1 END AS confidence, CASE WHEN NOT ok THEN 'Invalid coordinates' END AS error FROM s""")
def score_batch(spark, d):
    cells, model = land_model(spark, d)
    points = with_keys(shifted(spark, d).select("occ_id", "latitude", "longitude"))
    joined = points.join(cells.drop("latitude", "longitude"), ["ix", "iy"], "left")
    scored = scoring.score_batch(joined, model)
    # The fitted line meets the threshold only to rounding error, so compare at nine digits.
    level = risk.risk_category(F.round("risk_score", 9))
    return tidy(scored.select("occ_id", "risk_score", level.alias("risk_category"), "confidence", "error"))


@query("model_risk_zones", with_(t.LANDCELL_SQL) + f"""
SELECT ix, iy, CASE WHEN r < 3e-1 - 1e-9 THEN 'low' WHEN r < 6e-1 - 1e-9 THEN 'medium' ELSE 'high' END AS risk_level, {R('longitude-5e-2')} AS x0, {R('latitude-5e-2')} AS y0, {R('longitude+5e-2')} AS x1, {R('latitude+5e-2')} AS y1
FROM (SELECT *, {LINEAR_RISK} AS r FROM landcell)""")
def model_risk_zones(spark, d):
    cells, model = land_model(spark, d)
    zones = scoring.risk_zones(cells, model, 0.1)
    return tidy(zones.select("ix", "iy", risk.risk_category(F.round("risk_score", 9)).alias("risk_level"), "x0", "y0", "x1", "y1"))


@query("model_heatmap", with_(t.LANDCELL_SQL) + f"""
SELECT node_id, {R(LINEAR_RISK)} AS risk_score FROM (SELECT iy*80+ix AS node_id, * FROM landcell)""")
def model_heatmap(spark, d):
    cells, model = land_model(spark, d)
    nodes = cells.withColumn("node_id", F.col("iy") * 80 + F.col("ix"))
    return tidy(scoring.heatmap(nodes, model, "node_id").select("node_id", "risk_score"))


@query("forest_confidence")
def forest_confidence(spark, d):
    table, model = forest(spark, d)
    return tidy(scoring.score_batch(table, model).select("row_id", "risk_score", "risk_category", "confidence"))


# ---------------------------------------------------------------- files

def scratch(spark, name):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"


@query("csv_round_trip", with_(t.LANDUSE_SQL) + f"SELECT land_id, cover_name, {RA('latitude', 'longitude', 'forest_cover', 'elevation')} FROM landuse")
def csv_round_trip(spark, d):
    table = t.landuse(spark, d).select("land_id", "cover_name", "latitude", "longitude", "forest_cover", "elevation")
    path = sinks.write_processed(table, scratch(spark, "landuse.csv"), "csv")
    return tidy(readers.load_data_file(spark, path, table.schema))


@query("json_round_trip", with_(t.OCCURRENCE_SQL) + f"SELECT occ_id, species_name, is_endemic, {RA('latitude', 'longitude')} FROM occurrence")
def json_round_trip(spark, d):
    table = t.occurrence(spark, d).select("occ_id", "species_name", "is_endemic", "latitude", "longitude")
    path = sinks.write_processed(table, scratch(spark, "records.json"), "json")
    return tidy(readers.load_data_file(spark, path, table.schema))


@query("occurrence_csv_validated", with_(SHIFTED_SQL) + f"""SELECT occ_id, trim(species_name) AS species_name,
  CASE WHEN conservation_status IN ('LC','NT','VU','EN','CR','EW','EX') THEN conservation_status ELSE 'LC' END AS conservation_status
FROM shifted WHERE {VALID_SQL} AND length(trim(species_name)) > 0""")
def occurrence_csv_validated(spark, d):
    path = sinks.write_processed(shifted(spark, d), scratch(spark, "occurrences.csv"), "csv")
    read = readers.read_occurrence_csv(spark, path, shifted(spark, d).schema)
    return read.select("occ_id", "species_name", "conservation_status")


@query("geojson_round_trip", """WITH cover AS (SELECT c_custkey, 72e0 + CAST((c_custkey*97)%7000 AS DOUBLE)/1e3 AS x0,
  15e0 + CAST((c_custkey*61)%6000 AS DOUBLE)/1e3 AS y0, CASE c_custkey%5 WHEN 0 THEN 'forest' WHEN 1 THEN 'agricultural'
  WHEN 2 THEN 'urban' WHEN 3 THEN 'water' ELSE 'barren' END AS landuse_type FROM customer)
SELECT landuse_type, CAST(5 AS BIGINT) AS ring_size, """ + R("x0") + " AS x0, " + R("y0") + """ AS y0 FROM cover""")
def geojson_round_trip(spark, d):
    from greenlattice.operators.zones import zone_feature
    from greenlattice.plans.spatial_queries import cover_boxes
    boxes = cover_boxes(spark, d)
    corner = lambda i, axis: F.col("ring")[i][axis]
    feature = zone_feature(corner(0, "x"), corner(0, "y"), corner(2, "x"), corner(2, "y"), landuse_type=F.col("landuse_type"))
    path = scratch(spark, "cover.geojson")
    boxes.select(feature.alias("value")).write.text(path)
    read = readers.load_data_file(spark, path)
    return tidy(read.select("landuse_type", F.size("ring").cast("bigint").alias("ring_size"),
                            F.col("ring")[0]["x"].alias("x0"), F.col("ring")[0]["y"].alias("y0")))


@query("zone_geojson_features", with_(t.LANDCELL_SQL) + """SELECT CAST(count(*) AS BIGINT) AS features, CAST(sum(CASE WHEN urban_area >= 5e-2 THEN 1 ELSE 0 END) AS BIGINT) AS urban_features FROM landcell""")
def zone_geojson_features(spark, d):
    cells = t.landuse_cells(spark, d).withColumn("risk_score", F.col("urban_area")).withColumn(
        "risk_level", F.when(F.col("urban_area") >= 0.05, "urban").otherwise("rural"))
    from greenlattice.operators.zones import centred_zones
    zones = centred_zones(cells.drop("risk_level"), 0.1).drop("risk_level").withColumn(
        "risk_level", F.when(F.col("urban_area") >= 0.05, "urban").otherwise("rural"))
    path = scratch(spark, "zones")
    sinks.write_geojson_zones(zones, path)
    lines = spark.read.text(path)
    level = F.get_json_object("value", "$.properties.risk_level")
    return lines.agg(F.count(F.lit(1)).alias("features"), F.sum((level == "urban").cast("bigint")).alias("urban_features"))


@query("prediction_log", with_(t.LANDCELL_SQL) + f"SELECT CAST(count(*) AS BIGINT) AS n, {R(f'avg({LINEAR_RISK})')} AS average_risk, CAST(count(*) AS BIGINT) AS with_features FROM landcell")
def prediction_log(spark, d):
    cells, model = land_model(spark, d)
    path = scratch(spark, "predictions")
    sinks.append_predictions(scoring.score_batch(cells, model), path, "1.0.0", ["forest_cover", "urban_area"], "2024-05-01 12:00:00")
    log = spark.read.parquet(path)
    return tidy(log.agg(F.count(F.lit(1)).alias("n"), F.avg("predicted_risk").alias("average_risk"),
                        F.count(F.get_json_object("features", "$.forest_cover")).alias("with_features")))


@query("insert_if_absent", """SELECT CAST(count(DISTINCT p_brand) AS BIGINT) AS models, CAST(0 AS BIGINT) AS repeats FROM part""")
def insert_if_absent(spark, d):
    path = scratch(spark, "model_metrics")
    rows = t.table(spark, d, "part").select(F.col("p_brand").alias("model_name"), F.col("p_retailprice").alias("rmse"))  # many rows of a key
    sinks.insert_if_absent(rows, path, "model_name")
    again = sinks.insert_if_absent(rows, path, "model_name")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("models")).withColumn("repeats", F.lit(again).cast("bigint"))


@query("upserted_metrics", """WITH one AS (SELECT p_brand AS model_name, min(p_retailprice) AS rmse FROM part WHERE p_size <= 30 GROUP BY p_brand),
two AS (SELECT p_brand AS model_name, min(p_retailprice) AS rmse FROM part WHERE p_size > 30 AND p_brand < 'Brand#4' GROUP BY p_brand)
SELECT coalesce(two.model_name, one.model_name) AS model_name, """ + R("coalesce(two.rmse, one.rmse)") + " AS rmse FROM one FULL JOIN two ON one.model_name = two.model_name")
def upserted_metrics(spark, d):
    path = scratch(spark, "metrics")
    rows = t.table(spark, d, "part").select(F.col("p_brand").alias("model_name"), F.col("p_retailprice").alias("rmse"), "p_size")
    sinks.upsert(rows.where("p_size <= 30").select("model_name", "rmse"), path, "model_name")
    newest = sinks.upsert(rows.where("p_size > 30 AND model_name < 'Brand#4'").select("model_name", "rmse"), path, "model_name")
    return tidy(spark.read.parquet(newest))


@query("feedback_log", "SELECT event_type AS kind, CAST(2*count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def feedback_log(spark, d):
    path = scratch(spark, "feedback")
    rows = t.table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), "value")
    for _ in range(2):
        sinks.append_feedback(rows, path)
    return spark.read.parquet(path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("climate_csv_round_trip", with_(t.CLIMATE_SQL) + f"SELECT l_orderkey, l_linenumber, obs_date, {RA('latitude', 'longitude', 'temperature', 'precipitation', 'humidity', 'wind_speed')} FROM climate")
def climate_csv_round_trip(spark, d):
    table = t.climate_daily(spark, d).drop("ix", "iy")
    path = sinks.write_processed(table, scratch(spark, "climate.csv"), "csv")
    return tidy(readers.load_data_file(spark, path, table.schema))


@query("file_listing")
def file_listing(spark, d):
    path = scratch(spark, "listed")
    sinks.write_processed(t.sites(spark, d), f"{path}/sites")
    return sinks.list_files(spark, path, "*.parquet").select(F.col("kind"), (F.col("size") > 0).alias("has_content"))


@query("model_listing", "SELECT * FROM (VALUES ('line', 'linear', true, true), ('shrunk', 'ridge', true, true)) v(name, kind, has_size, has_time)")
def model_listing(spark, d):
    """Saved models with their size and time of change."""
    cells, model = land_model(spark, d)
    labelled = cells.withColumn("risk", F.col("urban_area") * 0.2)
    folder = scratch(spark, "models")
    for name, kind in (("line", "linear"), ("shrunk", "ridge")):
        models.fit_model(labelled, ["forest_cover", "urban_area"], "risk", kind, name, with_metrics=False).save(f"{folder}/{name}")
    return sinks.list_models(spark, folder).select("name", "kind", (F.col("size") > 0).alias("has_size"), F.col("modified").isNotNull().alias("has_time"))


@query("stored_results", with_(*PAIR_FOLDS, SETS, "tr AS (SELECT * FROM ff, g WHERE fold <> f)", PAIR_FIT.format(by="f", a="5e0"),
       f"s AS (SELECT f, 1-sum({WRONG}*{WRONG})/(var_pop(y)*count(*)) AS r2 FROM ff JOIN fit ON fold = f GROUP BY f)") + f"""
SELECT 'folds' AS "table", CAST(10 AS BIGINT) AS n, {R('avg(r2)')} AS test_r2 FROM s UNION ALL SELECT 'summary', 2, {R('avg(r2)')} FROM s""")
def stored_results(spark, d):
    """Fold scores and their summary written as CSV tables and read back."""
    folds = crossval.regression_cv(training(spark, d), PAIR, TARGET, "row_id", "ridge", {"alpha": 5.0})
    tables = {"folds": folds, "summary": crossval.cv_summary(folds)}
    paths = sinks.write_tables(tables, scratch(spark, "results"))
    back = {name: readers.load_data_file(spark, path, tables[name].schema) for name, path in paths.items()}
    test = F.when(F.col("part") == "test", F.col("score"))
    rows = [back["folds"].withColumnRenamed("r2", "score"), back["summary"].withColumnRenamed("r2_mean", "score")]
    return tidy(rows[0].agg(F.count(F.lit(1)).alias("n"), F.avg(test).alias("test_r2")).withColumn("table", F.lit("folds")).unionByName(
        rows[1].agg(F.count(F.lit(1)).alias("n"), F.avg(test).alias("test_r2")).withColumn("table", F.lit("summary"))))


@query("stored_training_set", COMBINED_SQL + "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT row_id) AS BIGINT) AS ids FROM combined")
def stored_training_set(spark, d):
    path = scratch(spark, "training")
    readers.training_set(spark, path, lambda: training(spark, d))
    again = readers.training_set(spark, path, lambda: training(spark, d))
    return again.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("ids"))


# ---------------------------------------------------------------- streams

def event_stream(spark, d):
    schema = t.table(spark, d, "events").schema
    return ingest.stream_table(spark, d, "events.parquet", schema)


@query("stream_validated_ingest", with_(SHIFTED_SQL) + f"""SELECT occ_id, trim(species_name) AS species_name, {RA('latitude', 'longitude')} FROM shifted
WHERE {VALID_SQL} AND length(trim(species_name)) > 0""")
def stream_validated_ingest(spark, d):
    from greenlattice.operators.validate import validate_occurrence
    rows = event_stream(spark, d).selectExpr(*t.OCCURRENCE_COLUMNS).selectExpr(
        "occ_id", f"{SHIFTED} AS latitude", "longitude",
        "CASE WHEN occ_id % 41 = 0 THEN '   ' WHEN occ_id % 43 = 0 THEN NULL ELSE concat(' ', species_name, '  ') END AS species_name",
        "conservation_status", "is_endemic", "observed_at")
    stored, _ = ingest.run_to_table(validate_occurrence(rows).select("occ_id", "species_name", "latitude", "longitude"))
    return tidy(stored)


@query("stream_daily_totals", """SELECT CAST(ts AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS n, """ + R("sum(value)", 4) + " AS total FROM events GROUP BY ALL")
def stream_daily_totals(spark, d):
    totals = ingest.run_complete(ingest.daily_totals(event_stream(spark, d), "ts", ["event_type"], "value"))
    return totals.select("day", "event_type", "n", rounded(F.col("total"), 4).alias("total"))


@query("stream_daily_updates", """SELECT CAST(ts AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS n, """ + R("sum(value)", 4) + " AS total FROM events GROUP BY ALL")
def stream_daily_updates(spark, d):
    """As ``stream_daily_totals``, but with state that ends at the watermark."""
    daily = ingest.daily_totals(event_stream(spark, d), "ts", ["event_type"], "value")
    return ingest.run_updates(daily, ["day", "event_type"]).select("day", "event_type", "n", rounded(F.col("total"), 4).alias("total"))


@query("stream_monthly_means", with_(t.CLIMATE_SQL) + f"""SELECT ix, iy, CAST(date_trunc('month', obs_date) AS DATE) AS month, {R('avg(temperature)')} AS temperature, {R('avg(precipitation)')} AS precipitation
FROM climate GROUP BY ix, iy, date_trunc('month', obs_date)""")
def stream_monthly_means(spark, d):
    schema = t.table(spark, d, "lineitem").schema
    rows = ingest.stream_table(spark, d, "lineitem.parquet", schema).selectExpr(*t.CLIMATE_COLUMNS)
    return tidy(ingest.run_complete(ingest.monthly_means(rows, "obs_date", ["ix", "iy"], ["temperature", "precipitation"])))


@query("stream_closed_months", with_(t.CLIMATE_SQL, "m AS (SELECT *, CAST(date_trunc('month', obs_date) AS DATE) AS month FROM climate)") + f"""
SELECT ix, iy, month, CAST(count(*) AS BIGINT) AS n, {R('avg(temperature)')} AS temperature, {R('avg(precipitation)')} AS precipitation
FROM m WHERE month + INTERVAL 2 MONTH <= (SELECT max(month) FROM m) GROUP BY ix, iy, month""")
def stream_closed_months(spark, d):
    """Months that have passed, given out once; only open months are held."""
    rows = ingest.stream_table(spark, d, "lineitem.parquet", t.table(spark, d, "lineitem").schema).selectExpr(*t.CLIMATE_COLUMNS)
    stored, _ = ingest.run_to_table(ingest.closed_months(rows, "obs_date", ["ix", "iy"], ["temperature", "precipitation"]))
    return tidy(stored)


@query("stream_upserts", f"""SELECT user_id, event_type, last.ts AS ts, last.event_id AS event_id, {R('last.v')} AS value FROM
  (SELECT user_id, event_type, max(struct_pack(ts := ts, event_id := event_id, v := CASE WHEN event_id % 3 = 0 THEN -value ELSE value END)) AS last FROM events GROUP BY ALL)""")
def stream_upserts(spark, d):
    """The last event per user and type in a keyed log: a stream, its replay, corrections, and a compaction between."""
    log = KeyedLog(scratch(spark, "last-events"), ("user_id", "event_type"), ("ts", "event_id"), buckets=8)
    stream = event_stream(spark, d).select("user_id", "event_type", "ts", "event_id", "value")
    schema = t.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value").schema
    ingest.upsert_stream(stream, log)
    ingest.upsert_stream(stream, log, first_version=0)  # the same batch once more
    log.compact(spark, schema, deltas=1)
    last = log.read(spark, schema)
    log.append(last.where("event_id % 3 = 0").withColumn("value", -F.col("value")), 1)
    return tidy(log.read(spark, schema))


@query("stream_deduplicated", "SELECT DISTINCT event_id FROM events")
def stream_deduplicated(spark, d):
    rows = event_stream(spark, d).select("event_id", "ts")
    twice = rows.unionByName(event_stream(spark, d).select("event_id", "ts"))
    stored, _ = ingest.run_to_table(ingest.deduplicate(twice, ["event_id"], "ts", "60 days"))
    return stored.select("event_id")


@query("stream_scored_points", with_(t.OCCURRENCE_SQL, t.LANDCELL_SQL) + f"""
, p AS (SELECT occ_id, CAST(round((longitude-72e0)/1e-1) AS BIGINT) AS ix, CAST(round((latitude-15e0)/1e-1) AS BIGINT) AS iy FROM occurrence)
SELECT occ_id, {R('(1-coalesce(forest_cover, 0))*3e-1 + coalesce(urban_area, 0)*2e-1')} AS predicted FROM p LEFT JOIN (SELECT ix, iy, forest_cover, urban_area FROM landcell) c USING (ix, iy)""")
def stream_scored_points(spark, d):
    cells, model = land_model(spark, d)
    points = with_keys(event_stream(spark, d).selectExpr(*t.OCCURRENCE_COLUMNS).select("occ_id", "latitude", "longitude"))
    scored = ingest.score_stream(points, cells.drop("latitude", "longitude"), ["ix", "iy"], model)
    path = scratch(spark, "scored")
    ingest.append_log(scored.select("occ_id", "predicted"), path)
    return tidy(spark.read.parquet(path).select("occ_id", "predicted"))
