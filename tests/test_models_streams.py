import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from greenlattice.functions.numeric import scatter_key
from greenlattice.operators import crossval, metrics, models, moments, scoring, splits, trees
from greenlattice.sources import landed, readers, sinks
from greenlattice.streaming import ingest

COLS = [f"feature_{i}" for i in range(4)]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(42)
    x = rng.normal(size=(500, 4))
    y = x @ [3.0, -2.0, 0.5, 0.0] + 1 + rng.normal(0, 0.1, 500)
    return pd.DataFrame(x, columns=COLS).assign(target=y, row_id=np.arange(500))


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame)


def centred(frame):
    x, y = frame[COLS].to_numpy(), frame["target"].to_numpy()
    return x - x.mean(0), y - y.mean()


def test_ridge_is_closed_form(frame, df):
    x, y = centred(frame)
    want = np.linalg.solve(x.T @ x + 7 * np.eye(4), x.T @ y)
    got = models.fit_model(df, COLS, "target", "ridge", params={"alpha": 7.0}).core.coefficients.toArray()
    np.testing.assert_allclose(got, want, atol=1e-8)


def test_lasso_meets_optimality(frame, df):
    x, y = centred(frame)
    b = models.fit_model(df, COLS, "target", "lasso", params={"alpha": 0.3}).core.coefficients.toArray()
    g = x.T @ (y - x @ b) / len(y)
    for gi, bi in zip(g, b):
        assert abs(gi - 0.3 * np.sign(bi)) < 1e-4 if bi else abs(gi) <= 0.3 + 1e-4


def test_path_agrees_with_fits(spark, df):
    path = {(round(r["alpha"], 6), r["feature"]): r["coefficient"] for r in models.regularization_path(
        spark, df, COLS, "target", "lasso", [0.3]).collect()}
    b = models.fit_model(df, COLS, "target", "lasso", params={"alpha": 0.3}).core.coefficients.toArray()
    assert [path[(0.3, c)] for c in COLS] == pytest.approx(list(b), abs=1e-4)


def test_forest_importance_save_load_and_spread(spark, df, tmp_path):
    model = models.fit_model(df, COLS, "target", "random_forest", params={"n_estimators": 8, "max_depth": 5}, validation=df)
    imp = model.importance(spark).toPandas()
    assert imp["importance"].sum() == pytest.approx(1) and imp["feature"][0] == "feature_0"
    assert model.train_metrics["r2"] > 0.8 and model.validation_metrics
    model.save(str(tmp_path / "forest"))
    loaded, default = models.load_models(spark, [str(tmp_path / "forest")])
    a = model.predict(df).orderBy("row_id").toPandas()["predicted"]
    b = loaded[default].predict(df).orderBy("row_id").toPandas()["predicted"]
    np.testing.assert_array_equal(a, b)
    spread = models.tree_spread(model, df).orderBy("row_id").toPandas()
    np.testing.assert_allclose(spread["tree_mean"], a)
    assert (spread["tree_std"] > 0).any()
    listing = sinks.list_models(spark, str(tmp_path)).collect()
    assert [(r["name"], r["kind"]) for r in listing] == [("random_forest", "random_forest")]
    stored = sum(f.stat().st_size for f in (tmp_path / "forest").rglob("*") if f.is_file() and not f.name.startswith((".", "_")))
    assert listing[0]["size"] == stored and listing[0]["path"] == str(tmp_path / "forest") and listing[0]["modified"] is not None
    left = sinks.run_summary(spark, str(tmp_path / "forest"))
    assert left["bytes"] == stored and left["files"] == sum(k["files"] for k in left["kinds"].values())
    paths = sinks.write_tables({"importance": model.importance(spark), "kinds": model.importance_by_kind(spark)}, str(tmp_path / "tables"))
    assert spark.read.option("header", True).csv(paths["importance"]).count() == 4 and paths["kinds"].endswith("kinds.csv")


def test_rows_of_a_forest_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(models, "FOREST_ROWS", 50)
    rows = [(i % 7 if i % 3 else None, float(i % 11)) for i in range(420)]
    one = spark.createDataFrame(rows, "a long, b double").coalesce(1)
    spread = models.spread(one, ["b", "a"])
    assert spread.rdd.getNumPartitions() == 9 and max(spread.rdd.glom().map(len).collect()) < 60
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.a, r.b) for r in spread.collect()), key=key) == sorted(rows, key=key)
    assert models.spread(one.limit(40), ["a"]).rdd.getNumPartitions() == 1


def test_feature_order_and_missing_feature(df):
    model = models.fit_model(df, COLS, "target", "linear")
    shuffled = df.select(*reversed(df.columns)).withColumn("extra", F.lit(1))
    assert model.evaluate(shuffled)["r2"] == pytest.approx(model.train_metrics["r2"])
    with pytest.raises(ValueError):
        model.predict(df.drop("feature_0"))


def test_polynomial_importance_sums_into_base(spark, df):
    model = models.fit_model(df, COLS[:2], "target", "linear", degree=2)
    assert {r["feature"] for r in model.importance(spark).collect()} == set(COLS[:2])
    assert model.equation().startswith("y = ")


def test_registry_takes_new_kinds_and_failures_are_skipped(df):
    @models.register_model("flat")
    def flat(params, facts):
        return models.LinearRegression(featuresCol="features", labelCol="label", predictionCol="predicted", regParam=1e9)
    done, failed = models.train_all(df, COLS, "target", {"flat": {"kind": "flat"}, "bad": {"kind": "unknown"}})
    assert set(done) == {"flat"} and "unknown" in failed["bad"]
    del models.MODELS["flat"]


def test_comparison_and_best(spark, df):
    done, _ = models.train_all(df, COLS, "target", {"a": {"kind": "linear"}, "b": {"kind": "lasso", "params": {"alpha": 1.0}}})
    table = models.comparison_table(spark, done, df, "b")
    assert models.best_model(table, "r2").first()["model"] == "a" and models.best_model(table, "rmse").first()["model"] == "a"
    assert table.where("model = 'a'").first()["improvement"] > 0


@pytest.mark.parametrize("rows_per_bucket", [10**9, 40])
def test_split_and_fold_sizes(df, rows_per_bucket):
    labels = splits.train_test_labels(df, "row_id", 0.2, 0.2, rows_per_bucket=rows_per_bucket).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in labels} == {"test": 100, "validation": 80, "train": 320}
    folds = splits.kfold(df.where("row_id < 499"), "row_id", 5, rows_per_bucket=rows_per_bucket).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [99, 100, 100, 100, 100]
    lop = df.withColumn("c", (F.col("row_id") % 10 == 0).cast("int"))
    deal = splits.stratified_kfold(lop, "row_id", "c", 5, rows_per_bucket=rows_per_bucket).groupBy("c", "fold").count().collect()
    assert {(r["c"], r["count"]) for r in deal} == {(0, 90), (1, 10)}


def test_time_blocks(df):
    parts = splits.time_series_block(df.withColumn("t", F.col("row_id") % 7), "t", "row_id", 4).cache()
    assert sorted(r["count"] for r in parts.groupBy("block").count().collect()) == [100] * 5
    train, test = splits.time_series_fold(parts, 1)
    assert train.agg(F.max("t")).first()[0] <= test.agg(F.min("t")).first()[0]


def test_cross_validation(df):
    scores = crossval.regression_cv(df, COLS, "target", "row_id", "linear", k=3)
    assert scores.count() == 6 and scores.agg(F.min("r2")).first()[0] > 0.99
    summary = {r["part"]: r for r in crossval.cv_summary(scores).collect()}
    assert summary["test"]["r2_std"] < 0.01
    with pytest.raises(ValueError):
        crossval.regression_cv(df, COLS, "target", "row_id", "linear", cv_type="other")


def test_learning_curve_grows(df):
    got = crossval.learning_curve(df, COLS, "target", "row_id", "linear", sizes=[0.1, 1.0], k=2).orderBy("size").collect()
    assert got[0]["validation_mean"] <= got[1]["validation_mean"] + 1e-3


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(1, .9), (1, .5), (0, .5), (0, .1)], "y int, s double")
    assert metrics.binary_auc(rows, "y", "s").first()[0] == pytest.approx(0.875)


def test_scoring_keeps_every_row(df):
    model = models.fit_model(df, COLS, "target", "linear")
    rows = df.withColumns({"latitude": F.when(F.col("row_id") == 3, 100.0).otherwise(10.0), "longitude": F.lit(20.0)})
    out = scoring.score_batch(rows, model)
    assert out.count() == 500
    bad = out.where("error is not null").collect()
    assert [r["row_id"] for r in bad] == [3] and bad[0]["risk_score"] is None
    assert out.where("error is null and risk_score between 0 and 1").count() == 499


def test_partial_dependence_of_line(df):
    model = models.fit_model(df, COLS, "target", "linear")
    got = models.partial_dependence(model, df, "feature_0", 10).orderBy("grid_value").collect()
    slope = (got[-1]["average"] - got[0]["average"]) / (got[-1]["grid_value"] - got[0]["grid_value"])
    assert len(got) == 10 and slope == pytest.approx(model.core.coefficients[0])


def test_readers(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType())])
    rows = spark.createDataFrame([(1.5, "x"), (float("nan"), "y")], schema)
    for kind in ("csv", "json", "parquet"):
        path = sinks.write_processed(rows, str(tmp_path / f"t.{kind}"), kind)
        got = readers.load_data_file(spark, path, schema).orderBy("b").collect()
        assert got[0]["a"] == 1.5 and got[1]["a"] is None
    with pytest.raises(ValueError):
        readers.load_data_file(spark, "table.xlsx")


def test_geojson_collection_and_ring_text(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"landuse_type": "forest"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}},
        {"type": "Feature", "properties": {"landuse_type": "flat"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]}}]}
    (tmp_path / "c.geojson").write_text(json.dumps(doc, indent=1))
    got = readers.read_geojson_polygons(spark, str(tmp_path / "c.geojson"), lines=False).collect()
    assert [r["landuse_type"] for r in got] == ["forest"] and len(got[0]["ring"]) == 4
    ring = readers.parse_rings(spark.createDataFrame([("0 0, 1 0,1 2.5",)], "t string"), "t").first()["ring"]
    assert [tuple(p) for p in ring] == [(0.0, 0.0), (1.0, 0.0), (1.0, 2.5)]


def test_flatten_records(spark):
    docs = [{"decimalLatitude": 1.0, "decimalLongitude": 2.0, "species": "Oak", "eventDate": "2020-05-01/2021-01-01"},
            {"decimalLatitude": 1.0, "decimalLongitude": 2.0, "scientificName": "Quercus", "eventDate": "spring", "year": "1999"},
            {"decimalLatitude": 1.0, "decimalLongitude": 2.0, "year": "1999"}, {"species": "Elm"}]
    rows = spark.createDataFrame([(json.dumps(x),) for x in docs], "value string")
    assert [(r["species_name"], r["year"]) for r in landed.flatten_records(rows).collect()] == [("Oak", 2020), ("Quercus", 1999), ("Unknown", None)]


def test_fetch_has_no_limit_of_its_own(spark):
    rows = spark.range(20_000).selectExpr("id AS occ_id", "1.0D AS longitude", "2.0D AS latitude", "'a' AS basis_of_record")
    assert landed.fetch_occurrences(rows, (0, 0, 5, 5), None).count() == 20_000
    assert landed.fetch_occurrences(rows, (0, 0, 5, 5), ["a"], "occ_id", 10_001).count() == 10_001


def test_reports_written(spark, df, tmp_path):
    done, _ = models.train_all(df, COLS, "target", {"a": {"kind": "linear"}})
    table = models.comparison_table(spark, done, df)
    sinks.write_evaluation_report(table, models.best_model(table), str(tmp_path / "r"))
    report = json.loads(spark.read.text(str(tmp_path / "r")).first()[0])
    assert report["best"]["model"] == "a" and report["n_models"] == 1


def test_insert_if_absent_and_listing(spark, tmp_path):
    rows = spark.createDataFrame([("m", 1.0), ("n", 2.0)], "model_name string, rmse double")
    path = str(tmp_path / "metrics")
    assert sinks.insert_if_absent(rows, path, "model_name") == 2
    assert sinks.insert_if_absent(rows.unionByName(spark.createDataFrame([("o", 3.0)], rows.schema)), path, "model_name") == 1
    assert sinks.list_files(spark, path, "*.parquet").where("size > 0").count() >= 1
    twice = spark.createDataFrame([("p", 5.0), ("p", 4.0), ("m", 9.0)], rows.schema)
    assert sinks.insert_if_absent(twice, path, "model_name") == 1
    assert spark.read.parquet(path).where("model_name = 'p'").first()["rmse"] == 4.0


def test_upsert_keeps_one_row_per_key(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    path = str(tmp_path / "t")
    sinks.upsert(make((1, "a"), (2, "b")), path, "k")
    last = sinks.upsert(make((2, "c"), (3, "d"), (3, "e")), path, "k")
    assert sorted(map(tuple, spark.read.parquet(last).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sinks.latest_version(spark, path) == 1 and sinks.latest_version(spark, str(tmp_path / "none")) is None


def test_late_rows_and_empty_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    st = spark.createDataFrame([], "id bigint, ts timestamp, v double").schema
    row = lambda i, day: spark.createDataFrame([(i, day, 1.0)], "id bigint, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    spark.createDataFrame([], st).write.parquet(source)
    totals = lambda: ingest.daily_totals(ingest.stream_table(spark, source, "*.parquet", st, 1), "ts", [], "v")
    assert ingest.run_complete(ingest.daily_totals(ingest.stream_table(spark, source, "none*", st), "ts", [], "v")).count() == 0
    keep = {"path": str(tmp_path / "out"), "checkpoint": str(tmp_path / "ck")}
    for i, day in enumerate(["2024-01-01", "2024-01-10", "2024-01-10", "2024-01-02"]):  # the last one is behind the watermark
        row(i, day).coalesce(1).write.mode("append").parquet(source)
        got = ingest.run_updates(totals(), ["day"], **keep)
    assert {str(r["day"]): r["n"] for r in got.collect()} == {"2024-01-01": 1, "2024-01-10": 2}


def test_scatter_order_of_large_ids(spark):
    ids = [0, 1, 5, 2**31, 2**32 - 1, 2**32, 2**33 + 7, 3_470_000_000, 2**62, 2**63 - 1, -1, -(2**63)]
    got = {r["id"]: r["k"] for r in spark.createDataFrame([(i,) for i in ids], "id long").select("id", scatter_key(F.col("id")).alias("k")).collect()}
    assert len(set(got.values())) == len(ids)
    small = [i for i in ids if 0 <= i < 2**32]
    assert sorted(small, key=got.get) == sorted(small, key=lambda i: i * 2654435761 % 2**32)
    big = spark.range(1000).selectExpr(f"id * 7 + {2**62} AS id")
    sizes = {r["fold"]: r["count"] for r in splits.kfold(big, "id", 5).groupBy("fold").count().collect()}
    assert sizes == {i: 200 for i in range(5)}
    labels = {r["split"]: r["count"] for r in splits.train_test_labels(big, "id", 0.2).groupBy("split").count().collect()}
    assert labels == {"test": 200, "train": 800}


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    schema = "id bigint, ts timestamp, v double"
    make = lambda lo, hi: spark.range(lo, hi).selectExpr("id", "timestamp'2024-01-01' + make_interval(0,0,0,0,id) AS ts", "CAST(id AS DOUBLE) AS v")
    source = str(tmp_path / "in")
    make(0, 10).write.mode("append").parquet(source)
    st = spark.createDataFrame([], schema).schema
    run = lambda: ingest.run_to_table(ingest.stream_table(spark, source, "*.parquet", st).where("v >= 2"),
                                      str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"))[0].count()
    assert run() == 8
    make(10, 15).write.mode("append").parquet(source)
    assert run() == 13
    totals = ingest.run_complete(ingest.daily_totals(ingest.stream_table(spark, source, "*.parquet", st), "ts", [], "v"))
    assert totals.agg(F.sum("n")).first()[0] == 15


def by_fitting(df, features, kind, params, k, degree=1, cv_type="kfold"):
    """Fold scores the long way: a fit per fold, a scan per part."""
    out = {}
    parts = splits.kfold(df, "row_id", k) if cv_type == "kfold" else splits.time_series_block(df, "row_id", "row_id", k)
    for i in range(k):
        if cv_type == "kfold":
            train, test = parts.where(F.col("fold") != i), parts.where(F.col("fold") == i)
        else:
            train, test = splits.time_series_fold(parts, i)
        model = models.fit_model(train, features, "target", kind, params=params, degree=degree, with_metrics=False)
        for part, data in (("train", train), ("test", test)):
            out[i, part] = model.evaluate(data)
    return out


@pytest.mark.parametrize("kind,params,degree,cv_type", [
    ("linear", None, 1, "kfold"), ("ridge", {"alpha": 3.0}, 1, "kfold"), ("lasso", {"alpha": 0.05}, 1, "kfold"),
    ("elastic_net", {"alpha": 0.05, "l1_ratio": 0.3}, 1, "kfold"), ("ridge", {"alpha": 1.0}, 2, "kfold"), ("linear", None, 1, "timeseries"),
    ("linear", {"fit_intercept": False}, 1, "kfold")])
def test_sums_score_as_fits_do(df, kind, params, degree, cv_type):
    noisy = df.withColumn("target", F.col("target") + F.hash("row_id") % 7 * 0.1)
    scorers = ["r2", "mse", "rmse", "mae", "neg_mse", "neg_mae"]
    got = crossval.regression_cv(noisy, COLS, "target", "row_id", kind, params, k=3, cv_type=cv_type, time="row_id", degree=degree, scorers=scorers).collect()
    want = by_fitting(noisy, COLS, kind, params, 3, degree, cv_type)
    assert len(got) == 6
    for r in got:
        m = want[r["fold"], r["part"]]
        for name in ("r2", "mse", "rmse", "mae"):
            assert r[name] == pytest.approx(m[name], rel=1e-4, abs=1e-6)
        assert r["neg_mse"] == -r["mse"] and r["neg_mae"] == -r["mae"]


def test_sums_take_one_job_for_all_folds_and_sizes(spark, df):
    spark.sparkContext.setJobGroup("curve", "learning curve")
    got = crossval.learning_curve(df, COLS, "target", "row_id", "linear", k=5)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("curve"))
    spark.sparkContext.setJobGroup("other", "")
    assert got.count() == 10 and jobs < 30  # 50 fits and 100 scans before
    with pytest.raises(ValueError):
        crossval.regression_cv(df, COLS, "target", "row_id", "linear", scorers=["accuracy"])
    with pytest.raises(ValueError):
        crossval.regression_cv(df.withColumn(COLS[0], F.when(F.col("row_id") > 3, F.col(COLS[0]))), COLS, "target", "row_id", "linear")


def test_moments_merge():
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1, (500, 3))

    def of(rows):
        mean = rows.mean(axis=0) if len(rows) else np.zeros(3)
        return moments.Moments(len(rows), mean, (rows - mean).T @ (rows - mean))

    whole = moments.merged([of(x[a:b]) for a, b in ((0, 1), (1, 1), (1, 70), (70, 500))], 3)
    assert whole.n == 500 and np.allclose(whole.mean, x.mean(axis=0)) and np.allclose(whole.cross, of(x).cross, rtol=1e-6)
    flat = moments.fit(of(np.column_stack([np.ones(9), np.arange(9.0), 2 * np.arange(9.0) + 1])))  # a constant column counts for nothing
    assert flat[0] == pytest.approx([0, 2]) and flat[1] == pytest.approx(1)
    assert moments.scores(of(x[:1]), *flat)["r2"] is None
    with pytest.raises(ValueError):
        moments.fit(moments.Moments.none(3))
    with pytest.raises(ValueError):
        moments.fit(whole, "random_forest")


@pytest.fixture(scope="module")
def tree_models(df):
    return [models.fit_model(df, COLS, "target", "random_forest", params={"n_estimators": 6, "max_depth": 5}, with_metrics=False),
            models.fit_model(df, COLS, "target", "gradient_boosting", params={"n_estimators": 5, "max_depth": 3}, with_metrics=False)]


def test_importance_kinds(spark, df, tree_models):
    for model in tree_models:
        nodes = model.nodes(spark)
        rows = {(r["feature"], r["kind"]): r for r in model.importance_by_kind(spark).collect()}
        assert len(rows) == 4 * len(trees.KINDS)
        for kind in trees.KINDS:
            assert sum(rows[f, kind]["share"] for f in COLS) == pytest.approx(1)
        splits = sum((t.numNodes - 1) // 2 for t in model.core.trees)
        assert sum(rows[f, "weight"]["score"] for f in COLS) == splits == nodes.where("feature is not null").count()
        text = "".join(t.toDebugString for t in model.core.trees)
        for i, f in enumerate(COLS):
            assert rows[f, "weight"]["score"] == text.count(f"If (feature {i} <=")
            if rows[f, "weight"]["score"]:
                assert rows[f, "total_cover"]["score"] == pytest.approx(rows[f, "cover"]["score"] * rows[f, "weight"]["score"])
        assert rows["feature_0", "total_gain"]["share"] == max(rows[f, "total_gain"]["share"] for f in COLS)
        # a split's rows are those of its children
        kids = nodes.alias("p").join(nodes.alias("c"), (F.col("p.tree") == F.col("c.tree")) & F.col("c.node").isin(F.col("p.left"), F.col("p.right")))
        assert kids.groupBy("p.tree", "p.node").agg((F.sum("c.cover") - F.first("p.cover")).alias("d")).where("abs(d) > 1e-6").isEmpty()


def test_partial_dependence_of_trees_is_that_of_all_rows(spark, frame, df, tree_models):
    grid = [-1.5, -0.2, 0.0, 0.4, 0.4, 2.0]
    for model in tree_models:
        fitted = trees.Trees.of(model.nodes(spark), COLS)
        got = trees.partial_dependence(fitted, df, COLS, "feature_1", grid)
        for v, average in zip(grid, got):
            assert average == pytest.approx(model.predict(df.withColumn("feature_1", F.lit(v))).agg(F.avg("predicted")).first()[0], rel=1e-9)
        near = trees.partial_dependence(fitted, None, COLS, "feature_1", grid)  # features are independent here
        assert np.corrcoef(near, got)[0, 1] > 0.98
        curve = models.partial_dependence(model, df, "feature_0", 20).orderBy("grid_value").collect()
        assert len(curve) == 20 and curve[0]["average"] < curve[-1]["average"]
    with pytest.raises(Exception, match="missing values"):
        trees.partial_dependence(fitted, df.withColumn("feature_2", F.when(F.col("row_id") > 5, F.col("feature_2"))), COLS, "feature_1", grid)
    assert all(np.isnan(trees.partial_dependence(fitted, df.limit(0), COLS, "feature_1", grid)))
