import datetime as dt
import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from greenlattice.functions import risk
from greenlattice.operators import features, scaling, selection, stats
from greenlattice.operators.metrics import regression_metrics, residual_analysis


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(42)
    n = 400
    return pd.DataFrame({"latitude": rng.uniform(15.6, 22, n), "longitude": rng.uniform(72.6, 80.9, n),
                         "temperature": rng.normal(25, 5, n), "precipitation": rng.exponential(2, n), "humidity": rng.uniform(30, 90, n),
                         "forest_cover": rng.random(n), "agricultural_area": rng.random(n), "urban_area": rng.random(n),
                         "species_count": rng.poisson(15, n), "endemic_species": rng.poisson(2, n), "threatened_species": rng.poisson(3, n)})


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame.reset_index(names="id"))


def column(df, name):
    return df.orderBy("id").toPandas()[name].to_numpy()


def test_bins_match_equal_width_cut(spark, frame, df):
    got = column(features.spatial_features(df), "lat_bin")
    np.testing.assert_array_equal(got, pd.cut(frame.latitude, bins=10, labels=False))
    rows = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (5.0,), (9.99,), (10.0,)], "x double")
    assert [r[0] for r in rows.select(features.equal_width_bin(F.col("x"), 0.0, 10.0)).collect()] == [0, 0, 1, 4, 9, 9]
    assert rows.select(features.equal_width_bin(F.lit(3.0), 3.0, 3.0)).first()[0] == pd.cut(pd.Series([3.0, 3.0]), bins=10, labels=False)[0]


def test_temporal_parts(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 18),), (dt.datetime(2024, 1, 3, 6),)], "when timestamp")
    a, b = features.temporal_features(rows, "when").orderBy("when").collect()
    assert a["when_weekday"] == 0 and b["when_days_since_start"] == 1 and a["when_quarter"] == 1
    assert a["when_month_sin"] == pytest.approx(math.sin(2 * math.pi / 12))


def test_row_statistics_skip_missing(spark):
    rows = spark.createDataFrame([(1.0, 2.0, None, 6.0), (None, None, None, 3.0), (None, None, None, None)], "a double, b double, c double, d double")
    got = features.statistical_features(rows).collect()
    assert got[0]["feature_mean"] == 3.0 and got[0]["feature_std"] == pytest.approx(statistics.stdev([1, 2, 6])) and got[0]["feature_range"] == 5
    assert got[1]["feature_std"] is None and got[1]["feature_min"] == 3 and got[2]["feature_mean"] is None


def test_engineer_all_adds_no_nulls(df):
    out = features.engineer_features(df).toPandas()
    assert len(out) == 400 and not out.isna().any().any() and len(out.columns) > 30


def test_polynomial_names(df):
    out = features.polynomial_features(df.select("id", "temperature", "humidity"), ["temperature", "humidity"], 3)
    assert out.columns == ["id", "temperature", "humidity", "temperature^2", "temperature humidity", "humidity^2", "temperature^3",
                           "temperature^2 humidity", "temperature humidity^2", "humidity^3"]


def test_risk_between_zero_and_one(df):
    out = features.ecological_risk(df)
    assert out.agg(F.min("ecological_risk"), F.max("ecological_risk")).first() == (0.0, 1.0)
    with pytest.raises(ValueError):
        features.ecological_risk(df.select("id"))


def test_risk_thresholds(spark):
    rows = spark.createDataFrame([(0.0,), (0.29,), (0.3,), (0.30001,), (0.59,), (0.6,), (1.0,), (None,)], "s double")
    assert [r[0] for r in rows.select(risk.risk_category(F.col("s"))).collect()] == ["low", "low", "medium", "medium", "medium", "high", "high", None]
    got = [r[0] for r in rows.select(risk.risk_bins(F.col("s"), 0.3, 0.6)).collect()]
    assert got == [None, "Low", "Low", "Medium", "Medium", "Medium", "High", None]


def test_moments_match(frame, df):
    got = {r["feature"]: r for r in stats.distribution_summary(df, ["precipitation", "temperature"]).collect()}
    for c in got:
        assert got[c]["skewness"] == pytest.approx(frame[c].skew()) and got[c]["kurtosis"] == pytest.approx(frame[c].kurtosis())
    assert got["temperature"]["level"] == "normal"


def test_correlation_matrix(frame, df):
    cols = ["temperature", "humidity", "forest_cover"]
    want = frame[cols].corr()
    for r in stats.correlation_matrix(df, cols).collect():
        assert r["correlation"] == pytest.approx(want.loc[r["feature_a"], r["feature_b"]])


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_scalers(frame, df, method):
    fitted = scaling.fit_scaler(df, method, ["temperature", "humidity"])
    out = fitted.transform(df)
    x = column(out, "temperature")
    if method == "standard":
        assert abs(x.mean()) < 1e-9 and x.std() == pytest.approx(1)
    elif method == "minmax":
        assert x.min() == 0 and x.max() == pytest.approx(1)
    else:
        assert abs(np.median(x)) < 1e-9
    np.testing.assert_allclose(column(fitted.inverse(out), "temperature"), frame.temperature)


def test_constant_column_and_unknown_method(spark):
    rows = spark.createDataFrame([(0, 4.0), (1, 4.0)], "id int, x double")
    for method in ("standard", "minmax", "robust"):
        assert [r["x"] for r in scaling.fit_scaler(rows, method, ["x"]).transform(rows).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        scaling.fit_scaler(rows, "other", ["x"])


def test_domain_scaler_inverse_has_no_epsilon(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 3.0)], "id int, x double")
    fitted = scaling.fit_domain_scaler(rows, ["x"], "standard")
    assert [r["x"] for r in fitted.inverse(fitted.transform(rows)).collect()] == pytest.approx([1.0, 3.0], abs=1e-7)


def quantile_reference(x, count):
    p = np.arange(count) / (count - 1)
    at = (len(x) - 1) * p
    at = np.where(np.abs(at - np.round(at)) < 1e-9, np.round(at), at)
    q = np.interp(at, np.arange(len(x)), np.sort(x))
    up, down = np.interp(x, q, p), -np.interp(-x, -q[::-1], -p[::-1])
    out = (up + down) / 2
    out[x == q[0]], out[x == q[-1]] = 0, 1
    return out


def test_quantile_map(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=900), 1)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(900), "x": x}))
    for count in (1000, 40):
        fitted = scaling.fit_quantile_map(df, ["x"], count)
        np.testing.assert_allclose(column(fitted.transform(df), "x"), quantile_reference(x, min(count, 900)), atol=1e-12)
    normal = column(scaling.fit_quantile_map(df, ["x"]).transform(df, "normal"), "x")
    assert abs(np.median(normal)) < 0.1 and 0.8 < normal[np.abs(normal) < 5].std() < 1.2


def test_inverse_normal(spark):
    probs = [1e-7, 0.001, 0.02, 0.3, 0.5, 0.9, 0.999, 1 - 1e-7]
    rows = spark.createDataFrame([(p,) for p in probs], "p double")
    got = [r[0] for r in rows.select(scaling.inverse_normal(F.col("p"))).collect()]
    assert got == pytest.approx([statistics.NormalDist().inv_cdf(p) for p in probs], abs=1e-7)


def yeo(x, lam):
    out = np.empty_like(x)
    pos = x >= 0
    out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-9 else ((x[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log1p(-x[~pos]) if abs(lam - 2) < 1e-9 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


def test_power_exponent_maximises_likelihood(frame, df):
    got = scaling.fit_power(df, ["precipitation", "temperature"])
    for c, lam in got.items():
        x = frame[c].to_numpy()
        ladder = np.linspace(-4, 6, 4001)
        ll = [-len(x) / 2 * np.log(yeo(x, v).var()) + (v - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum() for v in ladder]
        assert lam == pytest.approx(ladder[int(np.argmax(ll))], abs=0.01)
    out = scaling.power_transform(df.select("id", "precipitation"))
    assert abs(pd.Series(column(out, "precipitation")).skew()) < 0.3


def test_box_cox_falls_back_to_log(spark):
    rows = spark.createDataFrame([(0, -1.0), (1, 5.0)], "id int, x double")
    assert [r["x"] for r in scaling.power_transform(rows, ["x"], "box-cox", fallback="log").orderBy("id").collect()] == pytest.approx([np.log1p(1), np.log1p(7)])
    with pytest.raises(ValueError):
        scaling.power_transform(rows, ["x"], "box-cox")


def test_skew_correction(frame, df):
    out = scaling.handle_skew(df.select("id", "precipitation", "temperature"))
    assert abs(pd.Series(column(out, "precipitation")).skew()) < abs(frame.precipitation.skew())
    np.testing.assert_allclose(column(out, "temperature"), frame.temperature)


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_group_scaling(spark, method):
    rows = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (2, "a", 8.0), (3, "b", 5.0), (4, "b", 5.0)], "id int, g string, x double")
    got = list(column(scaling.normalize_by_groups(rows, "g", ["x"], method), "x"))
    assert got[3:] == [0.0, 0.0]
    if method == "minmax":
        assert got[:3] == pytest.approx([0, 2 / 7, 1])


def test_select_k_best(frame, df):
    got = selection.select_features(df, "temperature", ["humidity", "forest_cover", "species_count"], 2).collect()
    r = frame[["humidity", "forest_cover", "species_count"]].corrwith(frame.temperature)
    f = (r ** 2 / (1 - r ** 2) * (len(frame) - 2)).sort_values(ascending=False)
    assert [x["feature"] for x in got] == list(f.index[:2]) and got[0]["score"] == pytest.approx(f.iloc[0])


def test_mutual_information_of_a_copy_is_entropy(df):
    table = df.withColumn("copy", F.col("temperature"))
    got = {r["feature"]: r["score"] for r in selection.binned_mutual_information(table, "temperature", ["copy", "humidity"]).collect()}
    assert got["copy"] == pytest.approx(math.log(10), abs=0.01) and got["humidity"] < 0.3


def test_pca_is_svd(frame, df):
    cols = ["temperature", "precipitation", "humidity"]
    out, shares = selection.apply_pca(df.select("id", *cols), cols, components=2)
    x = frame[cols].to_numpy() - frame[cols].to_numpy().mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    np.testing.assert_allclose(np.abs(column(out, "PC1")), np.abs(u[:, 0] * s[0]), atol=1e-8)
    np.testing.assert_allclose(shares, (s ** 2 / (s ** 2).sum())[:2])
    kept = selection.apply_pca(df.select("id", *cols), cols)[1]
    assert sum(kept) >= 0.95 and sum(kept[:-1]) < 0.95


def test_perfect_fit_metrics(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "actual double, predicted double")
    r = regression_metrics(rows).first()
    assert r["r2"] == 1 and r["explained_variance"] == 1 and r["mape"] == 0


def test_normality_test_tells_normal_from_skewed(spark):
    rng = np.random.default_rng(0)
    normal = spark.createDataFrame(pd.DataFrame({"actual": rng.normal(size=2000), "predicted": 0.0}))
    skewed = spark.createDataFrame(pd.DataFrame({"actual": rng.exponential(size=2000), "predicted": 0.0}))
    assert residual_analysis(normal).first()["is_normal"] and not residual_analysis(skewed).first()["is_normal"]


def test_columns_without_spread_have_no_correlation(spark):
    rows = [(float(i), 7, float(i % 5), None if i == 3 else 1.0 + i, float(2 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, same int, y double, gap double, twice double").repartition(4)
    got = {(r[0], r[1]): r[2] for r in stats.correlation_matrix(df, ["x", "same", "y", "gap", "twice"]).collect()}
    frame = df.toPandas().astype(float).corr()
    for (a, b), v in got.items():
        if a != b and "same" in (a, b):
            assert v is None
        else:
            assert v == pytest.approx(frame.loc[a, b], abs=1e-12) if a != b else v == 1.0
    ranked = stats.correlation_with_target(df, "twice", ["same", "y", "x"]).collect()
    assert [r["feature"] for r in ranked] == ["x", "y", "same"] and ranked[-1]["strength"] is None
    best = selection.select_features(df, "twice", ["same", "y", "gap"], 3).collect()
    assert [r["feature"] for r in best][-1] == "same" and best[-1]["score"] is None


def test_power_exponents_take_no_row_per_exponent(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"x": np.exp(rng.normal(0, 1, 400)), "y": rng.normal(5, 1, 400) ** 2}))
    asked = []
    whole = type(df).collect

    def collect(self):
        asked.append(self._jdf.queryExecution().analyzed().toString())
        return whole(self)

    monkeypatch.setattr(type(df), "collect", collect)
    fitted = scaling.fit_power(df, ["x", "y"], "box-cox")
    rounds = [plan for plan in asked if "MapInArrow" in plan]
    assert abs(fitted["x"]) < 0.15 and len(rounds) == 8
    assert not any("Generate" in plan for plan in asked)
