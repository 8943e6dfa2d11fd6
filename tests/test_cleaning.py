import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from greenlattice.functions.numeric import clip, nan_to_null, numeric_columns
from greenlattice.operators import clean, validate
from greenlattice.operators import impute
from greenlattice.operators.impute import impute_nearest_rows

DIRTY = [
    (1, 19.0760, 72.8777, 25.5, 2.1, 65, 0.3, 15, 1, "A"), (2, 18.5204, 73.8567, 28.2, 0.0, 70, 0.5, 12, 2, "B"),
    (3, None, 75.1333, 22.1, 5.2, 55, 0.2, 18, 3, "C"), (4, 19.2183, 72.9781, 26.8, 1.8, 68, 0.4, 14, 4, "D"),
    (5, 200.0, 73.2478, -999.0, 3.4, 150, 0.6, 16, 5, "E")]
SCHEMA = ("n int, latitude double, longitude double, temperature double, precipitation double, humidity int, "
          "forest_cover double, species_count int, duplicate_col int, text_data string")


@pytest.fixture(scope="module")
def dirty(spark):
    rows = spark.createDataFrame(DIRTY, SCHEMA).drop("n")
    return rows.unionByName(rows.where("duplicate_col = 1"))


def test_duplicates_go(dirty):
    assert dirty.count() == 6
    assert clean.remove_duplicates(dirty).count() == 5


def test_duplicates_round_half_even_and_keep_first(spark):
    rows = spark.createDataFrame([(2, 1.0000001, 5.0), (1, 1.0000002, 5.0), (3, 1.1, 5.0)], "n int, latitude double, longitude double")
    assert {r["n"] for r in clean.remove_duplicates(rows, order=["n"]).collect()} == {1, 3}


def test_key_columns_keep_months_apart(spark):
    rows = spark.createDataFrame([(1.0, 2.0, "jan"), (1.0, 2.0, "feb"), (1.0, 2.0, "feb")], "latitude double, longitude double, m string")
    assert clean.remove_duplicates(rows).count() == 1
    assert clean.remove_duplicates(rows, ["latitude", "longitude", "m"]).count() == 2


def test_bad_places_go(dirty):
    kept = validate.drop_invalid_coordinates(dirty)
    assert kept.count() == 4 and kept.where("latitude > 90").count() == 0


def test_known_ranges(dirty):
    kept = clean.filter_known_ranges(dirty).collect()
    assert kept and all(-50 <= r["temperature"] <= 60 and r["humidity"] <= 100 for r in kept)


def test_clip_keeps_null(spark):
    rows = spark.createDataFrame([(None,), (-1.0,), (150.0,)], "x double")
    assert [r[0] for r in rows.select(clip(F.col("x"), 0, 100)).collect()] == [None, 0.0, 100.0]


def test_sequential_trim_sees_earlier_columns(spark):
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"a": rng.normal(size=500), "b": rng.exponential(size=500)})
    f["b"] = f["b"] + f["a"].abs() * 5
    want = f
    for c in ("a", "b"):
        lo, hi = want[c].quantile([0.01, 0.99])
        want = want[(want[c] >= lo) & (want[c] <= hi)]
    got = clean.quantile_trim(spark.createDataFrame(f), ["a", "b"]).toPandas()
    assert len(got) == len(want) and got["b"].max() == want["b"].max()
    want = f
    for c in ("a", "b"):
        q1, q3 = want[c].quantile([0.25, 0.75])
        want = want[(want[c] >= q1 - 1.5 * (q3 - q1)) & (want[c] <= q3 + 1.5 * (q3 - q1))]
    assert clean.remove_outliers_iqr(spark.createDataFrame(f), ["a", "b"]).count() == len(want)


def test_zscore_of_constant_column_drops_all(spark):
    rows = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert clean.remove_outliers_zscore(rows, ["x"]).count() == 0


def knn_brute(f, cols, k):
    x = f[cols].to_numpy(float)
    out = x.copy()
    for i in np.where(np.isnan(x).any(1))[0]:
        gap = x - x[i]
        both = ~np.isnan(gap)
        with np.errstate(invalid="ignore", divide="ignore"):
            d2 = np.where(both, gap, 0) ** 2
            d2 = d2.sum(1) * len(cols) / both.sum(1)
        for c in np.where(np.isnan(x[i]))[0]:
            ok = ~np.isnan(x[:, c]) & ~np.isnan(d2)
            order = sorted(np.where(ok)[0], key=lambda j: (d2[j], j))[:k]
            out[i, c] = x[order, c].mean() if order else np.nanmean(x[:, c])
    return out


@pytest.mark.parametrize("cell_rows", [4, 40, 10**6])
@pytest.mark.parametrize("gap_everywhere", [False, True])
def test_nearest_row_imputation_is_brute_force(spark, cell_rows, gap_everywhere):
    rng = np.random.default_rng(2)
    n = 260
    f = pd.DataFrame(rng.normal(size=(n, 5)) * [5, 3, 1, 2, 4], columns=list("abcde"))
    f.iloc[:60] = np.round(f.iloc[:60])
    f.iloc[60:140] = f.iloc[60].to_numpy()  # many copies of one row
    for c in (list("abcde") if gap_everywhere else ["c", "e"]):
        f.loc[rng.choice(n, 20, replace=False), c] = np.nan
    f.insert(0, "id", np.arange(n))
    df = nan_to_null(spark.createDataFrame(f))
    got = impute_nearest_rows(df, list("abcde"), "id", 5, cell_rows).toPandas().sort_values("id")
    np.testing.assert_allclose(got[list("abcde")].to_numpy(float), knn_brute(f, list("abcde"), 5), rtol=1e-9, atol=1e-9)


def test_missing_policy(spark):
    n = 100
    f = pd.DataFrame({"id": np.arange(n), "dense": np.arange(n) * 1.0, "few": np.arange(n) * 2.0, "some": np.arange(n) * 3.0,
                      "sparse": np.arange(n) * 1.0, "word": ["a", "b"] * 50, "y": np.arange(n) * 1.0})
    f.loc[:4, "few"] = np.nan
    f.loc[:59, "sparse"] = np.nan
    f.loc[0, "word"] = None
    f.loc[99, "y"] = np.nan
    out = clean.handle_missing(nan_to_null(spark.createDataFrame(f)), "y", "id").toPandas()
    assert len(out) == 99 and "sparse" not in out and not out.isna().any().any()
    assert out.set_index("id").loc[0, "word"] == "a"
    f.loc[:29, "some"] = np.nan
    only = clean.handle_missing(nan_to_null(spark.createDataFrame(f[["id", "some"]])), row_id="id").toPandas().set_index("id")
    assert only.loc[0, "some"] == f["some"].median()


def test_most_frequent_tie_takes_smallest(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "w string")
    assert clean.most_frequent(rows, "w") == "a"


def test_types(spark):
    rows = spark.createDataFrame([("1.5", "x", "yes"), ("2", "3", "TRUE"), (None, "4", "0")], "num string, mixed string, is_endemic string")
    out = clean.standardise_types(rows)
    assert dict(out.dtypes) == {"num": "double", "mixed": "string", "is_endemic": "boolean"}
    assert [r["is_endemic"] for r in out.collect()] == [True, None, False]


def test_label_encoder_reuses_codes_and_rejects_unseen(spark):
    enc = clean.LabelEncoder(["w"]).fit(spark.createDataFrame([("b",), ("a",), ("c",)], "w string"))
    assert [r["w_code"] for r in enc.transform(spark.createDataFrame([("c",), ("a",)], "w string")).collect()] == [2, 0]
    with pytest.raises(Exception):
        enc.transform(spark.createDataFrame([("z",)], "w string")).collect()


def test_full_clean(spark):
    rng = np.random.default_rng(7)
    n = 200
    f = pd.DataFrame({"latitude": rng.uniform(15, 22, n), "longitude": rng.uniform(72, 80, n), "temperature": rng.normal(25, 5, n),
                      "humidity": rng.uniform(30, 90, n), "forest_cover": rng.random(n), "row": np.arange(n)})
    f.loc[0, "temperature"] = 900
    f.loc[1, "latitude"] = 200
    f.loc[2:8, "humidity"] = np.nan
    out = clean.clean_dataset(nan_to_null(spark.createDataFrame(f)), row_id="row").toPandas()
    assert not out.isna().any().any() and out["temperature"].max() < 60 and out["latitude"].max() < 90
    assert 0 not in set(out["row"]) and set(range(2, 9)) & set(out["row"])
    with pytest.raises(ValueError):
        clean.clean_dataset(spark.createDataFrame(f), row_id="row", method="other")


def test_occurrence_defaults(spark):
    rows = spark.createDataFrame([(" Oak ", 1.0, 2.0), ("  ", 1.0, 2.0), ("Elm", 95.0, 0.0)], "species_name string, latitude double, longitude double")
    got = validate.validate_occurrence(rows, "2024-01-01").collect()
    assert len(got) == 1 and got[0]["species_name"] == "Oak" and got[0]["conservation_status"] == "LC" and got[0]["is_endemic"] is False
    with pytest.raises(ValueError):
        validate.validate_occurrence(rows.drop("species_name"))


def test_numeric_columns_leave_places_out(dirty):
    assert "latitude" not in numeric_columns(dirty) and "text_data" not in numeric_columns(dirty)


def test_distances_are_compiled_and_wide_rows_get_the_same(spark, monkeypatch):
    rng = random.Random(29)
    rows = [(i, *[None if rng.random() < 0.15 else float(rng.randint(0, 12)) for _ in range(5)]) for i in range(250)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in "abcde"))

    def filled():
        return impute_nearest_rows(df, list("abcde"), "id", 3, 16)

    def plan_of(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString()

    compiled = filled()
    assert "zip_with" not in plan_of(compiled)
    monkeypatch.setattr(impute, "UNROLLED", 4)
    wide = filled()
    assert "zip_with" in plan_of(wide)
    assert sorted(map(tuple, compiled.collect())) == sorted(map(tuple, wide.collect()))
