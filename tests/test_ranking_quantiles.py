import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from greenlattice.operators.quantiles import exact_quantiles, grouped_quantiles
from greenlattice.operators.ranking import average_rank, rank_values, row_position, values_at_positions
from greenlattice.operators.splits import time_series_block


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    n = 3000
    value = np.round(rng.normal(0, 10, n), 1)
    value[:1000] = 3.5  # a third of all rows share one value
    group = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abc"), n))
    frame = pd.DataFrame({"id": np.arange(n), "value": value, "grp": group})
    frame.loc[frame.id % 50 == 0, "value"] = np.nan
    return frame.sample(frac=1, random_state=1)


@pytest.fixture(scope="module")
def df(spark, table):
    return spark.createDataFrame(table).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@pytest.mark.parametrize("rows_per_bucket", [10**9, 100])
def test_average_rank(df, table, rows_per_bucket):
    got = average_rank(df, "value", "r", descending=True, rows_per_bucket=rows_per_bucket).toPandas().set_index("id")["r"].sort_index()
    want = table.set_index("id")["value"].rank(ascending=False).sort_index()
    np.testing.assert_allclose(got, want)


@pytest.mark.parametrize("rows_per_bucket", [10**9, 100])
def test_percent_rank_by_group(df, table, rows_per_bucket):
    got = average_rank(df, "value", "r", ["grp"], percent=True, rows_per_bucket=rows_per_bucket).toPandas().set_index("id")["r"].sort_index()
    want = table.set_index("id").groupby("grp")["value"].rank(pct=True).sort_index()
    np.testing.assert_allclose(got, want)


def test_buckets_bound_the_work(df):
    from greenlattice.operators.ranking import split_points
    assert len(split_points(df, "value", 100)) > 5
    assert rank_values(df, "value", rows_per_bucket=100).agg(F.sum("ties")).first()[0] == df.agg(F.count("value")).first()[0]


@pytest.mark.parametrize("rows_per_bucket", [10**9, 150])
def test_row_position_breaks_ties_by_id(df, table, rows_per_bucket):
    known = df.where(F.col("value").isNotNull())
    got = row_position(known, "value", "id", "p", rows_per_bucket=rows_per_bucket).toPandas().sort_values("p")
    want = table.dropna().sort_values(["value", "id"])
    assert list(got["id"]) == list(want["id"])
    assert list(got["p"]) == list(range(len(want)))


def test_values_at_positions(df, table):
    ordered = np.sort(table["value"].dropna().to_numpy())
    at = [0, 7, 900, 1500, len(ordered) - 1]
    got = values_at_positions(df, "value", at, rows_per_bucket=100)
    assert got == {i: ordered[i] for i in at}


@pytest.mark.parametrize("limit,candidates", [(10**9, 0), (10, 10**6), (10, 40), (10, 0)])
def test_exact_quantiles(df, table, limit, candidates):
    probs = [0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0]
    got = exact_quantiles(df, {"value": probs}, one_buffer_rows=limit, rows_per_bucket=100, max_candidates=candidates)["value"]
    np.testing.assert_allclose(got, table["value"].quantile(probs), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("limit", [10**9, 10])
def test_grouped_quantiles(df, table, limit):
    got = {r["grp"]: r["quantiles"] for r in grouped_quantiles(
        df, ["grp"], "value", [0.0, 0.25, 0.5, 0.9, 1.0], one_buffer_rows=limit, rows_per_bucket=100).collect()}
    for name, part in table.groupby("grp"):
        np.testing.assert_allclose(got[name], part["value"].quantile([0.0, 0.25, 0.5, 0.9, 1.0]), rtol=1e-12, atol=1e-12)


def test_empty_column_has_no_quantile(spark):
    empty = spark.createDataFrame([(None,)], "value double")
    assert exact_quantiles(empty, {"value": [0.5]})["value"] == [None]


def test_positions_by_date_in_buckets(spark):
    days = [dt.date(1969, 12, 1) + dt.timedelta(days=(i * 37) % 90) for i in range(300)]
    df = spark.createDataFrame([(i, day) for i, day in enumerate(days)], "id long, day date")
    placed = row_position(df, "day", "id", "at", rows_per_bucket=20).orderBy("at").collect()
    assert [(r["day"], r["id"]) for r in placed] == sorted((day, i) for i, day in enumerate(days))
    assert [r["at"] for r in placed] == list(range(300))
    blocks = time_series_block(df, "day", "id", 5, rows_per_bucket=20).groupBy("block").count().collect()
    assert {r["block"]: r["count"] for r in blocks} == dict.fromkeys(range(6), 50)
