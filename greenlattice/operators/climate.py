"""Climate aggregation and the day spine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def aggregate_monthly(df: DataFrame, keys: list[str] | None = None, date: str = "obs_date") -> DataFrame:
    """Per place and month: mean temperature, total rain, mean humidity and wind.

    The sum over only missing values is 0, a mean over only missing values stays missing.
    """
    keys = keys or ["latitude", "longitude"]
    return df.groupBy(*keys, F.trunc(date, "MM").alias(date)).agg(
        F.avg("temperature").alias("temperature"),
        F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("precipitation"),
        F.avg("humidity").alias("humidity"),
        F.avg("wind_speed").alias("wind_speed"))


def daily_spine(requests: DataFrame, start: str = "start_date", end: str = "end_date",
                out: str = "obs_date") -> DataFrame:
    """One row per request and day from start to end inclusive."""
    return requests.where(F.col(start) <= F.col(end)).withColumn(
        out, F.explode(F.sequence(F.col(start), F.col(end), F.expr("INTERVAL 1 DAY"))))


def daily_weather(requests: DataFrame, climate: DataFrame) -> DataFrame:
    """Day spine of each request with the landed daily means of its place."""
    variables = ["temperature", "precipitation", "humidity", "wind_speed"]
    # One row per place and day before the join, so a much-observed place joins as few rows.
    daily = climate.groupBy("ix", "iy", "obs_date").agg(*[F.avg(v).alias(v) for v in variables])
    return daily_spine(requests).join(daily, ["ix", "iy", "obs_date"], "left")
