"""Row validation and data-quality measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from greenlattice.functions.geo import valid_coordinates
from greenlattice.functions.numeric import clip
from greenlattice.operators.clean import quantile_trim
from greenlattice.schemas import CLIMATE_REQUIRED, CLIMATE_VARIABLES, IUCN_SCORES, OCCURRENCE_REQUIRED


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def drop_invalid_coordinates(df: DataFrame) -> DataFrame:
    return df.where(valid_coordinates(F.col("latitude"), F.col("longitude")))


def climate_row_rules(df: DataFrame) -> DataFrame:
    """Coordinates in range, humidity held to 0-100, rain and wind to zero or more."""
    require_columns(df, CLIMATE_REQUIRED)
    return drop_invalid_coordinates(df).withColumns({
        "humidity": clip(F.col("humidity"), 0.0, 100.0),
        "precipitation": clip(F.col("precipitation"), 0.0, None),
        "wind_speed": clip(F.col("wind_speed"), 0.0, None),
    })


def validate_climate(df: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Row rules, then each variable in turn trimmed to its 1-99 % range."""
    return quantile_trim(climate_row_rules(df), CLIMATE_VARIABLES, low, high)


def validate_occurrence(df: DataFrame, default_date: str | None = None) -> DataFrame:
    """Valid place, non-empty trimmed name, known conservation status, defaults filled in."""
    require_columns(df, OCCURRENCE_REQUIRED)
    out = drop_invalid_coordinates(df)
    if "conservation_status" not in df.columns:
        out = out.withColumn("conservation_status", F.lit("LC"))
    if "is_endemic" not in df.columns:
        out = out.withColumn("is_endemic", F.lit(False))
    if "observation_date" not in df.columns and "observed_at" not in df.columns:
        stamp = F.lit(default_date).cast("timestamp") if default_date else F.current_timestamp()
        out = out.withColumn("observation_date", stamp)
    known = F.coalesce(F.col("conservation_status").isin(*IUCN_SCORES), F.lit(False))
    return (out.withColumn("species_name", F.trim("species_name"))
            .where(F.length("species_name") > 0)
            .withColumn("conservation_status", F.when(known, F.col("conservation_status")).otherwise("LC")))


def bounds_error(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column,
                 resolution: Column, max_resolution: float = 1.0) -> Column:
    """NULL for a usable request, else the first rule it breaks."""
    return (F.when(min_lon.isNull() | min_lat.isNull() | max_lon.isNull() | max_lat.isNull(), "bounds need four values")
            .when(~(min_lat.between(-90, 90) & max_lat.between(-90, 90)), "latitude out of range")
            .when(~(min_lon.between(-180, 180) & max_lon.between(-180, 180)), "longitude out of range")
            .when(min_lat >= max_lat, "min_lat must be below max_lat")
            .when(min_lon >= max_lon, "min_lon must be below max_lon")
            .when(~((resolution > 0) & (resolution <= max_resolution)), "resolution out of range"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier identical row (NULLs equal)."""
    return df.groupBy(*df.columns).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def quality_summary(df: DataFrame, required: list[str], min_rows: int = 10) -> DataFrame:
    """One row: sizes, missing total, duplicates and whether the table is usable."""
    absent = [c for c in required if c not in df.columns]
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in df.columns])
    grouped = df.groupBy(*df.columns).count()
    return (grouped.agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.coalesce(F.sum(missing * F.col("count")), F.lit(0)).cast("bigint").alias("missing_values"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))
        .select("total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
                "missing_values", "duplicate_rows",
                F.lit(",".join(absent)).alias("missing_columns"),
                ((F.col("total_rows") >= min_rows) & F.lit(not absent)).alias("is_valid")))


def quality_report(df: DataFrame) -> DataFrame:
    """Long table: per column its type, missing count and missing percentage."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns])
    types = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    return (counts.unpivot(["_n"], df.columns, "column_name", "missing_count")
            .select("column_name", types[F.col("column_name")].alias("data_type"),
                    F.col("missing_count").cast("bigint").alias("missing_count"),
                    F.round(F.try_divide(F.col("missing_count") * 100.0, F.col("_n")), 2).alias("missing_pct"),
                    F.col("_n").alias("total_rows")))


def completeness(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """One row: completeness share, valid coordinates and per-column in-range counts."""
    cells = len(df.columns)
    present = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.sum(present) * 100.0 / (F.count(F.lit(1)) * cells)).alias("completeness_pct"),
        F.sum(valid_coordinates(F.col("latitude"), F.col("longitude")).cast("bigint")).alias("valid_coordinates"),
        *[F.sum(F.coalesce(F.col(c).between(lo, hi), F.lit(False)).cast("bigint")).alias(f"{c}_in_range")
          for c, (lo, hi) in ranges.items()])


def feature_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table (feature, low, high) captured from a training set."""
    wide = df.agg(*[F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c)
                    for c in columns])
    return wide.unpivot([], columns, "feature", "r").select("feature", "r.low", "r.high")


def check_feature_ranges(df: DataFrame, ranges: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Per feature: whether all new values lie in the trained range widened by ``tolerance``."""
    names = [r["feature"] for r in ranges.select("feature").collect()]  # one row per feature
    seen = feature_ranges(df, [c for c in names if c in df.columns])
    slack = (F.col("t.high") - F.col("t.low")) * F.lit(tolerance)
    return (ranges.alias("t").join(seen.alias("s"), "feature")
            .select("feature", F.col("t.low"), F.col("t.high"),
                    F.col("s.low").alias("seen_low"), F.col("s.high").alias("seen_high"),
                    ((F.col("s.low") >= F.col("t.low") - slack)
                     & (F.col("s.high") <= F.col("t.high") + slack)).alias("within")))
