"""Descriptive statistics, correlations, shares and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from greenlattice.operators.quantiles import exact_quantiles, grouped_quantiles


def adjusted_skewness(column: str) -> Column:
    """Bias-corrected sample skewness; NULL below three values or without spread."""
    n = F.count(column).cast("double")
    return F.when((n > 2) & (F.stddev_pop(column) > 0), F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(column: str) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values or without spread."""
    n = F.count(column).cast("double")
    return F.when((n > 3) & (F.stddev_pop(column) > 0),
                  (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over the rows that have both; NULL where one of them does not vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.covar_pop(x, x) * F.covar_pop(y, y)))


def _long(df: DataFrame, columns: list[str], stats: dict[str, "callable"]) -> DataFrame:
    """One aggregate for all columns, returned as one row per column."""
    wide = df.agg(*[F.struct(*[make(c).alias(name) for name, make in stats.items()]).alias(c) for c in columns])
    return wide.unpivot([], columns, "feature", "s").select("feature", *[f"s.{name}" for name in stats])


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per column (exact)."""
    base = _long(df, columns, {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp,
        "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")})
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    arrays = F.create_map(*[x for c in columns for x in (
        F.lit(c), F.array(*[F.lit(v).cast("double") for v in quartiles[c]]))])
    q = arrays[F.col("feature")]
    return base.select("feature", "count", "mean", "std", "min",
                       q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), "max")


def distribution_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments per feature with the skew level and the transformation it calls for."""
    base = _long(df, columns, {
        "mean": F.avg, "std": F.stddev_samp, "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"), "skewness": adjusted_skewness, "kurtosis": adjusted_kurtosis})
    size = F.abs("skewness")
    return base.withColumns({
        "level": F.when(size > 2, "highly_skewed").when(size > 1, "moderately_skewed")
        .when(size > 0.5, "mildly_skewed").otherwise("normal"),
        "recommendation": F.when(size > 2, "power_transform").when(size > 1, "log_transform")
        .when(size > 0.5, "quantile_transform").otherwise("standard_scaling")})


def missing_counts(df: DataFrame) -> DataFrame:
    return _long(df, df.columns, {"missing": lambda c: F.sum(F.col(c).isNull().cast("bigint"))})


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table (feature_a, feature_b, correlation) from one aggregate over pairs a < b."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[correlation(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                                 F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    half = row.select(F.explode(entries).alias("e")).select("e.*")
    mirrored = half.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "correlation")
    ones = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], half.schema)
    return half.unionByName(mirrored).unionByName(ones)


def correlation_with_target(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Features by absolute correlation with the target, strongest first; those without spread last."""
    return (_long(df, columns, {"correlation": lambda c: correlation(c, target)})
            .withColumn("strength", F.abs("correlation")).orderBy(F.desc_nulls_last("strength"), "feature"))


def linear_trend(df: DataFrame, x: str, columns: list[str]) -> DataFrame:
    """Slope and intercept of each column over ``x``."""
    return _long(df, columns, {"slope": lambda c: F.regr_slope(c, x), "intercept": lambda c: F.regr_intercept(c, x)})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), column)


def shares(df: DataFrame, column: str) -> DataFrame:
    """Rows and percentage per category (the window runs over one row per category)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of ``rows`` by ``columns`` with an ``All`` margin on both axes."""
    pairs = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows, columns).agg(
        F.count(F.lit(1)).alias("n"))
    cube = pairs.cube(rows, columns).agg(F.sum("n").alias("n"))  # margins of a handful of counts
    named = cube.select(F.coalesce(rows, F.lit("All")).alias(rows), F.coalesce(columns, F.lit("All")).alias("_c"), "n")
    cells = [F.coalesce(F.sum(F.when(F.col("_c") == v, F.col("n"))), F.lit(0)).cast("bigint").alias(v)
             for v in (*values, "All")]
    return named.groupBy(rows).agg(*cells)


def histogram(df: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width bin counts; the last bin is closed on the right."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        low = high = 0.0
    width = (high - low) / bins
    spot = F.floor((F.col(column) - F.lit(low)) / F.lit(width)) if width > 0 else F.lit(0)
    slot = F.least(spot, F.lit(bins - 1)).cast("int")
    counted = df.where(F.col(column).isNotNull()).groupBy(*(by or []), slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns({"bin_start": F.lit(low) + F.col("bin") * F.lit(width),
                                "bin_end": F.lit(low) + (F.col("bin") + 1) * F.lit(width)})


def box_summary(df: DataFrame, group: str, value: str, one_buffer_rows: int | None = None) -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    options = {} if one_buffer_rows is None else {"one_buffer_rows": one_buffer_rows}
    q = grouped_quantiles(df, [group], value, [0.0, 0.25, 0.5, 0.75, 1.0], **options)
    return q.select(group, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def grouped_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))


def overall_stats(df: DataFrame, value: str) -> DataFrame:
    """One row over all rows (the count includes missing values), with the exact median."""
    median = exact_quantiles(df, {value: [0.5]})[value][0]
    return df.agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                  F.min(value).alias("min"), F.max(value).alias("max")).withColumn(
        "median", F.lit(median).cast("double"))


def spatial_extent(df: DataFrame) -> DataFrame:
    box = df.agg(F.min("longitude").alias("min_x"), F.min("latitude").alias("min_y"),
                 F.max("longitude").alias("max_x"), F.max("latitude").alias("max_y"))
    return box.withColumn("area_degrees", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))


def density_grid(df: DataFrame, cell: float) -> DataFrame:
    return df.groupBy(F.floor(F.col("latitude") / F.lit(cell)).cast("bigint").alias("cy"),
                      F.floor(F.col("longitude") / F.lit(cell)).cast("bigint").alias("cx")).agg(
        F.count(F.lit(1)).alias("n"))


def hotspot_contrast(df: DataFrame, score: str, percentile: float, columns: list[str]) -> DataFrame:
    """Per column the mean over rows at or above the score percentile and over all rows."""
    cut = exact_quantiles(df, {score: [percentile / 100.0]})[score][0]
    hot = F.col(score) >= F.lit(cut)
    out = _long(df, columns, {"hotspot_mean": lambda c: F.avg(F.when(hot, F.col(c))), "overall_mean": F.avg})
    return out.withColumn("difference", F.col("hotspot_mean") - F.col("overall_mean"))
