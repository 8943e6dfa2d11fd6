"""Model quality as SQL aggregates over (actual, predicted) columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from greenlattice.operators.ranking import rank_values
from greenlattice.operators.selection import t_quantile


def _error(actual: str, predicted: str) -> Column:
    return F.col(actual) - F.col(predicted)


def regression_aggregates(actual: str = "actual", predicted: str = "predicted") -> dict[str, Column]:
    """Metric name to aggregate; usable globally or per group."""
    error = _error(actual, predicted)
    mse = F.avg(error * error)
    return {
        "mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(F.abs(error)),
        "r2": 1 - F.try_divide(F.sum(error * error), F.regr_syy(F.col(actual), F.col(predicted))),
        "mape": F.when(F.sum((F.col(actual) == 0).cast("int")) == 0,
                       F.avg(F.abs(F.try_divide(error, F.col(actual)))) * 100),
        "explained_variance": 1 - F.try_divide(F.var_pop(error), F.var_pop(actual)),
        "mape_guarded": F.avg(F.abs(F.try_divide(error, F.col(actual) + 0.001))) * 100,
    }


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       by: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    aggs = regression_aggregates(actual, predicted)
    chosen = [aggs[n].alias(n) for n in (names or aggs)]
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *chosen)


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy and both averages.

    Everything after the confusion counts runs on one row per class pair.
    """
    counts = confusion(df, actual, predicted)
    truth = counts.groupBy(F.col(actual).cast("string").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n"))).alias("hits"))
    said = counts.groupBy(F.col(predicted).cast("string").alias("class")).agg(F.sum("n").alias("said"))
    zero = F.lit(0.0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), zero)
    scored = truth.join(said, "class", "full").fillna(0, ["support", "hits", "said"])
    scored = scored.withColumns({"precision": ratio("hits", "said"), "recall": ratio("hits", "support")}).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
    per_class = scored.select("class", "precision", "recall", "f1", F.col("support").cast("bigint").alias("support"), "hits")
    total = F.sum("support")
    averages = per_class.agg(
        F.struct(F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.avg("f1").alias("f")).alias("macro"),
        F.struct(*[(F.sum(F.col(c) * F.col("support")) / total).alias(a)
                   for c, a in (("precision", "p"), ("recall", "r"), ("f1", "f"))]).alias("weighted"),
        (F.sum("hits") / total).alias("accuracy"), total.cast("bigint").alias("support"))
    acc = F.struct(F.col("accuracy").alias("p"), F.col("accuracy").alias("r"), F.col("accuracy").alias("f"))
    summary = averages.select("support", F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), acc.alias("v")),
        F.struct(F.lit("macro avg").alias("class"), F.col("macro").alias("v")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("weighted").alias("v")))).alias("e"))
    return per_class.drop("hits").unionByName(summary.select(
        "e.class", F.col("e.v.p").alias("precision"), F.col("e.v.r").alias("recall"), F.col("e.v.f").alias("f1"), "support"))


def binary_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from average ranks; equal scores are counted once."""
    positive = (F.col(label) == 1).cast("bigint")
    ranks = rank_values(df.where(F.col(label).isNotNull()), score, weights={"positives": positive})
    mean_rank = F.col("below") + (F.col("ties") + 1) / 2.0
    sums = ranks.agg(F.sum(mean_rank * F.col("positives")).alias("rank_sum"),
                     F.sum("positives").cast("double").alias("p"), F.sum("ties").cast("double").alias("n"))
    negatives = F.col("n") - F.col("p")
    return sums.select(F.try_divide(F.col("rank_sum") - F.col("p") * (F.col("p") + 1) / 2,
                                    F.col("p") * negatives).alias("auc"))


def prediction_interval(df: DataFrame, predicted: str, train_mse: float, rows: int, features: int,
                        alpha: float = 0.05) -> DataFrame:
    """Prediction plus and minus a Student-t margin from the training error."""
    margin = t_quantile(1 - alpha / 2, rows - features - 1) * train_mse ** 0.5
    return df.withColumns({"lower": F.col(predicted) - F.lit(margin), "upper": F.col(predicted) + F.lit(margin)})


def residual_analysis(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Residual moments, residual sum of squares and the K-squared normality test."""
    r = _error(actual, predicted)
    n = F.col("n")
    base = df.select(r.alias("_r")).agg(
        F.count("_r").cast("double").alias("n"), F.avg("_r").alias("mean"), F.stddev_pop("_r").alias("std"),
        F.min("_r").alias("min"), F.max("_r").alias("max"), F.sum(F.col("_r") * F.col("_r")).alias("rss"),
        F.skewness("_r").alias("g1"), F.kurtosis("_r").alias("g2"))
    # Skewness z-score.
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta = 1 / F.sqrt(F.ln(w2) / 2)
    ratio = y / F.sqrt(2 / (w2 - 1))
    z1 = delta * F.ln(ratio + F.sqrt(ratio * ratio + 1))
    # Kurtosis z-score.
    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("g2") + 3 - expected) / F.sqrt(variance)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    inner = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(inner) * F.pow(F.abs(inner), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    tested = base.withColumn("k2", F.when(n >= 8, z1 * z1 + z2 * z2))
    return tested.select(n.cast("bigint").alias("n"), "mean", "std", "min", "max", "rss", "k2",
                         F.exp(-F.col("k2") / 2).alias("p_value"),
                         (F.exp(-F.col("k2") / 2) > 0.05).alias("is_normal"))
