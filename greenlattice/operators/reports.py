"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from greenlattice.functions.risk import action_tier
from greenlattice.operators.ranking import row_position
from greenlattice.operators.scaling import inverse_normal

# Targets the headline figures are compared with.
KPI_TARGETS = {"avg_risk": 0.35, "high_risk": 15, "avg_species": 15, "avg_forest": 0.5}


def key_figures(df: DataFrame, risk: str = "risk_score", category: str = "risk_category") -> DataFrame:
    """One row: means, the number of high-risk places and their distance from the targets."""
    row = df.agg(F.avg(risk).alias("avg_risk"), F.sum((F.lower(category) == "high").cast("bigint")).alias("high_risk"),
                 F.avg("species_count").alias("avg_species"), F.avg("forest_cover").alias("avg_forest"))
    return row.withColumns({f"{k}_delta": F.col(k) - F.lit(float(v)) for k, v in KPI_TARGETS.items()})


def category_accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per category and overall: rows, correct rows and percentage."""
    hit = (F.col(actual) == F.col(predicted)).cast("bigint")
    counts = df.groupBy(F.col(actual).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("correct"))
    overall = counts.agg(F.lit("overall").alias("category"), F.sum("n").alias("n"), F.sum("correct").alias("correct"))
    return counts.unionByName(overall).withColumn("accuracy_pct", F.col("correct") * 100.0 / F.col("n"))


def category_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and shares per category for several category columns, in one pass."""
    tall = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("source"), F.col(c).alias("category")) for c in columns])).alias("e")).select("e.*")
    counts = tall.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("source").agg(F.sum("n").alias("_all"))
    return counts.join(totals, "source").withColumn("pct", F.col("n") * 100.0 / F.col("_all")).drop("_all")


def conservation_tiers(df: DataFrame, score: str) -> DataFrame:
    return df.groupBy(action_tier(F.col(score)).alias("tier")).agg(
        F.count(F.lit(1)).alias("locations"), F.avg("forest_cover").alias("avg_forest"),
        F.avg("urban_area").alias("avg_urban"), F.avg("population_density").alias("avg_population"))


def time_series(df: DataFrame, date: str, columns: list[str]) -> DataFrame:
    """Long chart table (date, series, value) in time order, one mean per date."""
    daily = df.groupBy(date).agg(*[F.avg(c).alias(c) for c in columns])
    return daily.unpivot([date], columns, "series", "value").orderBy("series", date)


def quantile_quantile(df: DataFrame, value: str, row_id: str) -> DataFrame:
    """Ordered values beside the normal quantile of their plotting position.

    The ends use the median of the extreme order statistic, the rest (i - .3175)/(n + .365).
    """
    n = df.where(F.col(value).isNotNull()).count()
    placed = row_position(df.where(F.col(value).isNotNull()).select(row_id, value), value, row_id, "_i")
    i = F.col("_i") + 1
    edge = 0.5 ** (1.0 / max(n, 1))
    share = F.when(i == n, F.lit(edge)).when(i == 1, F.lit(1 - edge)).otherwise((i - 0.3175) / F.lit(n + 0.365))
    return placed.select(row_id, F.col(value).alias("ordered_value"), inverse_normal(share).alias("theoretical"))


def prediction_statistics(log: DataFrame, today: str) -> DataFrame:
    """One row over the prediction log: totals, today's rows, mean risk, high-risk rows, accuracy."""
    return log.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.sum((F.to_date("created_at") == F.lit(today).cast("date")).cast("bigint")).alias("predictions_today"),
        F.avg("predicted_risk").alias("average_risk"),
        F.sum((F.col("predicted_risk") >= 0.6).cast("bigint")).alias("high_risk_count"),
        F.avg((F.col("actual_level") == F.col("predicted_level")).cast("double")).alias("accuracy"))


def feedback_accuracy(feedback: DataFrame) -> DataFrame:
    """Per predicted level: feedback rows, share that agree, share found helpful."""
    return feedback.groupBy("predicted_risk_level").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("actual_risk_level") == F.col("predicted_risk_level")).cast("double")).alias("accuracy"),
        F.avg(F.col("is_helpful").cast("double")).alias("helpful_rate"))
