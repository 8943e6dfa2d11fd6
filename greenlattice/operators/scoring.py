"""Scoring places with a fitted model, and the zones and heatmaps made from scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from greenlattice.functions.geo import valid_coordinates
from greenlattice.functions.numeric import clip
from greenlattice.functions.risk import risk_category
from greenlattice.operators.models import Model, tree_spread
from greenlattice.operators.spatial_join import nearest_site
from greenlattice.operators.splits import downsample
from greenlattice.operators.zones import centred_zones


def with_model_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Every model feature present as a double: a missing column or value is 0."""
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in features})


def location_features(points: DataFrame, point_id: str, grid: DataFrame, cell_id: str, columns: list[str]) -> DataFrame:
    """Features of each point taken from the nearest cell of a feature grid."""
    near = nearest_site(points, point_id, grid, cell_id)
    cells = grid.select(cell_id, *columns)
    return points.join(near.join(cells, cell_id), point_id, "left")


def score_batch(df: DataFrame, model: Model, low: float = 0.3, medium: float = 0.6) -> DataFrame:
    """Valid rows get risk_score, category and confidence, others an error; no row is lost.

    The confidence of a forest falls with the disagreement of its trees (a 0-1 score can
    differ by at most half around its mean); other models have the constant .8.
    """
    ok = valid_coordinates(F.col("latitude"), F.col("longitude"))
    ready = with_model_features(df.where(ok), model.features)
    if model.kind == "random_forest":
        scored = tree_spread(model, ready).withColumnRenamed("tree_mean", "predicted").withColumn(
            "confidence", clip(1 - F.col("tree_std") / 0.5, 0.0, 1.0)).drop("tree_std")
    else:
        scored = model.predict(ready).withColumn("confidence", F.lit(0.8))
    scored = scored.withColumn("risk_score", clip(F.col("predicted"), 0.0, 1.0)).drop("predicted")
    out = scored.withColumns({
        "risk_category": risk_category(F.col("risk_score"), low, medium), "error": F.lit(None).cast("string")})
    bad = df.where(~ok).withColumn("error", F.lit("Invalid coordinates"))
    return out.unionByName(bad, allowMissingColumns=True)


def risk_zones(nodes: DataFrame, model: Model, resolution: float) -> DataFrame:
    """Squares around scored lattice nodes with their level."""
    scored = score_batch(nodes, model).where(F.col("error").isNull())
    return centred_zones(scored, resolution)


def heatmap(nodes: DataFrame, model: Model, row_id: str, limit: int | None = None) -> DataFrame:
    """Scored lattice nodes; a ``limit`` keeps that many nodes of the scatter order."""
    return score_batch(downsample(nodes, row_id, limit), model).where(F.col("error").isNull())
