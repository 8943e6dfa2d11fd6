"""Risk categories, tiers and closed-form scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from greenlattice.functions.numeric import clip


def risk_category(score: Column, low: float = 0.3, medium: float = 0.6,
                  labels: tuple[str, str, str] = ("low", "medium", "high")) -> Column:
    """Left-closed thresholds: below ``low``, below ``medium``, the rest."""
    return (F.when(score.isNull(), F.lit(None))
            .when(score < low, labels[0]).when(score < medium, labels[1]).otherwise(labels[2]))


def risk_bins(score: Column, low: float = 0.33, medium: float = 0.66, top: float = 1.0,
              labels: tuple[str, str, str] = ("Low", "Medium", "High")) -> Column:
    """Right-closed bins (0, low], (low, medium], (medium, top]; anything outside is NULL."""
    return (F.when(score <= 0, F.lit(None)).when(score <= low, labels[0])
            .when(score <= medium, labels[1]).when(score <= top, labels[2]))


def action_tier(score: Column, low: float = 0.30, high: float = 0.75) -> Column:
    """Conservation tier of a score."""
    return (F.when(score.isNull(), F.lit(None)).when(score >= high, "immediate_action")
            .when(score >= low, "enhanced_monitoring").otherwise("maintenance"))


def marker_colour(score: Column) -> Column:
    """Map marker colour: above .6 red, above .3 orange, else green."""
    return F.when(score > 0.6, "red").when(score > 0.3, "orange").otherwise("green")


def radial_decay(lat: Column, lon: Column, centre_lat: Column, centre_lon: Column) -> Column:
    """Closed-form surface that falls off with the distance in degrees."""
    dlat, dlon = lat - centre_lat, lon - centre_lon
    return clip(F.exp(F.lit(-3.0) * F.sqrt(dlat * dlat + dlon * dlon)), 0.0, 1.0)


def category_order(category: Column) -> Column:
    """Sort key low, medium, high whatever the letter case."""
    name = F.lower(category)
    return F.when(name == "low", 0).when(name == "medium", 1).when(name == "high", 2)
