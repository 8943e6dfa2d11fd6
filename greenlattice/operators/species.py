"""Biodiversity metrics around places and the hotspots among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from greenlattice.operators.quantiles import exact_quantiles
from greenlattice.operators.ranking import average_rank
from greenlattice.operators.spatial_join import HOT_CELL_ROWS, radius_join
from greenlattice.schemas import IUCN_NAMES, IUCN_SCORES, THREATENED
from greenlattice.session import materialize


def iucn_score(status: Column) -> Column:
    scores = F.create_map(*[x for k, v in IUCN_SCORES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(scores, status)


def iucn_name(status: Column) -> Column:
    names = F.create_map(*[x for k, v in IUCN_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(names, status)


def species_metrics(occurrences: DataFrame, grid: DataFrame, radius_km: float = 5.0,
                    hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """Richness, endemic and threatened richness, Shannon diversity and threat index per place.

    Equal records (place, species, status, endemic flag) are counted before the radius
    join, and matches are counted per (place, species, status) before the final
    aggregates, so no step holds a place's raw records.
    """
    facts = ["species_name", "conservation_status", "is_endemic"]
    grid = grid.select("latitude", "longitude").distinct()
    packed = occurrences.groupBy("latitude", "longitude", *facts).agg(F.count(F.lit(1)).alias("_n"))
    packed = materialize(packed)  # counted per cell, then joined
    near = radius_join(grid, packed, radius_km, hot_rows=hot_rows)
    place = ["latitude", "longitude"]
    detail = near.groupBy(*place, *facts).agg(F.sum("_n").alias("_n"))
    score = iucn_score(F.col("conservation_status"))
    endemic = F.max(F.coalesce(F.col("is_endemic"), F.lit(False)).cast("int"))
    threatened = F.max(F.coalesce(F.col("conservation_status").isin(THREATENED), F.lit(False)).cast("int"))
    by_species = detail.groupBy(*place, "species_name").agg(
        F.sum("_n").alias("_n"), endemic.alias("_endemic"), threatened.alias("_threatened"),
        F.sum(score * F.col("_n")).alias("_score"), F.sum(F.when(score.isNotNull(), F.col("_n"))).alias("_scored"))
    # With counts c and total n: -sum(c/n ln(c/n)) = ln n - sum(c ln c) / n, one pass.
    named = F.when(F.col("species_name").isNotNull(), F.col("_n"))
    total = F.sum(named)
    shannon = F.ln(total) - F.sum(named * F.ln(named)) / total
    metrics = by_species.groupBy(*place).agg(
        F.count("species_name").alias("species_count"),
        F.sum(F.when(F.col("species_name").isNotNull(), F.col("_endemic"))).alias("endemic_species"),
        F.sum(F.when(F.col("species_name").isNotNull(), F.col("_threatened"))).alias("threatened_species"),
        F.greatest(shannon, F.lit(0.0)).alias("species_diversity"),
        (F.try_divide(F.sum("_score"), F.sum("_scored")) / 6.0).alias("threat_index"))
    zero = {"species_count": 0, "endemic_species": 0, "threatened_species": 0,
            "species_diversity": 0.0, "threat_index": 0.0}
    return grid.join(metrics, place, "left").fillna(zero)


def biodiversity_score(df: DataFrame) -> DataFrame:
    return df.withColumn("biodiversity_score",
                         F.col("species_count") * 0.4 + F.col("endemic_species") * 0.3
                         + F.col("species_diversity") * 0.2 + F.col("threatened_species") * 0.1)


def biodiversity_hotspots(metrics: DataFrame, percentile: float = 90.0) -> DataFrame:
    """Places at or above the score percentile with their average rank, best first."""
    scored = materialize(biodiversity_score(metrics))  # the search, the filter and the ranks read it
    threshold = exact_quantiles(scored, {"biodiversity_score": [percentile / 100.0]})["biodiversity_score"][0]
    hot = scored.where(F.col("biodiversity_score") >= F.lit(threshold))
    return average_rank(hot, "biodiversity_score", "hotspot_rank", descending=True).orderBy(
        "hotspot_rank", "latitude", "longitude")
