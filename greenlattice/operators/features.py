"""Derived features. Table-wide facts come from one aggregate and enter as literals."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F, types as T

from greenlattice.functions.geo import haversine_km
from greenlattice.functions.numeric import clip, numeric_columns, skip_null_mean, skip_null_sum
from greenlattice.operators.quantiles import exact_quantiles
from greenlattice.schemas import CLIMATE_VARIABLES, LANDUSE_SHARES, SPECIES_COUNTS

EPS = 0.001


def _facts(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float | None]]:
    """Minimum, maximum, mean and sample deviation per column in one pass."""
    if not columns:
        return {}
    row = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
                            F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in columns]).first()
    return {c: row[c].asDict() for c in columns}


def equal_width_bin(value: Column, low: float, high: float, bins: int = 10) -> Column:
    """Code 0..bins-1 of right-closed equal-width bins; the minimum falls in bin 0."""
    if high == low:
        # A constant column is widened by 0.1 % on either side, so it sits in the middle.
        return F.when(value.isNotNull(), F.lit((bins - 1) // 2))
    width = (high - low) / bins
    code = F.ceil((value - F.lit(low)) / F.lit(width)) - 1
    return F.when(value.isNotNull(), F.least(F.greatest(code, F.lit(0)), F.lit(bins - 1))).cast("int")


def spatial_features(df: DataFrame, bins: int = 10) -> DataFrame:
    facts = _facts(df, ["latitude", "longitude"])
    lat, lon = F.col("latitude"), F.col("longitude")
    a, o = facts["latitude"], facts["longitude"]
    return df.withColumns({
        "distance_from_center": haversine_km(lat, lon, F.lit(a["mean"]), F.lit(o["mean"])),
        "lat_squared": lat * lat, "lon_squared": lon * lon, "lat_lon_product": lat * lon,
        "lat_bin": equal_width_bin(lat, a["min"], a["max"], bins),
        "lon_bin": equal_width_bin(lon, o["min"], o["max"], bins),
        "distance_to_north": F.lit(a["max"]) - lat, "distance_to_south": lat - F.lit(a["min"]),
        "distance_to_east": F.lit(o["max"]) - lon, "distance_to_west": lon - F.lit(o["min"])})


def temporal_features(df: DataFrame, date: str) -> DataFrame:
    first = df.agg(F.min(date)).first()[0]
    d = F.col(date)
    if isinstance(df.schema[date].dataType, T.DateType):
        since = F.datediff(d, F.lit(first))
    else:  # whole days elapsed, as a timestamp difference floors
        stamp = d.cast("timestamp")
        since = F.floor((stamp.cast("double") - F.lit(first).cast("timestamp").cast("double")) / 86400.0).cast("int")
    turn = 2.0 * math.pi
    return df.withColumns({
        f"{date}_year": F.year(d), f"{date}_month": F.month(d), f"{date}_day": F.dayofmonth(d),
        f"{date}_dayofyear": F.dayofyear(d), f"{date}_weekday": F.weekday(d), f"{date}_quarter": F.quarter(d),
        f"{date}_month_sin": F.sin(F.month(d) * turn / 12), f"{date}_month_cos": F.cos(F.month(d) * turn / 12),
        f"{date}_day_sin": F.sin(F.dayofyear(d) * turn / 365), f"{date}_day_cos": F.cos(F.dayofyear(d) * turn / 365),
        f"{date}_days_since_start": since})


def interaction_features(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    col = F.col
    out: dict[str, Column] = {}
    if {"temperature", "precipitation"} <= have:
        out["temp_precip_interaction"] = col("temperature") * col("precipitation")
    if {"humidity", "temperature"} <= have:
        out["humidity_temp_interaction"] = col("humidity") * col("temperature")
    if {"forest_cover", "urban_area"} <= have:
        out["forest_urban_ratio"] = F.try_divide(col("forest_cover"), col("urban_area") + EPS)
    if {"forest_cover", "agricultural_area"} <= have:
        out["ag_forest_ratio"] = F.try_divide(col("agricultural_area"), col("forest_cover") + EPS)
    if {"species_count", "forest_cover"} <= have:
        out["species_forest_interaction"] = col("species_count") * col("forest_cover")
    return df.withColumns(out)


def aggregation_features(df: DataFrame) -> DataFrame:
    land = [c for c in LANDUSE_SHARES if c in df.columns]
    climate = [c for c in CLIMATE_VARIABLES[:3] if c in df.columns]
    counts = [c for c in SPECIES_COUNTS if c in df.columns]
    out: dict[str, Column] = {}
    if len(land) >= 2:
        total = skip_null_sum([F.col(c) for c in land])
        natural = (F.col("forest_cover") if "forest_cover" in land else F.lit(0.0)) + (
            F.col("water_bodies") if "water_bodies" in land else F.lit(0.0))
        out["total_developed_area"] = total
        out["natural_area_ratio"] = F.try_divide(natural, total + EPS)
    if len(climate) >= 2:
        facts = _facts(df, climate)
        scaled = [F.try_divide(F.col(c) - F.lit(facts[c]["min"]), F.lit(facts[c]["max"] - facts[c]["min"]))
                  for c in climate if facts[c]["min"] is not None]
        out["climate_favorability_index"] = skip_null_mean(scaled)
    if len(counts) >= 2:
        out["total_species_richness"] = skip_null_sum([F.col(c) for c in counts])
        if {"species_count", "endemic_species"} <= set(counts):
            out["endemic_ratio"] = F.try_divide(F.col("endemic_species"), F.col("species_count") + EPS)
    return df.withColumns(out)


def climate_stress(df: DataFrame, without_spread: float | None = None) -> Column:
    """Absolute deviation from the median in sample deviations, temperature plus rain.

    A variable without spread counts as ``without_spread``.
    """
    pair = ["temperature", "precipitation"]
    medians = exact_quantiles(df, {c: [0.5] for c in pair})
    facts = _facts(df, pair)
    stress = [F.abs(F.col(c) - F.lit(medians[c][0])) / F.lit(facts[c]["std"]) if facts[c]["std"]
              else F.lit(without_spread).cast("double") for c in pair]
    return stress[0] + stress[1]


def ecological_features(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    col = F.col
    out: dict[str, Column] = {}
    if {"forest_cover", "water_bodies", "urban_area"} <= have:
        out["habitat_quality_index"] = col("forest_cover") * 0.6 + col("water_bodies") * 0.3 - col("urban_area") * 0.4
    if {"forest_cover", "urban_area"} <= have:
        out["fragmentation_index"] = F.try_divide(col("urban_area"), col("forest_cover") + EPS)
    if {"temperature", "precipitation"} <= have:
        out["climate_stress_index"] = climate_stress(df)
    if {"threatened_species", "species_count"} <= have:
        out["threat_ratio"] = F.try_divide(col("threatened_species"), col("species_count") + EPS)
    if {"urban_area", "agricultural_area"} <= have:
        out["human_pressure_index"] = col("urban_area") * 0.7 + col("agricultural_area") * 0.3
    return df.withColumns(out)


def statistical_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row-wise mean, sample deviation, extremes, range and variation over the numeric columns."""
    columns = columns or numeric_columns(df)
    if len(columns) < 3:
        return df
    present = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    size = F.size("_present").cast("double")
    mean = F.try_divide(F.aggregate("_present", F.lit(0.0), lambda a, v: a + v), size)
    square = F.aggregate(F.transform("_present", lambda v: (v - F.col("feature_mean")) * (v - F.col("feature_mean"))),
                         F.lit(0.0), lambda a, v: a + v)
    return (df.withColumn("_present", present).withColumn("feature_mean", mean).withColumns({
        "feature_std": F.when(size > 1, F.sqrt(square / (size - 1))),
        "feature_min": F.array_min("_present"), "feature_max": F.array_max("_present")})
        .withColumn("feature_range", F.col("feature_max") - F.col("feature_min"))
        .withColumn("feature_cv", F.try_divide(F.col("feature_std"), F.col("feature_mean") + EPS))
        .drop("_present"))


def engineer_features(df: DataFrame, dates: list[str] | None = None) -> DataFrame:
    """All stages in order; later stages see the columns of earlier ones."""
    if {"latitude", "longitude"} <= set(df.columns):
        df = spatial_features(df)
    for date in dates if dates is not None else [c for c in df.columns if "date" in c.lower()]:
        df = temporal_features(df, date)
    for stage in (interaction_features, aggregation_features, ecological_features, statistical_features):
        df = stage(df)
    return df


def polynomial_terms(columns: list[str], degree: int) -> list[tuple[str, list[str]]]:
    """Names and factors of all products up to ``degree`` without the constant."""
    terms = []
    for size in range(1, degree + 1):
        for combo in combinations_with_replacement(columns, size):
            powers = {c: combo.count(c) for c in dict.fromkeys(combo)}
            terms.append((" ".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items()), list(combo)))
    return terms


def polynomial_features(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    """Replace ``columns`` by their products; names read ``a``, ``a^2``, ``a b``."""
    def product(factors: list[str]) -> Column:
        out = F.col(factors[0]).cast("double")
        for f in factors[1:]:
            out = out * F.col(f)
        return out
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, *[product(f).alias(n) for n, f in polynomial_terms(columns, degree)])


def exploration_features(df: DataFrame) -> DataFrame:
    """Interactions, ratios and composite indices used when exploring a training set."""
    have = set(df.columns)
    col = F.col
    pairs = {
        "temp_forest": ("temperature", "forest_cover"), "precip_forest": ("precipitation", "forest_cover"),
        "humidity_forest": ("humidity", "forest_cover"), "urban_temp": ("urban_area", "temperature"),
        "urban_pop": ("urban_area", "population_density"), "species_temp": ("species_count", "temperature"),
        "species_precip": ("species_count", "precipitation")}
    out = {f"{n}_interaction": col(a) * col(b) for n, (a, b) in pairs.items() if {a, b} <= have}
    if {"forest_cover", "urban_area", "agricultural_area", "water_bodies"} <= have:
        out |= {"non_forest_cover": 1 - col("forest_cover"),
                "total_developed": col("urban_area") + col("agricultural_area"),
                "natural_area": col("forest_cover") + col("water_bodies")}
    plus_one = {"endemic_to_total_species": ("endemic_species", "species_count"),
                "threatened_to_total_species": ("threatened_species", "species_count"),
                "temp_to_precip_ratio": ("temperature", "precipitation"),
                "humidity_to_precip_ratio": ("humidity", "precipitation")}
    out |= {n: F.try_divide(col(a), col(b) + 1) for n, (a, b) in plus_one.items() if {a, b} <= have}
    if set(SPECIES_COUNTS) <= have:
        out["biodiversity_index"] = (col("species_count") * 0.5 + col("endemic_species") * 0.3
                                     + col("threatened_species") * 0.2)
    df = df.withColumns(out)
    needed = [c for c in ("population_density", "precipitation") if c in have]
    facts = _facts(df, needed)
    out = {}
    if "temperature" in have:
        out["temperature_stress"] = F.abs(col("temperature") - 25.0) / 10.0
    if "precipitation" in have:
        out["precipitation_anomaly"] = F.try_divide(
            F.abs(col("precipitation") - F.lit(facts["precipitation"]["mean"])), F.lit(facts["precipitation"]["std"]))
    if {"forest_cover", "urban_area", "population_density"} <= have:
        threat = ((1 - col("forest_cover")) * 0.3 + col("urban_area") * 0.25
                  + F.try_divide(col("population_density"), F.lit(facts["population_density"]["max"])) * 0.25)
        if {"threatened_species", "species_count"} <= have:
            threat = threat + F.try_divide(col("threatened_species"), col("species_count") + 1) * 0.2
        out["habitat_threat"] = threat
        if "biodiversity_index" in df.columns:
            out["conservation_priority"] = col("biodiversity_index") * (1 - threat)
    if {"forest_cover", "urban_area", "water_bodies"} <= have:
        out["habitat_quality"] = clip(col("forest_cover") * 0.5 + (1 - col("urban_area")) * 0.3
                                      + col("water_bodies") / 0.3 * 0.2, 0.0, 1.0)
    return df.withColumns(out)


# ---------------------------------------------------------------- risk targets

def _min_max(df: DataFrame, value: Column) -> Column:
    """0-1 scaling; values without spread become 0."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or high == low:
        return F.when(value.isNotNull(), F.lit(0.0))
    return (value - F.lit(low)) / F.lit(high - low)


def ecological_risk(df: DataFrame, out: str = "ecological_risk") -> DataFrame:
    """Composite 0-1 risk from climate stress, fragmentation, threat and lost diversity.

    Only components whose columns exist take part; one without spread adds the same to
    every row. Two passes of bounded aggregates.
    """
    have = set(df.columns)
    parts: list[Column] = []
    if {"temperature", "precipitation"} <= have:
        parts.append(climate_stress(df, without_spread=0.0) / 2.0 * 0.3)
    ratios: dict[str, tuple[Column, float]] = {}
    if {"forest_cover", "urban_area"} <= have:
        ratios["fragmentation"] = (F.try_divide(F.col("urban_area"), F.col("forest_cover") + 0.01), 0.25)
    if {"threatened_species", "species_count"} <= have:
        ratios["threat"] = (F.try_divide(F.col("threatened_species"), F.col("species_count") + 0.01), 0.25)
    if "species_diversity" in have:
        ratios["diversity"] = (F.col("species_diversity"), 0.2)
    if ratios:
        span = df.agg(*[F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias(n)
                        for n, (v, _) in ratios.items()]).first()
        for name, (value, weight) in ratios.items():
            low, high = span[name]["low"], span[name]["high"]
            scaled = (value - F.lit(low)) / F.lit(high - low) if low is not None and high > low else F.lit(0.0)
            parts.append((1 - scaled if name == "diversity" else scaled) * weight)
    if not parts:
        raise ValueError("no risk component can be computed from these columns")
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.withColumn(out, _min_max(df, total))


def training_risk(signed_temperature: bool = True) -> Column:
    """Closed-form training target, held to 0-1."""
    departure = F.col("temperature") - 25.0
    departure = departure if signed_temperature else F.abs(departure)
    return clip((1 - F.col("forest_cover")) * 0.3 + F.col("urban_area") * 0.2 + departure / 10.0 * 0.15
                + F.lit(0.1) / (F.col("species_count") + 1) + F.col("population_density") / 1000.0 * 0.1, 0.0, 1.0)


def occurrence_risk(df: DataFrame, current_year: int, species: str = "species_name", year: str = "year") -> DataFrame:
    """Rarity and age of a record as a 0-1 risk: .6 rarity + .4 years since seen.

    Frequencies are counted once and joined back, so a very common species is not
    gathered in one window partition.
    """
    frequency = df.groupBy(species).agg(F.count(F.lit(1)).alias("frequency"))
    low, high = frequency.agg(F.min("frequency"), F.max("frequency")).first()
    joined = df.join(frequency, species, "left")
    rarity = 1 - (F.col("frequency") - F.lit(low)) / F.lit(float(max(high - low, 1)))
    age = F.greatest(F.lit(current_year) - F.col(year), F.lit(0))
    youngest, oldest = df.agg(F.min(age), F.max(age)).first()
    recency = (age - F.lit(youngest)) / F.lit(float(max(oldest - youngest, 1)))
    return joined.withColumns({"rarity": rarity, "recency": recency}).withColumn(
        "risk_score", clip(F.col("rarity") * 0.6 + F.col("recency") * 0.4, 0.0, 1.0))
