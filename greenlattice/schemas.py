"""Column contracts and fixed values of the working tables."""

from __future__ import annotations

from pyspark.sql import types as T

CLIMATE_SCHEMA = T.StructType([
    T.StructField("obs_date", T.DateType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("precipitation", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("wind_speed", T.DoubleType()),
])

OCCURRENCE_SCHEMA = T.StructType([
    T.StructField("species_name", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("observation_date", T.TimestampType()),
    T.StructField("conservation_status", T.StringType()),
    T.StructField("is_endemic", T.BooleanType()),
    T.StructField("observer", T.StringType()),
    T.StructField("basis_of_record", T.StringType()),
])

CLIMATE_VARIABLES = ["temperature", "precipitation", "humidity", "wind_speed"]
LANDUSE_SHARES = ["forest_cover", "agricultural_area", "urban_area", "water_bodies"]
SPECIES_COUNTS = ["species_count", "endemic_species", "threatened_species"]
CLIMATE_REQUIRED = ["latitude", "longitude", *CLIMATE_VARIABLES]
OCCURRENCE_REQUIRED = ["species_name", "latitude", "longitude"]
NON_FEATURES = ["latitude", "longitude", "id", "index"]

# Codes and scores that results depend on.
LANDUSE_TYPES = {1: "forest", 2: "agricultural", 3: "urban", 4: "water", 5: "grassland", 6: "barren"}
IUCN_SCORES = {"LC": 0, "NT": 1, "VU": 2, "EN": 3, "CR": 4, "EW": 5, "EX": 6}
IUCN_NAMES = {
    "LC": "Least Concern", "NT": "Near Threatened", "VU": "Vulnerable", "EN": "Endangered",
    "CR": "Critically Endangered", "EW": "Extinct in Wild", "EX": "Extinct",
}
THREATENED = ["VU", "EN", "CR"]
BOOLEAN_WORDS = {
    "True": True, "true": True, "1": True, "Yes": True, "yes": True,
    "False": False, "false": False, "0": False, "No": False, "no": False,
}
BOOLEAN_COLUMNS = ["is_endemic", "is_threatened", "is_protected"]
KNOWN_RANGES = {
    "temperature": (-50.0, 60.0), "precipitation": (0.0, 1000.0), "humidity": (0.0, 100.0),
    "wind_speed": (0.0, 200.0), "forest_cover": (0.0, 1.0), "agricultural_area": (0.0, 1.0),
    "urban_area": (0.0, 1.0), "water_bodies": (0.0, 1.0),
    "species_count": (0.0, None), "endemic_species": (0.0, None), "threatened_species": (0.0, None),
}
EARTH_RADIUS_KM = 6371.0
