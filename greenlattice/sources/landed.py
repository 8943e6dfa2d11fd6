"""Records landed as files by an outside collector: filters, caps and JSON flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

RECORD_FIELDS = T.StructType([
    T.StructField("decimalLatitude", T.DoubleType()), T.StructField("decimalLongitude", T.DoubleType()),
    T.StructField("species", T.StringType()), T.StructField("scientificName", T.StringType()),
    T.StructField("eventDate", T.StringType()), T.StructField("occurrenceDate", T.StringType()),
    T.StructField("year", T.StringType()), T.StructField("countryCode", T.StringType()),
])


def fetch_occurrences(landed: DataFrame, bounds: tuple[float, float, float, float], basis: list[str] | None,
                      order: str | None = None, limit: int | None = None) -> DataFrame:
    """Landed occurrences inside bounds and of the wanted kinds: all, or the first ``limit`` by ``order``."""
    min_lon, min_lat, max_lon, max_lat = bounds
    rows = landed.where(F.col("longitude").between(min_lon, max_lon) & F.col("latitude").between(min_lat, max_lat))
    if basis:
        rows = rows.where(F.col("basis_of_record").isin(basis))
    if limit is None:
        return rows
    if order is None:
        raise ValueError("a limit needs an order")
    return rows.orderBy(order).limit(limit)


def flatten_records(landed: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """JSON records to (species_name, latitude, longitude, year, country).

    Records without a place are dropped. The name falls back from species to scientific
    name to 'Unknown'. The year is that of the event date (the part before a slash); the
    record's own year counts only where a date is given but cannot be read.
    """
    r = F.from_json(F.col(column), RECORD_FIELDS)
    parsed = landed.select(*(keep or []), r.alias("r"))
    blank = lambda c: F.when(F.length(c) > 0, c)
    date = F.coalesce(blank(F.col("r.eventDate")), blank(F.col("r.occurrenceDate")))
    start = F.split(date, "/")[0]
    stamp = F.try_to_timestamp(start)
    year = F.coalesce(F.year(stamp), F.col("r.year").try_cast("int"))
    return parsed.where(F.col("r.decimalLatitude").isNotNull() & F.col("r.decimalLongitude").isNotNull()).select(
        *(keep or []), F.coalesce(blank(F.col("r.species")), blank(F.col("r.scientificName")), F.lit("Unknown")).alias("species_name"),
        F.col("r.decimalLatitude").alias("latitude"), F.col("r.decimalLongitude").alias("longitude"),
        F.when(date.isNotNull(), year).cast("int").alias("year"), F.col("r.countryCode").alias("country"))
