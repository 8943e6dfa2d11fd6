"""Cleaning: duplicates, missing values, outliers, types and known ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, functions as F, types as T

from greenlattice.functions.geo import valid_coordinates
from greenlattice.functions.numeric import numeric_columns, string_columns
from greenlattice.operators.impute import impute_nearest_rows
from greenlattice.operators.quantiles import exact_quantiles
from greenlattice.schemas import BOOLEAN_COLUMNS, BOOLEAN_WORDS, KNOWN_RANGES
from greenlattice.session import materialize


def remove_duplicates(df: DataFrame, key_columns: list[str] | None = None,
                      order: list[str] | None = None) -> DataFrame:
    """Drop exact copies, then keep one row per key.

    The default key is the coordinate pair rounded half-even to 6 digits. The kept row is
    the least by ``order`` (default: all columns), taken with a combined ``min_by`` so a
    key shared by much of the table shrinks before the shuffle.
    """
    if key_columns is None:
        if not {"latitude", "longitude"} <= set(df.columns):
            return df.distinct()
        keys = [F.bround("latitude", 6).alias("_k0"), F.bround("longitude", 6).alias("_k1")]
    else:
        keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(key_columns)]
    lead = list(order or [])
    rest = [c for c in df.columns if c not in lead]
    # A least struct skips no NULL fields, so exact copies fall together here as well.
    first = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c) for c in (*lead, *rest)])).alias("_row"))
    return first.select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def quantile_trim(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Keep rows inside [low, high] quantiles, column after column.

    Each column's quantiles are taken on the rows the earlier columns left. The bounds are
    two numbers per column, so they become literals the next scan can push down. The input
    is stored once, so a search reads one column of a table instead of repeating its joins.
    """
    df = materialize(df)
    for column in columns:
        lower, upper = exact_quantiles(df, {column: [low, high]})[column]
        df = df.where(F.lit(False)) if lower is None else df.where(F.col(column).between(lower, upper))
    return df


def remove_outliers_iqr(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Keep rows inside the interquartile fences, column after column."""
    df = materialize(df)
    for column in columns:
        q1, q3 = exact_quantiles(df, {column: [0.25, 0.75]})[column]
        if q1 is None:
            df = df.where(F.lit(False))
            continue
        spread = q3 - q1
        df = df.where((F.col(column) >= q1 - factor * spread) & (F.col(column) <= q3 + factor * spread))
    return df


def remove_outliers_zscore(df: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    """Keep rows within ``limit`` population standard deviations, column after column."""
    for column in columns:
        mean, std = df.agg(F.avg(column), F.stddev_pop(column)).first()
        if not std:  # all equal (or no rows): every score is undefined and drops the row
            df = df.where(F.lit(False))
            continue
        df = df.where(F.abs((F.col(column) - F.lit(mean)) / F.lit(std)) < limit)
    return df


def drop_sparse_columns(df: DataFrame, share: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop columns missing in more than ``share`` of the rows."""
    missing = missing_shares(df)
    return df.drop(*[c for c, s in missing.items() if s > share and c not in keep])


def missing_shares(df: DataFrame) -> dict[str, float]:
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns]).first()
    return {c: (row[c] or 0) / row["_n"] if row["_n"] else 0.0 for c in df.columns}


def most_frequent(df: DataFrame, column: str):
    """Most frequent value, the smallest on a tie (value counts combine map-side)."""
    row = (df.where(F.col(column).isNotNull()).groupBy(column).count()
           .orderBy(F.desc("count"), F.asc(column)).first())
    return row[0] if row else None


def fill_most_frequent(df: DataFrame, columns: list[str]) -> DataFrame:
    values = {c: most_frequent(df, c) for c in columns}
    return df.fillna({c: v for c, v in values.items() if v is not None})


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    medians = exact_quantiles(df, {c: [0.5] for c in columns})
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0])) for c in columns if medians[c][0] is not None})


def fill_zero_infinite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite, NaN and missing values become 0."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(bad(c), F.lit(0.0)).otherwise(F.col(c)) for c in columns})


def fill_defaults(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Per-column default for missing values; an absent column is added with its default."""
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def handle_missing(df: DataFrame, target: str | None = None, row_id: str | None = None,
                   neighbours: int = 5) -> DataFrame:
    """Missing-value policy by column kind and missing share.

    Target: drop the row. Over 50 %: drop the column. Text: most frequent value. Numeric
    under 10 %: mean of the nearest rows over all numeric columns. Numeric 10-50 %: median.
    Without ``row_id`` the rows are numbered and stored once, so that the fill has an id.
    """
    if target and target in df.columns:
        df = df.dropna(subset=[target])
    shares = {c: s for c, s in missing_shares(df).items() if s > 0 and c not in (target, row_id)}
    df = df.drop(*[c for c, s in shares.items() if s > 0.5])
    shares = {c: s for c, s in shares.items() if s <= 0.5}
    text = [c for c in string_columns(df) if c in shares]
    df = fill_most_frequent(df, text)
    numeric = numeric_columns(df, exclude=(row_id,) if row_id else ())
    # Columns are visited in table order: the first sparse one that is rarely missing
    # triggers the nearest-row fill of every numeric column still missing.
    for column in [c for c in numeric if c in shares]:
        if shares[column] < 0.10 and len(numeric) > 1:
            if row_id:
                return impute_nearest_rows(df, numeric, row_id, neighbours)
            numbered = materialize(df.withColumn("_row_number", F.monotonically_increasing_id()))
            return impute_nearest_rows(numbered, numeric, "_row_number", neighbours).drop("_row_number")
        df = fill_median(df, [column])
    return df


def standardise_types(df: DataFrame) -> DataFrame:
    """Text columns whose every value is a number become numeric; known flags become boolean."""
    strings = [c for c in string_columns(df) if c not in BOOLEAN_COLUMNS]
    if strings:
        checks = df.agg(*[
            (F.count(c) == F.count(F.expr(f"try_cast(`{c}` AS DOUBLE)"))).alias(c) for c in strings]).first()
        df = df.withColumns({c: F.col(c).cast("double") for c in strings if checks[c]})
    flags = [f.name for f in df.schema.fields
             if f.name in BOOLEAN_COLUMNS and isinstance(f.dataType, T.StringType)]
    words = F.create_map(*[x for k, v in BOOLEAN_WORDS.items() for x in (F.lit(k), F.lit(v))])
    df = df.withColumns({c: F.try_element_at(words, F.col(c)) for c in flags})
    places = [c for c in ("latitude", "longitude") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("double") for c in places})


def filter_known_ranges(df: DataFrame) -> DataFrame:
    """Keep rows whose known variables are present and inside their physical range."""
    rules = []
    for column, (low, high) in KNOWN_RANGES.items():
        if column in df.columns:
            rules.append(F.col(column) >= low)
            if high is not None:
                rules.append(F.col(column) <= high)
    return df.where(reduce(lambda a, b: a & b, rules)) if rules else df


def clean_dataset(df: DataFrame, target: str | None = None, row_id: str | None = None,
                  key_columns: list[str] | None = None, method: str = "iqr") -> DataFrame:
    """The full cleaning chain in its fixed order."""
    df = remove_duplicates(df, key_columns)
    if {"latitude", "longitude"} <= set(df.columns):
        df = df.where(valid_coordinates(F.col("latitude"), F.col("longitude")))
    df = materialize(handle_missing(df, target, row_id))  # the fences below take one pass per column
    skip = ("latitude", "longitude", target, row_id)
    columns = numeric_columns(df, exclude=[c for c in skip if c])
    if method == "iqr":
        df = remove_outliers_iqr(df, columns)
    elif method == "zscore":
        df = remove_outliers_zscore(df, columns)
    else:
        raise ValueError(f"unknown outlier method {method}")
    return filter_known_ranges(standardise_types(df))


class LabelEncoder:
    """Codes 0.. by sorted value; a value not seen at fit time fails."""

    def __init__(self, columns: list[str]):
        self.columns = columns
        self.model = None

    def fit(self, df: DataFrame) -> "LabelEncoder":
        self.model = StringIndexer(
            inputCols=self.columns, outputCols=[f"{c}_code" for c in self.columns],
            stringOrderType="alphabetAsc", handleInvalid="error").fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumns(
            {f"{c}_code": F.col(f"{c}_code").cast("int") for c in self.columns})
