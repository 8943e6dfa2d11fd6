"""Small column helpers shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from greenlattice.schemas import NON_FEATURES

NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = tuple(NON_FEATURES)) -> list[str]:
    """Numeric columns of ``df`` that count as features."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN means missing; make it NULL so that every later operator agrees."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(*[
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, floats) else F.col(f.name)
        for f in df.schema.fields
    ])


def clip(col: Column, low: float | None, high: float | None) -> Column:
    """Bound a value on either side; NULL stays NULL (greatest/least alone would skip it)."""
    bounded = col
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(col.isNotNull(), bounded)


def skip_null_sum(columns: list[Column]) -> Column:
    """Row sum where a missing value counts as nothing."""
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])


def skip_null_mean(columns: list[Column]) -> Column:
    """Row mean over the values that are present."""
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.try_divide(skip_null_sum(columns), present)


def rounded(col: Column, digits: int = 6) -> Column:
    """Stable rounding for results compared across engines.

    The tiny shift decides exact decimal ties the same way whatever the last bit of a
    summed double is; adding zero turns -0.0 into 0.0.
    """
    return F.round(col.cast("double") + F.lit(1e-10), digits) + F.lit(0.0)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column of a result."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(*[
        rounded(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, floats) else F.col(f.name)
        for f in df.schema.fields
    ])


# Odd multipliers of the scatter orders.
SCATTER, SCATTER_OTHER = 2654435761, 2246822519


WORD = 4294967296


def scatter_key(col: Column, multiplier: int = SCATTER) -> Column:
    """A fixed pseudo-random order of all 64-bit ids in which no two ids tie.

    The low and the high half of the id are each multiplied modulo 2**32, in pieces of 16
    bits so that no product overflows, and added; the high half follows behind and tells
    apart ids whose sums agree. For ids below 2**32 the order is that of
    ``(id * multiplier) % 2**32``. Negative ids mirror the others.
    """
    def times(x: Column) -> Column:
        high, low = F.shiftright(x, 16), x.bitwiseAND(F.lit(65535).cast("bigint"))
        return ((high * multiplier) % WORD * 65536 + low * multiplier) % WORD

    def key(x: Column) -> Column:
        low, high = x.bitwiseAND(F.lit(WORD - 1)), F.shiftright(x, 32)
        return (times(low) + times(high)) % WORD * F.lit(2147483648) + high

    x = col.cast("bigint")
    return F.when(x >= 0, key(x)).otherwise(-1 - key(-1 - x))
