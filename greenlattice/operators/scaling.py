"""Scalers and transforms: fit returns a small parameter table, transform is a projection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from greenlattice.functions.numeric import numeric_columns
from greenlattice.operators.quantiles import exact_quantiles, grouped_quantiles
from greenlattice.operators.ranking import values_at_positions
from greenlattice.operators.stats import adjusted_skewness


@dataclass
class Scaler:
    """Affine scaling ``(x - centre) / scale`` with one parameter pair per column."""

    method: str
    params: dict[str, tuple[float, float]] = field(default_factory=dict)
    eps: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(m)) / F.lit(s + self.eps) for c, (m, s) in self.params.items() if c in df.columns})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, (m, s) in self.params.items() if c in df.columns})

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(c, m, s) for c, (m, s) in self.params.items()],
                                     "feature string, center double, scale double")

    @classmethod
    def from_table(cls, method: str, table: DataFrame, eps: float = 0.0) -> "Scaler":
        return cls(method, {r["feature"]: (r["center"], r["scale"]) for r in table.collect()}, eps)


def fit_scaler(df: DataFrame, method: str = "standard", columns: list[str] | None = None) -> Scaler:
    """standard (population deviation), minmax or robust (median, interquartile range).

    A column without spread gets scale 1, so it becomes 0.
    """
    columns = columns or numeric_columns(df)
    if method == "standard":
        row = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
        raw = {c: (row[c]["m"], row[c]["s"]) for c in columns}
    elif method == "minmax":
        row = df.agg(*[F.struct(F.min(c).cast("double").alias("m"), F.max(c).cast("double").alias("h")).alias(c)
                       for c in columns]).first()
        raw = {c: (row[c]["m"], row[c]["h"] - row[c]["m"] if row[c]["m"] is not None else None) for c in columns}
    elif method == "robust":
        q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
        raw = {c: (q[c][1], q[c][2] - q[c][0] if q[c][0] is not None else None) for c in columns}
    else:
        raise ValueError(f"unknown scaling method {method}")
    return Scaler(method, {c: (float(m), float(s) or 1.0) for c, (m, s) in raw.items() if m is not None})


def fit_domain_scaler(df: DataFrame, columns: list[str], method: str = "minmax",
                      ranges: dict[str, tuple[float, float]] | None = None) -> Scaler:
    """Min-max or mean/sample-deviation scaling where given ranges override the data."""
    ranges = ranges or {}
    free = [c for c in columns if c not in ranges]
    params = {c: (float(ranges[c][0]), float(ranges[c][1] - ranges[c][0])) for c in columns if c in ranges}
    if free:
        row = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"),
                                F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in free]).first()
        for c in free:
            r = row[c]
            params[c] = (r["m"], r["s"]) if method == "standard" else (r["lo"], r["hi"] - r["lo"])
    return Scaler(method, params, eps=1e-8)


def min_max_column(df: DataFrame, column: str) -> DataFrame:
    """Scale one column to 0-1; a column without spread is left as it is."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or high <= low:
        return df
    return df.withColumn(column, (F.col(column) - F.lit(low)) / F.lit(high - low))


@dataclass
class QuantileMap:
    """Piecewise-linear map of a value to its share of the training distribution."""

    landmarks: dict[str, list[tuple[float, float, float]]]  # value, first and last share

    def transform(self, df: DataFrame, output: str = "uniform") -> DataFrame:
        for c, marks in self.landmarks.items():
            values = [m[0] for m in marks]
            if len(values) == 1:
                share: Column = F.when(F.col(c).isNotNull(), F.lit(0.0))
                df = df.withColumn(c, _normal(share) if output == "normal" else share)
                continue
            splits = [float("-inf"), *values, float("inf")]
            cut = Bucketizer(splits=splits, inputCol="_v", outputCol="_i", handleInvalid="keep")
            order = df.columns
            located = cut.transform(df.withColumn("_v", F.col(c).cast("double") + 0.0)).withColumn("_i", F.col("_i").cast("int"))
            # Bucket i >= 1 starts at landmark i - 1. At most as many rows as landmarks.
            rows = [(i + 1, a[0], (a[1] + a[2]) / 2, a[2], b[0], b[1])
                    for i, (a, b) in enumerate(zip(marks, [*marks[1:], marks[-1]]))]
            steps = df.sparkSession.createDataFrame(
                rows, "_i int, _v0 double, _middle double, _p0 double, _v1 double, _p1 double")
            share = (F.when(F.col("_v").isNull(), F.lit(None).cast("double"))
                     .when(F.col("_v") <= values[0], F.lit(0.0)).when(F.col("_v") >= values[-1], F.lit(1.0))
                     .when(F.col("_v") == F.col("_v0"), F.col("_middle"))
                     .otherwise(F.col("_p0") + F.try_divide(
                         (F.col("_p1") - F.col("_p0")) * (F.col("_v") - F.col("_v0")), F.col("_v1") - F.col("_v0"))))
            df = located.join(steps, "_i", "left").withColumn(
                c, _normal(share) if output == "normal" else share).select(*order)
        return df


def fit_quantile_map(df: DataFrame, columns: list[str], quantiles: int = 1000) -> QuantileMap:
    """Landmarks at evenly spaced exact quantiles (as many as there are rows, at most ``quantiles``)."""
    sizes = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    landmarks = {}
    for c in columns:
        count = max(1, min(quantiles, sizes[c]))
        shares = [i / (count - 1) for i in range(count)] if count > 1 else [0.0]
        at = [(sizes[c] - 1) * p for p in shares]
        # A position that is whole but for rounding is whole: tied values must stay tied.
        at = [round(a) if abs(a - round(a)) < 1e-9 * max(1.0, a) else a for a in at]
        value = values_at_positions(df, c, [k for a in at for k in (math.floor(a), math.ceil(a))]) if sizes[c] else {}
        merged: dict[float, list[float]] = {}
        for p, a in zip(shares, at):
            if value:
                low, high = float(value[math.floor(a)]), float(value[math.ceil(a)])
                merged.setdefault(low if low == high else low + (high - low) * (a - math.floor(a)), []).append(p)
        landmarks[c] = [(v, ps[0], ps[-1]) for v, ps in sorted(merged.items())]
    return QuantileMap(landmarks)


def _normal(share: Column) -> Column:
    return inverse_normal(F.least(F.greatest(share, F.lit(1e-7)), F.lit(1 - 1e-7)))


# Rational approximation of the standard normal quantile (relative error about 1e-9).
CENTRE_TOP = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
              1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
CENTRE_BOTTOM = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
                 6.680131188771972e+01, -1.328068155288572e+01, 1.0]
TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
TAIL_BOTTOM = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0]
TAIL_EDGE = 0.02425


def _horner(x: Column, coefficients: list[float]) -> Column:
    out: Column = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile of a probability strictly between 0 and 1."""
    tail = F.least(p, 1 - p)
    t = F.sqrt(F.lit(-2.0) * F.ln(tail))
    far = _horner(t, TAIL_TOP) / _horner(t, TAIL_BOTTOM)
    q = p - 0.5
    near = _horner(q * q, CENTRE_TOP) * q / _horner(q * q, CENTRE_BOTTOM)
    return F.when(tail >= TAIL_EDGE, near).when(p < 0.5, far).otherwise(-far)


# ---------------------------------------------------------------- log, root and power transforms

def log_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    """log1p after a shift of abs(min) + 1 for columns that reach zero or below."""
    lows = df.agg(*[F.min(c).cast("double").alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        low = lows[c]
        shift = abs(low) + 1 if low is not None and low <= 0 else 0.0
        out[c] = F.log1p(F.col(c) + F.lit(float(shift)))
    return df.withColumns(out)


def yeo_johnson(x: Column, lam: Column) -> Column:
    upper = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    lower = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, upper).otherwise(lower)


def box_cox(x: Column, lam: Column) -> Column:
    return F.when(F.abs(lam) < 1e-12, F.ln(x)).otherwise((F.pow(x, lam) - 1) / lam)


def _merged(n: float, mean: np.ndarray, m2: np.ndarray, more: float, other: np.ndarray, other_m2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and summed squares about them of two groups, ``n`` rows in all and ``more`` of these in the second."""
    gap = other - mean
    return mean + gap * (more / n), m2 + other_m2 + gap * gap * ((n - more) * more / n)


def _power_sums(method: str, ladder: list[float]):
    def power(logs: np.ndarray, exponent: float) -> np.ndarray:
        return logs if abs(exponent) < 1e-12 else (np.exp(exponent * logs) - 1) / exponent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, jac, mean, m2 = 0, 0.0, np.zeros(len(ladder)), np.zeros(len(ladder))
        with np.errstate(all="ignore"):  # what overflows fits no exponent
            for batch in batches:
                x = batch.column(0).to_numpy(zero_copy_only=False)
                if not len(x):
                    continue
                if method == "box-cox":
                    logs = np.log(x)
                    rows = [power(logs, v) for v in ladder]
                else:
                    logs, minus = np.log1p(np.abs(x)), x < 0
                    rows = [np.where(minus, -power(logs, 2 - v), power(logs, v)) if minus.any() else power(logs, v) for v in ladder]
                    logs = np.sign(x) * logs
                n, jac = n + len(x), jac + float(logs.sum())
                own = np.array([row.mean() for row in rows])
                mean, m2 = _merged(n, mean, m2, len(x), own, np.array([((row - m) ** 2).sum() for row, m in zip(rows, own)]))
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([float(n)]), "jac": pa.array([jac]), "mean": pa.array([mean.tolist()], pa.list_(pa.float64())),
                                              "m2": pa.array([m2.tolist()], pa.list_(pa.float64()))})
    return run


def fit_power(df: DataFrame, columns: list[str], method: str = "yeo-johnson", low: float = -4.0, high: float = 6.0,
              points: int = 17, rounds: int = 4) -> dict[str, float]:
    """Maximum-likelihood exponent per column.

    One pass a column evaluates the likelihood of a ladder of exponents: a task sums its rows up for
    all of them, and a row a task comes back. The bracket around the best one is refined ``rounds`` times.
    """
    if method not in ("yeo-johnson", "box-cox"):
        raise ValueError(f"unknown power method {method}")
    if method == "box-cox":
        lows = df.agg(*[F.min(c).alias(c) for c in columns]).first()
        bad = [c for c in columns if lows[c] is not None and lows[c] <= 0]
        if bad:
            raise ValueError(f"box-cox needs positive values: {bad}")
    best: dict[str, float] = {}
    for c in columns:
        values = df.select(F.col(c).cast("double").alias("x")).where("x is not null")
        a, b = low, high
        for _ in range(rounds):
            ladder = [a + (b - a) * i / (points - 1) for i in range(points)]
            parts = values.mapInArrow(_power_sums(method, ladder), "n double, jac double, mean array<double>, m2 array<double>").collect()  # a row a task
            fits = {"n": 0.0, "jac": 0.0}
            mean, m2 = np.zeros(points), np.zeros(points)
            with np.errstate(all="ignore"):
                for r in parts:
                    fits = {"n": fits["n"] + r["n"], "jac": fits["jac"] + r["jac"]}
                    mean, m2 = _merged(fits["n"], mean, m2, r["n"], np.array(r["mean"]), np.array(r["m2"]))
            score = {}
            for i, exponent in enumerate(ladder):
                spread = m2[i] / fits["n"] if parts else 0.0
                if 0 < spread < math.inf:
                    score[i] = -fits["n"] / 2 * math.log(spread) + (exponent - 1) * fits["jac"]
            if not score:
                raise ValueError(f"no exponent fits {c}")
            top = max(score, key=score.get)
            best[c] = ladder[top]
            a, b = ladder[max(0, top - 1)], ladder[min(points - 1, top + 1)]
    return best


def apply_power(df: DataFrame, exponents: dict[str, float], method: str = "yeo-johnson") -> DataFrame:
    apply = box_cox if method == "box-cox" else yeo_johnson
    return df.withColumns({c: apply(F.col(c).cast("double"), F.lit(lam)) for c, lam in exponents.items()})


def power_transform(df: DataFrame, columns: list[str] | None = None, method: str = "yeo-johnson",
                    threshold: float = 0.5, fallback: str | None = None) -> DataFrame:
    """Power transform of skewed columns. Where it cannot be fitted it fails, unless ``fallback='log'`` asks for the log transform."""
    if fallback not in (None, "log"):
        raise ValueError(f"unknown fallback {fallback}")
    if columns is None:
        candidates = numeric_columns(df)
        skews = df.agg(*[adjusted_skewness(c).alias(c) for c in candidates]).first()
        columns = [c for c in candidates if skews[c] is not None and abs(skews[c]) > threshold]
    if not columns:
        return df
    try:
        exponents = fit_power(df, columns, method)
    except ValueError:
        if fallback is None or method not in ("yeo-johnson", "box-cox"):
            raise
        return log_transform(df, columns)
    return apply_power(df, exponents, method)


def handle_skew(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per-column remedy by skew: above 2 a standardised power transform, above 1 a root or
    log, above ``threshold`` a map to the normal distribution."""
    columns = numeric_columns(df)
    row = df.agg(*[F.struct(adjusted_skewness(c).alias("s"), F.min(c).cast("double").alias("m")).alias(c)
                   for c in columns]).first()
    size = {c: abs(row[c]["s"]) if row[c]["s"] is not None else 0.0 for c in columns}
    high = [c for c in columns if size[c] > 2 and size[c] > threshold]
    middle = [c for c in columns if 1 < size[c] <= 2 and size[c] > threshold]
    mild = [c for c in columns if threshold < size[c] <= 1]
    maps = fit_quantile_map(df, mild) if mild else None
    if high:
        df = apply_power(df, fit_power(df, high))
        df = fit_scaler(df, "standard", high).transform(df)
    df = df.withColumns({c: F.sqrt(F.col(c)) for c in middle if row[c]["m"] >= 0})
    logged = [c for c in middle if row[c]["m"] < 0]
    df = log_transform(df, logged) if logged else df
    return maps.transform(df, "normal") if maps else df


def normalize_by_groups(df: DataFrame, group: str, columns: list[str], method: str = "standard") -> DataFrame:
    """Scale within each group; a group without spread gets divisor 1.

    Group parameters are aggregated (combined map-side) and joined back, so no task has to
    hold a whole group.
    """
    if method == "standard":
        stats = df.groupBy(group).agg(*[x for c in columns for x in (
            F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    elif method == "minmax":
        stats = df.groupBy(group).agg(*[x for c in columns for x in (
            F.min(c).alias(f"_m_{c}"), (F.max(c) - F.min(c)).alias(f"_s_{c}"))])
    elif method == "robust":
        stats = None
        for c in columns:
            q = grouped_quantiles(df, [group], c, [0.25, 0.5, 0.75]).select(
                group, F.col("quantiles")[1].alias(f"_m_{c}"),
                (F.col("quantiles")[2] - F.col("quantiles")[0]).alias(f"_s_{c}"))
            stats = q if stats is None else stats.join(q, group)
    else:
        raise ValueError(f"unknown scaling method {method}")
    scaled = df.join(stats, group, "left").withColumns({
        c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        for c in columns})
    return scaled.select(*df.columns)
