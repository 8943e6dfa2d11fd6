"""Feature selection and reduction."""

from __future__ import annotations

import math

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from greenlattice.operators.quantiles import exact_quantiles
from greenlattice.operators.stats import _long, correlation


def regression_scores(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Univariate F statistic of each feature, from one correlation aggregate."""
    rows = df.dropna(subset=[target, *columns])
    base = _long(rows, columns, {"r": lambda c: correlation(c, target), "n": F.count})
    square = F.col("r") * F.col("r")
    return base.select("feature", F.try_divide(square * (F.col("n") - 2), 1 - square).alias("score"))


def binned_mutual_information(df: DataFrame, target: str, columns: list[str], bins: int = 10) -> DataFrame:
    """Mutual information (nats) of quantile-binned feature and target.

    All features are counted in one pass over (feature, feature bin, target bin); what
    follows runs on at most features * bins * bins rows.
    """
    rows = df.dropna(subset=[target, *columns])
    cuts = exact_quantiles(rows, {c: [i / bins for i in range(1, bins)] for c in (target, *columns)})

    def bin_of(c: str):
        edges = sorted(set(cuts[c]))
        slot = F.lit(0)
        for e in edges:
            slot = slot + (F.col(c) > F.lit(e)).cast("int")
        return slot

    tall = rows.select(bin_of(target).alias("ty"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), bin_of(c).alias("tx")) for c in columns])).alias("e"))
    joint = tall.groupBy("e.feature", "e.tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    left = joint.groupBy("feature", "tx").agg(F.sum("n").alias("nx"))
    right = joint.groupBy("feature", "ty").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    term = p * F.ln(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))
    return (joint.join(left, ["feature", "tx"]).join(right, ["feature", "ty"]).join(total, "feature")
            .groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("score")))


def select_features(df: DataFrame, target: str, columns: list[str], k: int = 10,
                    method: str = "f_regression") -> DataFrame:
    """The ``k`` best features with their score, best first."""
    if method == "f_regression":
        scores = regression_scores(df, target, columns)
    elif method == "mutual_info":
        scores = binned_mutual_information(df, target, columns)
    else:
        raise ValueError(f"unknown selection method {method}")
    return scores.orderBy(F.desc_nulls_last("score"), "feature").limit(k)


def apply_pca(df: DataFrame, columns: list[str], components: int | None = None,
              variance: float = 0.95) -> tuple[DataFrame, list[float]]:
    """Centred principal components PC1.. in place of ``columns`` and their variance shares.

    Without ``components`` the fewest components that reach ``variance`` are kept.
    """
    assembled = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="error").transform(df)
    centre = StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False).fit(assembled)
    centred = centre.transform(assembled)
    full = PCA(k=len(columns), inputCol="_c", outputCol="_p").fit(centred)
    shares = [float(v) for v in full.explainedVariance.toArray()]
    if components is None:
        running, components = 0.0, len(shares)
        for i, s in enumerate(shares):
            running += s
            if running >= variance:
                components = i + 1
                break
    projected = full.transform(centred).withColumn("_a", vector_to_array("_p"))
    others = [c for c in df.columns if c not in columns]
    out = projected.select(*others, *[F.col("_a")[i].alias(f"PC{i + 1}") for i in range(components)])
    return out, shares[:components]


def t_quantile(p: float, degrees: float) -> float:
    """Student t quantile by bisection on its distribution function (driver-side scalar)."""
    if p < 0.5:
        return -t_quantile(1 - p, degrees)

    def upper_tail(t: float) -> float:
        # Substituting t = sqrt(v) tan(a) makes the tail a smooth integral of cos(a)**(v-1).
        scale = math.exp(math.lgamma((degrees + 1) / 2) - math.lgamma(degrees / 2)) / math.sqrt(math.pi)
        # Beyond ``end`` the integrand is below 1e-20 (many degrees of freedom make it narrow).
        end = math.pi / 2 if degrees <= 41 else math.acos(10 ** (-20 / (degrees - 1)))
        start, steps = math.atan(t / math.sqrt(degrees)), 2000
        if start >= end:
            return 0.0
        h = (end - start) / steps
        f = lambda a: max(0.0, math.cos(a)) ** (degrees - 1)
        inner = sum((4 if i % 2 else 2) * f(start + i * h) for i in range(1, steps))
        return scale * h / 3 * (f(start) + inner + f(end))

    low, high = 0.0, 1.0
    while upper_tail(high) > 1 - p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if upper_tail(middle) > 1 - p:
            low = middle
        else:
            high = middle
    return (low + high) / 2
