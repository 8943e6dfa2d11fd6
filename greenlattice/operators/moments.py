"""Linear models from mergeable sums: one aggregate serves any number of training sets.

A set of rows enters a linear model only through its row count, means and centred
cross-products. These merge, so the sums of disjoint groups (folds, size steps) are taken once,
and each training or test set is the merge of its groups. Groups are few: a collected row each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Model kinds that the sums determine.
KINDS = ("linear", "ridge", "lasso", "elastic_net")
ROUNDS, ENOUGH = 10_000, 1e-12


@dataclass(frozen=True)
class Moments:
    """Row count, means and centred cross-products; the last column is the target."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if other.n else self
        n, gap = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n))

    @staticmethod
    def none(columns: int) -> Moments:
        return Moments(0, np.zeros(columns), np.zeros((columns, columns)))


def merged(parts: list[Moments], columns: int) -> Moments:
    return reduce(Moments.__add__, parts, Moments.none(columns))


def moments_by(df: DataFrame, columns: list[str], by: list[str]) -> dict[tuple, Moments]:
    """The sums of ``columns`` for each group, in one aggregate; a missing value fails rather than vanishes."""
    size = len(columns)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    x = [F.col(c).cast("double") for c in columns]
    rows = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_c{i}") for i, c in enumerate(x)], *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(x)],
        *[F.covar_pop(x[i], x[j]).alias(f"_s{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        lacking = [c for i, c in enumerate(columns) if r[f"_c{i}"] < r["_n"]]
        if lacking:
            raise ValueError(f"missing values in {lacking}")
        cross = np.zeros((size, size))
        for i, j in pairs:
            cross[i, j] = cross[j, i] = r[f"_s{i}_{j}"] * r["_n"]
        out[tuple(r[c] for c in by)] = Moments(r["_n"], np.array([r[f"_m{i}"] for i in range(size)]), cross)
    return out


def shrunk(xx: np.ndarray, xy: np.ndarray, l1: float, l2: float, start: np.ndarray | None = None) -> np.ndarray:
    """Coefficients of least squares with penalties ``l1`` and ``l2`` on summed errors, by coordinate descent."""
    beta = np.zeros(len(xy)) if start is None else start.copy()
    for _ in range(ROUNDS):
        before = beta.copy()
        for j in np.flatnonzero(np.diag(xx)):
            rho = xy[j] - xx[j] @ beta + xx[j, j] * beta[j]
            beta[j] = np.sign(rho) * max(abs(rho) - l1, 0.0) / (xx[j, j] + l2)
        if np.max(np.abs(beta - before), initial=0.0) < ENOUGH:
            break
    return beta


def fit(m: Moments, kind: str = "linear", params: dict | None = None) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of one kind on the rows that ``m`` sums."""
    params = params or {}
    if kind not in KINDS:
        raise ValueError(f"{kind} is not a function of sums")
    if not m.n:
        raise ValueError("no rows to fit")
    cross = m.cross
    centred = kind != "linear" or params.get("fit_intercept", True)
    if not centred:
        cross = cross + m.n * np.outer(m.mean, m.mean)
    xx, xy = cross[:-1, :-1], cross[:-1, -1]
    alpha = params.get("alpha", 1.0)
    if kind == "linear":  # scaled, so that columns of any unit count alike; least norm where columns depend on each other
        scale = np.sqrt(np.diag(xx))
        scale[scale == 0] = 1.0
        beta = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=1e-13)[0] / scale
    elif kind == "ridge":
        beta = np.linalg.lstsq(xx + alpha * np.eye(len(xy)), xy, rcond=None)[0]
    else:
        share = params.get("l1_ratio", 0.5) if kind == "elastic_net" else 1.0
        beta = shrunk(xx, xy, alpha * share * m.n, alpha * (1 - share) * m.n)
    return beta, float(m.mean[-1] - beta @ m.mean[:-1]) if centred else 0.0


def squared_error(m: Moments, beta: np.ndarray, intercept: float) -> float:
    """Sum of squared errors of a model over the rows that ``m`` sums."""
    off = m.mean[-1] - intercept - beta @ m.mean[:-1]
    inside = m.cross[-1, -1] - 2 * beta @ m.cross[:-1, -1] + beta @ m.cross[:-1, :-1] @ beta
    return max(0.0, float(inside)) + m.n * float(off) ** 2


def scores(m: Moments, beta: np.ndarray, intercept: float) -> dict[str, float | None]:
    """r2, mse and rmse over the rows that ``m`` sums; r2 is null where the target does not vary."""
    if not m.n:
        return {"r2": None, "mse": None, "rmse": None}
    wrong, total = squared_error(m, beta, intercept), float(m.cross[-1, -1])
    return {"r2": 1 - wrong / total if total else None, "mse": wrong / m.n, "rmse": (wrong / m.n) ** 0.5}


def predicted(columns: list[str], beta: np.ndarray, intercept: float) -> Column:
    """The model as a column."""
    return reduce(lambda s, cb: s + F.col(cb[0]).cast("double") * F.lit(float(cb[1])), zip(columns, beta), F.lit(float(intercept)))
