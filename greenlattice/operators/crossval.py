"""Cross-validation, model comparison by folds and learning curves.

Linear kinds are fitted from sums per fold (``operators/moments.py``): one aggregate for all folds,
models and training sizes, a second one for absolute errors where they are asked for. Other
kinds are fitted fold by fold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from greenlattice.functions.numeric import SCATTER_OTHER, scatter_key
from greenlattice.operators import models, moments
from greenlattice.operators.features import polynomial_features, polynomial_terms
from greenlattice.operators.metrics import binary_auc, classification_report
from greenlattice.operators.quantiles import exact_quantiles
from greenlattice.operators.splits import kfold, stratified_kfold, time_series_block
from greenlattice.session import materialize

SCORES = ["r2", "mse", "mae"]
#: Scorers to choose from; errors also negated, so that greater is better.
SCORERS = ["r2", "mse", "rmse", "mae", "neg_mse", "neg_rmse", "neg_mae"]


def _mean(xs: list[float | None]) -> float | None:
    """Mean of the scores that are defined."""
    known = [x for x in xs if x is not None]
    return sum(known) / len(known) if known else None


def _std(xs: list[float | None]) -> float | None:
    known = [x for x in xs if x is not None]
    return math.sqrt(sum((x - _mean(known)) ** 2 for x in known) / len(known)) if known else None


def _chosen(metrics: dict, scorers: list[str]) -> list[float | None]:
    def one(name: str) -> float | None:
        value = metrics[name.removeprefix("neg_")]
        return -value if name.startswith("neg_") and value is not None else value
    return [one(name) for name in scorers]


class _Folds:
    """Rows with the number of their part, and the parts that each fold trains and tests on."""

    def __init__(self, df: DataFrame, row_id: str, k: int, cv_type: str, time: str | None) -> None:
        if cv_type == "kfold":
            self.rows, self.part = kfold(df, row_id, k), "fold"
            self.sets = [([j for j in range(k) if j != i], [i]) for i in range(k)]
        elif cv_type == "timeseries":
            self.rows, self.part = time_series_block(df, time or row_id, row_id, k), "block"
            self.sets = [(list(range(i + 1)), [i + 1]) for i in range(k)]
        else:
            raise ValueError(f"unsupported cross-validation {cv_type}")

    def __iter__(self) -> Iterator[tuple[int, DataFrame, DataFrame]]:
        for i, (train, test) in enumerate(self.sets):
            yield i, self.rows.where(F.col(self.part).isin(train)), self.rows.where(F.col(self.part).isin(test))


def _stored(df: DataFrame, features: list[str], target: str, row_id: str, time: str | None = None) -> DataFrame:
    """What folds and models read, written once."""
    return materialize(df.select(*dict.fromkeys([row_id, *([time] if time else []), *features, target])))


def _fold_scores_from_sums(folds: _Folds, features: list[str], target: str, specs: dict[str, dict], degree: int,
                           scorers: list[str]) -> list[tuple]:
    """(model, fold, part, scores): all models and folds from one aggregate; absolute errors take one more."""
    rows, part = folds.rows, folds.part
    columns = features
    if degree > 1:
        columns = [n for n, _ in polynomial_terms(features, degree)]
        rows = polynomial_features(rows.select(*dict.fromkeys([part, *features, target])), features, degree)
    sums = {key[0]: m for key, m in moments.moments_by(rows, [*columns, target], [part]).items()}
    size = len(columns) + 1

    def of(parts: list[int]) -> moments.Moments:
        return moments.merged([sums[p] for p in parts if p in sums], size)

    fits = [(name, i, moments.fit(of(train), spec["kind"], spec.get("params"))) for name, spec in specs.items()
            for i, (train, _) in enumerate(folds.sets)]
    absolute: dict[int, list[float]] = {}
    if any(s.endswith("mae") for s in scorers):
        wrong = [F.sum(F.abs(F.col(target) - moments.predicted(columns, *model))).alias(f"_e{m}") for m, (_, _, model) in enumerate(fits)]
        absolute = {r[part]: list(r[1:]) for r in rows.groupBy(part).agg(*wrong).collect()}  # a row per part
    out = []
    for m, (name, i, model) in enumerate(fits):
        for label, parts in zip(("train", "test"), folds.sets[i]):
            seen = of(parts)
            metrics = moments.scores(seen, *model)
            metrics["mae"] = sum(absolute[p][m] for p in parts if p in absolute) / seen.n if absolute and seen.n else None
            out.append((name, i, label, *_chosen(metrics, scorers)))
    return out


def _fold_scores(folds: _Folds, features: list[str], target: str, specs: dict[str, dict], scorers: list[str]) -> list[tuple]:
    """(model, fold, part, scores) of every spec {name: {kind, params, degree}}."""
    unknown = [s for s in scorers if s not in SCORERS]
    if unknown:
        raise ValueError(f"unknown scorers {unknown}")
    out = []
    linear: dict[int, dict[str, dict]] = {}
    for name, spec in specs.items():
        if spec["kind"] in moments.KINDS:
            linear.setdefault(spec.get("degree", 1), {})[name] = spec
            continue
        for i, train, test in folds:
            model = models.fit_model(train, features, target, spec["kind"], params=spec.get("params"), degree=spec.get("degree", 1), with_metrics=False)
            for part, data in (("train", train), ("test", test)):
                out.append((name, i, part, *_chosen(model.evaluate(data), scorers)))
    for degree, some in linear.items():
        out += _fold_scores_from_sums(folds, features, target, some, degree, scorers)
    return out


def regression_cv(df: DataFrame, features: list[str], target: str, row_id: str, kind: str, params: dict | None = None,
                  k: int = 5, cv_type: str = "kfold", time: str | None = None, degree: int = 1,
                  scorers: list[str] | None = None) -> DataFrame:
    """(fold, part, scores) with one row per fold and part; r2, mse and mae unless ``scorers`` are named."""
    scorers = scorers or SCORES
    folds = _Folds(_stored(df, features, target, row_id, time), row_id, k, cv_type, time)
    rows = _fold_scores(folds, features, target, {kind: {"kind": kind, "params": params, "degree": degree}}, scorers)
    return df.sparkSession.createDataFrame([r[1:] for r in rows], ", ".join(["fold int, part string", *[f"{s} double" for s in scorers]]))


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of each score over the folds."""
    return scores.groupBy("part").agg(*[x for s in SCORERS if s in scores.columns for x in (
        F.avg(s).alias(f"{s}_mean"), F.stddev_pop(s).alias(f"{s}_std"))])


def classification_cv(df: DataFrame, features: list[str], target: str, row_id: str, k: int = 5,
                      params: dict | None = None) -> DataFrame:
    """Stratified folds: accuracy, weighted precision / recall / F1 and, for two classes, AUC."""
    parts = materialize(stratified_kfold(df, row_id, target, k))
    classes = parts.select(target).distinct().count()
    rows = []
    for i in range(k):
        model = models.fit_classifier(parts.where(F.col("fold") != i), features, target, params)
        scored = models.predict_proba(model, models.spread(parts.where(F.col("fold") == i), [*features, target]))
        scored = materialize(scored.select(F.col(target).cast("int").alias("actual"), F.col("predicted").cast("int").alias("predicted"),
                                           F.element_at("probabilities", 2).alias("score")))  # read by each pass of the ranks
        report = {r["class"]: r for r in classification_report(scored, "actual", "predicted").collect()}  # one row per class
        w = report["weighted avg"]
        auc = binary_auc(scored, "actual", "score").first()[0] if classes == 2 else None
        rows.append((i, report["accuracy"]["precision"], w["precision"], w["recall"], w["f1"], auc))
    return df.sparkSession.createDataFrame(
        rows, "fold int, accuracy double, precision double, recall double, f1 double, roc_auc double")


def compare_by_cv(df: DataFrame, features: list[str], target: str, row_id: str, specs: dict[str, dict],
                  k: int = 5) -> DataFrame:
    """One row per model with its fold means, best test r2 first."""
    folds = _Folds(_stored(df, features, target, row_id), row_id, k, "kfold", None)
    scores = _fold_scores(folds, features, target, specs, SCORES)
    rows = []
    for name in specs:
        test, train = (np.array([r[3:] for r in scores if r[0] == name and r[2] == part], dtype=float) for part in ("test", "train"))
        r2, mse, mae = (float(v) for v in test.mean(axis=0))
        rows.append((name, r2, float(test[:, 0].std()), float(train[:, 0].mean()), mse, mae))
    return df.sparkSession.createDataFrame(
        rows, "model string, r2_mean double, r2_std double, train_r2_mean double, mse_mean double, mae_mean double"
    ).orderBy(F.desc("r2_mean"), "model")


def learning_curve(df: DataFrame, features: list[str], target: str, row_id: str, kind: str, params: dict | None = None,
                   sizes: list[float] | None = None, k: int = 5) -> DataFrame:
    """(size, train/validation r2 mean and deviation): each size is a prefix of
    a scatter order unrelated to the one the folds are cut from.

    Linear kinds take one aggregate by fold and size step, whatever the number of folds and sizes.
    """
    sizes = sorted(sizes or [i / 10 for i in range(1, 11)])
    stored = _stored(df, features, target, row_id)
    parts = kfold(stored, row_id, k).withColumn("_key", scatter_key(F.col(row_id), SCATTER_OTHER).cast("double"))
    cuts = exact_quantiles(parts, {"_key": sizes})["_key"]
    if kind in moments.KINDS:
        step = sum((F.col("_key") > F.lit(c)).cast("int") for c in cuts)  # rows beyond the last size only validate
        sums = moments.moments_by(parts.withColumn("_step", step), [*features, target], ["fold", "_step"])

    def of(fold_wanted, last: int) -> moments.Moments:
        return moments.merged([m for (fold, at), m in sorted(sums.items()) if fold_wanted(fold) and at <= last], len(features) + 1)

    rows = []
    for at, (size, cut) in enumerate(zip(sizes, cuts)):
        seen, held = [], []
        for i in range(k):
            if kind in moments.KINDS:
                train = of(lambda fold: fold != i, at)  # noqa: B023 - used at once
                model = moments.fit(train, kind, params)
                seen.append(moments.scores(train, *model)["r2"])
                held.append(moments.scores(of(lambda fold: fold == i, len(cuts)), *model)["r2"])  # noqa: B023
                continue
            train = parts.where((F.col("fold") != i) & (F.col("_key") <= F.lit(cut)))
            fitted = models.fit_model(train, features, target, kind, params=params, with_metrics=False)
            seen.append(fitted.evaluate(train)["r2"])
            held.append(fitted.evaluate(parts.where(F.col("fold") == i))["r2"])
        rows.append((size, _mean(seen), _std(seen), _mean(held), _std(held)))
    return df.sparkSession.createDataFrame(
        rows, "size double, train_mean double, train_std double, validation_mean double, validation_std double")
