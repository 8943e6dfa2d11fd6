"""Regressors and classifiers on Spark ML with a small registry."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (GBTRegressor, LinearRegression, RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession, functions as F

from greenlattice.operators import trees
from greenlattice.operators.features import polynomial_features, polynomial_terms
from greenlattice.operators.metrics import regression_metrics
from greenlattice.operators.quantiles import exact_quantiles

FOREST_ROWS = 20_000  # rows that one task of a forest takes at least
FOREST_TASKS = 64  # every task sends sums for all nodes of a level, so there are not many

Factory = Callable[[dict, dict], object]
MODELS: dict[str, Factory] = {}


def register_model(name: str) -> Callable[[Factory], Factory]:
    """Add a model kind: a function of (parameters, training facts) that returns an estimator."""
    def add(factory: Factory) -> Factory:
        MODELS[name] = factory
        return factory
    return add


def _forest_depth(params: dict) -> int:
    return min(30, params.get("max_depth") or 30)


@register_model("random_forest")
def _random_forest(params: dict, facts: dict):
    return RandomForestRegressor(
        featuresCol="features", labelCol="label", predictionCol="predicted",
        numTrees=params.get("n_estimators", 100), maxDepth=_forest_depth(params),
        featureSubsetStrategy=params.get("max_features", "sqrt"), seed=params.get("random_state", 42))


@register_model("gradient_boosting")
def _gradient_boosting(params: dict, facts: dict):
    estimator = GBTRegressor(
        featuresCol="features", labelCol="label", predictionCol="predicted",
        maxIter=params.get("n_estimators", 100), maxDepth=params.get("max_depth", 6),
        stepSize=params.get("learning_rate", 0.1), subsamplingRate=params.get("subsample", 1.0),
        seed=params.get("random_state", 42))
    if "colsample" in params:
        estimator = estimator.setFeatureSubsetStrategy(str(params["colsample"]))
    if params.get("validation_column"):
        estimator = estimator.setValidationIndicatorCol(params["validation_column"])
    return estimator


def _linear_estimator(reg: float, mix: float, fit_intercept: bool = True):
    return LinearRegression(featuresCol="features", labelCol="label", predictionCol="predicted",
                            regParam=reg, elasticNetParam=mix, standardization=False, solver="normal",
                            fitIntercept=fit_intercept)


@register_model("linear")
def _linear(params: dict, facts: dict):
    return _linear_estimator(0.0, 0.0, params.get("fit_intercept", True))


@register_model("ridge")
def _ridge(params: dict, facts: dict):
    # Spark scales its penalty by the label's deviation and averages the loss over rows.
    return _linear_estimator(params.get("alpha", 1.0) * facts["label_std"] / facts["rows"], 0.0)


@register_model("lasso")
def _lasso(params: dict, facts: dict):
    return _linear_estimator(params.get("alpha", 1.0), 1.0)


@register_model("elastic_net")
def _elastic_net(params: dict, facts: dict):
    alpha, l1 = params.get("alpha", 1.0), params.get("l1_ratio", 0.5)
    total = alpha * l1 + alpha * (1 - l1) * facts["label_std"]
    return _linear_estimator(total, alpha * l1 / total if total else 0.0)


@dataclass
class Model:
    """A fitted model: the Spark pipeline plus what is needed to reuse and explain it."""

    name: str
    kind: str
    features: list[str]
    target: str
    fitted: PipelineModel
    params: dict = field(default_factory=dict)
    train_metrics: dict = field(default_factory=dict)
    validation_metrics: dict = field(default_factory=dict)
    degree: int = 1

    @property
    def core(self):
        return self.fitted.stages[-1]

    def inputs(self) -> list[str]:
        return [n for n, _ in polynomial_terms(self.features, self.degree)] if self.degree > 1 else self.features

    def _prepared(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"missing features: {missing}")
        if self.degree == 1:
            return df
        kept = df
        for n, factors in polynomial_terms(self.features, self.degree):
            if len(factors) > 1:
                value = F.col(factors[0])
                for f in factors[1:]:
                    value = value * F.col(f)
                kept = kept.withColumn(n, value)
        return kept

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``predicted``; extra columns are kept, features are taken in training order."""
        added = [c for c in self.inputs() if c not in df.columns]
        return self.fitted.transform(self._prepared(df)).drop("features", *added)

    def evaluate(self, df: DataFrame) -> dict:
        scored = self.predict(df).select(F.col(self.target).alias("actual"), "predicted")
        return regression_metrics(scored, names=["mse", "rmse", "mae", "r2", "mape"]).first().asDict()

    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance), largest first; polynomial terms are summed into their base features."""
        core = self.core
        if hasattr(core, "featureImportances"):
            values = core.featureImportances.toArray()
        else:
            values = np.abs(core.coefficients.toArray())
        rows: dict[str, float] = {}
        for (name, factors), v in zip(polynomial_terms(self.features, self.degree), values):
            for base in dict.fromkeys(factors):
                rows[base] = rows.get(base, 0.0) + float(v)
        return spark.createDataFrame(list(rows.items()), "feature string, importance double").orderBy(
            F.desc("importance"), "feature")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The fitted trees as a table of nodes (``operators/trees.py``)."""
        return trees.node_table(self.core, self.inputs(), spark)

    def importance_by_kind(self, spark: SparkSession) -> DataFrame:
        """(feature, kind, score, share) by splits, gain and cover."""
        return trees.importance_by_kind(self.nodes(spark), self.inputs())

    def coefficients(self, spark: SparkSession) -> DataFrame:
        core = self.core
        rows = list(zip(self.inputs(), (float(v) for v in core.coefficients.toArray())))
        return spark.createDataFrame([*rows, ("intercept", float(core.intercept))], "feature string, coefficient double")

    def equation(self, digits: int = 3) -> str:
        """One line in training order, intercept last; what rounds to nothing is left out."""
        weighted = [*zip(self.core.coefficients.toArray(), self.inputs()), (self.core.intercept, None)]
        shown: list[str] = []
        for value, name in weighted:
            if abs(value) <= 10.0 ** -digits:
                continue
            number = f"{value:.{digits}f}" + (f" * {name}" if name else "")
            shown.append(f"+ {number}" if shown and value > 0 else number)
        return "y = " + " ".join(shown)

    def tree_statistics(self) -> dict:
        fitted = self.core.trees
        depths, nodes = [t.depth for t in fitted], [t.numNodes for t in fitted]
        leaves = [(n + 1) // 2 for n in nodes]
        return {"n_trees": len(fitted), "max_depth": max(depths), "avg_depth": float(np.mean(depths)),
                "total_nodes": int(sum(nodes)), "avg_nodes": float(np.mean(nodes)),
                "total_leaves": int(sum(leaves)), "avg_leaves": float(np.mean(leaves))}

    def info(self) -> dict:
        return {"name": self.name, "kind": self.kind, "features": self.features, "target": self.target,
                "params": self.params, "degree": self.degree, "train_metrics": self.train_metrics,
                "validation_metrics": self.validation_metrics}

    def save(self, path: str) -> None:
        self.fitted.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(self.info()),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Model":
        info = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        return cls(fitted=PipelineModel.load(f"{path}/pipeline"), **info)


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows of ``df`` over as many tasks as a forest has use for.

    A stored table of some MB is one file, which a single task would read for all trees and levels.
    Rows are dealt in turn, so rows that repeat don't meet in one task; their order is fixed, as it decides what a tree draws.
    """
    rows = df.select(*dict.fromkeys(columns))
    tasks = min(FOREST_TASKS, -(-rows.count() // FOREST_ROWS))
    return rows if tasks <= rows.rdd.getNumPartitions() else rows.repartition(tasks).sortWithinPartitions(*rows.columns)


def fit_model(df: DataFrame, features: list[str], target: str, kind: str, name: str | None = None,
              params: dict | None = None, degree: int = 1, validation: DataFrame | None = None,
              with_metrics: bool = True) -> Model:
    """Fit one registered kind; rows with a missing feature or target fail rather than vanish."""
    if kind not in MODELS:
        raise ValueError(f"unknown model kind {kind}")
    params = dict(params or {})
    rows = df.withColumn("label", F.col(target).cast("double"))
    facts = {}
    if kind in ("ridge", "elastic_net"):
        r = rows.agg(F.count("label"), F.stddev_pop("label")).first()
        facts = {"rows": r[0], "label_std": r[1]}
    inputs = [n for n, _ in polynomial_terms(features, degree)] if degree > 1 else features
    if degree > 1:
        extra = [c for c in ("label", target) if c not in features]
        rows = polynomial_features(rows.select(*features, *extra), features, degree)
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")
    fitted = Pipeline(stages=[assembler, MODELS[kind](params, facts)]).fit(rows)
    model = Model(name or kind, kind, features, target, fitted, params, degree=degree)
    if with_metrics:
        model.train_metrics = model.evaluate(df)
        if validation is not None:
            model.validation_metrics = model.evaluate(validation)
    return model


def load_models(spark: SparkSession, paths: list[str]) -> tuple[dict[str, Model], str | None]:
    """All saved models and the default one (the first)."""
    models = {}
    for path in paths:
        m = Model.load(spark, path)
        models[m.name] = m
    return models, next(iter(models), None)


def train_all(df: DataFrame, features: list[str], target: str, specs: dict[str, dict],
              validation: DataFrame | None = None) -> tuple[dict[str, Model], dict[str, str]]:
    """Fit every spec {name: {kind, params, degree}}; a failing one is reported and skipped."""
    done, failed = {}, {}
    for name, spec in specs.items():
        try:
            done[name] = fit_model(df, features, target, spec["kind"], name, spec.get("params"),
                                   spec.get("degree", 1), validation)
        except Exception as error:  # noqa: BLE001 - one bad spec must not stop the others
            failed[name] = f"{type(error).__name__}: {error}"
    return done, failed


def comparison_table(spark: SparkSession, models: dict[str, Model], test: DataFrame, baseline: str | None = None,
                     failed: dict[str, str] | None = None) -> DataFrame:
    """One row per model: train and test metrics, the gap between them, the gain over a baseline.

    A model that failed has a row with its error and no metrics.
    """
    rows = []
    for name, m in models.items():
        seen = m.evaluate(test)
        rows.append((name, m.train_metrics.get("r2"), seen["r2"], seen["rmse"], seen["mae"], seen["mse"], None))
    rows += [(name, *[None] * 5, error) for name, error in (failed or {}).items()]
    table = spark.createDataFrame(
        rows, "model string, train_r2 double, r2 double, rmse double, mae double, mse double, error string")
    table = table.withColumn("overfit_gap", F.col("train_r2") - F.col("r2"))
    if baseline:
        base = next((r[2] for r in rows if r[0] == baseline), None)
        table = table.withColumn("improvement", F.col("r2") - F.lit(base).cast("double"))
    return table.orderBy(F.desc_nulls_last("r2"), "model")


def best_model(table: DataFrame, metric: str = "r2") -> DataFrame:
    """One row with the best model: greatest r2 / accuracy, least error otherwise."""
    pick = F.max_by if metric in ("r2", "accuracy", "f1") else F.min_by
    return table.agg(pick("model", metric).alias("model"),
                     (F.max if metric in ("r2", "accuracy", "f1") else F.min)(metric).alias(metric))


def fit_classifier(df: DataFrame, features: list[str], target: str, params: dict | None = None) -> PipelineModel:
    params = params or {}
    rows = df.withColumn("label", F.col(target).cast("double"))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", predictionCol="predicted",
                                    numTrees=params.get("n_estimators", 100), maxDepth=params.get("max_depth", 12),
                                    seed=params.get("random_state", 42))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest]).fit(spread(rows, [*features, "label"]))


def predict_proba(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``predicted`` and ``probabilities`` (one share per class)."""
    return model.transform(df.withColumn("label", F.lit(0.0))).withColumn(
        "probabilities", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "label")


def tree_spread(model: Model, df: DataFrame) -> DataFrame:
    """Mean and deviation of the single trees' predictions of a forest per row."""
    out = model.fitted.stages[0].transform(df)
    names = []
    for i, tree in enumerate(model.core.trees):
        names.append(f"_t{i}")
        tree = tree.copy()  # the fitted forest keeps its own columns
        tree.setFeaturesCol("features")
        tree.setPredictionCol(names[-1])
        out = tree.transform(out)
    values = F.array(*names)
    n = F.lit(float(len(names)))
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    out = out.withColumn("_trees", values).withColumn("tree_mean", mean)
    spread = F.sqrt(F.aggregate(
        F.transform("_trees", lambda v: (v - F.col("tree_mean")) * (v - F.col("tree_mean"))),
        F.lit(0.0), lambda a, v: a + v) / n)
    return out.withColumn("tree_std", spread).drop("features", "_trees", *names)


def partial_dependence(model: Model, df: DataFrame, feature: str, resolution: int = 100) -> DataFrame:
    """Mean prediction at each grid value of a feature, over all rows.

    The grid is the distinct values where there are fewer than ``resolution``, else evenly
    spaced between the 5 % and 95 % quantiles. Trees take one pass over the rows, whatever the grid.
    """
    few = [r[0] for r in df.select(F.col(feature).cast("double")).where(F.col(feature).isNotNull())
           .distinct().limit(resolution + 1).collect()]  # at most resolution + 1 values
    if len(few) <= resolution:
        points = sorted(few)
    else:
        low, high = exact_quantiles(df, {feature: [0.05, 0.95]})[feature]
        points = [low + (high - low) * i / (resolution - 1) for i in range(resolution)]
    if hasattr(model.core, "trees") and model.degree == 1:
        fitted = trees.Trees.of(model.nodes(df.sparkSession), model.features)
        values = trees.partial_dependence(fitted, df, model.features, feature, points)
        return df.sparkSession.createDataFrame([(float(p), float(v)) for p, v in zip(points, values)], "grid_value double, average double")
    # Rows that agree in the other features predict alike: score them once, weighted.
    others = [c for c in model.features if c != feature]
    packed = df.groupBy(*others).agg(F.count(F.lit(1)).alias("_w"))
    spread = packed.withColumn(feature, F.explode(F.array(*[F.lit(float(p)) for p in points])))
    scored = model.predict(spread)
    return scored.groupBy(F.col(feature).alias("grid_value")).agg(
        (F.sum(F.col("predicted") * F.col("_w")) / F.sum("_w")).alias("average"))


def boosting_history(model: Model, df: DataFrame, metric: str = "squared") -> list[float]:
    """Loss after each boosting iteration on ``df``."""
    rows = model.fitted.stages[0].transform(df.withColumn("label", F.col(model.target).cast("double")))
    return [float(v) for v in model.core.evaluateEachIteration(rows, metric)]


def complexity(model: Model) -> dict:
    core = model.core
    if hasattr(core, "trees"):
        return {"kind": model.kind, "features": len(model.features), **model.tree_statistics()}
    values = core.coefficients.toArray()
    return {"kind": model.kind, "features": len(model.features), "coefficients": int(values.size),
            "nonzero": int(np.count_nonzero(values))}


# ---------------------------------------------------------------- regularisation path

def gram_matrix(df: DataFrame, features: list[str], target: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and centred cross-products of (features, target) in one aggregate."""
    columns = [*features, target]
    size = len(columns)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    row = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns],
                 *[F.covar_pop(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")) for i, j in pairs]).first()
    n, means = row[0], np.array([float(v) for v in row[1:1 + size]])
    cross = np.zeros((size, size))
    for (i, j), v in zip(pairs, row[1 + size:]):
        cross[i, j] = cross[j, i] = float(v) * n
    return n, means, cross


def regularization_path(spark: SparkSession, df: DataFrame, features: list[str], target: str, kind: str = "ridge",
                        alphas: list[float] | None = None, l1_ratio: float = 0.5) -> DataFrame:
    """(alpha, feature, coefficient, r2) for ridge, lasso or elastic net.

    One pass builds the cross-products; every alpha is then solved on that small matrix.
    """
    if kind not in ("ridge", "lasso", "elastic_net"):
        raise ValueError("a path needs a regularised model")
    alphas = alphas or [10 ** (-4 + 6 * i / 49) for i in range(50)]
    n, _, cross = gram_matrix(df, features, target)
    xx, xy, yy = cross[:-1, :-1], cross[:-1, -1], cross[-1, -1]
    rows = []
    beta = np.zeros(len(features))
    for alpha in sorted(alphas, reverse=True):
        if kind == "ridge":
            beta = np.linalg.solve(xx + alpha * np.eye(len(features)), xy)
        else:
            l1 = alpha * n * (1.0 if kind == "lasso" else l1_ratio)
            l2 = 0.0 if kind == "lasso" else alpha * n * (1 - l1_ratio)
            for _ in range(10_000):
                before = beta.copy()
                for j in range(len(features)):
                    if xx[j, j] == 0:
                        continue
                    rho = xy[j] - xx[j] @ beta + xx[j, j] * beta[j]
                    beta[j] = np.sign(rho) * max(abs(rho) - l1, 0.0) / (xx[j, j] + l2)
                if np.max(np.abs(beta - before)) < 1e-12:
                    break
        r2 = 1 - (yy - 2 * beta @ xy + beta @ xx @ beta) / yy if yy else 0.0
        rows += [(float(alpha), f, float(b), float(r2)) for f, b in zip(features, beta)]
    return spark.createDataFrame(rows, "alpha double, feature string, coefficient double, r2 double")
