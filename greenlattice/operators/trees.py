"""Fitted trees as a table of nodes: importance by kind and partial dependence without copies of rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from greenlattice.session import stage_path

KINDS = ("weight", "gain", "cover", "total_gain", "total_cover")


def node_table(core, features: list[str], spark: SparkSession) -> DataFrame:
    """(tree, tree_weight, node, feature, threshold, gain, cover, left, right, value) of every node of a fitted forest or boosting.

    It is read from the model's own stored form. ``cover`` counts the training rows (with their
    weights) of a node; ``gain`` of a split is the loss that it takes off, summed over those rows. Leaves have no
    feature. Weights are those by which trees add up to the prediction.
    """
    path = stage_path(spark)
    core.write().save(path)
    n = F.col("nodeData")
    stored = spark.read.parquet(f"{path}/data")
    if not stored.where(n.split.numCategories >= 0).isEmpty():
        raise ValueError("splits by categories have no threshold")
    inner = n.leftChild >= 0
    cover = n.impurityStats[0]
    weights = F.array(*[F.lit(float(w)) for w in tree_weights(core)])
    names = F.array(*[F.lit(f) for f in features])
    return stored.select(
        F.col("treeID").alias("tree"), weights[F.col("treeID")].alias("tree_weight"), n.id.alias("node"),
        F.when(inner, names[n.split.featureIndex]).alias("feature"), F.when(inner, n.split.leftCategoriesOrThreshold[0]).alias("threshold"),
        F.when(inner, n.gain * cover).alias("gain"), cover.alias("cover"),
        F.when(inner, n.leftChild).alias("left"), F.when(inner, n.rightChild).alias("right"), n.prediction.alias("value"))


def tree_weights(core) -> list[float]:
    """What each tree's prediction counts: an equal share in a forest, its own weight in boosting."""
    if type(core).__name__.startswith("GBT"):
        return list(core.treeWeights)
    return [1.0 / core.getNumTrees] * core.getNumTrees


def importance_by_kind(nodes: DataFrame, features: list[str]) -> DataFrame:
    """(feature, kind, score, share): splits counted (weight), loss taken off and rows split, per split (gain, cover) and in total.

    Features without a split have 0; the shares of a kind add up to 1 if any tree splits.
    """
    splits = nodes.where(F.col("feature").isNotNull()).groupBy("feature").agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.avg("gain").alias("gain"), F.avg("cover").alias("cover"),
        F.sum("gain").alias("total_gain"), F.sum("cover").alias("total_cover"))
    every = nodes.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    wide = every.join(splits, "feature", "left")
    long = wide.select("feature", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.coalesce(k, F.lit(0.0)).alias("score")) for k in KINDS])).alias("s")).select("feature", "s.*")
    total = long.groupBy("kind").agg(F.sum("score").alias("_all"))
    return long.join(total, "kind").select("feature", "kind", "score", F.coalesce(F.try_divide("score", "_all"), F.lit(0.0)).alias("share"))


@dataclass
class Trees:
    """All nodes of a model as arrays, numbered through; a model fits the driver that fitted it."""

    root: np.ndarray
    feature: np.ndarray  # number of the feature, -1 at leaves
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray  # times the tree's weight

    @staticmethod
    def of(nodes: DataFrame, features: list[str]) -> Trees:
        t = nodes.orderBy("tree", "node").toArrow()
        c = {name: t.column(name).to_numpy(zero_copy_only=False) for name in ("tree", "tree_weight", "node", "threshold", "left", "right", "cover", "value")}
        starts = np.flatnonzero(np.diff(c["tree"], prepend=-1))
        first = starts[np.searchsorted(starts, np.arange(len(c["tree"])), "right") - 1]
        if (c["node"] != np.arange(len(first)) - first).any():
            raise ValueError("nodes of a tree are not numbered through")
        number = {f: i for i, f in enumerate(features)}
        feature = np.array([number.get(f, -1) for f in t.column("feature").to_pylist()], np.int64)
        child = [np.where(feature >= 0, np.nan_to_num(c[side]) + first, -1).astype(np.int64) for side in ("left", "right")]
        return Trees(starts, feature, c["threshold"], child[0], child[1], c["cover"], c["value"] * c["tree_weight"])

    def reached(self, rows: np.ndarray, free: int) -> np.ndarray:
        """How many rows get to each node if splits on feature ``free`` let them go both ways."""
        out = np.zeros(len(self.feature), np.int64)
        for root in self.root:
            node, row = np.full(len(rows), root), np.arange(len(rows))
            while len(node):
                out += np.bincount(node, minlength=len(out))
                inner = self.feature[node] >= 0
                node, row = node[inner], row[inner]
                both = self.feature[node] == free
                low = rows[row, self.feature[node]] <= self.threshold[node]
                to_left, to_right = both | low, both | ~low
                node, row = np.concatenate([self.left[node[to_left]], self.right[node[to_right]]]), np.concatenate([row[to_left], row[to_right]])
        return out

    def average(self, reached: np.ndarray, rows: float, free: int, grid: np.ndarray) -> np.ndarray:
        """Mean prediction at each value of the sorted ``grid``: leaves count by the rows that reach them, over their range of the feature."""
        low, high = np.full(len(self.feature), -np.inf), np.full(len(self.feature), np.inf)
        level = self.root
        while len(level):  # ranges from the roots down
            inner = level[self.feature[level] >= 0]
            for side in (self.left, self.right):
                low[side[inner]], high[side[inner]] = low[inner], high[inner]
            own = inner[self.feature[inner] == free]
            high[self.left[own]] = np.minimum(high[own], self.threshold[own])
            low[self.right[own]] = np.maximum(low[own], self.threshold[own])
            level = np.concatenate([self.left[inner], self.right[inner]])
        leaf = np.flatnonzero((self.feature < 0) & (low < high))
        adds = self.value[leaf] * reached[leaf] / rows
        steps = np.zeros(len(grid) + 1)
        np.add.at(steps, np.searchsorted(grid, low[leaf], "right"), adds)
        np.add.at(steps, np.searchsorted(grid, high[leaf], "right"), -adds)
        return steps.cumsum()[:-1]

    def by_cover(self, free: int) -> np.ndarray:
        """As ``reached`` from the covers of training alone: a free split passes all rows on, another one by its children's covers."""
        share = np.zeros(len(self.feature))
        share[self.root] = 1.0
        level = self.root
        while len(level):
            inner = level[self.feature[level] >= 0]
            both = self.feature[inner] == free
            for side in (self.left, self.right):
                part = self.cover[side[inner]] / self.cover[inner]
                share[side[inner]] = share[inner] * np.where(both, 1.0, part)
            level = np.concatenate([self.left[inner], self.right[inner]])
        return share


def partial_dependence(trees: Trees, df: DataFrame | None, features: list[str], feature: str, grid: list[float]) -> list[float]:
    """Mean prediction at each grid value over the rows of ``df``, in one pass over them whatever the grid.

    The rows go down the trees once, both ways at splits on ``feature``; tasks return counts per node.
    Without rows the covers of training stand in for them (exact if features do not depend on each other).
    """
    free, points = features.index(feature), np.unique(np.array(grid, float))
    if df is None:
        values = trees.average(trees.by_cover(free), 1.0, free, points)
    else:
        others = [f for f in features if f != feature]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(len(trees.feature), np.int64), 0
            for batch in batches:
                rows = np.zeros((batch.num_rows, len(features)))
                for f in others:
                    rows[:, features.index(f)] = batch.column(f).to_numpy(zero_copy_only=False)
                if np.isnan(rows).any():
                    raise ValueError("missing values in features")
                total += trees.reached(rows, free)
                n += batch.num_rows
            if n:
                met = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), pa.array(np.append(total[met], n))], names=["node", "n"])

        wanted = df.select(*[F.col(f).cast("double").alias(f) for f in others]) if others else df.select(F.lit(0.0).alias("_none"))
        met = wanted.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toArrow()  # nodes of the model
        counts = dict(zip(met.column("node").to_pylist(), met.column("n").to_pylist()))
        rows = counts.pop(-1, 0)
        if not rows:
            return [float("nan")] * len(grid)
        reached = np.zeros(len(trees.feature))
        reached[list(counts)] = list(counts.values())
        values = trees.average(reached, rows, free, points)
    at = dict(zip(points.tolist(), values.tolist()))
    return [at[float(v)] for v in grid]
