"""Hard negatives by inner product: cover trees over norm-augmented rows, searched best first.

Rows are (vec_id, label, vector of integers). An anchor's positives are the rows of its own label
with the highest inner products; for each, the negatives are the highest rows of another label
whose product lies in a window below that of the positive.

* One more coordinate gives every row the same norm M (the greatest of all), so rows lie on a
  sphere, and the inner product with a query falls with the angle between them.
* A small tree over a bounded sample (``SAMPLE`` rows) only deals out rows: each goes to the
  cell of its nearest leaf. Neighbouring cells form shards of about ``SHARD_ROWS`` rows; a cell
  that holds more, such as copies of one vector, is sliced. Every row is in one shard.
* Each shard is a cover tree. The children of a node are farthest-first centres that cover it
  within half its radius (``FAN`` of them at most, the radius is then what they reach), so
  covering radii shrink level by level. A node's centre and radius bound the product of a
  query with all rows under it, from both sides.
* Anchors come in blocks. A block meets the shards whose root bounds touch one of its windows.
  There each anchor descends best first: the node with the highest bound is opened next,
  nodes outside all windows that still want rows are skipped, rows of leaves are verified by
  exact products. Few rows per window, anchor and shard leave the task, and a ranking keeps the first.

Results are exact: bounds have a slack above rounding, products are whole numbers (beyond 2^53 as
Python's; a score that 64 bits cannot hold stays at their end).

Nulls: rows without id, label or vector, or with a missing component, take no part. Vectors of
unequal length count as zero where they end. Of repeated rows, and of rows that share an id,
the one with the smallest (label, vector) takes part. Equal scores are ordered by id. An empty table
gives an empty result. Only the three columns are read, so others may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from greenlattice.llm.common import keep, query, small, table

SAMPLE = 2048  # rows that the dealing tree is fitted on
SAMPLE_LEAF = 16
SHARD_ROWS = 2048
BLOCK = 1024  # anchors of a block
LEAF = 256
FAN = 16
ROOTS = 4096  # shards whose roots a task looks at together
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100  # percent of the positive's score
SLACK = 1e-6
LEAST, MOST = -(2**63), 2**63 - 1


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of ``dims`` integers, zero where they end."""
    ends = np.cumsum(np.fromiter((len(v) for v in lists), np.int64, len(lists)))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(lists) * dims:
        return flat.reshape(len(lists), dims)
    out = np.zeros((len(lists), dims), np.int64)
    for i, end in enumerate(ends):
        own = flat[ends[i - 1] if i else 0:end]
        out[i, :len(own)] = own
    return out


def raised(rows: np.ndarray, norm: float) -> np.ndarray:
    """Rows on the sphere of radius ``norm``, by one more coordinate."""
    x = rows.astype(np.float64)
    rest = np.sqrt(np.maximum(0.0, norm * norm - np.einsum("ij,ij->i", x, x)))
    return np.concatenate([x, rest[:, None]], axis=1)


def inner(rows: np.ndarray, one: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as 64-bit integers; ``exact`` says that doubles hold them."""
    if exact:
        return (rows @ one).astype(np.int64)
    wide = rows.astype(np.int64).astype(object) @ one.astype(np.int64).astype(object)
    return np.array([min(MOST, max(LEAST, v)) for v in wide], np.int64)


class Tree:
    """A cover tree: per node its centre (a row), covering radius, rows [begin, end) and children [first, first + kids)."""

    def __init__(self, points: np.ndarray, norm: float, leaf: int = LEAF) -> None:
        n = len(points)
        mean = points.mean(axis=0) if n else points.sum(axis=0)
        self.order = np.arange(n)
        root = int((points @ mean).argmax()) if n else 0
        away = self.away(points, points[root]) if n else np.zeros(0)
        self.centre, self.radius = [root], [float(away.max(initial=0.0))]
        self.begin, self.end, self.first, self.kids = [0], [n], [0], [0]
        node = 0
        while node < len(self.centre):  # level by level
            b, e = self.begin[node], self.end[node]
            if e - b > leaf and self.radius[node] > SLACK * norm:
                self.split(points, node, self.order[b:e].copy())
            node += 1

    @staticmethod
    def away(points: np.ndarray, one: np.ndarray) -> np.ndarray:
        gap = points - one
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def split(self, points: np.ndarray, node: int, rows: np.ndarray) -> None:
        own = points[rows]
        centres = [self.centre[node]]  # a node's centre is one of the next level's
        best = self.away(own, points[centres[0]])
        nearest = np.zeros(len(rows), np.int64)
        while len(centres) < FAN and best.max() > self.radius[node] / 2:
            far = int(best.argmax())
            d = self.away(own, own[far])
            closer = d < best
            nearest[closer], best[closer] = len(centres), d[closer]
            centres.append(int(rows[far]))
        if len(centres) == 1:  # all within half: the same centre, a smaller radius
            self.radius[node] = float(best.max())
            return self.split(points, node, rows) if self.radius[node] > 0 else None
        self.first[node] = len(self.centre)
        at = self.begin[node]
        for k, centre in enumerate(centres):
            under = np.flatnonzero(nearest == k)
            if len(under):
                self.order[at:at + len(under)] = rows[under]
                self.centre.append(centre)
                self.radius.append(float(best[under].max()))
                self.begin.append(at)
                at += len(under)
                self.end.append(at)
                self.first.append(0)
                self.kids.append(0)
                self.kids[node] += 1
        return None


def bounds(toward: np.ndarray, size: float, norm: float, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of a query of length ``size`` with rows within ``radius`` of centres that it has ``toward``."""
    top = size * norm
    if top == 0:
        return np.zeros_like(toward), np.zeros_like(toward)
    angle = np.arccos(np.clip(toward / top, -1, 1))
    spread = 2 * np.arcsin(np.clip(radius / (2 * norm), 0, 1)) + SLACK
    slack = SLACK * top + 1e-3
    low, high = top * np.cos(np.minimum(np.pi, angle + spread)) - slack, top * np.cos(np.maximum(0, angle - spread)) + slack
    return np.clip(low, LEAST, MOST), np.clip(high, LEAST, MOST)  # as scores are


class Shard:
    """A stored tree with its rows in leaf order, ready to be searched."""

    def __init__(self, row: dict, dims: int, norm: float, exact: bool) -> None:
        self.ids, self.labels = row["ids"], row["labels"]
        self.rows = row["vectors"].reshape(len(self.ids), dims)
        self.rows = self.rows.astype(np.float64) if exact else self.rows
        self.begin, self.end, self.first, self.kids, self.radius = (row[c] for c in ("begin", "end", "first", "kids", "radius"))
        self.centres = self.rows[row["centre"]].astype(np.float64)
        self.norm, self.exact = norm, exact

    def search(self, q: np.ndarray, vec_id: int, label: int, same: bool, lows: np.ndarray, highs: np.ndarray, most: int) -> list[tuple[int, int, int]]:
        """(window, score, id) of the first ``most`` rows of each window [low, high], with the label or with another."""
        wide = q.astype(np.float64)
        low, high = bounds(self.centres @ wide, float(np.sqrt(wide @ wide)), self.norm, self.radius)
        q = wide if self.exact else q
        best: list[list[tuple[int, int]]] = [[] for _ in lows]
        least = [int(x) for x in lows]  # what a row must reach to count
        tops = [int(x) for x in highs]
        waiting = [(-high[0], 0)]
        while waiting:
            upper, node = heapq.heappop(waiting)
            if -upper < min(least):
                break
            if not any(-upper >= x and low[node] <= y for x, y in zip(least, tops)):
                continue
            kids = self.kids[node]
            if kids:
                for child in range(self.first[node], self.first[node] + kids):
                    heapq.heappush(waiting, (-high[child], child))
                continue
            b, e = self.begin[node], self.end[node]
            score = inner(self.rows[b:e], q, self.exact)
            fits = np.flatnonzero(((self.labels[b:e] == label) == same) & (self.ids[b:e] != vec_id) & (score >= min(least)) & (score <= max(tops)))
            if not len(fits):
                continue
            found = list(zip((-score[fits]).tolist() if self.exact else [-int(s) for s in score[fits]], self.ids[b:e][fits].tolist()))
            for w, y in enumerate(tops):
                own = [f for f in found if least[w] <= -f[0] <= y]
                if own:
                    best[w] = heapq.nsmallest(most, best[w] + own)
                    if len(best[w]) == most:
                        least[w] = max(least[w], -best[w][-1][0])
        return [(w, -score, i) for w, rows in enumerate(best) for score, i in rows]


SHARD = ("_shard long, _bucket int, ids array<long>, labels array<long>, vectors array<long>, centre array<int>, radius array<double>, "
         "begin array<int>, end array<int>, first array<int>, kids array<int>, root array<long>")


class Miner:
    """The functions that Spark runs, with facts about all rows."""

    def __init__(self, dims: int, norm: float, exact: bool) -> None:
        self.dims, self.norm, self.exact = dims, norm, exact

    def dealer(self, sample: np.ndarray):
        """Adds the cell of each row: the leaf of the sample's tree with the nearest centre."""
        points = raised(sample, self.norm)
        tree = Tree(points, self.norm, SAMPLE_LEAF)
        centres = points[[c for c, kids in zip(tree.centre, tree.kids) if not kids]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = (raised(matrix(batch.column("vector"), self.dims), self.norm) @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "_cell"])
        return run

    def plant(self, group: pa.Table) -> pa.Table:
        """One shard's rows as a cover tree."""
        rows = matrix(group.column("vector").combine_chunks(), self.dims)
        tree = Tree(raised(rows, self.norm), self.norm)
        place = np.argsort(tree.order)
        lists = {"ids": group.column("vec_id").to_numpy()[tree.order], "labels": group.column("label").to_numpy()[tree.order],
                 "vectors": rows[tree.order].ravel(), "centre": place[tree.centre], "radius": tree.radius, "begin": tree.begin, "end": tree.end,
                 "first": tree.first, "kids": tree.kids, "root": rows[tree.centre[0]]}
        types = dict.fromkeys(lists, pa.int32()) | dict.fromkeys(("ids", "labels", "vectors", "root"), pa.int64()) | {"radius": pa.float64()}
        out = pa.Table.from_arrays([group.column(c).slice(0, 1) for c in ("_shard", "_bucket")], names=["_shard", "_bucket"])
        for name, values in lists.items():
            out = out.append_column(name, pa.array([np.asarray(values, types[name].to_pandas_dtype())], pa.list_(types[name])))
        return out

    def anchors(self, packed: pa.Scalar) -> tuple[np.ndarray, ...]:
        own = packed.values
        lists = [own.field(c).flatten().to_numpy().reshape(len(own), -1) for c in ("lows", "highs")]
        return (own.field("vec_id").to_numpy(), own.field("label").to_numpy(), matrix(own.field("vector"), self.dims), *lists)

    def meets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, shard) whose root bounds touch a window of an anchor."""
        for batch in batches:
            for i in range(batch.num_rows):
                ids, _, q, lows, highs = self.anchors(batch.column("anchors")[i])
                roots = batch.column("roots")[i].values
                centres, radius = matrix(roots.field("root"), self.dims).astype(np.float64), roots.field("radius").to_numpy()
                q = q.astype(np.float64)
                met = np.zeros(len(radius), np.bool_)
                for a in range(len(ids)):
                    low, high = bounds(centres @ q[a], float(np.sqrt(q[a] @ q[a])), self.norm, radius)
                    met |= ((high[:, None] >= lows[a]) & (low[:, None] <= highs[a])).any(axis=1)
                found = roots.field("_shard").filter(pa.array(met))
                yield pa.RecordBatch.from_arrays([batch.column("_block").take(pa.array(np.zeros(len(found), np.int64) + i)), found], names=["_block", "_shard"])

    def finder(self, same: bool, most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, shard = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    if (own := batch.column("_shard")[i].as_py()) != last:  # rows come sorted by shard
                        row = {c: batch.column(c)[i].values.to_numpy() for c in ("ids", "labels", "vectors", "centre", "radius", "begin", "end", "first", "kids")}
                        last, shard = own, Shard(row, self.dims, self.norm, self.exact)
                    ids, labels, q, lows, highs = self.anchors(batch.column("anchors")[i])
                    out = [(ids[a], *found) for a in range(len(ids)) for found in shard.search(q[a], ids[a], labels[a], same, lows[a], highs[a], most)]
                    columns = list(zip(*out)) or [()] * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                        names=["anchor_id", "_window", "score", "vec_id"])
        return run


def dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``rows`` with ``name``, the number of a set of about ``size`` rows of one bucket: neighbouring cells, or a slice of a large one."""
    cells = rows.groupBy("_bucket", "label", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_bucket").orderBy("label", "_cell")) - F.col("_n")
    large = F.col("_n") > size
    placed = keep(cells.select("_bucket", "label", "_cell", F.when(large, F.ceil(F.col("_n") / size)).otherwise(1).alias("_slices"),
                               F.when(large, F.xxhash64("label", "_cell")).otherwise(F.floor(before / size)).alias("_set")))
    own = F.when(F.col("_slices") > 1, F.pmod(F.xxhash64("vec_id"), F.col("_slices"))).otherwise(-1)
    return rows.join(small(placed), ["_bucket", "label", "_cell"]).withColumn(name, F.xxhash64("_bucket", "_set", own)).drop("_slices", "_set")


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector (64-bit integers) of the rows that take part, one per id, stored."""
    given = keep(rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<bigint>"))
                 .where("vec_id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)"))
    twice = keep(given.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"))
    if twice.isEmpty():
        return given
    one = given.join(twice, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")
    return keep(given.join(twice, "vec_id", "left_anti").unionByName(one))


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``rows`` (vec_id, label, vector)."""
    spark, rows = rows.sparkSession, usable(rows)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    most = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims"), F.max(F.sqrt(square)).alias("norm"), F.max(most).alias("most")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts["n"]:
        return spark.createDataFrame([], out)
    dims = facts["dims"] or 0
    miner = Miner(dims, facts["norm"] or 0.0, dims * (facts["most"] or 0.0) ** 2 < 2**53)
    share = -(-(facts["n"]) // SAMPLE)
    sampled = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(share)) == 0).select("vector").limit(2 * SAMPLE).toArrow()
    sample = matrix(sampled.column("vector").combine_chunks(), dims) if sampled.num_rows else np.zeros((1, dims), np.int64)
    buckets = -(-facts["n"] // shard_rows)
    celled = keep(rows.mapInArrow(miner.dealer(sample), "vec_id long, label long, vector array<long>, _cell int")
                  .withColumn("_bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int")))
    shards = keep(dealt(celled, shard_rows, "_shard").groupBy("_shard").applyInArrow(lambda group: miner.plant(group), SHARD))
    seeking = celled.where(is_anchor)

    def blocks(anchors: DataFrame) -> DataFrame:
        one = F.struct("vec_id", "label", "vector", "lows", "highs")
        return keep(dealt(anchors, block, "_block").groupBy("_block").agg(F.first("_bucket").alias("_bucket"), F.collect_list(one).alias("anchors")))

    def search(pairs: DataFrame, same: bool, many: int) -> DataFrame:
        met = pairs.join(shards.drop("_bucket", "root"), "_shard").sortWithinPartitions("_shard")
        found = met.mapInArrow(miner.finder(same, many), "anchor_id long, _window int, score long, vec_id long")
        first = W.partitionBy("anchor_id", "_window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= many)

    everything = blocks(seeking.withColumns({"lows": F.array(F.lit(LEAST).cast("long")), "highs": F.array(F.lit(MOST).cast("long"))}))
    own = keep(search(everything.join(shards.select("_shard", "_bucket"), "_bucket").drop("_bucket"), True, positives)
               .select("anchor_id", "_rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # scores by rank, and for each the window of its negatives; 128-bit products of the percentages
    score = F.col("positive_score").cast("decimal(20,0)")
    edge = [F.ceil(score * low / 100).cast("long"), F.floor(score * high / 100).cast("long")]
    rest = [F.lit(MOST).cast("long"), F.lit(LEAST).cast("long")]  # no window
    wide = own.groupBy("anchor_id").agg(*[F.max(F.when(F.col("_rank") == r, e)).alias(f"_{side}{r}")
                                          for r in range(1, positives + 1) for side, e in zip("lh", edge)])
    windows = wide.select(F.col("anchor_id").alias("vec_id"), *[
        F.array(*[F.coalesce(f"_{side}{r}", none) for r in range(1, positives + 1)]).alias(name)
        for side, none, name in zip("lh", rest, ("lows", "highs"))])
    wanted = blocks(seeking.join(windows, "vec_id"))
    pages = -(-shards.count() // ROOTS)
    roots = keep(shards.withColumn("_page", F.pmod(F.xxhash64("_shard"), F.lit(pages)).cast("int")).groupBy("_page").agg(
        F.collect_list(F.struct("_shard", "root", F.col("radius")[0].alias("radius"))).alias("roots")))
    paged = wanted.select("_block", "anchors", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("_page"))
    met = keep(paged.join(roots, "_page").mapInArrow(miner.meets, "_block long, _shard long"))
    found = search(met.join(wanted.drop("_bucket"), "_block"), False, negatives)
    return found.select("anchor_id", (F.col("_window") + 1).alias("_rank"), F.col("_rank").alias("rank"), F.col("vec_id").alias("negative_id"),
                        F.col("score").alias("negative_score")).join(own, ["anchor_id", "_rank"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""


def floored(component: Column) -> Column:
    """floor(256 x) of the component as a double; null if it is missing or not finite."""
    x = component.cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), F.floor(256 * x))


@query("op13_hard_negatives", SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = given.select("vec_id", moved.alias("label"), F.transform("embedding", floored).alias("vector"))
    return mine(rows, F.col("vec_id") % 100 == 0)
