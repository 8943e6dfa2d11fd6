"""Benchmark decontamination: exact keys of item parts (pigeonhole), exact edit check.

Texts are sequences of words (lower-cased, outer punctuation off). A document contains an
item if some stretch of it is within ``EDITS`` (a fifth) of the item's words, by word edit
distance.

* An item is cut into one part more than it may have edits. An edit spoils one part at most,
  so each occurrence holds a part unedited: no occurrence is lost, whatever its length.
* Every stretch of a document that is as long as a part is looked up among the parts.
* A hit is confirmed by the exact edit distance of the item to the text around it.

The benchmark is the stated query set: its keys go to the workers in blocks of a fixed
number of items, and every block meets all documents where they are read. Nothing about
documents is shuffled but the hits.

Nulls: null or empty texts and items hold nothing. Repeated rows are found alike; repeated
items each. Without items or documents the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenlattice.llm.common import column_safe, keep, query, release, small, table

EDITS = 0.2  # of the item's words
BLOCK_ITEMS = 20_000  # items whose keys are in the workers at a time: some 100 MB
PUNCTUATION = ".,;:!?\"'()[]{}«»“”‘’…-–—*#"
WORKED_ROWS = 256
CACHE = 65_536  # words kept at hand


class Known(dict):
    """Number of a word as it stands in a text; 0 for one that is punctuation only."""

    def __missing__(self, word: str) -> int:
        bare = word.lower().strip(PUNCTUATION)
        self[word] = h = xxhash.xxh3_64_intdigest(bare.encode("utf-8", "replace")) | 1 if bare else 0
        return h


class Words:
    """Words of texts as 64-bit numbers."""

    def __init__(self) -> None:
        self.known = Known()

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        if len(self.known) > CACHE:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        return h[h != 0]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def edit_distance(item: np.ndarray, text: np.ndarray) -> int:
    """Least word edits from ``item`` to a stretch of ``text`` (bit-parallel, exact)."""
    n = len(item)
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best = n
    for w in text.tolist():
        eq = places.get(w, 0)
        x = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full  # a stretch may begin anywhere
        minus = minus << 1 & full
        up = minus | ~(x | plus) & full
        down = plus & x
        best = min(best, score)
    return best


def parts_of(n: int) -> list[tuple[int, int]]:
    """Bounds of one part more than an item of ``n`` words may have edits: one of them stands unedited."""
    parts = int(EDITS * n) + 1
    edges = [n * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:]))


def gram_keys(words: np.ndarray, size: int) -> np.ndarray:
    """A key for each stretch of ``size`` words."""
    n = max(0, len(words) - size + 1)
    keys = np.full(n, size, np.uint64)
    for step in range(size):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + words[step:step + n])
    return keys


class Index:
    """Keys of the parts of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        words = Words()
        self.ids = [i for i, _ in items]
        self.words = [words.of(t or "") for _, t in items]
        self.flat = np.concatenate([np.empty(0, np.uint64), *self.words])
        self.begin = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        rows = sorted((int(gram_keys(w[a:b], b - a)[0]), at, a, b - a) for at, w in enumerate(self.words) if len(w) for a, b in parts_of(len(w)))
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.owners, self.offsets = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        self.sizes = sorted({r[3] for r in rows})
        self.bits = 20
        while 1 << self.bits < 64 * len(self.keys) and self.bits < 27:
            self.bits += 1
        self.may = np.zeros(1 << self.bits, np.bool_)
        self.may[self.keys >> np.uint64(64 - self.bits)] = True

    def with_enough_words(self, met: np.ndarray, flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The hits (text, item, start) whose text holds all words of the item but as many as it may have edits.

        Items that share a common phrase with a text are told apart here, all items of a text at once.
        """
        out = []
        edges = np.searchsorted(met[:, 0], np.unique(met[:, 0]))
        for own in np.split(met, edges[1:]) if len(met) else ():
            text = own[0, 0]
            owners, which = np.unique(own[:, 1], return_inverse=True)
            begin, n = self.begin[owners], self.begin[owners + 1] - self.begin[owners]
            ends = n.cumsum()
            words = self.flat[np.repeat(begin - ends + n, n) + np.arange(n.sum())]
            held = np.add.reduceat(np.isin(words, flat[begins[text]:begins[text + 1]]), ends - n)
            out.append(own[(held >= n - (EDITS * n).astype(np.int64))[which]])
        return np.concatenate(out) if out else met

    def hits(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(number of the text, number of the item, edit distance) of all occurrences."""
        flat = np.concatenate(texts) if texts else np.empty(0, np.uint64)
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        found = []
        for size in self.sizes:
            keys = gram_keys(flat, size)
            at = np.flatnonzero(self.may[keys >> np.uint64(64 - self.bits)])
            left, right = (np.searchsorted(self.keys, keys[at], side) for side in ("left", "right"))
            times = right - left
            at, left, ends = np.repeat(at, times), np.repeat(left, times), np.cumsum(times)
            entry = left + np.arange(len(at)) - np.repeat(ends - times, times)
            text = np.searchsorted(begins, at, "right") - 1
            inside = at + size <= begins[text + 1]
            found.append(np.stack([text, self.owners[entry], at - self.offsets[entry]], axis=1)[inside])
        best: dict[tuple[int, int], int] = {}
        met = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)
        for text, owner, start in self.with_enough_words(met, flat, begins).tolist():
            item = self.words[owner]
            most = int(EDITS * len(item))
            if best.get((text, owner), most + 1) == 0:
                continue
            around = flat[max(begins[text], start - most):min(begins[text + 1], start + len(item) + most)]
            if np.isin(item, around).sum() < len(item) - most:
                continue  # each item word that is missing there is an edit
            d = edit_distance(item, around)
            if d <= most and d < best.get((text, owner), most + 1):
                best[text, owner] = d
        for (text, owner), d in sorted(best.items()):
            yield text, owner, d


def _search(items: list[tuple[int, str]]):
    held: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Index(items))
        index, words = held[0], Words()
        for batch in batches:
            for at in range(0, batch.num_rows, WORKED_ROWS):
                part = batch.slice(at, WORKED_ROWS)
                rows = list(index.hits([words.of(t.as_py() or "") for t in part.column("_text")]))
                if rows:
                    where = pa.array([r[0] for r in rows])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("_id").take(where), part.column("_tkey").take(where), pa.array([index.ids[r[1]] for r in rows], pa.int64()),
                         pa.array([len(index.words[r[1]]) for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())],
                        names=["_id", "_tkey", "item_id", "n_words", "edits"])
        release()
    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """_id, _tkey (hash of the text), item_id, n_words, edits: each item that a document contains, stored."""
    given = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tkey"), F.col("text").alias("_text"))
    schema = T.StructType([T.StructField("_id", docs.schema["doc_id"].dataType), T.StructField("_tkey", T.LongType()),
                           T.StructField("item_id", T.LongType()), T.StructField("n_words", T.IntegerType()), T.StructField("edits", T.IntegerType())])
    items = keep(benchmark.select("item_id", "text").where("trim(text) <> ''"))
    blocks = items.count() // BLOCK_ITEMS + 1
    out = docs.sparkSession.createDataFrame([], schema)
    for block in range(blocks):  # a block is bounded; more items are more passes over the documents
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        if part:
            out = out.unionByName(given.mapInArrow(_search([(r["item_id"], r["text"]) for r in part]), schema))
    return keep(out)


@column_safe
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that contain a benchmark item go."""
    gone = keep(contamination(docs, table(spark, sf_dir, "benchmark")).select(F.col("_id").alias("_dc_id"), F.col("_tkey").alias("_dc_tkey")).distinct())
    tagged = docs.withColumn("_dc_text", F.xxhash64("text"))
    same: Column = F.col("doc_id").eqNullSafe(F.col("_dc_id")) & (F.col("_dc_text") == F.col("_dc_tkey"))
    return tagged.join(small(gone), same, "left_anti").select(*docs.columns)


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.groupBy(F.col("_id").alias("doc_id"), "item_id").agg(
        F.min("n_words").cast("long").alias("n_words"), F.min("edits").cast("long").alias("edits"))
