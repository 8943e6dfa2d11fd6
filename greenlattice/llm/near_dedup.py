"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact links, components.

A document is the set of its distinct five-word shingles; documents with Jaccard similarity
of 0.75 or more are linked.

* Equal sets are one class (a 128-bit digest of the sorted set); classes are the nodes.
* A signature has 60 b-bit symbols (b = 32), split into 12 chunks of 5. Two signatures that
  differ in at most 2 * 12 - 1 = 23 symbols have, by the pigeonhole principle, a chunk with
  one error at most. Each chunk is looked up with every allowed error: five keys, each with
  one symbol left out. So every pair within distance 23 meets under a key. Most pairs further
  apart meet as well: a pair at similarity 0.75 misses all chunks with probability 6e-6.
* Groups are not expanded. First every member is compared with one leader, then with all
  leaders of its keys, and only members of one key that are still in different components
  with each other, in blocks where they are many. Pairs pass a distance test on the signatures
  (more than 32 of 60 symbols apart are one linked pair in 10^7), those of the last step one on
  sketches of 1024 bins too, and are confirmed on the full sets.
* Components: large-star and small-star rounds over the confirmed links.

Tables in between are written to the shared folder. Texts are read again only for members
of a key with company. Nothing but counts reaches the driver.

Nulls and empty texts have no shingles and are linked with nothing; a text of fewer than
five words is one shingle. Rows without a doc_id count as copies, but cannot name a
component: they have component null if no row with an id is reachable. Repeated rows get
equal answers. An empty table gives an empty result.
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

WORDS = 5
CHUNK, CHUNKS = 5, 12
SYMBOLS = CHUNK * CHUNKS
MOST_APART = 32  # differing symbols beyond which a pair is not looked at (a linked one: about 1e-7)
LEAST_PERCENT = 75
BIN_BITS = 10  # a sketch has 1024 bytes
MEET = 4096  # members of a key that meet in one task
BLOCK = 2048
CACHE = 65_536  # words kept at hand

_rng = np.random.default_rng(20_231)
WEIGHTS = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SCALES = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Shingle sets of texts, with the hashes of words met before at hand."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit shingles of the whole text."""
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < WORDS:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(words) - WORDS + 1
        total = h[:n] * WEIGHTS[0]
        for k in range(1, WORDS):
            total += h[k:n + k] * WEIGHTS[k]
        return np.unique(mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` minima of 32 bits."""
    best = np.full(SYMBOLS, 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        part = SCALES[:, None] * shingles[None, at:at + BLOCK]
        part += SHIFTS[:, None]
        np.minimum(best, part.min(axis=1) >> np.uint64(32), out=best)
    return best.astype(np.uint32).view(np.int32)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for batch in batches:
        n, digest, symbols = [], [], []
        for text in batch.column("_text"):
            s = shingles.of(text.as_py())
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()))
            symbols.append(signature(s))
        flat = pa.array(np.concatenate(symbols) if symbols else np.empty(0, np.int32))
        ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * SYMBOLS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_tkey"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
             pa.ListArray.from_arrays(ends, flat)], names=["_id", "_tkey", "n_shingles", "set", "symbols"])
    release()


def described(docs: DataFrame) -> DataFrame:
    """_id, _tkey (hash of the text), n_shingles, set (digest), symbols (signature) of each row, stored."""
    given = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tkey"), F.col("text").alias("_text"))
    schema = T.StructType([T.StructField("_id", docs.schema["doc_id"].dataType), T.StructField("_tkey", T.LongType()),
                           T.StructField("n_shingles", T.LongType()), T.StructField("set", T.BinaryType()),
                           T.StructField("symbols", T.ArrayType(T.IntegerType()))])
    return keep(given.mapInArrow(_describe, schema))


def keys(symbols: str) -> Column:
    """Hashes of every chunk with one symbol left out."""
    s = F.col(symbols)
    out = []
    for chunk in range(CHUNKS):
        for left_out in range(CHUNK):
            rest = [s[chunk * CHUNK + i] for i in range(CHUNK) if i != left_out]
            out.append(F.xxhash64(F.lit(chunk * CHUNK + left_out), *rest))
    return F.array(*out)


def near(a: str, b: str) -> Column:
    """Signatures within ``MOST_APART``."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)
    return F.size(same) >= SYMBOLS - MOST_APART


def sizes_fit(a: str, b: str) -> Column:
    """No sets of such sizes are too unlike."""
    return (100 * F.least(a, b)) >= (LEAST_PERCENT * F.greatest(a, b))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for batch in batches:
        linked, last, held = [], None, np.empty(0, np.uint64)
        for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb")):
            if a != last:
                last, held = a, shingles.of(ta.as_py())
            other = shingles.of(tb.as_py())
            both = len(np.intersect1d(held, other, assume_unique=True))
            linked.append(100 * both >= LEAST_PERCENT * (len(held) + len(other) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))
        release()  # a batch holds two whole texts a pair


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte per bin of the shingles' leading bits: some of the bits of its least shingle, 0 if empty."""
    shingles = Shingles()
    for batch in batches:
        out = []
        for text in batch.column("_text"):
            s = shingles.of(text.as_py())
            bins, first = np.unique(s >> np.uint64(64 - BIN_BITS), return_index=True)
            line = np.zeros(1 << BIN_BITS, np.uint8)
            line[bins] = s[first] % np.uint64(255) + np.uint64(1)
            out.append(line.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("_node"), pa.array(out, pa.binary())], names=["_node", "sketch"])
    release()


def first_shared(same: np.ndarray) -> np.ndarray:
    """Number of the first key that two signatures share, given where they agree; -1 if none."""
    chunks = same.reshape(-1, CHUNKS, CHUNK)
    hit = chunks.sum(axis=2) >= CHUNK - 1
    chunk = hit.argmax(axis=1)
    at = chunks[np.arange(len(chunks)), chunk]
    return np.where(hit.any(axis=1), chunk * CHUNK + np.where(at.all(axis=1), 0, at.argmin(axis=1)), -1)


def least_share(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Share of equal bins below which a linked pair lies less than once in 10^7.

    ``bins`` of about ``sizes`` / 1.75 shingles of the union are seen, drawn without replacement.
    """
    unseen = np.maximum(0, 1 - 1.75 * bins / np.maximum(sizes, 1))
    return 0.75 - 5.5 * np.sqrt(0.1875 / np.maximum(bins, 1) * unseen)


def pairs_that_meet(group: pa.Table, best: bool) -> list[np.ndarray]:
    """Pairs of one key in different components that signatures and sketches let be linked: x, y, share of equal bins.

    A pair counts under the first key that it shares only. With ``best``, only the most
    alike partner of each x, which is outside of the largest component here.
    """
    node, root, n = (group.column(c).to_numpy() for c in ("_node", "root", "n_shingles"))
    part = group.column("_part").to_numpy()
    low, high, slot = (group.column(c)[0].as_py() for c in ("_low", "_high", "_slot"))
    symbols = np.stack(group.column("symbols").to_numpy())
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
    roots, size = np.unique(root, return_counts=True)
    outside = np.flatnonzero(root != roots[size.argmax()])
    is_outside = np.zeros(len(node), np.bool_)
    is_outside[outside] = True
    found = []
    for x in outside.tolist():
        may = (root != root[x]) & (100 * np.minimum(n, n[x]) >= LEAST_PERCENT * np.maximum(n, n[x]))
        if not best:
            may &= ~is_outside | (node > node[x])
        if low != high:
            may &= part != part[x]
        near_ = np.flatnonzero(may)
        same = symbols[near_] == symbols[x]
        close = same.sum(axis=1) >= SYMBOLS - MOST_APART
        near_, same = near_[close], same[close]
        near_ = near_[first_shared(same) == slot]
        both, own = sketch[near_], sketch[x]
        held = ((both == own) & (own > 0)).sum(axis=1)
        bins = ((both > 0) | (own > 0)).sum(axis=1)
        share = held / np.maximum(bins, 1)
        good = share >= least_share(bins, n[near_] + n[x])
        near_, share = near_[good], share[good]
        if best and len(near_):
            near_, share = near_[[share.argmax()]], share[[share.argmax()]]
        found.append((np.full(len(near_), node[x]), node[near_], share))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]


def _meet(best: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, _low, _high): the pairs of each such group, which is held until it ends."""
        names = ["key", "_low", "_high"]
        waiting: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            if waiting:
                x, y, share = pairs_that_meet(pa.Table.from_batches(waiting), best)
                waiting.clear()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(share, pa.float64())], names=["x", "y", "share"])

        last = None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in names]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows else []
            for at, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if at == end:
                    continue
                group = tuple(c[at] for c in columns)
                if group != last:
                    yield from out()
                    last = group
                waiting.append(batch.slice(at, end - at))
        yield from out()
        release()
    return run


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked, stored."""
    a = texts.select(F.col("_node").alias("a"), F.col("_text").alias("ta"))
    b = texts.select(F.col("_node").alias("b"), F.col("_text").alias("tb"))
    return keep(pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(_confirm, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node with a link, stored."""
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(low, "u")
        star = keep(small_.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
        if star.agg(*mark).first() == edges.agg(*mark).first():
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = star


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that no component holds yet."""
    ra = roots.select(F.col("node").alias("a"), F.col("root").alias("_ra"))
    rb = roots.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
    apart = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return apart.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b")


def links_of(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, root over ``classes`` (_node, _id, _tkey, n_shingles, symbols)."""
    keyed = classes.select("_node", F.posexplode(keys("symbols")).alias("_slot", "key"))
    groups = keep(keyed.groupBy("key").agg(F.min("_node").alias("lead"), F.max("_node").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = keep(keyed.join(groups.where("n > 2").select("key", "lead"), "key"))
    pairs = members.where("_node != lead").select(F.col("lead").alias("a"), F.col("_node").alias("b")).unionByName(
        groups.where("n = 2").select(F.col("lead").alias("a"), F.col("last").alias("b"))).distinct()
    sig = classes.select("_node", "n_shingles", "symbols")
    sa, sb = (sig.select(F.col("_node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("symbols").alias(f"s{x}")) for x in "ab")
    stars = keep(pairs.join(sa, "a").join(sb, "b").where(sizes_fit("na", "nb") & near("sa", "sb")).select("a", "b"))
    company = members.select("_node").union(stars.select("a")).union(stars.select("b")).distinct()
    wanted = keep(classes.select("_node", "_id", "_tkey").join(company, "_node"))
    found = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_key"), F.col("text").alias("_text"))
    texts = keep(found.join(small(wanted), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_tkey")))
                 .select("_node", "_text").dropDuplicates(["_node"]))

    first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    linked = confirm(first, texts)
    roots = components(linked)
    more = confirm(across(stars.join(first, ["a", "b"], "left_anti"), roots), texts)
    linked = linked.unionByName(more)
    roots = components(linked)

    # members of one key that are still apart meet each other, large groups in pairs of blocks:
    # twice for the most alike partner of each, which joins most of them, then for all that are left
    sketches = None
    for best in (True, True, False):
        apart = members.join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn("root", F.coalesce("root", "_node"))
        mixed_keys = apart.groupBy("key").agg((F.min("root") != F.max("root")).alias("m"), F.count(F.lit(1)).alias("n")).where("m")
        left = keep(apart.where("_node != lead").join(mixed_keys.select("key", F.ceil(F.col("n") / MEET).cast("int").alias("_parts")), "key"))
        if sketches is None:  # later rounds have no other nodes
            sketches = keep(texts.join(left.select("_node").distinct(), "_node", "left_semi").mapInArrow(_sketch, "_node long, sketch binary"))
        left = left.join(sketches, "_node").join(sig, "_node").withColumn("_part", F.pmod(F.xxhash64("_node"), F.col("_parts")).cast("int"))
        met = left.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(
            "key", F.least("_part", "_other").alias("_low"), F.greatest("_part", "_other").alias("_high"), "_part",
            "_slot", "_node", "root", "n_shingles", "symbols", "sketch")
        rest = met.repartition("key", "_low", "_high").sortWithinPartitions("key", "_low", "_high").mapInArrow(_meet(best), "x long, y long, share double")
        if best:
            rest = rest.groupBy("x").agg(F.max_by("y", F.struct("share", -F.col("y"))).alias("y"))
        pairs = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        linked = linked.unionByName(confirm(pairs, texts))
        roots = components(linked)
    return roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """_id, _tkey, n_shingles, component_id of each row of ``docs`` (doc_id, text)."""
    rows = described(docs)
    rep = F.min(F.struct(F.col("_id").isNull(), "_id", "_tkey")).alias("rep")
    classes = rows.where("n_shingles > 0").groupBy("set").agg(
        F.min("_id").alias("label"), rep, F.first("n_shingles").alias("n_shingles"), F.first("symbols").alias("symbols"))
    classes = keep(classes.select("set", "label", F.col("rep._id").alias("_id"), F.col("rep._tkey").alias("_tkey"), "n_shingles",
                                  "symbols", F.monotonically_increasing_id().alias("_node")))
    roots = links_of(classes.drop("set", "label"), docs)
    rooted = classes.select("set", "label", "_node").join(roots.withColumnRenamed("node", "_node"), "_node", "left")
    rooted = rooted.select("set", "label", F.coalesce("root", "_node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("label").alias("component_id")), "root").select("set", "component_id")
    return (rows.select("_id", "_tkey", "n_shingles", "set").join(named, "set", "left")
            .select("_id", "_tkey", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id")))


@column_safe
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one document stays, of repeated rows one row.

    The rows that go are joined to the texts, not those that stay: they are fewer.
    """
    judged = keep(near_duplicates(docs))
    kept = F.col("_id").eqNullSafe(F.col("component_id"))
    own = [F.col("_id").alias("_nd_id"), F.col("_tkey").alias("_nd_tkey")]
    gone = keep(judged.where(~kept).select(*own).distinct())
    twice = keep(judged.where(kept).groupBy(*own).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_nd_id", "_nd_tkey"))
    tagged = docs.withColumn("_nd_text", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_nd_id")) & (F.col("_nd_text") == F.col("_nd_tkey"))
    once = tagged.join(small(keep(gone.unionByName(twice))), same, "left_anti")
    one_of = tagged.join(small(twice), same, "left_semi").dropDuplicates(["doc_id", "_nd_text"])
    return once.unionByName(one_of).select(*docs.columns)


@query("op7_near_dedup")
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id",
                        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
