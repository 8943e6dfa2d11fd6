"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Units are the 16-bit code units of the text in UTF-16, none of them folded, so four of them
are one 64-bit integer; orders 1 to ``ORDER`` = 4. The model is trained on all texts that
the labels call good and not toxic.

* Counting: each task counts the n-grams of its texts, Spark adds the counts up. An n-gram's
  context is its number without the last unit, its suffix that without the first.
* Sharded count joins: lower orders count distinct left neighbours; the statistics of each
  context are joined to its n-grams, hash-sharded by context. The model stays a stored table.
* Scoring: documents are dealt into blocks of some ``BLOCK`` units, each block names its
  distinct n-grams. Those of all blocks are joined order by order to the shares of seen
  n-grams and to the back-off weights of their contexts, and the costs go back to the blocks
  that named them. An n-gram comes once, so no context meets more rows than there are units.
* Limits: a fifth of the trusted texts is scored by a second model that has not read them.
  Per language, a quantile sketch of these scores gives the limit: the upper confidence
  bound of their ``QUANTILE``, so at most some 3 % of clean documents go, less where few are held out.

``kneser_ney`` also takes texts folded to ``ALPHABET`` = 64 symbols (6 bits a unit), few
enough for a table of all n-grams: ``dense`` is that plain version, no query uses it.

Nulls: null and empty texts have no perplexity and are kept out; a null language, or one
with few trusted documents, takes the limit of all. Labels may repeat a document: it is
trusted if every label of it is good. Repeated rows are scored alike. With fewer than
``LEAST_HELD`` held-out texts no limit can be told and all texts are kept; an empty table
gives an empty result. A text is scored in one task, however long.
"""

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from greenlattice.llm.common import keep, query, release, row_key, small, small_batches, table, text_of

ORDER, UNIT, BITS = 4, 16, 6  # bits of a unit, and of a folded one
ALPHABET = 1 << BITS
START = {UNIT: 0xFFFF, BITS: 0}  # stands before a text; U+FFFF is no character
BLOCK = 16 << 20  # units of the texts that name their n-grams together
PIECE = 1 << 20  # n-grams that a task sorts at once
#: Symbols that keep a number of their own; the rest of ASCII shares one, capitals share one.
OWN = "abcdefghijklmnopqrstuvwxyz \n.,!?'\"-:;()|#$%&*@/=_+<>"
CAPITAL, DIGIT, MARK, OTHER = len(OWN) + 1, len(OWN) + 2, len(OWN) + 3, len(OWN) + 4
GROUPS = ALPHABET - OTHER
FOLDS = 5  # one of them is held out
QUANTILE = 0.97  # of the held-out documents' scores is the limit,
CONFIDENCE = 5 * 1.33  # widened by five standard errors, each 1.33 / sqrt(n) of its distance from the median in a normal
PRIOR = 200  # characters at the median that every text is reckoned to have besides
LEAST = 200  # trusted documents from which a language has a limit of its own
LEAST_HELD = 20  # held-out documents that a limit needs


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Symbol of every code point: other letters share ``GROUPS`` numbers by their place in the script."""
    out = np.full(0x110000, MARK, dtype=np.uint8)
    points = np.arange(0x80, 0x110000)
    out[0x80:] = OTHER + (points % GROUPS)
    for c in range(0x80):
        ch = chr(c)
        out[c] = OWN.index(ch) + 1 if ch in OWN else CAPITAL if ch.isupper() else DIGIT if ch.isdigit() else MARK
    for c in range(0x80, 0x2000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Lu":
            out[c] = CAPITAL
        elif kind == "Nd":
            out[c] = DIGIT
        elif kind[0] in "PSZ":
            out[c] = MARK
    return out


def grams(text: str, bits: int = BITS) -> np.ndarray:
    """Numbers of the ``ORDER``-grams of a text, one per unit."""
    if bits == UNIT:
        units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
    else:
        units = symbols()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    line = np.concatenate([np.full(ORDER - 1, START[bits], units.dtype), units]).astype(np.uint64)
    n = len(units)
    out = line[:n]
    for k in range(1, ORDER):
        out = (out << np.uint64(bits)) | line[k:n + k]
    return out.view(np.int64)


def pieces(texts: Iterable[str | None], bits: int) -> Iterator[np.ndarray]:
    """The n-grams of the texts, ``PIECE`` and the rest of a text at once."""
    part, size = [], 0
    for text in texts:
        if text:
            part.append(grams(text, bits))
            size += len(part[-1])
        if size >= PIECE:
            yield np.concatenate(part)
            part, size = [], 0
    if part:
        yield np.concatenate(part)


def count_grams(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """gram, n of one task's texts."""
        total = np.zeros(0, np.int64)
        seen = np.zeros(0, np.int64)
        for piece in (p for batch in batches for p in pieces(batch.column(0).to_pylist(), bits)):
            new, n = np.unique(piece, return_counts=True)
            both, where = np.unique(np.concatenate([seen, new]), return_inverse=True)
            total = np.bincount(where, weights=np.concatenate([total, n]), minlength=len(both)).astype(np.int64)
            seen = both
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total)], names=["gram", "n"])
        del total, seen
        release()
    return run


def context_of(gram: str, bits: int) -> Column:
    """An n-gram without its last unit."""
    return F.shiftrightunsigned(F.col(gram), bits)


def suffix_of(gram: str, units: int, bits: int) -> Column:
    """The last ``units`` units of a longer n-gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << bits * units) - 1).cast("long"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents whose labels all say good and not toxic."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_trusted")).agg(F.min(good.cast("int")).alias("_good")).where("_good = 1").select("_trusted")


def kneser_ney(texts: DataFrame, bits: int = BITS) -> DataFrame:
    """Stored rows (order, gram, p): the discounted share of a seen n-gram; or its context's
    back-off weight where ``p`` belongs to order + 100. ``texts`` has one column of text."""
    counts = keep(texts.mapInArrow(count_grams(bits), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    out = None
    for order in range(ORDER, 0, -1):
        if order < ORDER:  # continuation counts: distinct left neighbours of a shorter n-gram
            counts = counts.groupBy(suffix_of("gram", order, bits).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        of = [F.coalesce(F.sum(F.when(F.col("n") == k, 1)), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
        r = counts.agg(*of).first()
        base = r.n1 / (r.n1 + 2 * r.n2) if r.n1 else 0.5
        d = [min(k - 0.01, max(0.01, k - (k + 1) * base * a / b)) if b else 0.5 * k
             for k, a, b in ((1, r.n2, r.n1), (2, r.n3, r.n2), (3, r.n4, r.n3))]
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = counts.withColumn("context", context_of("gram", bits))
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("freed"))
        joined = rows.join(contexts, "context").select(
            F.lit(order).alias("order"), "gram", ((F.col("n") - cut) / F.col("total")).alias("p"))
        weights = contexts.select(F.lit(order + 100).alias("order"), F.col("context").alias("gram"), (F.col("freed") / F.col("total")).alias("p"))
        out = joined.unionByName(weights) if out is None else out.unionByName(joined).unionByName(weights)
    return keep(out)


def dense(order: np.ndarray, gram: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Negative log probability of every possible ``ORDER``-gram of folded symbols, from the model's rows."""
    lower = np.full(1, 1.0 / ALPHABET, np.float32)
    for k in range(1, ORDER + 1):
        weight = np.ones(ALPHABET ** (k - 1), np.float32)
        own, back = order == k, order == k + 100
        weight[gram[back]] = share[back]
        p = np.repeat(weight, ALPHABET).reshape(ALPHABET, -1)  # by first symbol and the rest
        p *= lower
        lower = p.ravel()
        lower[gram[own]] += share[own]
    np.maximum(lower, 1e-30, out=lower)
    np.log(lower, out=lower)
    np.negative(lower, out=lower)
    return lower


def shares(wanted: DataFrame, model: DataFrame, order: int = ORDER, bits: int = UNIT) -> DataFrame:
    """gram, p: the probability of the last unit of every wanted ``order``-gram after the others.

    ``wanted`` (gram) holds each n-gram once.
    """
    own = model.where(F.col("order") == order).select("gram", F.col("p").alias("_own"))
    weight = model.where(F.col("order") == order + 100).select(F.col("gram").alias("_context"), F.col("p").alias("_weight"))
    asked = wanted.withColumn("_context", context_of("gram", bits)).join(weight, "_context", "left").join(own, "gram", "left")
    if order == 1:
        asked = asked.withColumn("_lower", F.lit(1.0 / (1 << bits)))
    else:
        suffix = suffix_of("gram", order - 1, bits)
        lower = shares(wanted.select(suffix.alias("gram")).distinct(), model, order - 1, bits)
        asked = asked.withColumn("_suffix", suffix).join(lower.select(F.col("gram").alias("_suffix"), F.col("p").alias("_lower")), "_suffix")
    return asked.select("gram", (F.coalesce("_own", F.lit(0.0)) + F.coalesce("_weight", F.lit(1.0)) * F.col("_lower")).alias("p"))


def block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_block, gram: the distinct n-grams of each block's texts."""
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        texts: dict[int, list[str]] = {}
        for block, text in zip(batch["_block"].to_pylist(), batch["text"].to_pylist()):
            texts.setdefault(block, []).append(text)
        for block, own in texts.items():
            for piece in pieces(own, UNIT):
                seen[block] = np.union1d(seen.get(block, np.zeros(0, np.int64)), np.unique(piece))
    for block, found in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block, np.int32)), pa.array(found)], names=["_block", "gram"])
    seen.clear()
    release()


def score_block(docs: pa.Table, costs: pa.Table) -> pa.Table:
    """A block's documents with ``_cost`` in place of the text; ``costs`` (gram, cost) of its n-grams."""
    gram, cost = costs["gram"].to_numpy(), costs["cost"].to_numpy()
    by = np.argsort(gram)
    gram, cost = gram[by], cost[by]
    mean = [cost[np.searchsorted(gram, grams(t, UNIT))].sum(dtype=np.float64) / len(t) for t in docs["text"].to_pylist()]
    release()
    return docs.drop_columns(["_block", "text"]).append_column("_cost", pa.array(mean, pa.float64()))


def perplexity(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars of ``docs`` and ``_cost``, the mean negative log probability of a character of its text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "lang", "n_chars", "text")
    full = docs.where("n_chars > 0")
    size = full.agg(F.sum("n_chars")).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks)
    dealt = full.withColumn("_block", F.pmod(row_key(), F.lit(blocks)).cast("int")).repartition(parts, "_block")
    wanted = full.select("text").mapInArrow(count_grams(UNIT), "gram long, n long").select("gram").distinct()
    p = keep(shares(keep(wanted), model))
    named = dealt.mapInArrow(block_grams, "_block int, gram long")  # after the one shuffle of texts, that of the scoring
    costs = named.join(p, "gram").select("_block", "gram", (-F.ln(F.greatest("p", F.lit(1e-30)))).cast("float").alias("cost"))
    out = docs.drop("text").schema.add("_cost", "double")
    scored = dealt.groupBy("_block").cogroup(costs.groupBy("_block")).applyInArrow(score_block, out)
    return scored.unionByName(docs.where("n_chars = 0").drop("text").withColumn("_cost", F.lit(None).cast("double")))


def score(mid: Column) -> Column:
    """The mean cost over a text and ``PRIOR`` characters that cost ``mid``: few characters say little."""
    return (F.col("_cost") * F.col("n_chars") + mid * PRIOR) / (F.col("n_chars") + PRIOR)


def held_out(text: str = "text") -> Column:
    """Whether a trusted text is held out; copies are on one side."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)) == 0


def limits(costs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
    """Median cost and upper limit of the score per language (stored), and of all languages together.

    ``costs`` (lang, n_chars, _cost) are the held-out documents, ``trusted`` (lang) all trusted ones.
    """
    costs = keep(costs.where(F.col("_cost").isNotNull()))

    def sketches(df: DataFrame, *by: str) -> DataFrame:
        mids = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_cost").alias("s"))
        return mids.select(*by, "n", F.kll_sketch_get_quantile_double("s", F.lit(0.5)).alias("_mid"))

    def most(df: DataFrame, *by: str) -> DataFrame:
        of = df.groupBy(*by, "n", "_mid").agg(F.kll_sketch_agg_double(score(F.col("_mid"))).alias("s"))
        high, mid = F.kll_sketch_get_quantile_double("s", F.lit(QUANTILE)), F.kll_sketch_get_quantile_double("s", F.lit(0.5))
        return of.select(*by, "_mid", (high + CONFIDENCE / F.sqrt("n") * (high - mid)).alias("_most"))

    enough = trusted.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LEAST).select("_lang")
    held = costs.withColumnRenamed("lang", "_lang")
    sizes = keep(sketches(held, "_lang").where(F.col("n") >= LEAST_HELD).join(enough.withColumnRenamed("_lang", "_l"), F.col("_lang").eqNullSafe(F.col("_l"))).drop("_l"))
    with_mid = held.withColumnRenamed("_lang", "_l").join(small(sizes), F.col("_l").eqNullSafe(F.col("_lang"))).drop("_l")
    own = keep(most(with_mid, "_lang"))
    if costs.count() < LEAST_HELD:  # too few to say where clean texts end
        return own, (0.0, float("inf"))
    top = sketches(costs).first()
    rest = most(costs.select("*", F.lit(top["n"]).alias("n"), F.lit(top["_mid"]).alias("_mid"))).first()
    return own, (rest["_mid"], rest["_most"])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, log_perplexity, most (the limit of its language), kept.

    What is held against the limit is the ``score`` of a document.
    """
    small_batches(docs.sparkSession)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    docs = docs.select("doc_id", lang, "text").withColumn("n_chars", F.length(text_of()).cast("long"))
    ids = keep(trusted_ids(labels))
    trusted = docs.join(small(ids), F.col("doc_id") == F.col("_trusted"), "left_semi").where("n_chars > 0")
    blind = kneser_ney(trusted.where(~held_out()).select("text"), UNIT)
    own, (rest_mid, rest_most) = limits(perplexity(trusted.where(held_out()), blind).select("lang", "n_chars", "_cost"), trusted)
    costs = perplexity(docs, kneser_ney(trusted.select("text"), UNIT))
    mid, most = F.coalesce("_mid", F.lit(rest_mid)), F.coalesce("_most", F.lit(rest_most))
    return (costs.join(small(own), F.col("lang").eqNullSafe(F.col("_lang")), "left")
            .select("doc_id", "lang", "n_chars", F.col("_cost").alias("log_perplexity"), most.alias("most"),
                    F.coalesce(score(mid) <= most, F.lit(False)).alias("kept")))


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
