"""Exact duplicates: frequent digests are settled map-side, the rest by one ordinary shuffle.

Texts are equal if they are identical once every run of white space is one space; the SHA-256
of that text stands for it. Of equal texts the row with the smallest doc_id stays.

* A Misra-Gries summary (the mergeable frequent-items sketch behind ``approx_top_k``) names
  at most ``CANDIDATES`` digests that may be frequent. Each task keeps ``TRACKED`` counters.
* Their exact sizes and winners are one aggregate with partial sums in every task. Those that
  hold more than one row in ``TRACKED`` are the heavy hitters; they are few by that bound,
  so they are broadcast, and their rows get their answer where they are read.
* Every other digest holds a bounded share of the rows and goes through a shuffle of digests
  (no texts) to a window.

Nulls: a null text is an empty one; a null doc_id is larger than any other, and keep_id is null
if no row of the group has an id. Repeated rows are rows of their own: one of them stays.
Texts of any length are read whole, their digest is all that moves. An empty table gives an
empty result. Other columns, whatever their names, stay out of the way: only doc_id and text
are read, and ``deduplicated`` uses names that the input lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from greenlattice.llm.common import keep, query, small, table, text_of

TRACKED = 4096  # counters of a summary
CANDIDATES = 1024  # digests that it may name


def normalised(column: str = "text") -> Column:
    """The text with each run of white space as one space; lone spaces are left alone, so few matches are made."""
    return F.regexp_replace(text_of(column), "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]", " ")


def digest(column: str = "text") -> Column:
    return F.sha2(normalised(column), 256)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and _row, a number of its own, of every row; stored."""
    return keep(docs.select("doc_id", digest().alias("text_sha256"), F.monotonically_increasing_id().alias("_row")))


def heavy_hitters(rows: DataFrame, tracked: int = TRACKED, candidates: int = CANDIDATES) -> DataFrame:
    """text_sha256, _size, _first (doc_id and _row of the winner) of the frequent digests, stored: ``candidates`` rows at most."""
    summary = rows.agg(F.expr(f"approx_top_k(text_sha256, {candidates}, {tracked})").alias("top"))
    named = keep(summary.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256")))
    exact = rows.join(F.broadcast(named), "text_sha256").groupBy("text_sha256").agg(
        F.count(F.lit(1)).alias("_size"), winner().alias("_first"))
    return keep(exact.where((F.col("_size") > 1) & (F.col("_size") * tracked >= rows.count())))


def winner() -> Column:
    """The row with the smallest doc_id, the first of several such."""
    return F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))


def groups(rows: DataFrame, tracked: int = TRACKED, candidates: int = CANDIDATES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``digests``."""
    heavy = F.broadcast(heavy_hitters(rows, tracked, candidates))
    same = W.partitionBy("text_sha256")
    often = rows.join(heavy, "text_sha256")
    seldom = rows.join(heavy.select("text_sha256"), "text_sha256", "left_anti").select(
        "*", F.count(F.lit(1)).over(same).alias("_size"), winner().over(same).alias("_first"))
    return often.unionByName(seldom).select(
        "doc_id", F.col("_first.doc_id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_first._row")).alias("kept"), "text_sha256")


def exact_duplicates(docs: DataFrame, tracked: int = TRACKED, candidates: int = CANDIDATES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text)."""
    return groups(digests(docs), tracked, candidates)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that go are found by id and digest. Only texts of which the winning id comes
    several times are shuffled, to leave one row of it.
    """
    tag, gone_id, gone_tag = (_free(docs, name) for name in ("digest", "gone_id", "gone_digest"))
    judged = keep(exact_duplicates(docs))
    own = [F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_tag)]
    of_winner = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = judged.where(~of_winner).select(*own).distinct()
    twice = keep(judged.where(of_winner).groupBy(*own).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    tagged = docs.withColumn(tag, digest())
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(tag) == F.col(gone_tag))
    once = tagged.join(small(keep(gone.unionByName(twice))), same, "left_anti")
    one_of = tagged.join(small(twice), same, "left_semi").dropDuplicates(["doc_id", tag])
    return once.unionByName(one_of).select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` lacks."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


@query("op11_exact_dedup", SQL)
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
