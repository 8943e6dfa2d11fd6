"""What the training-data operators share: tables, stages, row keys and the query register."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from greenlattice.session import materialize as keep  # noqa: F401 - one name for all operators

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Rows up to which a checked side is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 200_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register an operator's query, with SQL for another engine where SQL can say it."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """64 bits of id and text: rows that share it are equal, and so is what is decided of them.

    Two hashes of independent seeds go into it, so ids that differ but collide in one
    stay apart in the other.
    """
    return F.xxhash64(F.col(id_column), F.length(text_column), F.hash(id_column, text_column), F.col(text_column))


def small(df: DataFrame) -> DataFrame:
    """A stored table as a join side: broadcast only if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def release() -> None:
    """Give freed memory back to the system: idle workers of one step stay alive beside those of the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Workers get batches of at most 8 MB: texts differ too much in length to be counted in rows."""
    held = spark.conf.get(BATCH_BYTES)
    if held.endswith("b") and held[:-1].isdigit() and int(held[:-1]) > MOST_BYTES:  # not one that the user has set
        spark.conf.set(BATCH_BYTES, str(MOST_BYTES))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns of documents that stages read by name.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def column_safe(stage: Stage) -> Stage:
    """``stage`` for documents with columns of any name, in batches of bounded size: columns it doesn't read have plain names on the way."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        plain = [c if c in READ else f"given{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*plain), sf_dir).select(*plain).toDF(*docs.columns)
    return run
