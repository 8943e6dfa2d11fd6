"""Byte-level BPE over whole texts, long ones by tree concatenation.

A text longer than ``PIECE`` code points is cut into the leaves of a binary tree, none of them
longer than that; they are rows of their own and are encoded in parallel on all executors.
Neighbours are then joined pairwise up the tree: the last tokens of the left side and the
first of the right are encoded again as one string, in windows that double until the
result begins with the left side's own tokens and ends with the right side's. What is
outside such a window is untouched, and adjacent tokens there were adjacent before.

The window reaches further than the special string is long on both sides, so a special
string that a cut falls into is found as well.

Nulls: a null text is an empty one (no tokens). Repeated rows are encoded each. Special
strings in a text become their id, as the tokenizers library does by default. An empty
table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenlattice.llm.common import query, release, small_batches, table, text_of

VOCABULARY = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json
SPECIAL = ("<|endoftext|>", 50256)
PIECE = 16_384
WINDOW = 32  # tokens of each side that a join first looks at; more than SPECIAL has characters
ROWS = 256  # texts that a worker holds in Python at a time
AGREE = 2  # outer tokens that must come out as before


class Encoder:
    """One vocabulary in one worker."""

    def __init__(self, path: str, special: tuple[str, int] = SPECIAL) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.special = special[0]
        self.core = tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={special[0]: special[1]})
        self.bytes = {rank: token for token, rank in ranks.items()} | {special[1]: special[0].encode()}

    def encode(self, text: str) -> list[int]:
        if self.special in text:
            return self.core.encode(text, allowed_special={self.special}, disallowed_special=())
        return self.core.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.core.decode_bytes(ids).decode("utf-8", "replace")

    def inside(self, token: int) -> bool:
        """Whether a token starts within a character, or with an apostrophe that might open a suffix."""
        first = self.bytes[token][0]
        return first & 0xC0 == 0x80 or first == 0x27

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the two texts as one."""
        size = WINDOW
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            while a > 0 and self.inside(left[a]):
                a -= 1
            while b < len(right) and self.inside(right[b]):
                b += 1
            again = self.encode(b"".join(map(self.bytes.__getitem__, left[a:] + right[:b])).decode("utf-8"))
            if ((a == 0 or again[:AGREE] == left[a:a + AGREE])
                    and (b == len(right) or again[-AGREE:] == right[b - AGREE:b])):
                return left[:a] + again + right[b:]
            size *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """All parts in order as one, joined pairwise."""
        while len(parts) > 1:
            parts = [self.join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode_column(path: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [np.asarray(code.encode(text.as_py()), dtype=np.int32) for text in part.column("_text")]
                ends = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(name) for name in kept] + [column], names=[*kept, "ids"])
        release()
    return run


def _join_pieces(path: str, kept: list[str]):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_piece")
        ids = encoder(path).tree(group.column("ids").to_pylist())
        return group.slice(0, 1).select(kept).append_column("ids", pa.array([ids], pa.list_(pa.int32())))
    return run


def encode(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), path: str | None = None, piece: int = PIECE) -> DataFrame:
    """``columns`` of ``docs`` and ``ids``, the tokens of the whole text."""
    path = path or public_tokenizers.path(VOCABULARY)
    kept = list(columns)
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    given = T.StructType([T.StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)])
    names = given.fieldNames()  # a payload column may have any name, so it gets a plain one on the way
    texts = docs.select(*[F.col(c).alias(n) for c, n in zip(kept, names)], text_of().alias("_text"))
    short = texts.where(F.length("_text") <= piece).mapInArrow(_encode_column(path, names), T.StructType([*given, ids]))
    pieces = F.sequence(F.lit(0), ((F.length("_text") - 1) / piece).cast("int"))
    cut = (texts.where(F.length("_text") > piece).withColumn("_row", F.monotonically_increasing_id())
           .select("*", F.explode(pieces).alias("_piece"))
           .withColumn("_text", F.substr("_text", F.col("_piece") * piece + 1, F.lit(piece)))
           .repartition("_row", "_piece"))
    row = [T.StructField("_row", T.LongType()), T.StructField("_piece", T.IntegerType())]
    coded = cut.mapInArrow(_encode_column(path, [*names, "_row", "_piece"]), T.StructType([*given, *row, ids]))
    joined = coded.groupBy("_row").applyInArrow(_join_pieces(path, names), T.StructType([*given, ids]))
    return short.unionByName(joined).select(*[F.col(n).alias(c) for c, n in zip(kept, names)], "ids")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``coded`` with ``decoded``, the text of its tokens ``ids``."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [code.decode(tokens.values.to_numpy().tolist()) for tokens in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])
        release()

    return coded.mapInArrow(run, T.StructType([*coded.schema, T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of the tokens and of the text they decode to."""
    return decode(encode(docs)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: every document with its tokens, and the digest of the text they decode to."""
    small_batches(spark)
    return decode(encode(docs)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
