"""Alignment of two tokenizers over whole texts, by fragments that compose in any grouping.

Tokenizer A is byte-level BPE, tokenizer B a sentence-piece BPE. Both spell the same bytes,
a space and the text. Byte offsets at which a token of each ends cut both sequences into
groups; inside a group every pair of an A and a B token that overlap is a link.

* A **fragment** is what one byte range knows: the A and B tokens that end in it, and how
  many of each lie before its first common end (open prefix), between common ends (closed
  groups) and after the last (open suffix). ``compose`` joins neighbours: the left suffix
  and the right prefix become one group, all else stays. It is associative, and a range
  without a common end is a fragment that is open on both sides.
* Texts of over ``CHUNK`` code points are cut into byte ranges at fixed steps, also inside
  of tokens. A range is encoded with its surroundings out to the next place on each side
  that no token of either tokenizer can span (a lone space between two other characters)
  and keeps the tokens that end in it. Ranges are rows of their own, spread over all
  executors, and are reduced up a tree of ``FAN`` fragments a step. A stretch without such
  a place that is longer than a range is not cut.
* Between two such places tokens depend on nothing else, so a worker remembers the tokens of
  the stretches it met last.

Corpus counts: documents are collected in blocks of about ``BLOCK_LINKS`` links. A block
holds a dictionary of its linked id pairs; the dictionaries are summed over the corpus, joined
with the totals (a pair comes once a block at most, however frequent it is), and go back to
their block, where each document's links look up theirs. No total is broadcast.

Nulls: null and empty texts, and texts that either tokenizer spells otherwise, have no tokens:
zeros and an empty digest. Repeated rows are aligned each and count each. Rows without a
doc_id are aligned as well. An empty table gives an empty result. Only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenlattice.llm.common import keep, query, release, table, text_of

BYTE_RANKS = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json
PIECES = "piece_bpe_32k.model"
CHUNK = 65_536  # code points of a range
FAN = 8  # fragments that one step joins
BLOCK_LINKS = 1 << 18
BLOCK_DOCS = 1 << 14
ROWS = 256  # texts that a worker holds in Python at a time
CACHE = 65_536  # stretches at hand
CACHE_TOKENS = 1 << 20  # and their tokens
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
BITS = 17  # ids of B; an id pair is (B << BITS) | A


class Fragment:
    """Tokens ``a`` and ``b`` that end in a byte range; ``ga`` and ``gb`` count them from one common end to the next.

    The first count is the open prefix, the last the open suffix; one count is a range without
    a common end. ``ok`` says whether both tokenizers spell the range.
    """

    __slots__ = ("a", "b", "ga", "gb", "ok")

    def __init__(self, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, ok: bool) -> None:
        self.a, self.b, self.ga, self.gb, self.ok = a, b, ga, gb, ok


#: A range that B spells otherwise.
NOTHING = Fragment(np.empty(0, np.int32), np.empty(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64), False)


def compose(parts: list[Fragment]) -> Fragment:
    """Neighbouring fragments, in order, as one."""
    def counts(name: str) -> np.ndarray:
        out: list[np.ndarray] = []
        for part in parts:
            own = getattr(part, name)
            if out:  # an open suffix and an open prefix are one group
                last = out[-1].copy()
                last[-1] += own[0]
                out[-1] = last
                own = own[1:]
            if len(own):
                out.append(own)
        return np.concatenate(out)

    return Fragment(np.concatenate([p.a for p in parts]), np.concatenate([p.b for p in parts]),
                    counts("ga"), counts("gb"), all(p.ok for p in parts))


def between(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of A and of B tokens from one common end to the next."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return tuple(np.diff(np.searchsorted(ends, common, "right"), prepend=0, append=len(ends)) for ends in (ends_a, ends_b))


class Pair:
    """Both tokenizers in one worker."""

    def __init__(self, path_a: str, path_b: str) -> None:
        with open(path_a, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.core = tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any(re.search("[^▁]▁", name) for name in names):
            raise ValueError("a piece of B goes on after a space: stretches between spaces are not apart")
        self.bytes_b = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode()
                        for n in names]
        self.size_a = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size_a[rank] = len(token)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        if len(self.size_a) > 1 << BITS:
            raise ValueError("ids of A need more bits")
        # an id, as it stands before a comma, before the end of A's part, and before the end of the group
        self.spelt = np.array([f"{i}{end}" for end in (",", "|") for i in range(len(self.size_a))]
                              + [f"{i}{end}" for end in (",", ";") for i in range(len(self.size_b))], object)
        self.forget()

    def forget(self) -> None:
        """Stretches at hand: their numbers, and by number their tokens and whether B spells them."""
        self.known: dict[str, int] = {}
        self.flat = [np.empty(0, np.int32)] * 2
        self.edge = [np.zeros(1, np.int64)] * 2
        self.spells = np.empty(0, np.bool_)

    def learn(self, stretches: set[str]) -> None:
        """Hold the tokens of stretches (without the space that each begins with; B puts it there itself)."""
        new = stretches.difference(self.known)
        if len(self.known) + len(new) > CACHE or len(self.flat[0]) > CACHE_TOKENS:
            self.forget()
            new = stretches
        bare, edged = [], []  # those that begin or end with white space are not apart from others
        for s in new:
            (edged if not s or s[0].isspace() or s[-1].isspace() else bare).append(s)
        asked = bare + edged
        if not asked:
            return
        spelt = [(" " + s).encode("utf-8", "surrogatepass") for s in asked]
        a = np.array(self.core.encode_ordinary("".join([" " + s for s in bare])), np.int32)
        many_a = np.diff(np.searchsorted(self.size_a[a].cumsum(), np.cumsum([len(x) for x in spelt[:len(bare)]]), "right"), prepend=0)
        others = [self.core.encode_ordinary(" " + s) for s in edged]
        b = self.pieces.encode(asked, num_threads=1)
        spells = [b"".join([self.bytes_b[i] for i in ids]) == x for ids, x in zip(b, spelt)]
        flat = [np.concatenate([a, *[np.array(x, np.int32) for x in others]]), np.fromiter(chain.from_iterable(b), np.int32)]
        many = [np.concatenate([many_a, np.array([len(x) for x in others], np.int64)]), np.array([len(x) for x in b], np.int64)]
        self.known.update(zip(asked, range(len(self.known), len(self.known) + len(asked))))
        self.flat = [np.concatenate(x) for x in zip(self.flat, flat)]
        self.edge = [np.concatenate([e, e[-1] + n.cumsum()]) for e, n in zip(self.edge, many)]
        self.spells = np.concatenate([self.spells, spells])

    def tokens(self, side: int, at: np.ndarray, texts: np.ndarray) -> list[np.ndarray]:
        """Tokens of texts, given the numbers of their stretches and how many each has."""
        begin, n = self.edge[side][at], self.edge[side][at + 1] - self.edge[side][at]
        ends = n.cumsum()
        flat = self.flat[side][np.repeat(begin - ends + n, n) + np.arange(n.sum())]
        return np.split(flat, np.append(0, ends)[texts.cumsum()[:-1]])

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Tokens of texts that begin with a space, and whether B spells them (A always does)."""
        if not texts:
            return
        parts = [BETWEEN.split(text) for text in texts]
        for p in parts:
            p[0] = p[0][1:]
        self.learn(set().union(*parts))
        many = np.array([len(p) for p in parts])
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, many.sum())
        ok = np.logical_and.reduceat(self.spells[at], many.cumsum() - many)
        yield from zip(self.tokens(0, at, many), self.tokens(1, at, many), ok.tolist())

    def fragments(self, given: list[tuple[str, int, int] | str]) -> Iterator[Fragment]:
        """Fragments of texts: of all their bytes, or of those from the second to the third of a triple."""
        asked = [g if isinstance(g, tuple) else (g, 0, None) for g in given]
        for (_, begin, end), (a, b, ok) in zip(asked, self.encode([text for text, _, _ in asked])):
            if not ok:
                yield NOTHING
                continue
            ends_a, ends_b = self.size_a[a].cumsum(), self.size_b[b].cumsum()
            if end is not None:
                in_a, in_b = ((ends > begin) & (ends <= end) for ends in (ends_a, ends_b))
                a, b, ends_a, ends_b = a[in_a], b[in_b], ends_a[in_a], ends_b[in_b]
            yield Fragment(a, b, *between(ends_a, ends_b), True)

    def fragment(self, text: str, begin: int = 0, end: int | None = None) -> Fragment:
        return next(self.fragments([(text, begin, end)]))

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id pair of every link of whole texts, in order."""
        ends_a, ends_b = self.size_a[a].cumsum(), self.size_b[b].cumsum()
        steps = np.union1d(ends_a, ends_b)  # between two steps one token of each is open
        of_a, of_b = a[np.searchsorted(ends_a, steps)], b[np.searchsorted(ends_b, steps)]
        return of_b.astype(np.int64) << BITS | of_a

    def digest(self, whole: Fragment) -> str:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``."""
        ga, gb = whole.ga[:-1], whole.gb[:-1]
        at_a, at_b = whole.a.astype(np.int64), whole.b.astype(np.int64) + 2 * len(self.size_a)
        at_a[ga.cumsum() - 1] += len(self.size_a)
        at_b[gb.cumsum() - 1] += len(self.size_b)
        group_a, group_b = np.repeat(np.arange(len(ga)), ga), np.repeat(np.arange(len(gb)), gb)
        order = np.empty(len(at_a) + len(at_b), np.int64)
        order[np.arange(len(at_a)) + (gb.cumsum() - gb)[group_a]] = at_a
        order[np.arange(len(at_b)) + ga.cumsum()[group_b]] = at_b
        return hashlib.sha256("".join(self.spelt[order].tolist())[:-1].encode()).hexdigest()


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def place_before(text: str, at: int, least: int) -> int:
    """The last place at or before ``at`` that no token spans; -1 if there is none from ``least`` on."""
    while (at := text.rfind(" ", max(least, 1), at + 1)) > 0:
        if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
        at -= 1
    return -1


def ranges(text: str, chunk: int) -> Iterator[tuple[str, int, int]]:
    """Byte ranges of a text, each with its surroundings: (stretch of text, begin and end in it)."""
    n = len(text)
    cuts = [(0, 0, 0)]  # cut, place before, place after
    for at in range(chunk, n, chunk):
        before = place_before(text, at, at - chunk)
        after = BETWEEN.search(text, at, min(n, at + chunk + 2))
        if before > 0 and after:
            cuts.append((at, before, after.start()))
    cuts.append((n, n, n))
    for (begin, start, _), (end, _, stop) in zip(cuts, cuts[1:]):
        part = text[start:stop]
        lead, inside = (len(text[x:y].encode("utf-8", "surrogatepass")) for x, y in ((start, begin), (begin, end)))
        yield part, lead, lead + inside


BLOCKED = ("kind int, block long, doc_id {id}, n_a long, n_b long, n_groups long, groups_sha256 string, "
           "slots array<int>, times array<int>, codes array<long>, totals array<long>")


class Blocks:
    """Documents of one task, in blocks: a row per document (kind 0) and one of the dictionary (kind 1)."""

    def __init__(self, tools: Pair, id_type: pa.DataType, side: int) -> None:
        self.tools, self.id_type = tools, id_type
        self.next = side << 62 | TaskContext.get().partitionId() << 32  # texts and joined fragments number theirs apart
        self.clear()

    def clear(self) -> None:
        self.ids: list = []
        self.codes: list[np.ndarray] = []
        self.facts: list[tuple[int, int, int, str]] = []
        self.links = 0

    def add(self, doc_id, whole: Fragment) -> Iterator[pa.RecordBatch]:
        known = whole.ok and len(whole.a) > 0
        codes = self.tools.linked(whole.a, whole.b) if known else np.empty(0, np.int64)
        self.ids.append(doc_id)
        self.codes.append(codes)
        self.facts.append((len(whole.a), len(whole.b), len(whole.ga) - 1, self.tools.digest(whole)) if known else (0, 0, 0, ""))
        self.links += len(codes)
        if self.links >= BLOCK_LINKS or len(self.ids) >= BLOCK_DOCS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        n, sizes = len(self.ids), [len(c) for c in self.codes]
        pairs, slot, totals = np.unique(np.concatenate(self.codes), return_inverse=True, return_counts=True)
        width = max(1, len(pairs))
        own, times = np.unique(np.repeat(np.arange(n), sizes) * width + slot, return_counts=True)
        edges = np.searchsorted(own, np.arange(n + 1) * width).astype(np.int32)
        block, self.next = self.next, self.next + 1

        def lists(edges: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))

        for at in range(0, n, ROWS):  # small batches out
            part = slice(at, min(n, at + ROWS))
            m = part.stop - at
            none = lists(np.zeros(m + 1, np.int32), np.empty(0, np.int64), pa.int64())
            begin, end = edges[at], edges[part.stop]
            inner = edges[at:part.stop + 1] - begin
            n_a, n_b, n_groups, digests = zip(*self.facts[part])
            yield self.batch([0] * m, [block] * m, pa.array(self.ids[part], self.id_type), n_a, n_b, n_groups, pa.array(digests, pa.string()),
                             lists(inner, own[begin:end] % width, pa.int32()), lists(inner, times[begin:end], pa.int32()), none, none)
        empty = lists(np.zeros(2, np.int32), np.empty(0, np.int32), pa.int32())
        whole = np.array([0, len(pairs)])
        yield self.batch([1], [block], pa.array([None], self.id_type), [0], [0], [0], pa.array([""]), empty, empty,
                         lists(whole, pairs, pa.int64()), lists(whole, totals, pa.int64()))
        self.clear()

    @staticmethod
    def batch(kind, block, ids, n_a, n_b, n_groups, digests, slots, times, codes, totals) -> pa.RecordBatch:
        long = pa.int64()
        return pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(block, long), ids, pa.array(n_a, long), pa.array(n_b, long), pa.array(n_groups, long), digests,
             slots, times, codes, totals],
            names=["kind", "block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "slots", "times", "codes", "totals"])


class Aligner:
    """The functions that Spark runs, with their parameters."""

    def __init__(self, path_a: str, path_b: str, chunk: int) -> None:
        self.paths, self.chunk = (path_a, path_b), chunk

    def short(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of whole texts."""
        tools, blocks = pair(*self.paths), None
        for batch in batches:
            blocks = blocks or Blocks(tools, batch.schema.field("doc_id").type, 0)
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column("_text").to_pylist()
                found = tools.fragments([" " + text for text in texts if text])
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                    yield from blocks.add(doc_id, next(found) if text else NOTHING)
        if blocks:
            yield from blocks.flush()
        release()

    def cut(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Byte ranges of long texts."""
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                parts = list(ranges(" " + own.column("_text")[0].as_py(), self.chunk))
                for at in range(0, len(parts), FAN):
                    some = parts[at:at + FAN]
                    here = pa.array(np.zeros(len(some), np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [own.column("doc_id").take(here), own.column("_row").take(here), pa.array(range(at, at + len(some)), pa.int64()),
                         pa.array([p[0] for p in some]), pa.array([p[1] for p in some], pa.int64()), pa.array([p[2] for p in some], pa.int64())],
                        names=["doc_id", "_row", "_at", "_text", "_begin", "_end"])

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fragments of byte ranges."""
        tools = pair(*self.paths)
        for batch in batches:
            for i in range(batch.num_rows):
                text, begin, end = (batch.column(c)[i].as_py() for c in ("_text", "_begin", "_end"))
                yield fragment_row(batch.slice(i, 1), tools.fragment(text, begin, end))
        release()

    @staticmethod
    def join(group: pa.Table) -> pa.Table:
        """Neighbouring fragments of a text as one."""
        group = group.sort_by("_at")
        parts = [Fragment(*(group.column(c)[i].values.to_numpy() for c in ("a", "b", "ga", "gb")), group.column("ok")[i].as_py())
                 for i in range(group.num_rows)]
        first = group.slice(0, 1).combine_chunks().to_batches()[0]
        out = fragment_row(first, compose(parts))
        return pa.Table.from_batches([out]).set_column(2, "_at", pa.array([first.column("_at")[0].as_py() // FAN], pa.int64()))

    def joined(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of texts whose fragments are joined."""
        tools, blocks = pair(*self.paths), None
        for batch in batches:
            blocks = blocks or Blocks(tools, batch.schema.field("doc_id").type, 1)
            for i in range(batch.num_rows):
                a, b, ga, gb = (batch.column(c)[i].values.to_numpy() for c in ("a", "b", "ga", "gb"))
                yield from blocks.add(batch.column("doc_id")[i].as_py(), Fragment(a, b, ga, gb, batch.column("ok")[i].as_py()))
        if blocks:
            yield from blocks.flush()
        release()


FRAGMENT = "_row long, _at long, a array<int>, b array<int>, ga array<long>, gb array<long>, ok boolean"


def fragment_row(own: pa.RecordBatch, f: Fragment) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [own.column("doc_id"), own.column("_row"), own.column("_at"), pa.array([f.a], pa.list_(pa.int32())), pa.array([f.b], pa.list_(pa.int32())),
         pa.array([f.ga], pa.list_(pa.int64())), pa.array([f.gb], pa.list_(pa.int64())), pa.array([f.ok])],
        names=["doc_id", "_row", "_at", "a", "b", "ga", "gb", "ok"])


def _resolve(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Documents of one block, with the corpus counts of its dictionary."""
    count = np.zeros(found.num_rows, np.int64)
    best = np.zeros(found.num_rows, np.bool_)
    slot = found.column("slot").to_numpy()
    count[slot], best[slot] = found.column("count").to_numpy(), found.column("best").to_numpy()
    n_links, n_best, total = [], [], []
    for slots, times in zip(docs.column("slots"), docs.column("times")):
        at, t = slots.values.to_numpy(), times.values.to_numpy().astype(np.int64)
        n_links.append(int(t.sum()))
        n_best.append(int(t[best[at]].sum()))
        total.append(int((t * count[at]).sum()))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups"])
    for name, values in (("n_links", n_links), ("n_best", n_best), ("count_sum", total)):
        out = out.append_column(name, pa.array(values, pa.int64()))
    return out.append_column("groups_sha256", docs.column("groups_sha256"))


def blocked(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """The documents in blocks with their dictionaries, stored."""
    run = Aligner(path_a or public_tokenizers.path(BYTE_RANKS), path_b or public_tokenizers.path(PIECES), chunk)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", text_of().alias("_text"))
    schema = BLOCKED.format(id=id_type)
    short = given.where(F.length("_text") < chunk).mapInArrow(run.short, schema)
    long = given.where(F.length("_text") >= chunk).withColumn("_row", F.monotonically_increasing_id())
    cut = long.mapInArrow(run.cut, f"doc_id {id_type}, _row long, _at long, _text string, _begin long, _end long")
    form = f"doc_id {id_type}, {FRAGMENT}"
    parts = keep(cut.repartition("_row", "_at").mapInArrow(run.encode, form))
    width = (parts.agg(F.max("_at")).first()[0] or 0) + 1
    while width > 1:  # one step of the tree for all texts
        parts = parts.groupBy("_row", F.floor(F.col("_at") / FAN)).applyInArrow(Aligner.join, form)
        width = -(-width // FAN)
    return keep(short.unionByName(parts.mapInArrow(run.joined, schema)))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs`` (doc_id, text)."""
    rows = blocked(docs, path_a, path_b, chunk)
    words = rows.where("kind = 1").select("block", F.posexplode(F.arrays_zip("codes", "totals")).alias("slot", "z")).select(
        F.col("block").alias("_block"), "slot", F.col("z.codes").alias("code"), F.col("z.totals").alias("total"))
    counts = keep(words.groupBy("code").agg(F.sum("total").alias("count")))
    of_b = F.shiftright("code", BITS).alias("_b")
    most = counts.groupBy(of_b).agg(F.max("count").alias("_most"))
    marked = counts.withColumn("_b", of_b).join(most, "_b").select("code", "count", (F.col("count") == F.col("_most")).alias("best"))
    found = words.drop("total").join(marked, "code").select("_block", "slot", "count", "best")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.where("kind = 0").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "slots", "times").groupBy("block").cogroup(
        found.groupBy("_block")).applyInArrow(
        _resolve, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
