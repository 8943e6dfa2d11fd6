"""Alignment of two tokenizers against whole-text encoding and plain counting."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from greenlattice.llm import token_alignment as ta

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SCHEMA = "doc_id long, text string, block string, _row string, codes string"


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(ta.PIECES))


@pytest.fixture(scope="module")
def tools():
    return ta.pair(public_tokenizers.path(ta.BYTE_RANKS), public_tokenizers.path(ta.PIECES))


def byte_of():
    """Character to byte of byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain(both, texts):
    """Rows of the query, by the libraries and nested loops."""
    a_lib, b_lib = both
    back, docs, counts = byte_of(), [], Counter()
    for text in texts:
        links, row = [], (0, 0, 0, "")
        if text:
            a = a_lib.encode(" " + text, add_special_tokens=False).ids
            b = b_lib.encode(text)
            spelt_a = [bytes(back[c] for c in a_lib.id_to_token(i)) for i in a]
            names = [b_lib.id_to_piece(i) for i in b]
            spelt_b = [bytes([int(n[3:5], 16)]) if len(n) == 6 and n.startswith("<0x") else n.replace("▁", " ").encode() for n in names]
            want = (" " + text).encode()
            if b"".join(spelt_a) == want and b"".join(spelt_b) == want:
                ends_a, ends_b = (list(np.cumsum([len(x) for x in s])) for s in (spelt_a, spelt_b))
                common = sorted(set(ends_a) & set(ends_b))
                groups, x, y = [], 0, 0
                for end in common:
                    i, j = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
                    groups.append((a[x:i], b[y:j]))
                    for p in range(x, i):
                        for q in range(y, j):
                            if max(ends_a[p] - len(spelt_a[p]), ends_b[q] - len(spelt_b[q])) < min(ends_a[p], ends_b[q]):
                                links.append((a[p], b[q]))
                    x, y = i, j
                line = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
                row = (len(a), len(b), len(groups), hashlib.sha256(line.encode()).hexdigest())
        docs.append((row, links))
        counts.update(links)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    return [(*row[:3], len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), row[3]) for row, links in docs]


WORDS = ["the", "unbelievable", "ʻokina", "naïve", "日本語のテキスト", "x" * 40, "<|endoftext|>", "</s>", "don't", "3.14159", "\n\n", "  ", "\t",
         "🙂🙃", " ", "á", "ﬁ", "\x1c", " ", "…", "Ωmega", "_" * 9, "http://x.y/z?q=1"]


def odd_texts(seed=3, n=60):
    rng = random.Random(seed)
    texts = [None, "", " ", "  ", "\n", "a", " a", "a ", "▁", "a▁b c", "<s>", "<0x41> b", "the cat", "the cat", "\x00 b"]
    texts += [" ".join(rng.choices(WORDS, k=rng.randint(1, 40))) for _ in range(n)]
    texts += ["".join(rng.choices(WORDS, k=rng.randint(1, 40))) for _ in range(n // 3)]
    return texts


def rows_of(found):
    return {r.doc_id: tuple(r)[1:] for r in found.collect()}


@pytest.mark.parametrize("chunk", [ta.CHUNK, 50])
def test_equals_whole_text_encoding(spark, both, chunk):
    texts = odd_texts() + [" ".join(random.Random(9).choices(WORDS, k=4000)), "y" * 500 + " z" * 300]
    docs = spark.createDataFrame([(i, t, "b", "r", "c") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert rows_of(ta.align(docs, chunk=chunk)) == dict(enumerate(plain(both, texts)))


def test_given_documents(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert rows_of(ta.align(docs, chunk=2000)) == dict(zip([r.doc_id for r in rows], plain(both, [r.text for r in rows])))


def test_missing_ids(spark, both):
    texts = odd_texts(5, 20)
    docs = spark.createDataFrame([(None, t, "b", "r", "c") for t in texts], SCHEMA).repartition(2)
    found = sorted(map(tuple, ta.align(docs).drop("doc_id").collect()))
    assert found == sorted(plain(both, texts))


def test_small_cache(tools, monkeypatch):
    """What a worker forgets is encoded anew."""
    texts = [" " + t for t in odd_texts(8, 40) if t]
    want = list(tools.fragments(texts))
    monkeypatch.setattr(ta, "CACHE", 30)
    monkeypatch.setattr(ta, "CACHE_TOKENS", 50)
    for at in range(0, len(texts), 7):
        for x, y in zip(tools.fragments(texts[at:at + 7]), want[at:at + 7]):
            assert same(x, y)


def test_empty_table(spark):
    assert ta.align(spark.createDataFrame([], SCHEMA)).collect() == []


def parts_of(tools, text, cuts):
    """Fragments of a text between byte offsets, also inside of tokens and characters."""
    size = len(text.encode())
    edges = sorted({0, size, *[c % (size + 1) for c in cuts]})
    return [tools.fragment(text, x, y) for x, y in zip(edges, edges[1:])]


def same(x, y):
    return x.ok == y.ok and all(np.array_equal(getattr(x, n), getattr(y, n)) for n in ("a", "b", "ga", "gb"))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([w for w in WORDS if "▁" not in w]), min_size=1, max_size=25), st.lists(st.integers(0, 10**6), max_size=9), st.data())
def test_fragments_compose_in_any_grouping(tools, words, cuts, data):
    text = " " + " ".join(words)
    whole = tools.fragment(text)
    parts = parts_of(tools, text, cuts)
    assert same(ta.compose(parts), whole)
    while len(parts) > 1:  # neighbours in any order
        at = data.draw(st.integers(0, len(parts) - 2))
        parts[at:at + 2] = [ta.compose(parts[at:at + 2])]
    assert same(parts[0], whole)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(WORDS), min_size=1, max_size=60), st.integers(3, 60), st.booleans())
def test_ranges_give_the_whole(tools, words, chunk, spaced):
    text = " " + (" " if spaced else "").join(words)
    found = [tools.fragment(*r) for r in ta.ranges(text, chunk)]
    whole = tools.fragment(text)
    assert all(f.ok for f in found) == whole.ok
    if whole.ok:
        assert same(ta.compose(found), whole)
