"""Exact duplicates against plain grouping."""

import hashlib
import re

import pytest

from greenlattice.llm import exact_dedup

SCHEMA = "doc_id long, text string, text_sha256 string, digest string"


def plain(rows):
    groups = {}
    for doc_id, text in rows:
        key = hashlib.sha256(re.sub("[ \t-\r]+", " ", text or "").encode()).hexdigest()
        groups.setdefault(key, []).append(doc_id)
    return groups


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(parts)


ROWS = ([(i, "hot  text") for i in range(40, 90)] + [(i, f"own {i}") for i in range(200, 260)]
        + [(1, "a b"), (2, "a\t\nb"), (3, "a  b"), (4, " a b"), (5, "a b"), (6, None), (7, ""), (8, " "), (9, "\n\n"),
           (None, "a b"), (None, "no id"), (None, "no id"), (10, "twice"), (10, "twice"), (11, "twice"), (12, "x" * 300_000 + "  y"),
           (13, "x" * 300_000 + " y")])


@pytest.mark.parametrize("tracked,candidates", [(4096, 1024), (16, 4), (8, 1)])
def test_groups_equal_plain_ones(spark, tracked, candidates):
    got = exact_dedup.exact_duplicates(frame(spark, ROWS), tracked, candidates).collect()
    want = plain(ROWS)
    assert len(got) == len(ROWS)
    for row in got:
        ids = want[row.text_sha256]
        named = [i for i in ids if i is not None]
        assert row.group_size == len(ids) and row.keep_id == (min(named) if named else None)
        assert not row.kept or row.doc_id == row.keep_id
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted(want)  # one row of each group, repeated rows and missing ids too


def test_heavy_hitters_are_verified(spark):
    rows = exact_dedup.digests(frame(spark, ROWS))
    heavy = exact_dedup.heavy_hitters(rows, 16, 4).collect()
    sizes = {k: len(v) for k, v in plain(ROWS).items()}
    hot = hashlib.sha256(b"hot text").hexdigest()
    assert hot in {r.text_sha256 for r in heavy} and len(heavy) <= 4
    for r in heavy:
        assert r._size == sizes[r.text_sha256] and r._size > 1 and r._size * 16 >= len(ROWS)
    assert next(r for r in heavy if r.text_sha256 == hot)._first.doc_id == 40


def test_deduplicated_rows_keep_their_columns(spark):
    docs = frame(spark, ROWS)
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(plain(ROWS)) and {(r.text_sha256, r.digest) for r in rows} == {("x", "y")}
    assert sorted(plain([(r.doc_id, r.text) for r in rows])) == sorted(plain(ROWS))


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [], 1)).collect() == []
    assert exact_dedup.deduplicated(frame(spark, [], 1)).collect() == []
