"""Keyed logs against a dictionary, and calendar months that close."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F, types as T

from greenlattice.sources.keyed_log import KeyedLog
from greenlattice.streaming import ingest

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType()), T.StructField("at", T.LongType()),
                       T.StructField("v", T.DoubleType())])


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stored(log, spark):
    return {(r["k"], r["name"]): (r["at"], r["v"]) for r in log.read(spark, SCHEMA).collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.startswith("part-"))


def test_log_is_a_dictionary(spark, tmp_path):
    rng = random.Random(4)
    log, want = KeyedLog(str(tmp_path / "log"), ("k", "name"), ("at",), buckets=5), {}
    assert stored(log, spark) == {} and log.compact(spark, SCHEMA) == []
    for version in range(9):
        rows = [(rng.choice([None, *range(30)]), rng.choice("ab"), rng.randint(0, 3), float(rng.randint(0, 99))) for _ in range(25)]
        log.append(batch(spark, rows), version)
        if version % 3 == 0:
            log.append(batch(spark, rows), version)  # replayed
        newest = {}
        for k, name, at, v in rows:
            newest[k, name] = max(newest.get((k, name), (-1, -1.0)), (at, v))
        want |= newest
        if version in (3, 7):
            assert stored(log, spark) == want
            log.compact(spark, SCHEMA, deltas=3)
    assert stored(log, spark) == want
    log.compact(spark, SCHEMA, deltas=1)
    assert log.vacuum(spark) == list(range(9)) and stored(log, spark) == want
    log.append(batch(spark, [(1, "a", 0, -5.0)]), 9)  # an older order, but a newer version
    assert stored(log, spark) == want | {(1, "a"): (0, -5.0)}


def test_upserts_cost_as_much_as_their_batch(spark, tmp_path):
    log = KeyedLog(str(tmp_path / "big"), ("k", "name"), ("at",), buckets=4)
    log.append(spark.range(20_000).selectExpr("id AS k", "'n' AS name", "0L AS at", "rand(1) AS v"), 0)
    log.compact(spark, SCHEMA, deltas=1)
    before = size(log.path)
    log.append(batch(spark, [(5, "n", 1, 1.0)]), 1)
    assert size(log.path) - before < before / 50
    assert log.compact(spark, SCHEMA, deltas=2) == []
    base = size(f"{log.path}/base")
    assert len(log.compact(spark, SCHEMA, deltas=1)) == 1  # only the bucket of that key is written anew
    assert size(f"{log.path}/base") - base < base / 2
    found = stored(log, spark)
    assert len(found) == 20_000 and found[5, "n"] == (1, 1.0)


def test_uncommitted_versions_do_not_count(spark, tmp_path):
    log = KeyedLog(str(tmp_path / "torn"), ("k",), ("at",), buckets=2)
    log.append(batch(spark, [(1, "a", 0, 1.0)]), 0)
    log.append(batch(spark, [(1, "b", 0, 2.0)]), 1)
    os.remove(f"{log.path}/delta/version=1/_SUCCESS")
    assert stored(log, spark) == {(1, "a"): (0, 1.0)}
    log.append(batch(spark, [(1, "c", 0, 3.0)]), 1)
    assert stored(log, spark) == {(1, "c"): (0, 3.0)}


def test_streamed_upserts(spark, tmp_path):
    log, folder = KeyedLog(str(tmp_path / "s"), ("k",), ("at",), buckets=3), str(tmp_path / "in")
    offsets = str(tmp_path / "offsets")
    for i, rows in enumerate([[(1, "a", 0, 1.0), (2, "a", 0, 2.0)], [(1, "b", 1, 3.0)], [(2, "c", 0, 4.0), (3, "c", 0, 5.0)]]):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        ingest.upsert_stream(ingest.stream_table(spark, folder, "*.parquet", SCHEMA), log, offsets)
        assert log.state(spark)[0] == list(range(i + 1))
    want = {(1, "b"): (1, 3.0), (2, "c"): (0, 4.0), (3, "c"): (0, 5.0)}
    assert stored(log, spark) == want
    ingest.upsert_stream(ingest.stream_table(spark, folder, "*.parquet", SCHEMA), log)  # all files again as one batch: later than all before
    assert len(stored(log, spark)) == 3 and log.state(spark)[0] == [0, 1, 2, 3]


def test_months_close_and_leave_the_state(spark, tmp_path):
    schema = T.StructType.fromDDL("site string, day date, v double")
    folder, offsets, out = (str(tmp_path / n) for n in ("in", "offsets", "out"))
    batches = [[("a", (2023, 1, 5), 1.0), ("a", (2023, 1, 31), 3.0), ("b", (2023, 1, 2), 7.0)],
               [("a", (2023, 2, 1), 5.0), ("a", (2023, 1, 30), 5.0)],  # January is still open
               [("a", (2023, 3, 15), 9.0)],
               [("a", (2023, 1, 9), 100.0), ("b", (2023, 2, 2), 4.0), ("a", (2023, 4, 1), 2.0)],  # January is late now, February open
               [("a", (2023, 6, 1), 1.0)], [("a", (2023, 6, 2), 1.0)]]
    held, dropped = [], 0
    for rows in batches:
        spark.createDataFrame([(s, dt.date(*d), v) for s, d, v in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = ingest.closed_months(ingest.stream_table(spark, folder, "*.parquet", schema), "day", ["site"], ["v"])
        query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        dropped += sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress)
    got = {(r["site"], r["month"].month): (r["n"], r["v"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 1): (3, 3.0), ("b", 1): (1, 7.0), ("a", 2): (1, 5.0), ("b", 2): (1, 4.0), ("a", 3): (1, 9.0), ("a", 4): (1, 2.0)}
    assert dropped == 1 and max(held) <= 5 and held[-1] == 1  # only June is held
    with pytest.raises(ValueError):
        ingest.closed_months(spark.createDataFrame([], schema), "day", ["site"], ["v"], 40)
