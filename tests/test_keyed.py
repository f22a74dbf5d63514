"""Stored tables: replacement by key, removal, failures half way, and what is kept of older versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphs import asset, graph
from undertow.operators import publishing
from undertow.sources import sinks
from undertow.sources.keyed import KeyedTable

SCHEMA = "asset string, property string, value string, bucket_no int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, tmp_path, buckets=8):
    return KeyedTable(spark, str(tmp_path / "values"), SCHEMA, ["asset"], buckets)


def versions(path, name="data"):
    return sorted(d for d in os.listdir(f"{path}/{name}") if not d.startswith((".", "_")))


def test_upserts_and_a_removal_agree_with_the_frame_expressions(spark, tmp_path, rows):
    random.seed(1)
    stored, want = table(spark, tmp_path), frame(spark, [])
    assert stored.read().isEmpty() and stored.remove(F.col("property") == "x") == 0 and stored.vacuum() == 0
    for n in range(3):
        some = [(random.choice([None, "a", "b", f"k{random.randrange(30)}"]), f"undertow_{i}" if i % 3 else "note", f"{n}", i) for i in range(25)]
        stored.upsert(frame(spark, some))
        keys = {r[0] for r in some}
        kept = [tuple(r) for r in want.collect() if r["asset"] not in keys]
        want = frame(spark, kept + some)
        assert rows(stored.read()) == rows(want)
    stored.remove(F.col("property").startswith(publishing.PROPERTY_PREFIX))
    assert rows(stored.read()) == rows(publishing.without_prefix(want))
    stored.remove(F.lit(True))
    assert stored.read().isEmpty()


def test_a_batch_reads_and_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    stored = table(spark, tmp_path, 16)
    stored.upsert(frame(spark, [(f"k{i}", "p", "old", i) for i in range(200)]))
    before = set(stored._places())
    assert stored.upsert(frame(spark, [("k7", "p", "new", 0), ("k7", "q", "new", 1)])) == 1
    after = set(stored._places())
    assert len(before & after) == len(before) - 1
    assert stored.read().where("asset = 'k7'").count() == 2 and stored.read().count() == 201
    assert stored.upsert(frame(spark, [])) == 0 and set(stored._places()) == after


def test_a_job_that_fails_half_way_leaves_the_table_as_it_was(spark, tmp_path, rows):
    stored = table(spark, tmp_path)
    stored.upsert(frame(spark, [("a", "p", "1", 0), ("b", "p", "1", 0)]))
    was = rows(stored.read())
    bad = frame(spark, [("a", "p", "2", 0)]).withColumn("value", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        stored.upsert(bad.select(*stored.schema.names))
    frame(spark, [("a", "p", "half", 0)]).write.parquet(f"{stored.path}/data/version=half/bucket_of_key=1")  # no commit names it
    assert rows(stored.read()) == was
    stored.upsert(frame(spark, [("a", "p", "2", 0)]))
    once = rows(stored.read())
    stored.upsert(frame(spark, [("a", "p", "2", 0)]))
    assert rows(stored.read()) == once == sorted([("a", "p", "2", 0), ("b", "p", "1", 0)], key=repr)
    stored.vacuum(1)
    assert "version=half" not in versions(stored.path) and rows(stored.read()) == once


def test_vacuum_keeps_what_the_last_commits_read(spark, tmp_path, rows):
    stored = table(spark, tmp_path, 2)
    for n in range(6):
        stored.upsert(frame(spark, [(f"k{i}", "p", str(n), i) for i in range(10)]))
    earlier = stored.read()  # of the sixth commit
    stored.upsert(frame(spark, [("k1", "p", "last", 1)]))
    assert len(versions(stored.path)) == 7 and stored.vacuum(keep=2) == 5
    assert earlier.where("value = '5'").count() == 10 and stored.read().where("value = 'last'").count() == 1
    assert stored.vacuum(keep=1) == 0  # the other bucket still is what the sixth commit wrote
    assert stored.read().count() == 10


def test_refreshed_tables_keep_n_versions_and_those_being_read(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.refresh(spark.range(1), path)
    with sinks.reading(spark, path) as held:
        for n in range(2, 11):
            sinks.refresh(spark.range(n), path)
        assert len(versions(path, "versions")) == 10 and sinks.vacuum(spark, path, keep=3) == 6
        assert held.count() == 1 and len(versions(path, "versions")) == 4
    assert sinks.vacuum(spark, path, keep=3) == 1 and sinks.current(spark, path).count() == 10
    assert sinks.vacuum(spark, str(tmp_path / "none")) == 0


def test_snapshots_that_no_read_names_go(spark, tmp_path):
    folder = str(tmp_path / "snapshots")
    graphs = [graph(spark, [asset(name)], [], owners=[(name, "ann")]) for name in ("a.x", "a.y")]
    first = sinks.store_snapshot(graphs[0], folder, "2026-01-01T00:00:00Z", "here")[0]
    assert not sinks.store_snapshot(graphs[0], folder, "2026-01-02T00:00:00Z", "here")[1]
    second = sinks.store_snapshot(graphs[1], folder, "2026-01-03T00:00:00Z", "here")[0]
    assert len(versions(folder, "parts")) == 3 and sinks.vacuum_snapshots(spark, folder) == 1
    assert sinks.load_snapshot(spark, folder, first).fingerprint().first()[0] == first
    assert sinks.vacuum_snapshots(spark, folder, keep=1) == 1
    assert sinks.load_snapshot(spark, folder, second).fingerprint().first()[0] == second
