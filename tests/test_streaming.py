import os

import pytest
from pyspark.sql import functions as F

from undertow.sources.keyed import KeyedTable
from undertow.streaming import events


@pytest.fixture(scope="module")
def feed(w, tmp_path_factory):
    """The page views and readings as several files, in time order with some out of place."""
    folder = tmp_path_factory.mktemp("feed")
    views = w["ev_page_views"].orderBy("event_ts_ms")
    views.repartitionByRange(4, "event_ts_ms").write.parquet(f"{folder}/views")
    w["ops_temperature_readings"].coalesce(1).write.parquet(f"{folder}/readings")
    return str(folder)


def test_staged_stream_equals_the_batch_view(spark, w, feed, tmp_path):
    stream = events.staged(events.source(spark, f"{feed}/views", "ev_page_views", 1), "stg_page_views")
    events.append_to(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").select(*w["stg_page_views"].columns)
    assert out.exceptAll(w["stg_page_views"]).isEmpty() and out.count() == w["stg_page_views"].count()


def test_session_counts_end_as_the_batch_does(spark, w, feed, tmp_path):
    stream = events.staged(events.source(spark, f"{feed}/views", "ev_page_views"), "stg_page_views")
    events.update_to(events.session_counts(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = events.current(spark.read.parquet(f"{tmp_path}/out"), ["session_id", "session_date"])
    want = w["stg_page_views"].groupBy("session_id").agg(F.count("*").alias("n"))
    joined = got.join(want, "session_id", "full")
    assert joined.where(~F.col("page_view_count").eqNullSafe(F.col("n"))).isEmpty()


def test_sessions_hold_back_only_the_open_tail(spark, w, feed, tmp_path):
    stream = events.staged(events.source(spark, f"{feed}/views", "ev_page_views"), "stg_page_views")
    events.append_to(events.sessions(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    batch = w["stg_page_views"].groupBy(
        F.session_window("event_ts", events.SESSION_GAP).alias("s"), "session_id"
    ).agg(F.count("*").alias("events"))
    newest = w["stg_page_views"].agg(F.max("event_ts")).first()[0]
    closed = batch.where(F.col("s.end") <= F.lit(newest) - F.expr(f"interval {events.LATENESS}"))
    assert got.count() == closed.count() and 0 <= batch.count() - got.count() < batch.count()


def test_a_repeated_event_is_counted_once(spark, feed, tmp_path):
    views = spark.read.parquet(f"{feed}/views").limit(50)
    views.unionByName(views).write.parquet(f"{tmp_path}/twice")
    stream = events.staged(events.source(spark, f"{tmp_path}/twice", "ev_page_views"), "stg_page_views")
    events.append_to(events.deduplicated(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 50 == out.select("event_id").distinct().count()


def test_facility_days_end_as_the_batch_does(spark, w, feed, tmp_path):
    stream = events.staged(
        events.source(spark, f"{feed}/readings", "ops_temperature_readings"), "o_stg_temperature_readings"
    )
    events.update_to(events.facility_alerts(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = events.current(spark.read.parquet(f"{tmp_path}/out"), ["facility_id", "condition_date"])
    want = w["o_int_facility_conditions"]
    assert got.select(*want.columns).exceptAll(want).isEmpty() and got.count() == want.count()


def test_open_sessions_are_the_rest_of_the_batch(spark, w, feed, tmp_path):
    """Cut by the watermark of the last batch: what was given out and what is still held are all sessions."""
    stream = events.staged(events.source(spark, f"{feed}/views", "ev_page_views"), "stg_page_views")
    events.append_to(events.sessions(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    closed = spark.read.parquet(f"{tmp_path}/out")
    held = events.open_sessions(spark, f"{tmp_path}/cp")
    batch = w["stg_page_views"].groupBy(F.session_window("event_ts", events.SESSION_GAP).alias("s"), "session_id")
    batch = batch.agg(F.count("*").alias("events")).select("session_id", "s.start", "s.end", "events")
    both = closed.unionByName(held.select(*closed.columns))
    assert not held.isEmpty() and both.exceptAll(batch).isEmpty() and both.count() == batch.count()


def test_a_merged_rollup_keeps_one_row_a_key_in_a_bounded_number_of_folders(spark, w, tmp_path, monkeypatch):
    views = w["ev_page_views"].orderBy("event_ts_ms")
    views.repartitionByRange(24, "event_ts_ms").write.parquet(f"{tmp_path}/views")
    for i, file in enumerate(sorted(f for f in os.listdir(f"{tmp_path}/views") if f.startswith("part"))):
        os.utime(f"{tmp_path}/views/{file}", (1_700_000_000 + i, 1_700_000_000 + i))  # files arrive in the order of time
    schema = "session_id string, session_date date, page_view_count bigint, first_view_ts timestamp"
    table = KeyedTable(spark, f"{tmp_path}/table", schema, ["session_id", "session_date"], 2)
    stream = events.staged(events.source(spark, f"{tmp_path}/views", "ev_page_views", 1), "stg_page_views")
    counts, upsert = events.session_counts(stream), KeyedTable.upsert
    calls = []

    def failing(self, batch):
        calls.append(1)
        found = upsert(self, batch)
        if len(calls) == 4:
            raise RuntimeError("stopped after the batch was stored")
        return found

    monkeypatch.setattr(KeyedTable, "upsert", failing)
    with pytest.raises(Exception, match="stopped"):
        events.merge_to(counts, table, f"{tmp_path}/cp", 5).awaitTermination()
    events.merge_to(counts, table, f"{tmp_path}/cp", 5).awaitTermination()  # the fourth batch runs again
    want = w["stg_page_views"].groupBy("session_id").agg(F.count("*").alias("n"))
    got = table.read()
    assert got.count() == got.select("session_id", "session_date").distinct().count()
    assert got.groupBy("session_id").agg(F.sum("page_view_count").alias("n")).exceptAll(want).isEmpty()
    folders = [d for d in os.listdir(f"{tmp_path}/table/data") if d.startswith("version=")]
    assert len(calls) >= 24 and len(folders) <= 5 + 2 * table.buckets
