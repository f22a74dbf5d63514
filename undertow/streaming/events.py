"""The event-side pipelines as streams, sharing their expressions with the batch models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import MODELS
from ..sources.contracts import contract
from ..sources.keyed import KeyedTable

# Producers may deliver an event this much out of order.
LATENESS = "2 minutes"
SESSION_GAP = "30 minutes"


def source(spark: SparkSession, path: str, role: str, files_per_batch: int | None = None) -> DataFrame:
    """New files of an event folder as a stream with the role's declared schema."""
    reader = spark.readStream.schema(contract(role))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def staged(events: DataFrame, model: str) -> DataFrame:
    """A staging model over a stream: the same function that builds the batch view."""
    return MODELS[model].build(events)


def deduplicated(events: DataFrame, at: str = "event_ts", key: str = "event_id") -> DataFrame:
    """Each event id once; state is kept only as long as a duplicate may still arrive."""
    return events.withWatermark(at, LATENESS).dropDuplicatesWithinWatermark([key])


def session_counts(views: DataFrame) -> DataFrame:
    """Page views per session and day, updated as late events arrive.

    The day is part of the key so that the watermark can drop finished sessions from state.
    """
    return (
        views.withWatermark("event_ts", LATENESS)
        .groupBy(F.window("event_ts", "1 day").alias("day"), "session_id")
        .agg(F.count("*").alias("page_view_count"), F.min("event_ts").alias("first_view_ts"))
        .select("session_id", F.to_date("day.start").alias("session_date"), "page_view_count", "first_view_ts")
    )


def sessions(views: DataFrame, by: str = "session_id") -> DataFrame:
    """Runs of activity separated by a gap; a session is given out once it can grow no more."""
    return (
        views.withWatermark("event_ts", LATENESS)
        .groupBy(F.session_window("event_ts", SESSION_GAP).alias("w"), by)
        .agg(F.count("*").alias("events"))
        .select(by, F.col("w.start").alias("started_ts"), F.col("w.end").alias("ended_ts"), "events")
    )


def facility_alerts(readings: DataFrame) -> DataFrame:
    """Temperature per facility and day, as the batch table of facility conditions has it."""
    return (
        readings.withWatermark("recorded_at", LATENESS)
        .groupBy("facility_id", F.window("recorded_at", "1 day").alias("day"))
        .agg(
            F.avg("celsius").alias("mean_temperature"),
            F.count_if("is_alert").alias("temperature_alerts"),
        )
        .select(
            "facility_id",
            F.to_date("day.start").alias("condition_date"),
            "mean_temperature",
            "temperature_alerts",
        )
    )


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Finished rows to a table, each exactly once, working through what is there."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def update_to(stream: DataFrame, path: str, checkpoint: str):
    """Changed rows to a folder per batch; :func:`current` gives the newest row of each key.

    A batch that is run again after a failure replaces its own folder, so nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key among the written batches."""
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*rest), "batch").alias("r")
    return changes.groupBy(*keys).agg(newest).select(*keys, "r.*")


def merge_to(stream: DataFrame, table: KeyedTable, checkpoint: str, tidy_every: int = 20):
    """Changed rows into a keyed table, one row a key, whatever the number of batches.

    A batch rewrites the buckets of its keys; every ``tidy_every`` batches the versions that nothing reads any more
    are deleted, so the folders stay as many as there are buckets and that many batches. A batch that is run again
    after a failure puts the same rows in place of themselves.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        table.upsert(batch)
        batch.unpersist()
        if number % tidy_every == tidy_every - 1:
            table.vacuum()

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def open_sessions(spark: SparkSession, checkpoint: str, by: str = "session_id") -> DataFrame:
    """The sessions that a stopped stream of :func:`sessions` still holds, as the state store has them.

    Together with those given out they are the sessions of all that was read.
    """
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(
        F.col(f"key.{by}").alias(by),
        F.col("value.session_window.start").alias("started_ts"),
        F.col("value.session_window.end").alias("ended_ts"),
        F.col("value.count").alias("events"),
    )
