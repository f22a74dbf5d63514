"""Run history: the latest run, missed runs, evidence, freshness and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.ordered import previous, running_max
from ..functions.scalars import instant

MAX_AGE_HOURS = 25
STATUSES = ("succeeded", "failed")


def latest(records: DataFrame, by: list[str], at: str, tie: str) -> DataFrame:
    """The newest record per group; an unreadable time counts as older than any other."""
    order = F.struct(F.coalesce(instant(F.col(at)), F.lit("0001-01-01").cast("timestamp")), tie)
    whole = F.struct(*[F.col(c) for c in records.columns])
    return records.groupBy(*by).agg(F.max_by(whole, order).alias("r")).select("r.*")


def missed(attempts: DataFrame, reads: DataFrame) -> DataFrame:
    """Attempts that did not succeed after their own target's last good run.

    An attempt without a target, or whose target has no good run, is held against the newest
    good run of any target. That one instant is a scalar subquery.
    """
    good = reads.groupBy("target").agg(F.max(instant(F.col("read_at"))).alias("own_cutoff"))
    newest = reads.agg(F.max(instant(F.col("read_at")))).scalar()
    late = attempts.where(~F.col("status").eqNullSafe("succeeded")).withColumn(
        "attempted_ts", instant(F.col("attempted_at"))
    )
    return (
        late.join(good, "target", "left")
        .where(F.col("attempted_ts") > F.coalesce("own_cutoff", newest))
        .drop("own_cutoff")
    )


def missed_per_target(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("target", F.lit("(none)")).alias("target")).agg(
        F.count("*").alias("missed_runs"), F.max("attempted_ts").alias("newest_miss")
    )


def evidence(reads: DataFrame, captures: DataFrame, standing: DataFrame | None = None) -> DataFrame:
    """The capture that belongs to each run.

    A capture the record names is the answer, or there is none. Otherwise it is the target's
    newest one that is not later than the run: of the same day if there is one, or of an earlier
    day; and where there is neither, the standing example of the target (``standing``: target,
    example), if it has one. Runs and captures are put in one order and each run takes the newest capture so far,
    so a target's runs never meet its captures pair by pair.
    """
    stamp = instant(F.col("read_at"))
    named = captures.select(
        "target", F.col("path").alias("verification_artifact"), F.col("path").alias("named_path")
    )
    capture = F.struct("generated_at", "path")
    kept = captures.select(
        "target",
        F.col("generated_at").alias("ts"),
        F.lit(0).alias("turn"),
        F.col("path").alias("tie"),
        capture.alias("capture"),
        F.lit(None).cast("bigint").alias("line_no"),
    )
    asked = reads.select(
        "target",
        stamp.alias("ts"),
        F.lit(1).alias("turn"),
        F.col("line_no").cast("string").alias("tie"),
        F.lit(None).cast("struct<generated_at: timestamp, path: string>").alias("capture"),
        "line_no",
    )
    order = [F.asc("ts"), F.asc("turn"), F.asc("tie")]
    newest = (
        running_max(kept.unionByName(asked), ["target"], order, "capture", "best")
        .where(F.col("turn") == 1)
        .select("line_no", "best")
    )
    whole = reads.join(named, ["target", "verification_artifact"], "left").join(
        newest, "line_no", "left"
    )
    if standing is None:
        whole = whole.withColumn("example", F.lit(None).cast("string"))
    else:
        whole = whole.join(standing.select("target", "example"), "target", "left")
    is_named = F.col("verification_artifact").isNotNull()
    same_day = F.to_date("best.generated_at") == F.to_date(stamp)
    return whole.select(
        "line_no",
        "target",
        F.when(is_named, F.col("named_path"))
        .otherwise(F.coalesce("best.path", "example"))
        .alias("evidence"),
        F.when(is_named & F.col("named_path").isNull(), "named capture is missing")
        .when(is_named, "named")
        .when(same_day, "same day")
        .when(F.col("best").isNotNull(), "earlier")
        .when(F.col("example").isNotNull(), "standing example")
        .otherwise("none")
        .alias("how"),
    )


def freshness(attempts: DataFrame, now: Column, max_age_hours: float = MAX_AGE_HOURS) -> DataFrame:
    """Whether the runs are alive, from the newest readable attempt; one row, also for no runs."""
    readable = attempts.withColumn("at", instant(F.col("attempted_at"))).where(
        F.col("at").isNotNull()
    )
    newest = readable.agg(
        F.max_by(F.struct("at", "status", "stage", "target"), F.struct("at", "line_no")).alias("r")
    )
    age = (F.unix_micros(now) - F.unix_micros("r.at")) / F.lit(3.6e9)
    verdict = (
        F.when(F.col("r").isNull(), "never run")
        .when(age > max_age_hours, "stale")
        .when(~F.col("r.status").eqNullSafe("succeeded"), "last run failed")
        .otherwise("alive")
    )
    return newest.select(
        verdict.alias("verdict"), age.alias("age_hours"), "r.status", "r.stage", "r.target"
    )


def invalid_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts that may not be recorded, and why."""
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status"),
            F.when(F.coalesce(F.trim("stage"), F.lit("")) == "", "stage"),
            F.when(instant(F.col("attempted_at")).isNull(), "attempted_at"),
        )
    )
    return attempts.withColumn("reasons", F.array_join(reasons, ",")).where(F.col("reasons") != "")


def trend(scores: DataFrame) -> DataFrame:
    """A line per scoring run with its most fragile asset and that asset's score; a dash where there is none.

    ``top`` holds the records of a scoring run (origin, score, cost), most fragile first, as an array
    or as the JSON a ledger keeps of it. Names alone, without scores, are taken as they are.
    """
    if isinstance(scores.schema["top"].dataType, ArrayType):
        first = F.try_element_at("top", F.lit(1))
        name, score = first["origin"], first["score"].cast("double")
    else:
        first = F.try_element_at(F.from_json("top", "array<struct<origin string, score double>>"), F.lit(1))
        alone = F.try_element_at(F.from_json("top", "array<string>"), F.lit(1))
        name = F.coalesce(first["origin"], F.when(~F.coalesce(alone, F.lit("")).startswith("{"), alone))
        score = first["score"]
    return scores.select(
        "target", "line_no", "scored_at", "mean_score", F.coalesce(name, F.lit("—")).alias("most_fragile"), score.alias("score")
    )


def targets(ledger: DataFrame) -> DataFrame:
    """Targets that have a history; one that never ran is absent."""
    return ledger.groupBy("target").agg(F.count("*").alias("runs"))


def changes(reads: DataFrame) -> DataFrame:
    """Whether each read found the estate as the read of its target before it did."""
    order = [F.asc("_at"), F.asc("line_no")]
    timed = reads.withColumn("_at", instant(F.col("read_at")))
    before = F.col("_before")
    return (
        previous(timed, ["target"], order, "fingerprint", "_before")
        .withColumn(
            "change",
            F.when(before.isNull(), "first")
            .when(before == F.col("fingerprint"), "same")
            .otherwise("changed"),
        )
        .drop("_at", "_before")
    )


def captured_metrics(lines: DataFrame, by: list[str]) -> DataFrame:
    """Precision and recall from the last captured line that states both, per run.

    A run that states neither is still listed, with ``found`` false, because a missing figure
    is an error and not a zero.
    """
    pattern = r"precision\s+([0-9.eE+-]+)\s+recall\s+([0-9.eE+-]+)"
    stated = F.col("text").rlike(pattern)
    last = F.max_by(
        F.struct(
            F.regexp_extract("text", pattern, 1).try_cast("double").alias("precision"),
            F.regexp_extract("text", pattern, 2).try_cast("double").alias("recall"),
        ),
        F.when(stated, F.col("line_no")),
    )
    return lines.groupBy(*by).agg(last.alias("m"), F.bool_or(stated).alias("found")).select(
        *by, "m.precision", "m.recall", "found"
    )
