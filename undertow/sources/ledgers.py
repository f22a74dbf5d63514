"""Append-only JSON-lines ledgers: tolerant reading, and appending without rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import pin


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Good records and bad lines of a ledger given as (line_no, text); blank lines are skipped.

    A bad line keeps its number and text, with ``record`` null.
    """
    present = lines.where(F.trim("text") != "")
    fields = f"{schema}, _corrupt string"
    parsed = F.from_json("text", fields, {"columnNameOfCorruptRecord": "_corrupt"})
    return present.withColumn("record", parsed).withColumn(
        "record", F.when(F.col("record._corrupt").isNull(), F.col("record"))
    )


def records(parsed: DataFrame) -> DataFrame:
    good = parsed.where(F.col("record").isNotNull()).select("line_no", "record.*")
    return good.drop("_corrupt")


def complaints(parsed: DataFrame) -> DataFrame:
    """The lines that do not parse, with the file they are in where that is known."""
    columns = [c for c in ("file", "line_no", "text") if c in parsed.columns]
    return parsed.where(F.col("record").isNull()).select(*columns)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the text files under ``path``: file, line_no from one, text, and the folder's partition columns.

    Files are read in blocks, by as many tasks as they have. A line's place in its block is known to the
    task that reads it, and one row per block is enough to know how many lines come before it, so no file
    is read by one task only, whatever store it is in.
    """
    read = spark.read.text(path)
    kept = [F.col(c) for c in read.columns if c != "value"]
    block = F.col("_metadata.file_block_start").alias("_block")
    file = F.col("_metadata.file_path").alias("file")
    lines = pin(read.select(file, block, F.monotonically_increasing_id().alias("_at"), F.col("value").alias("text"), *kept), "lines")
    blocks = lines.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")
    blocks = blocks.select("file", "_block", "_first", before.alias("_before"))
    place = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return lines.join(blocks, ["file", "_block"]).select("file", place.alias("line_no"), "text", *[F.col(c) for c in lines.columns[4:]])


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger folder with its declared schema; fields a line lacks are null, blank lines are skipped.

    ``file`` and ``line_no`` say where a line is. Lines that do not parse are kept with the text in ``_corrupt``.
    """
    parsed = parse_lines(numbered_lines(spark, path), schema)
    corrupt = F.when(F.col("record").isNull(), F.col("text")).alias("_corrupt")
    names = [f.name for f in parsed.schema["record"].dataType if f.name != "_corrupt"]
    rest = [c for c in parsed.columns if c not in ("file", "line_no", "text", "record", *names)]
    return parsed.select(*[F.col(f"record.{n}").alias(n) for n in names], corrupt, "file", "line_no", *rest)


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Add rows to a ledger; what is there is never rewritten."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*by) if by else writer).json(path)
