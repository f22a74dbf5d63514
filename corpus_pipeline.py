"""A corpus from documents to token ids, in stages that each read what the one before has written.

Every function takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of
documents (the last one: token ids). Rows are carried whole, so null or repeated ids, empty
texts and empty tables need no care here; what each operator makes of them its own module says.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm import bpe, decontam, langid, lines, simhash
from undertow.llm.common import id_class, read
from undertow.session import pin, prepare

#: A language is believed from this posterior on.
LEAST_SCORE = 0.5


def _stage(fn):
    """A stage under the session settings every job here relies on."""
    return functools.wraps(fn)(lambda spark, docs, sf_dir: fn(prepare(spark), docs, sf_dir))


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one column, with its text inside."""
    return docs.select(F.struct("*").alias("row"))


@_stage
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: texts that are null, without a letter or undecided go."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    model = langid.train(docs.where(id_class("doc_id", 5) != 0), path)
    told = langid.predict(_rows(docs), model, path, "row")
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


@_stage
def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one; those left without a word go."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    done = lines.dedup(rows)
    emptied = (F.col("n_removed") > 0) & ~F.regexp_like("text", F.lit(lines.HAS_WORD))
    left = done.where(~F.coalesce(emptied, F.lit(False)))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return left.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


@_stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id in each group of near-duplicates; a null id comes last."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.monotonically_increasing_id().alias("row"))
    placed = docs.select(F.struct("*").alias("row"), place.alias("place"), "text")
    found = simhash.groups(placed.select("place", "text"), key="place")
    first = found.where(F.col("place") == F.col("component_id")).select(F.col("place.row").alias("first"))
    return placed.join(first, F.col("place.row") == F.col("first"), "left_semi").select("row.*")


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontam.hits(_rows(docs), read(spark, sf_dir, "benchmark"), key="row")
    return found.where(F.size("items") == 0).select("row.*")


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32 bits) and the digest of the decoded text."""
    kept = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.encode_decode(kept, path, public_tokenizers.PATTERN, "row")
    n_tokens = (F.octet_length("ids") / 4).cast("bigint")
    return done.select("row.*", n_tokens.alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", remove_repeated_lines),
    ("simhash", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: No SQL can tell languages, hash shingles or merge bytes; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
