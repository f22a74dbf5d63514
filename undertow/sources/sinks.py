"""Table writes: full refresh, counted load, snapshots stored under their content, and retention of all of them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans import MODELS, Warehouse

PARTS = ("assets", "columns", "owners", "edges", "column_edges")
_COMMIT = "number bigint, version string"
_READ = "fingerprint string, read_at string, source string, place string"


def refresh(df: DataFrame, path: str) -> DataFrame:
    """Rebuild a table whole and read it back.

    Each rebuild is a new version beside the old one, which a commit record then makes current: a
    job that fails leaves the table as it was, and ``df`` may read the table it replaces.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    done = _commits(spark, path)
    record = spark.createDataFrame([(commit_number(done), version)], _COMMIT)
    record.coalesce(1).write.mode("append").json(f"{path}/commits")
    return current(spark, path)


def commit_number(done: DataFrame | None) -> int:
    """The number of the next commit."""
    return 1 + (done.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] if done is not None else 0)


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    return read_json(spark, f"{path}/commits", _COMMIT)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version of a refreshed table that the last commit names."""
    return spark.read.parquet(f"{path}/versions/{newest(spark, path)}")


def newest(spark: SparkSession, path: str) -> str:
    """The version of a refreshed table that its last commit names."""
    done = _commits(spark, path)
    if done is None:
        raise FileNotFoundError(f"no refresh of {path} has been committed")
    return done.agg(F.max_by("version", F.struct("number", "version"))).first()[0]


@contextmanager
def reading(spark: SparkSession, path: str) -> Iterator[DataFrame]:
    """The current version of a refreshed table, kept from :func:`vacuum` as long as the ``with`` block lasts."""
    mark = f"{path}/readers/{uuid.uuid4().hex}"
    while True:
        # The mark is there before the version is looked up again, so a vacuum either sees it or went before.
        version = newest(spark, path)
        spark.createDataFrame([(version,)], "version string").coalesce(1).write.json(mark)
        if version == newest(spark, path):
            break
        _remove(spark, mark)
    try:
        yield spark.read.parquet(f"{path}/versions/{version}")
    finally:
        _remove(spark, mark)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete versions of a refreshed table that are not among its last ``keep`` commits and that nobody reads.

    Readers are those inside :func:`reading`. What failed jobs left goes too, so no refresh of the table may be
    at work. Returns how many versions went.
    """
    done = _commits(spark, path)
    if done is None:
        return 0
    kept = {r["version"] for r in done.orderBy(F.desc("number"), F.desc("version")).limit(max(1, keep)).collect()}
    marks = read_json(spark, f"{path}/readers/*", "version string")
    if marks is not None:
        kept |= {r["version"] for r in marks.distinct().collect()}
    return remove_folders(spark, f"{path}/versions", kept)


def vacuum_snapshots(spark: SparkSession, folder: str, keep: int | None = None) -> int:
    """Delete stored graphs that no read names, and with ``keep`` those that only older reads than the last ``keep`` name."""
    reads = snapshots(spark, folder)
    if reads is None:
        return 0
    if keep is not None:
        reads = reads.orderBy(F.desc(F.try_to_timestamp("read_at")), F.desc("fingerprint")).limit(max(1, keep))
    return remove_folders(spark, f"{folder}/parts", {r["place"] for r in reads.select("place").distinct().collect()})


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    place, files = _folder(spark, path)
    files.delete(place, True)


def remove_folders(spark: SparkSession, path: str, kept: set[str]) -> int:
    """Delete the folders directly under ``path`` whose names are not ``kept``; returns how many went."""
    place, files = _folder(spark, path)
    if not files.exists(place):
        return 0
    gone = [f.getPath() for f in files.listStatus(place) if f.isDirectory() and f.getPath().getName() not in kept]
    for folder in gone:
        files.delete(folder, True)
    return len(gone)


def load(df: DataFrame, path: str) -> int:
    """Append rows to a table and return how many went in, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return seen.get["rows"]


def materialize(w: Warehouse, names: list[str], folder: str) -> Warehouse:
    """Write models as tables in build order; later ones read the written earlier ones."""
    done: dict[str, DataFrame] = {}
    wanted = set(names)
    for name in MODELS:
        if name in wanted:
            current = Warehouse(w.spark, w.root, {**w.replaced, **done})
            done[name] = refresh(current[name], f"{folder}/{name}")
    return Warehouse(w.spark, w.root, {**w.replaced, **done})


def store_snapshot(graph, folder: str, read_at: str, source: str) -> tuple[str, bool]:
    """Store a graph under its fingerprint; say which it is and whether it was new.

    The parts are written once, to a place of their own, and the fingerprint is taken from there.
    They count from the moment the list of reads names that place, so a job that fails before
    leaves nothing behind that a second one could stumble over. The same content again only adds
    a line to the list, which names the place it has already.
    """
    from ..operators.lineage import Graph

    spark = graph.assets.sparkSession
    place = uuid.uuid4().hex
    for part in PARTS:
        getattr(graph, part).write.parquet(f"{folder}/parts/{place}/{part}")
    found = Graph(*_parts(spark, folder, place)).fingerprint().first()["fingerprint"]
    known = snapshots(spark, folder)
    before = None if known is None else known.where(F.col("fingerprint") == found).first()
    line = [(found, read_at, source, before["place"] if before else place)]
    spark.createDataFrame(line, _READ).coalesce(1).write.mode("append").json(f"{folder}/reads")
    return found, before is None


def _parts(spark: SparkSession, folder: str, place: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/parts/{place}/{part}") for part in PARTS]


def snapshots(spark: SparkSession, folder: str) -> DataFrame | None:
    """The reads stored under a folder, or none."""
    return read_json(spark, f"{folder}/reads", _READ)


def latest_fingerprint(reads: DataFrame) -> DataFrame:
    """The fingerprint of the newest read."""
    return reads.agg(
        F.max_by("fingerprint", F.struct(F.try_to_timestamp("read_at"), "fingerprint")).alias(
            "fingerprint"
        )
    )


def load_snapshot(spark: SparkSession, folder: str, fingerprint: str):
    """A stored graph by its fingerprint."""
    from ..operators.lineage import Graph

    place = snapshots(spark, folder).where(F.col("fingerprint") == fingerprint).first()["place"]
    return Graph(*_parts(spark, folder, place))
