"""Tables stored by key: upserts and removals that rewrite only the buckets they touch."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.publishing import upsert
from ..session import pin
from .sinks import commit_number, read_json, remove_folders

BUCKETS = 64
_FOLDER = "bucket_of_key"
_COMMIT = "number bigint, version string, bucket int, row_count bigint"


class KeyedTable:
    """Rows of a key that are replaced together, in a folder of buckets by a hash of the key.

    A batch writes new versions of the buckets that its keys fall into, and a commit record then
    makes them current, all at once: until it is there, readers see the table as it was, and a
    job that fails half way leaves files nobody reads. A bucket is what its last commit says. Applying the
    same batch again changes nothing. One writer at a time; readers need no lock.

    ``schema`` is DDL; ``key`` may hold nulls. The number of buckets is fixed by the first writer's choice and part of the
    table, so give a table of many rows many of them: a batch of few keys reads and writes few.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets
        self.schema = StructType.fromDDL(schema)

    # ---------------------------------------------------------- reading

    def commits(self) -> DataFrame | None:
        return read_json(self.spark, f"{self.path}/commits", _COMMIT)

    def _places(self, buckets: list[int] | None = None) -> list[str]:
        """The folders that hold the current rows, one a bucket at most."""
        done = self.commits()
        if done is None:
            return []
        if buckets is not None:
            done = done.where(F.col("bucket").isin(buckets))
        order = F.struct("number", "version")
        newest = done.groupBy("bucket").agg(F.max_by(F.struct("version", "row_count"), order).alias("c"))
        found = newest.where("c.row_count > 0").select("bucket", "c.version").orderBy("bucket").collect()
        return [f"{self.path}/data/version={r['version']}/{_FOLDER}={r['bucket']}" for r in found]

    def _at(self, places: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The current rows."""
        return self._at(self._places())

    # ---------------------------------------------------------- writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets with a row: as many as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())

    def _replace(self, buckets: list[int], rows: DataFrame) -> int:
        """Write ``rows`` as all there is in ``buckets``; returns the number of the commit."""
        version = uuid.uuid4().hex
        place = f"{self.path}/data/version={version}"
        # A bucket that holds most rows is dealt to several tasks, small ones are put together.
        dealt = rows.withColumn(_FOLDER, self._bucket()).hint("rebalance", F.col(_FOLDER))
        dealt.write.partitionBy(_FOLDER).parquet(place)
        try:
            held = self.spark.read.schema(f"{_FOLDER} int").parquet(place).groupBy(_FOLDER).agg(F.count("*").alias("n"))
            counted = {r[_FOLDER]: r["n"] for r in held.collect()}
        except AnalysisException:  # nothing is left in these buckets, so there is no folder
            counted = {}
        number = commit_number(self.commits())
        records = [(number, version, b, counted.get(b, 0)) for b in buckets]
        self.spark.createDataFrame(records, _COMMIT).coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return number

    def upsert(self, fresh: DataFrame) -> int:
        """Replace all rows of each key that ``fresh`` brings; returns how many buckets were written."""
        fresh = pin(fresh.select(*self.schema.names), "batch")  # read three times below, and the same each time
        touched = self._touched(fresh)
        if touched:
            self._replace(touched, upsert(self._at(self._places(touched)), fresh, self.key))
        return len(touched)

    def remove(self, which: Column) -> int:
        """Take out the rows for which ``which`` holds; returns how many buckets were written."""
        gone = F.coalesce(which, F.lit(False))
        touched = self._touched(self.read().where(gone))
        if touched:
            self._replace(touched, self._at(self._places(touched)).where(~gone))
        return len(touched)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the files of versions that neither the table nor any of the last ``keep`` commits reads; returns how many.

        A reader that started before the last ``keep`` commits may lose its files. What failed jobs left behind goes too,
        so no writer may be at work.
        """
        done = self.commits()
        if done is None:
            return 0
        last = done.agg(F.max("number")).first()[0]
        # What is read as of commit n: of each bucket the newest version up to n.
        points = self.spark.range(max(1, last - keep + 1), last + 1).select(F.col("id").alias("point"))
        seen = done.join(points, F.col("number") <= F.col("point"))
        newest = seen.groupBy("point", "bucket").agg(F.max_by("version", F.struct("number", "version")).alias("version"))
        held = {r["version"] for r in newest.select("version").distinct().collect()}
        return remove_folders(self.spark, f"{self.path}/data", {f"version={v}" for v in held})
