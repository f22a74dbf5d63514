"""Production stored with a checksum per bucket of keys, so that rebuilds are compared without reading it again."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.summaries import bucket_contents, bucket_of
from ..plans import MODELS, Warehouse
from ..sources.sinks import current, newest, read_json, refresh, vacuum
from .impact import DEGRADED

BUCKETS = 256
#: Models of one depth that are built at the same time; the cluster's scheduler shares the machines among them.
AT_ONCE = 4


def levels(names: Iterable[str]) -> list[list[str]]:
    """Models by depth among ``names``: none reads another of its own level, and each reads only earlier ones."""
    wanted, depth = set(names), {}
    for name, m in MODELS.items():
        if name in wanted:
            depth[name] = 1 + max((depth[t] for t in m.reads if t in depth), default=-1)
    return [[n for n in depth if depth[n] == d] for d in range(max(depth.values(), default=-1) + 1)]


def by_level(names: Iterable[str], work: Callable[[str], tuple]) -> dict[str, tuple]:
    """``work`` of each model, those of a level as concurrent jobs, a level after what it reads."""
    done: dict[str, tuple] = {}
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for level in levels(names):
            done.update(zip(level, pool.map(work, level)))
    return done


class Baseline:
    """Models under a folder, each with a list of its buckets: number of rows and checksum.

    Rows fall into a bucket by the columns that are unique in their model, by all columns where a
    model has none, so a changed row stays in its bucket on both sides. A list belongs to one
    version of its table; one that is missing, or made from an older version, is made again when
    it is next asked for. Lists have a line for every bucket, empty ones too, so a table
    without rows is told from a table without a list.
    """

    def __init__(self, w: Warehouse, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = w.spark, folder, buckets
        self.warehouse = w

    def store(self, names: Iterable[str]) -> Warehouse:
        """Build models and their lists, each model once, and return the warehouse that reads them there."""
        written: dict[str, DataFrame] = {}

        def build(name: str) -> tuple:
            written[name] = refresh(self.warehouse.holding(written)[name], self._table(name))
            self.listed(name)
            return ()

        by_level(names, build)
        return self.warehouse.holding(written)

    def production(self, names: Iterable[str]) -> Warehouse:
        """The warehouse that reads models stored before."""
        return self.warehouse.holding({name: current(self.spark, self._table(name)) for name in names})

    def _table(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _keys(self, name: str, df: DataFrame) -> list[str]:
        unique = [c.column for c in MODELS[name].checks if c.kind == "unique" and c.column in df.columns]
        return unique or df.columns

    def summary(self, name: str, df: DataFrame) -> DataFrame:
        """The list of a table: (bucket, row_count, checksum) for every bucket."""
        found = bucket_contents(df, self._keys(name, df), self.buckets)
        every = self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket"))
        none = F.lit(0).cast("decimal(38,0)")
        return every.join(found, "bucket", "left").select(
            "bucket",
            F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
            F.coalesce("checksum", none).alias("checksum"),
        )

    def listed(self, name: str) -> DataFrame:
        """The list of the stored table's current version."""
        version, place = newest(self.spark, self._table(name)), f"{self._table(name)}/list"
        lines = None if read_json(self.spark, f"{place}/commits", "number bigint") is None else current(self.spark, place)
        if lines is None or lines.where(F.col("version") == version).count() != self.buckets:
            made = self.summary(name, current(self.spark, self._table(name)))
            made = made.withColumn("version", F.lit(version)).select("version", "bucket", "row_count", "checksum")
            lines = refresh(made.coalesce(1), place)
        return lines.drop("version")

    def changed(self, name: str, rebuilt: DataFrame) -> DataFrame:
        """Buckets that differ: (bucket, rebuilt_rows, stored_rows). A table of stored columns only is asked for."""
        ours = self.summary(name, rebuilt).withColumnsRenamed({"row_count": "rebuilt_rows", "checksum": "ours"})
        theirs = self.listed(name).withColumnsRenamed({"row_count": "stored_rows", "checksum": "theirs"})
        differ = (F.col("ours") != F.col("theirs")) | (F.col("rebuilt_rows") != F.col("stored_rows"))
        return ours.join(theirs, "bucket").where(differ).select("bucket", "rebuilt_rows", "stored_rows")

    def compare(self, name: str, rebuilt: DataFrame) -> tuple[str | None, str]:
        """How a rebuilt model differs from the stored one: its impact, if any, and the evidence.

        Two lists meet, of a line per bucket; the stored rows are not read.
        """
        if rebuilt.columns != current(self.spark, self._table(name)).columns:
            return DEGRADED, "columns differ"
        found = self.changed(name, rebuilt).agg(
            F.count("*").alias("n"), F.sum(F.col("rebuilt_rows") - F.col("stored_rows")).alias("gap")
        ).first()
        if not found["n"]:
            return None, "identical"
        where = f"in {found['n']} of {self.buckets} buckets"
        if found["gap"]:
            rows = self.listed(name).agg(F.sum("row_count")).first()[0]
            return DEGRADED, f"{rows + found['gap']} rows against {rows} ({found['gap']:+d}), {where}"
        return DEGRADED, f"same row count, contents differ {where}"

    def differing_rows(self, name: str, rebuilt: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rebuilt and stored rows of the buckets that differ; all others are equal and need no exact comparison."""
        stored = current(self.spark, self._table(name))
        keys = self._keys(name, stored)
        buckets = [r["bucket"] for r in self.changed(name, rebuilt).select("bucket").collect()]  # at most ``buckets``
        inside = lambda df: df.where(bucket_of(df, keys, self.buckets).isin(buckets))
        return inside(rebuilt), inside(stored)

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Remove versions of a stored model and of its list, as :func:`sinks.vacuum` does."""
        vacuum(self.spark, f"{self._table(name)}/list", keep)
        return vacuum(self.spark, self._table(name), keep)
