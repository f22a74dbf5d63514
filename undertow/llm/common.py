"""What the text operators share: reading columns in a task, lower-casing, and hash classes of ids."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import pin

#: Bytes of text that a task takes apart at a time.
PORTION_BYTES = 1 << 20
#: Rows of a slice of an order.
SLICE_ROWS = 2_000_000
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


_HOLDER: list[Callable[[], None]] = []


def hold(forget: Callable[[], None]) -> None:
    """Say that a worker process now remembers things that ``forget`` drops.

    A worker is used again by the tasks of later jobs; it holds the memory of one operator at a time, and
    what it drops goes back to the machine, which the engine shares with it.
    """
    if forget not in _HOLDER:
        for other in _HOLDER:
            other()
        if _HOLDER:
            give_back()
        _HOLDER[:] = [forget]


def give_back() -> None:
    """Return memory that is free in this process to the machine, as far as its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def read(spark, root: str, name: str, *columns: str) -> DataFrame:
    """A table of the folder, with the given columns only."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def lower_ascii(text: bytes) -> bytes:
    """A-Z lower-cased; every other byte as it is."""
    return text.translate(_LOWER)


def id_class(column: str, classes: int) -> Column:
    """crc32 of the id as text, modulo ``classes``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % classes


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None where it is null."""
    return pc.cast(column, pa.large_binary()).to_pylist()


def map_texts(
    df: DataFrame, key: str, fields: str, fn: Callable[[list[bytes | None]], list], room: int = PORTION_BYTES
) -> DataFrame:
    """``key`` with the columns ``fields`` (DDL) that ``fn`` derives from a batch of texts, ``room`` bytes of them or one text.

    The work is per row: no shuffle, and a lost task is simply run again. ``key`` passes through
    untouched, so it may be of any type and null; where it is a struct with a field ``text``, the
    texts are taken from there and not sent along once more.
    """
    kind = df.schema[key].dataType
    inside = isinstance(kind, StructType) and "text" in kind.names
    texts = [] if inside else [F.col("text").cast("string").alias("_text")]
    picked = df.select(F.col(key).alias("_key"), *texts)
    added = StructType.fromDDL(fields)
    schema = StructType([*picked.select(F.col("_key").alias(key)).schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if inside:
                keys = batch.column(0)
                batch = pa.RecordBatch.from_arrays([keys, keys.field("text")], names=["_key", "_text"])
            for keys, texts in portions(batch, room):
                columns = fn(texts)
                arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays([keys, *arrays], names=schema.names)

    return picked.mapInArrow(run, schema)


def portions(batch: pa.RecordBatch, room: int = PORTION_BYTES) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    """The first column of a batch and the texts of its second, some megabytes of text at a time.

    What a task holds of split texts is many times their size, so it is bounded here. A longer text
    comes alone, whole.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64) + 64)
    first = 0
    while first < batch.num_rows:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + room, "right")))
        part = batch.slice(first, last - first)
        yield part.column(0), byte_texts(part.column(1))
        first = last


def run_starts(lengths: np.ndarray) -> np.ndarray:
    """Where each run begins when runs of the given lengths lie one after another."""
    starts = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    return starts


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every run, one after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - run_starts(lengths), lengths) if len(lengths) else np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + shift


def in_slices(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows``, which are read from a table, in ``order``: range partitioned, and written with ``_slice`` and ``_at``.

    ``_at`` ascends in the order, by one from row to row of a slice. Slices grow in number, not in size.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(rows.count() / SLICE_ROWS))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = pin(ranged.withColumn("_at", F.monotonically_increasing_id()), "slices")
    return placed.withColumn("_slice", F.shiftright("_at", 33))


def numbered(rows: DataFrame, order: list[Column], alias: str, count: Column) -> tuple[DataFrame, int]:
    """``rows`` numbered from one in ``order``, ties in any order; and ``count`` over all of them, taken on the way.

    One row per slice of the order is handed on; no task sees more than its slice.
    """
    seen = Observation()
    held = pin(rows.observe(seen, count.alias("n")), "rows")
    placed = in_slices(held, order)
    sizes = placed.groupBy("_slice").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")  # a row per slice
    sizes = sizes.select("_slice", "_first", before.alias("_before"))
    place = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return placed.join(sizes, "_slice").withColumn(alias, place).drop("_slice", "_at", "_first", "_before"), seen.get["n"]
