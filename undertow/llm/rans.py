"""Token ids in files: interleaved range asymmetric numeral coding with one shared frequency table.

A file set is a folder of Parquet files whose rows are blocks, in ascending order of documents:

    shard, block      place of the block; blocks are in order of (shard, block)
    shard_start       ids in the blocks before it in its shard
    doc_ids, lengths  documents of the block and their numbers of ids, in order
    n_tokens          ids in the block
    states            LANES 64-bit states at each checkpoint, little-endian
    offsets           place in ``words`` at each checkpoint
    words             32-bit words of the code, little-endian
    crc32             checksum of the block's ids as little-endian unsigned 32-bit integers

beside a folder ``table`` with (symbol, frequency): frequencies of all ids of the set, scaled to
sum to 2**SCALE_BITS. A block of n ids is a matrix of rows of LANES ids, the last row filled with
its first id. There is a checkpoint before each STRIDE rows, so every stretch between two
checkpoints can be decoded alone and beside the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranges, run_starts

LANES, STRIDE = 64, 256
SCALE_BITS = 20
BLOCK_TOKENS = 1 << 16
_LOW = np.uint64(1 << 31)


class Table:
    """Cumulative frequencies and the inverse table of a set of symbols."""

    def __init__(self, symbols: np.ndarray, frequencies: np.ndarray) -> None:
        order = np.argsort(symbols)
        self.symbols, f = symbols[order].astype(np.int64), frequencies[order].astype(np.uint64)
        self.f = f
        self.c = (np.cumsum(f) - f).astype(np.uint64)
        size = int(self.symbols[-1]) + 1 if len(symbols) else 0
        self.index = np.full(size, -1, np.int64)
        self.index[self.symbols] = np.arange(len(f))
        self.slots = np.repeat(np.arange(len(f), dtype=np.int32), f.astype(np.int64))


def scaled(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least one that sum to 2**SCALE_BITS, in proportion to counts."""
    total = 1 << SCALE_BITS
    if len(counts) > total:
        raise ValueError("more symbols than the scale can tell apart")
    share = counts.astype(float) * (total - len(counts)) / counts.sum()
    f = np.floor(share).astype(np.int64) + 1
    short = total - int(f.sum())
    most = np.lexsort((symbols, -(share - np.floor(share))))[:short]
    f[most] += 1
    return f


def encode_blocks(blocks: list[np.ndarray], table: Table) -> list[dict]:
    """Code several blocks (none empty) at once; their lanes are coded side by side."""
    n = np.array([len(b) for b in blocks])
    rows = -(-n // LANES)
    most = int(rows.max())
    index = np.zeros((len(blocks), most * LANES), np.int64)
    for k, b in enumerate(blocks):
        index[k, : n[k]] = table.index[b]
        index[k, n[k] :] = index[k, 0]
    index = index.reshape(len(blocks), most, LANES)
    x = np.full((len(blocks), LANES), _LOW, np.uint64)
    words = np.zeros((most, len(blocks), LANES), np.uint32)
    sent = np.zeros((most, len(blocks), LANES), bool)
    saved: list[list[np.ndarray]] = [[] for _ in blocks]
    scale = np.uint64(SCALE_BITS)
    for r in range(most - 1, -1, -1):
        live = rows > r
        which = index[live, r]
        f, state = table.f[which], x[live]
        full = state >> np.uint64(63 - SCALE_BITS) >= f
        words[r, live] = np.where(full, state, 0).astype(np.uint32)
        sent[r, live] = full
        state = np.where(full, state >> np.uint64(32), state)
        high = state // f
        x[live] = (high << scale) + (state - high * f) + table.c[which]
        if r % STRIDE == 0:
            for k in np.flatnonzero(live):
                saved[k].append(x[k].copy())
    out = []
    for k in range(len(blocks)):
        mask = sent[: rows[k], k]
        per_row = np.concatenate([[0], np.cumsum(mask.sum(1))])
        out.append(
            {
                "states": np.concatenate(saved[k][::-1]).astype("<u8").tobytes(),
                "offsets": per_row[np.arange(0, rows[k], STRIDE)].tolist(),
                "words": words[: rows[k], k][mask].astype("<u4").tobytes(),
            }
        )
    return out


def decode_blocks(blocks: list[dict], table: Table) -> list[np.ndarray]:
    """Ids of several blocks; all stretches between checkpoints are decoded side by side."""
    n = np.array([b["n_tokens"] for b in blocks])
    rows = -(-n // LANES)
    cuts = -(-rows // STRIDE)
    block = np.repeat(np.arange(len(blocks)), cuts)
    first = ranges(np.zeros(len(blocks), np.int64), cuts) * STRIDE
    height = np.minimum(STRIDE, rows[block] - first)
    words = [np.frombuffer(b["words"], "<u4") for b in blocks]
    base = run_starts(np.array([len(w) for w in words], np.int64))
    words = np.concatenate([*words, np.zeros(1, np.uint32)])
    x = np.concatenate([np.frombuffer(b["states"], "<u8") for b in blocks]).reshape(-1, LANES).copy()
    at = base[block] + np.concatenate([np.asarray(b["offsets"], np.int64) for b in blocks])
    out = np.zeros((len(block), STRIDE, LANES), np.int32)
    mask, scale = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    order = np.argsort(-height, kind="stable")  # stretches that end early leave from the back
    x, at, height = x[order], at[order], height[order]
    for r in range(int(height[0])):
        live = int(np.searchsorted(-height, -r, "left"))
        state, here = x[:live], at[:live]
        slot = state & mask
        which = table.slots[slot]
        out[order[:live], r] = table.symbols[which]
        state = table.f[which] * (state >> scale) + slot - table.c[which]
        low = state < _LOW
        taken = np.cumsum(low, 1)
        place = np.minimum(here[:, None] + taken - 1, len(words) - 1)
        x[:live] = np.where(low, state << np.uint64(32) | words[np.maximum(place, 0)], state)
        at[:live] = here + taken[:, -1]
    flat, starts = out.reshape(len(block), -1), run_starts(cuts)
    return [flat[starts[k] : starts[k] + cuts[k]].reshape(-1)[: n[k]] for k in range(len(blocks))]


# -- file sets --------------------------------------------------------------------------------

_BLOCK = (
    "shard int, block int, shard_start bigint, doc_ids array<bigint>, lengths array<bigint>, n_tokens bigint, states binary, "
    "offsets array<bigint>, words binary, crc32 bigint"
)
_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("shard_start", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("n_tokens", pa.int64()),
        ("states", pa.binary()),
        ("offsets", pa.list_(pa.int64())),
        ("words", pa.binary()),
        ("crc32", pa.int64()),
    ]
)


def count_ids(tokens: DataFrame, packing: str = "<u4") -> DataFrame:
    """(symbol, count) over all packed ids, added up in each task before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            packed = b"".join([p for p in batch.column(0).to_pylist() if p])
            found = np.bincount(np.frombuffer(packed, packing), minlength=len(total))
            found[: len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["symbol", "count"])

    parts = tokens.select("ids").mapInArrow(run, "symbol bigint, count bigint")
    return parts.groupBy("symbol").agg(F.sum("count").alias("count"))


def write(tokens: DataFrame, path: str, packing: str = "<u4", block_tokens: int = BLOCK_TOKENS) -> None:
    """Write documents (doc_id, ids packed as little-endian unsigned integers) as a file set.

    Documents are range partitioned by doc_id and sorted, so shards and blocks are in ascending
    order (nulls first; rows of one doc_id in the order of their ids within a shard, repeated rows as they come). A block closes with the
    document that brings it to ``block_tokens`` ids. The frequency table has at most as many rows
    as the vocabulary has ids, which is what the driver and the tasks hold. ``tokens`` is read
    twice and must give the same rows each time, so hand over a written table. Files are written by
    Spark's committer: a task that is lost is run again and leaves no part behind.
    """
    spark = tokens.sparkSession
    counts = count_ids(tokens, packing).toArrow()
    symbols, seen = (counts.column(i).to_numpy() for i in (0, 1))
    frequencies = scaled(symbols, seen) if len(symbols) else seen
    spark.createDataFrame(
        pa.table({"symbol": pa.array(symbols, pa.int64()), "frequency": pa.array(frequencies, pa.int64())})
    ).coalesce(1).write.parquet(f"{path}/table")
    table = spark.sparkContext.broadcast((symbols, frequencies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, coder, shard, number, start = [], None, TaskContext.get().partitionId(), 0, 0
        for docs in _gathered(batches, packing, block_tokens):
            coder = coder or Table(*table.value)
            held.append(docs)
            if len(held) == 16:
                yield _packed(held, coder, shard, number, start)
                number, start, held = number + len(held), start + _size(held), []
        if held:
            yield _packed(held, coder, shard, number, start)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one doc_id, or without any, may be most of them: their place in the table deals them out, too. The
    # ranges are sampled from these two columns; ids never go to the driver.
    placed = tokens.select("doc_id", "ids", F.monotonically_increasing_id().alias("_at"))
    ordered = placed.repartitionByRange(parts, "doc_id", "_at").drop("_at").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def _size(held: list[list[tuple]]) -> int:
    return sum(len(ids) for docs in held for _, ids in docs)


def _gathered(batches: Iterator[pa.RecordBatch], packing: str, room: int) -> Iterator[list[tuple]]:
    """Runs of documents that together have ``room`` ids or more."""
    docs, size = [], 0
    for batch in batches:
        for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.frombuffer(packed or b"", packing)
            docs.append((doc, ids))
            size += len(ids)
            if size >= room:
                yield docs
                docs, size = [], 0
    if docs:
        yield docs


def _packed(held: list[list[tuple]], table: Table, shard: int, number: int, start: int) -> pa.RecordBatch:
    blocks = [np.concatenate([ids for _, ids in docs]) for docs in held]
    filled = [k for k, b in enumerate(blocks) if len(b)]
    coded = dict(zip(filled, encode_blocks([blocks[k] for k in filled], table))) if filled else {}
    before = start + run_starts(np.array([len(b) for b in blocks], np.int64))
    rows = [
        {
            "shard": shard,
            "block": number + k,
            "shard_start": int(before[k]),
            "doc_ids": [doc for doc, _ in docs],
            "lengths": [len(ids) for _, ids in docs],
            "n_tokens": len(blocks[k]),
            "crc32": zlib.crc32(blocks[k].astype("<u4").tobytes()),
            **coded.get(k, {"states": b"", "offsets": [], "words": b""}),
        }
        for k, docs in enumerate(held)
    ]
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def read(spark: SparkSession, path: str, fields: str, fn: Callable[[np.ndarray], list]) -> DataFrame:
    """(doc_id, start, n_tokens, ``fields``) of every document of a file set.

    ``fn`` turns the ids of one document into the values of ``fields`` (DDL), in the task that
    decoded them. ``start`` counts the ids of all documents before it. A block whose ids do not
    have its checksum stops the read.
    """
    counts = spark.read.parquet(f"{path}/table").toArrow()
    table = spark.sparkContext.broadcast(tuple(counts.column(c).to_numpy() for c in ("symbol", "frequency")))
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    # One row per shard, of which there are as many as partitions were written: summed in order.
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")
    totals = totals.select(F.col("shard").alias("_shard"), before.alias("_before"))
    placed = blocks.join(F.broadcast(totals), F.col("shard") == F.col("_shard"))
    placed = placed.withColumn("first_token", F.col("_before") + F.col("shard_start"))
    schema = f"doc_id bigint, start bigint, n_tokens bigint, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Table(*table.value)
            rows = batch.to_pylist()
            for at in range(0, len(rows), 16):
                yield from _documents(rows[at : at + 16], coder, fn, names)

    names = [f.split()[0] for f in fields.split(",")]
    return placed.mapInArrow(run, schema)


def _documents(rows: list[dict], coder: Table, fn: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    filled = [r for r in rows if r["n_tokens"]]
    decoded = iter(decode_blocks(filled, coder)) if filled else iter(())
    for row in rows:
        ids = next(decoded) if row["n_tokens"] else np.zeros(0, np.int32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != row["crc32"]:
            raise ValueError(f"block {row['block']} of shard {row['shard']} is damaged")
        lengths = np.array(row["lengths"], np.int64)
        first = run_starts(lengths)
        values = [fn(ids[a : a + n]) for a, n in zip(first, lengths)]
        columns = [pa.array([v[i] for v in values]) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(first + row["first_token"]),
                pa.array(lengths),
                *columns,
            ],
            names=["doc_id", "start", "n_tokens", *names],
        )
