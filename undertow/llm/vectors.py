"""Embedding near-duplicates: tiles of vectors in principal axes, compared leading axes first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import pin
from .components import labelled

THRESHOLD = 0.93
#: Vectors of a tile at most, leading axes with a box per tile, and cosines this near the threshold
#: are taken anew from the vectors as given.
TILE, BOXED, DOUBT = 1024, 8, 1e-9
#: Tiles that a task holds, and tiles that it lets pass by these, per group of pairs of tiles.
HELD, PASSING = 8, 32
#: Rows of a square matrix that are sent together, and matrices that one group adds up.
STRIPE, FAN = 64, 128


def _valid(vectors: DataFrame, key: str, label: str, embedding: str) -> DataFrame:
    """Vectors that can have links, as doubles: (id, label, v)."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(label).isNotNull() & F.col(key).isNotNull() & some & ~bad).select(
        F.col(key).alias("id"), F.col(label).alias("label"), v.alias("v")
    )


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, size)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal_axes(distinct: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector an orthogonal matrix of principal axes, the strongest first.

    From the second moments of all unit vectors: each task adds up one square matrix per length and hands
    on stripes of STRIPE rows of it. Stripes of equal place are added FAN at a time, in as many levels as the
    number of tasks asks for, so no group holds more than FAN stripes; one matrix per length reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, rows in _by_size(batch.column(0)):
                u = _unit(_matrix(batch.column(0).take(rows), size))
                total[size] = total.get(size, 0) + u.T @ u
        for size, m in total.items():
            for at in range(0, size, STRIPE):
                part = [[size], [at], [m[at : at + STRIPE].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, arrow)], names=["size", "at", "moments"])

    def add(rows):
        total = sum(np.frombuffer(m) for m in rows["moments"])
        return rows.head(1).assign(moments=[total.tobytes()])

    arrow = [pa.int64(), pa.int64(), pa.binary()]
    kind = "size bigint, at bigint, moments binary, task bigint"
    parts = distinct.select("v").mapInArrow(run, "size bigint, at bigint, moments binary")
    parts, tasks = _stripes(parts.withColumn("task", F.spark_partition_id().cast("bigint")))
    while tasks > 1:
        some = parts.withColumn("task", F.expr(f"task div {FAN}"))
        parts, tasks = _stripes(some.groupBy("size", "at", "task").applyInPandas(add, kind))
    axes = {}
    rows = sorted(parts.select("size", "at", "moments").collect(), key=lambda r: (r["size"], r["at"]))
    for size in dict.fromkeys(r["size"] for r in rows):
        moments = np.frombuffer(b"".join(r["moments"] for r in rows if r["size"] == size)).reshape(size, size)
        _, found = np.linalg.eigh(moments)
        axes[size] = found[:, ::-1].copy()
    return axes


def _stripes(parts: DataFrame) -> tuple[DataFrame, int]:
    """Stripes written out, and one more than the greatest task number among them, seen by the same write."""
    seen = Observation()
    written = pin(parts.observe(seen, F.coalesce(F.max("task") + 1, F.lit(0)).alias("n")), "moments")
    return written, seen.get["n"]


def _by_size(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    sizes = np.asarray(column.value_lengths())
    for size in np.unique(sizes):
        yield int(size), pa.array(np.flatnonzero(sizes == size))


def _placed(distinct: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """``distinct`` with its length and its coordinate on the first axis."""
    shared = distinct.sparkSession.sparkContext.broadcast({k: m[:, 0] for k, m in axes.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("v")
            lead = np.zeros(batch.num_rows)
            for size, rows in _by_size(batch.column(at)):
                lead[np.asarray(rows)] = _unit(_matrix(batch.column(at).take(rows), size)) @ shared.value[size]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead)], names=[*batch.schema.names, "lead"])

    schema = StructType([*distinct.schema.fields, StructField("lead", DoubleType())])
    return distinct.mapInArrow(run, schema).withColumn("size", F.size("v"))


def _tiles(placed: DataFrame, axes: dict[int, np.ndarray], tile: int) -> DataFrame:
    """Rows of up to ``tile`` vectors of one label and length, neighbours on the first axis.

    The vectors are range partitioned by label and first coordinate, so a label that holds most of
    them spans many partitions.
    """
    shared = placed.sparkSession.sparkContext.broadcast(axes)

    def pack(label, size, rows) -> dict:
        v = np.array([r["v"] for r in rows])
        u = (_unit(v) @ shared.value[size])[:, :BOXED]
        return {
            "label": label,
            "size": size,
            "low": (u.min(0) - DOUBT).tolist(),
            "high": (u.max(0) + DOUBT).tolist(),
            "ids": [r["id"] for r in rows],
            "copies": [r["copies"] for r in rows],
            "vectors": v.tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for r in batch.to_pylist():
                here = r["label"], r["size"]
                if held and (here != at or len(held) == tile):
                    yield pa.RecordBatch.from_pylist([pack(*at, held)], schema=arrow)
                    held = []
                held.append(r)
                at = here
        if held:
            yield pa.RecordBatch.from_pylist([pack(*at, held)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_type

    ids, label = (placed.schema[c].dataType for c in ("id", "label"))
    arrow = pa.schema(
        [
            ("label", to_arrow_type(label)), ("size", pa.int32()), ("low", pa.list_(pa.float64())),
            ("high", pa.list_(pa.float64())), ("ids", pa.list_(to_arrow_type(ids))), ("copies", pa.list_(pa.int64())),
            ("vectors", pa.binary()),
        ]
    )
    schema = (
        f"label {label.simpleString()}, size int, low array<double>, high array<double>, "
        f"ids array<{ids.simpleString()}>, copies array<bigint>, vectors binary"
    )
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(parts, "label", "size", "lead").sortWithinPartitions("label", "size", "lead")
    return ranged.mapInArrow(run, schema).withColumn("tile", F.monotonically_increasing_id())


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of all pairs of tiles, each with itself too, whose boxes are near enough for a link.

    Unit vectors of cosine c are sqrt(2 - 2c) apart. Tiles meet in cells of that width along the
    first axis, so a tile meets its neighbours and not all tiles of its label, and are then tried
    by the gap between their boxes.
    """
    far = 2 - 2 * threshold + DOUBT
    width = far**0.5
    cell = F.floor
    x = tiles.select(
        "label",
        "size",
        F.col("tile").alias("a"),
        F.col("low").alias("al"),
        F.col("high").alias("ah"),
        F.sequence(cell((F.col("low")[0] - width) / width), cell((F.col("high")[0] + width) / width)).alias("ac"),
    ).withColumn("cell", F.explode("ac"))
    y = tiles.select(
        "label",
        "size",
        F.col("tile").alias("b"),
        F.col("low").alias("bl"),
        F.col("high").alias("bh"),
        F.sequence(cell(F.col("low")[0] / width), cell(F.col("high")[0] / width)).alias("bc"),
    ).withColumn("cell", F.explode("bc"))
    gaps = F.transform(
        F.arrays_zip("al", "ah", "bl", "bh"),
        lambda g: F.greatest(g["al"] - g["bh"], g["bl"] - g["ah"], F.lit(0.0)),
    )
    gap = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    once = F.col("cell") == F.greatest(F.col("ac")[0], F.col("bc")[0])
    met = x.join(y, ["label", "size", "cell"])
    return met.where(once & (F.col("a") <= F.col("b")) & (gap <= far)).select("a", "b")


def projected(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as given, their unit vectors in principal axes, and the norms of what remains from each axis on."""
    u = _unit(x) @ axes
    rest = np.sqrt(np.maximum(np.cumsum((u * u)[:, ::-1], 1)[:, ::-1], 0))
    return x, u, np.hstack([rest, np.zeros((len(u), 1))])


def compare(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of x, j of y) whose cosine is at least ``threshold``."""
    return compare_projected(projected(x, axes), projected(y, axes), threshold)


def compare_projected(left: tuple, right: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of left, j of right), both as :func:`projected` gives them, whose cosine is at least ``threshold``.

    Products are added up along the principal axes, leading ones first. What the remaining axes can
    add is at most the product of both vectors' norms on them; a pair that cannot reach the
    threshold with it is given up. Cosines within DOUBT of the threshold are computed from the vectors as given.
    """
    (x, u, rest_u), (y, w, rest_w) = left, right
    size = u.shape[1]
    steps = [s for s in (8, 16, 32, 64, 128, 256, 512) if s < size] + [size]
    partial = u[:, : steps[0]] @ w[:, : steps[0]].T
    i, j = np.nonzero(partial + np.outer(rest_u[:, steps[0]], rest_w[:, steps[0]]) >= threshold - DOUBT)
    dots = partial[i, j]
    for a, b in zip(steps, steps[1:]):
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            dots[part] += np.einsum("ij,ij->i", u[i[part], a:b], w[j[part], a:b])
        on = dots + rest_u[i, b] * rest_w[j, b] >= threshold - DOUBT
        i, j, dots = i[on], j[on], dots[on]
    for k in np.flatnonzero(np.abs(dots - threshold) <= DOUBT):
        p, q = x[i[k]], y[j[k]]
        dots[k] = (p @ q) / np.sqrt((p @ p) * (q @ q))
    on = dots >= threshold
    return i[on], j[on]


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least number each of n nodes reaches over edges (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _met(tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tiles dealt to groups of pairs: group (ga, gb), side, others (tiles on side 0 that one on side 1 meets) and the tile.

    Neighbouring tiles form blocks of HELD on one side and of PASSING on the other, and the pairs of two blocks one
    group. A tile is sent once per group and not once per pair: of n tiles that all meet, n * n / 2 * (1 / HELD + 1 / PASSING)
    are sent in place of n * n / 2.
    """
    block = lambda c, n: F.expr(f"{c} - pmod({c}, {n})")  # noqa: E731  tile numbers of a partition follow one another
    dealt = pairs.select(block("a", HELD).alias("ga"), block("b", PASSING).alias("gb"), "a", "b")
    left = dealt.select("ga", "gb", F.lit(0).alias("side"), F.col("a").alias("tile")).distinct()
    left = left.withColumn("others", F.array().cast("array<bigint>"))
    right = dealt.groupBy("ga", "gb", F.lit(1).alias("side"), F.col("b").alias("tile")).agg(F.collect_list("a").alias("others"))
    wanted = left.unionByName(right)
    met = wanted.join(tiles.select("tile", "size", "ids", "copies", "vectors"), "tile")
    return met.repartition("ga", "gb").sortWithinPartitions("ga", "gb", "side", "tile")


def _links(tiles: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(id, n, to): links of a vector found in one pair of tiles, copies counted, and a vector it is joined to.

    A task holds the tiles on one side of a group, at most HELD, and lets those on the other pass one by
    one; each is put into principal axes once per group. A pair of tiles gives a row per linked vector and never a row per link.
    """
    shared = tiles.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for n in range(batch.num_rows):
                r = {name: batch.column(name)[n] for name in batch.schema.names}
                here, tile, size = (r["ga"].as_py(), r["gb"].as_py()), r["tile"].as_py(), r["size"].as_py()
                if here != at:
                    at, held = here, {}
                v = projected(np.frombuffer(r["vectors"].as_buffer()).reshape(-1, size), shared.value[size])
                mine = r["ids"].as_py(), np.array(r["copies"].as_py()), v
                if r["side"].as_py() == 0:
                    held[tile] = mine
                    continue
                for a in r["others"].as_py():
                    found = linked(held[a], mine, a == tile)
                    if found.num_rows:
                        yield found

    def linked(one: tuple, other: tuple, itself: bool) -> pa.RecordBatch:
        i, j = compare_projected(one[2], other[2], threshold)
        if itself:
            on = i < j
            i, j, ids, copies = i[on], j[on], one[0], one[1]
        else:
            j, ids, copies = j + len(one[0]), one[0] + other[0], np.concatenate([one[1], other[1]])
        n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        to, some = _least(len(ids), i, j), np.flatnonzero(n)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[k] for k in some], kind),
                pa.array(n[some].astype(np.int64)),
                pa.array([ids[to[k]] for k in some], kind),
            ],
            names=["id", "n", "to"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = tiles.schema["ids"].dataType.elementType
    kind = to_arrow_type(id_type)
    name = id_type.simpleString()
    return _met(tiles, pairs).mapInArrow(run, f"id {name}, n bigint, to {name}")


def near(
    vectors: DataFrame, key: str = "vec_id", label: str = "label", embedding: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE
) -> DataFrame:
    """key, n_links, component_id and kept of every vector.

    Vectors of equal, non-null label and equal length are linked if their cosine, in double precision, is at
    least ``threshold`` (which must be positive). n_links counts the other vectors linked directly,
    component_id is the least key reachable, itself included, kept tells whether that is the
    vector's own. Vectors that are null, zero or hold null or non-finite components link with
    nothing, as do those with a null key.

    Equal vectors are made one, with their number, before anything is compared. All rows are kept,
    repeated ones too (each is a vector); no vectors give no rows.
    """
    valid = _valid(vectors, key, label, embedding)
    distinct = pin(valid.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vectors")
    axes = principal_axes(distinct)
    tiles = pin(_tiles(_placed(distinct, axes), axes, tile), "tiles")
    found = pin(_links(tiles, _tile_pairs(tiles, threshold), axes, threshold), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    edges = found.select(F.col("id").alias("u"), F.col("to").alias("v"))
    groups = labelled(distinct.join(counts, "id", "left"), "id", edges, "component").select(
        F.col("label").alias("_label"),
        F.col("v").alias("_v"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("component").alias("component_id"),
    )
    marked = vectors.select(F.col(key), F.col(label).alias("_l"), F.col(embedding).cast("array<double>").alias("_e"))
    joined = marked.join(groups, (F.col("_l") == F.col("_label")) & (F.col("_e") == F.col("_v")) & F.col(key).isNotNull(), "left")
    component = F.coalesce("component_id", key)
    return joined.select(
        key,
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col(key), F.lit(True)).alias("kept"),
    )
