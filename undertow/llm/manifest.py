"""Merkle dataset manifest: leaves appended in order to trees of eight, with witnesses that grow as siblings arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.ordered import numbered
from ..session import pin
from .common import in_slices

#: Nodes of a run, and levels of a tree that are built in one place: a block has FAN ** LEVELS leaves.
FAN, LEVELS = 8, 4
#: Bytes of a digest written as hex text.
WIDTH = 64
#: The fields of a document that its leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    """Hex text of the SHA-256 of the parts, one after another."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def path(place: int, n: int) -> Iterator[tuple[int, int]]:
    """From a leaf's place in a tree of ``n`` leaves to its root: (place in the run, size of the run)."""
    while n > 1:
        run = place // FAN
        yield place % FAN, min(FAN, n - run * FAN)
        place, n = run, -(-n // FAN)


def fold(leaf: bytes, witness: bytes, steps: Iterator[tuple[int, int]]) -> bytes:
    """The root that a leaf and the siblings of its path lead to."""
    at = 0
    for place, size in steps:
        siblings = witness[at : at + (size - 1) * WIDTH]
        leaf = digest(siblings[: place * WIDTH], leaf, siblings[place * WIDTH :])
        at += len(siblings)
    return leaf


class Frontier:
    """A tree under construction: the open run of every level, and a partial witness of each leaf.

    A full run is closed: each of its nodes learns its siblings, which extends the witnesses of all
    leaves below that node, and the parent is appended to the level above.
    """

    def __init__(self, levels: int) -> None:
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels + 1)]
        self.witnesses: list[bytes] = []

    def append(self, leaf: bytes) -> None:
        at = len(self.witnesses)
        self.witnesses.append(b"")
        self._add(0, (leaf, at, at + 1))

    def finish(self) -> bytes:
        """The root, after closing runs that stayed short."""
        for level in range(len(self.open) - 1):
            if self.open[level]:
                self._close(level)
        return self.open[-1][0][0]

    def _add(self, level: int, node: tuple[bytes, int, int]) -> None:
        run = self.open[level]
        run.append(node)
        if len(run) == FAN and level < len(self.open) - 1:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for k, (_, first, end) in enumerate(run):
            siblings = b"".join(d for j, (d, _, _) in enumerate(run) if j != k)
            for i in range(first, end):
                self.witnesses[i] += siblings
        self._add(level + 1, (digest(*(d for d, _, _ in run)), run[0][1], run[-1][2]))


def leaf(fields: tuple[str, ...] = FIELDS, **instead: Column) -> Column:
    """The digest of a row: per field its UTF-8 byte count, a colon and the value, or ``-`` for a null.

    ``instead`` has values to be taken in place of a field's own.
    """
    values = [instead.get(f, F.col(f)).cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with (t, n_trees), the place of their tree and the number of trees, and (pos, n) in it.

    Rows are range partitioned by tree and order, so that a tree with most of the rows spans many
    slices; one row per slice and tree is passed on between them. Slices grow in number, not in size.
    """
    ranged = in_slices(rows, [F.col(c) for c in ("tree", *order)])
    starts = ranged.groupBy("_slice", "tree").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    starts = pin(starts, "leaves")
    trees = numbered(starts.groupBy("tree").agg(F.sum("_n").alias("n")), [], [F.asc_nulls_first("tree")], "t")
    trees = pin(trees.withColumn("t", F.col("t") - 1), "trees")
    n_trees = trees.count()
    before = F.sum("_n").over(Window.partitionBy("tree").orderBy("_slice")) - F.col("_n")
    starts = starts.withColumn("_before", before).alias("s").join(trees.alias("w"), F.expr("s.tree <=> w.tree"))
    starts = starts.select("_slice", F.col("s.tree").alias("_tree"), "_first", "_before", "t", "n")
    starts = starts.withColumnRenamed("_slice", "_of")
    joined = ranged.join(starts, (F.col("_slice") == F.col("_of")) & F.col("tree").eqNullSafe(F.col("_tree")))
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return joined.withColumn("pos", place).drop("_at", "_slice", "_of", "_tree", "_first", "_before"), n_trees


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (t, pos, n, ...) dealt by blocks of whole subtrees, in order."""
    block = F.floor(F.col("pos") / FAN**LEVELS).cast("bigint")
    return nodes.withColumn("block", block)


def _frontiers(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[tuple[int, int, int, bytes | None, list[dict], Frontier]]:
    """Per block: (t, block, n, outer, rows, frontier), with the rows streaming past in order of (t, block, pos).

    A block's first row may be the witness of its root, which has no digest.
    """
    now, rows, outer, frontier = None, [], None, None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["t"], row["block"]) != now:
                if now is not None and rows:
                    yield *now, rows[0]["n"], outer, rows, frontier
                now, rows, outer, frontier = (row["t"], row["block"]), [], None, None
            if row["digest"] is None:
                outer = row["outer"]
                continue
            if frontier is None:
                frontier = Frontier(min(levels, height(row["n"])))
            frontier.append(row["digest"].hex().encode())
            rows.append(row)
    if now is not None and rows:
        yield *now, rows[0]["n"], outer, rows, frontier


def _roots(nodes: DataFrame) -> DataFrame:
    """(t, pos, n, digest) of the root of each block: a node of the tree that the blocks are the leaves of."""
    levels = LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, block, n, _, _, frontier in _frontiers(batches, levels):
            root = bytes.fromhex(frontier.finish().decode())
            columns = [pa.array([t]), pa.array([block]), pa.array([-(-n // FAN**levels)]), pa.array([root])]
            yield pa.RecordBatch.from_arrays(columns, names=["t", "pos", "n", "digest"])

    dealt = _blocks(nodes.select("t", "pos", "n", "digest")).repartition("t", "block")
    return dealt.sortWithinPartitions("t", "block", "pos").mapInArrow(run, "t bigint, pos bigint, n bigint, digest binary")


def _witnessed(nodes: DataFrame, outer: DataFrame | None) -> DataFrame:
    """``nodes`` with ``witness``: the siblings on the way to the block's root, and then those of ``outer``,
    which has (t, pos, witness) of the blocks as nodes of their own."""
    rows = _blocks(nodes).withColumn("outer", F.lit(None).cast("binary"))
    if outer is not None:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema.fields if f.name not in ("t", "pos")]
        above = outer.select("t", F.lit(-1).cast("bigint").alias("pos"), *blank, F.col("pos").alias("block"), F.col("witness").alias("outer"))
        rows = rows.unionByName(above)
    schema = StructType([*nodes.schema.fields, StructField("witness", rows.schema["outer"].dataType)])
    levels = LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for _, _, _, outer, rows, frontier in _frontiers(batches, levels):
            frontier.finish()
            for row, witness in zip(rows, frontier.witnesses):
                row["witness"] = witness + (outer or b"")
            for at in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_pylist(rows[at : at + 1024], schema=kind)

    dealt = rows.repartition("t", "block").sortWithinPartitions("t", "block", "pos")
    return dealt.mapInArrow(run, schema)


def _grown(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and, one after another, the tables of block roots above them, until every tree is one node."""
    levels = [nodes]
    while True:
        roots = pin(_roots(levels[-1]), "roots")
        levels.append(roots)
        if (roots.agg(F.max("n")).first()[0] or 0) <= 1:
            return levels


def _extended(levels: list[DataFrame], outer: DataFrame | None) -> DataFrame:
    """The lowest of ``levels`` with whole witnesses: those of a block's root extend those inside the block."""
    for nodes in reversed(levels[1:]):
        outer = pin(_witnessed(nodes, outer).select("t", "pos", "witness"), "witnesses")
    return _witnessed(levels[0], outer)


def manifest(
    documents: DataFrame,
    key: str = "doc_id",
    tree: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    changed: dict[str, Column] | None = None,
) -> tuple[DataFrame, bytes | None]:
    """Per document its leaf and witness, and the root over all documents (hex text; None without documents).

    Columns: ``key``, leaf, changed, subroot (digests as bytes), witness (hex text of the siblings, level by level
    up to the root, left to right), and the place (pos of n leaves in its tree, t of n_trees trees).

    The rows of each value of ``tree`` are the leaves of a tree, ascending by ``key``; runs of eight
    become one node until one remains. These subroots, ordered by their value (null first, then by
    UTF-8 bytes), are the leaves of the last tree. ``changed`` gives other values for some fields: the digest that the
    row would have with them is returned beside the leaf (as it is where they are null).

    Nulls: a null field is part of the leaf as such; a null tree is a tree of its own, a null key comes first.
    Rows of equal key are ordered by their leaf, and equal rows are leaves of their own. Texts of any length are
    hashed where they are; only digests move. Other columns of ``documents`` are not looked at.

    A task holds the witnesses of one block of 4096 leaves. Lost tasks are run again from the
    written leaves; their order is settled down to equal rows.
    """
    values = {f: F.col(f) for f in fields} | (changed or {})
    other = leaf(fields, **values) if changed else F.lit(None).cast("binary")
    picked = documents.select(F.col(key).alias("key"), F.col(tree).alias("tree"), leaf(fields).alias("digest"), other.alias("changed"))
    leaves = pin(picked, "digests")
    if leaves.isEmpty():
        return _named(leaves.withColumns({c: F.lit(0).cast("bigint") for c in ("t", "pos", "n", "n_trees")}).withColumns(
            {"witness": F.col("digest"), "subroot": F.col("digest")}), key), None
    placed, n_trees = _placed(leaves, ["key", "digest", "changed"])
    levels = _grown(pin(placed.drop("tree"), "placed"))
    subroots = levels[-1]
    top = _grown(subroots.select(F.lit(0).cast("bigint").alias("t"), F.col("t").alias("pos"), F.lit(n_trees).cast("bigint").alias("n"), "digest"))
    root = bytes(top[-1].first()["digest"]).hex().encode()
    above = _extended(top[:-1], None).select(F.col("pos").alias("t"), F.lit(0).cast("bigint").alias("pos"), "witness")
    # The subroots are the last level; their witnesses are those of the last tree's leaves.
    found = _extended(levels[:-1], pin(above, "witnesses"))
    ends = subroots.select("t", F.col("digest").alias("subroot"))
    return _named(found.withColumn("n_trees", F.lit(n_trees).cast("bigint")).join(ends, "t"), key), root


def _named(found: DataFrame, key: str) -> DataFrame:
    return found.select(
        F.col("key").alias(key), F.col("digest").alias("leaf"), "changed", "subroot", "witness", "pos", "n", "t", "n_trees"
    )


def folded(proofs: DataFrame, leaf: Column) -> DataFrame:
    """``proofs`` (of :func:`manifest`) with ``folded``: the root (bytes) that the digest ``leaf`` leads to."""
    rows = proofs.withColumn("folded", leaf)
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = {name: batch.column(name) for name in ("pos", "n", "t", "n_trees", "witness", "folded")}
            out = []
            for pos, n, t, n_trees, witness, start in zip(*(c.to_pylist() for c in take.values())):
                steps = [*path(pos, n), *path(t, n_trees)]
                out.append(bytes.fromhex(fold(start.hex().encode(), witness, iter(steps)).decode()))
            columns = [pa.array(out, pa.binary()) if name == "folded" else batch.column(name) for name in schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(documents: DataFrame, key: str = "doc_id", tree: str = "lang", classes: int = 3) -> DataFrame:
    """Per document: leaf, subroot, root, proof_sha256, folded_root and verified, for a tampering that lower-cases
    A-Z of the texts whose key as text has a crc32 divisible by ``classes`` (a null key is left alone)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    touched = F.crc32(F.col(key).cast("string").cast("binary")) % classes == 0
    text = F.when(touched, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    proofs, root = manifest(documents, key, tree, changed={"text": text})
    done = folded(proofs, F.col("changed"))
    shown = lambda c: F.lower(F.hex(c))
    whole = F.lit((root or b"").decode())
    return done.select(
        key, shown("leaf").alias("leaf"), shown("subroot").alias("subroot"), whole.alias("root"),
        F.sha2("witness", 256).alias("proof_sha256"), shown("folded").alias("folded_root"),
        (shown("folded") == whole).alias("verified"),
    )
