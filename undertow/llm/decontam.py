"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import pin
from .common import hold, map_texts

# Words are runs of digits, letters a-z and bytes above 0x7F, after lower-casing A-Z.
_WORD_BYTES = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32
    for i in range(256)
)
WINDOW = 10
#: Benchmark bytes searched for in one pass over the documents; a larger benchmark takes several.
PASS_BYTES = 32 << 20


def words(text: bytes | None) -> list[bytes]:
    """The words of a text; none for null."""
    return text.translate(_WORD_BYTES).split() if text else []


@dataclass
class Search:
    """Tables of one class of patterns: all windows of the same number of words.

    ``shift`` maps a block (the last two words looked at, or one where windows have a single
    word) to how far the search may move on; a block in no window allows the longest move.
    Blocks that end a window have no shift: they lead through ``ends`` to the windows with that
    ending, which are then compared word by word.
    """

    size: int
    shift: dict = field(default_factory=dict)
    ends: dict = field(default_factory=dict)

    def add(self, window: tuple[bytes, ...], item: str) -> None:
        width = min(2, self.size)
        for last in range(width - 1, self.size):
            block = window[last] if width == 1 else (window[last - 1], window[last])
            move = self.size - 1 - last
            self.shift[block] = min(self.shift.get(block, move), move)
        self.ends.setdefault(block, {}).setdefault(window, set()).add(item)

    def find(self, text: list[bytes]):
        """(first word, items) of every occurrence, in order."""
        size, shift, ends, n = self.size, self.shift, self.ends, len(text)
        at = size - 1
        if size == 1:
            for at, word in enumerate(text):
                if word in shift:
                    yield at, ends[word][(word,)]
            return
        far = size - 1
        while at < n:
            block = (text[at - 1], text[at])
            move = shift.get(block, far)
            if move:
                at += move
                continue
            window = tuple(text[at - size + 1 : at + 1])
            items = ends[block].get(window)
            if items:
                yield at - size + 1, items
            at += 1


def searches(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> list[Search]:
    """One search per pattern length: ``window`` words, or all the words of a shorter item."""
    by_size: dict[int, Search] = {}
    for item, text in items:
        found = words(text)
        size = min(window, len(found))
        for at in range(len(found) - size + 1 if size else 0):
            by_size.setdefault(size, Search(size)).add(tuple(found[at : at + size]), item)
    return [by_size[size] for size in sorted(by_size)]


def scan(text: bytes | None, tables: list[Search]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, the merged stretches [first, end) of hit words, and the items found."""
    found = words(text)
    spans, items = [], set()
    for table in tables:
        for first, names in table.find(found):
            spans.append((first, first + table.size))
            items |= names
    merged: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((first, end))
    return len(found), merged, items


def _batches(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in groups of at most ``limit`` bytes of text (at least one item each)."""
    group, room = [], limit
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    for item, text in rows.where("text is not null").toLocalIterator():
        if group and len(text) > room:
            yield group
            group, room = [], limit
        group.append((item or "", bytes(text)))
        room -= len(text)
    yield group


_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_FIELDS = "n_words bigint, spans array<struct<first: bigint, end: bigint>>, items array<string>"
_TABLES: dict = {}


def _tables(mark: str, shared) -> list[Search]:
    """The tables of a pass, built once per worker process."""
    hold(_TABLES.clear)
    if mark not in _TABLES:
        _TABLES.clear()
        _TABLES[mark] = searches(*shared.value)
    return _TABLES[mark]


def _pass(documents: DataFrame, key: str, group: list[tuple[str, bytes]], window: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast((group, window))
    mark = uuid.uuid4().hex

    def search(texts):
        tables = _tables(mark, shared)
        rows = [scan(t, tables) for t in texts]
        return [
            pa.array([n for n, _, _ in rows], pa.int64()),
            pa.array([[{"first": a, "end": b} for a, b in spans] for _, spans, _ in rows], _SPAN),
            pa.array([sorted(items) for _, _, items in rows], pa.list_(pa.string())),
        ]

    return map_texts(documents, key, _FIELDS, search)


def hits(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """``key``, n_words, spans (stretches of hit words) and items (ids found, as sorted text) per document.

    A word inside any occurrence of ``window`` consecutive words of a benchmark item is hit; an
    item of fewer words, but not none, is looked for whole. Every task holds the patterns of a
    pass, so their bytes are counted: a benchmark beyond ``pass_bytes`` is searched for in several
    passes over the documents, each written before the next. Documents are never shuffled. Where
    ``key`` is a struct with a field ``text``, the texts are taken from there (see :func:`map_texts`).

    Null or empty texts have no words; a null item_id counts as the empty string; an empty
    benchmark hits nothing; rows are kept as they are, repeated ones too.
    """
    groups = _batches(benchmark, pass_bytes)
    group, further = next(groups), next(groups, None)
    if further is None:
        return _pass(documents, key, group, window)
    kind = documents.schema[key].dataType
    inside = isinstance(kind, StructType) and "text" in kind.names
    row = F.col(key) if inside else F.struct(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    rows = _pass(documents.select(row.alias("row")), "row", group, window)
    while further is not None:
        held = pin(rows.select(F.struct("*").alias("before"), F.col("row.text").alias("text")), "decontam")
        rows = _pass(held, "before", further, window).select(
            "before.row",
            "n_words",
            _merged(F.concat("before.spans", "spans")).alias("spans"),
            F.array_sort(F.array_union("before.items", "items")).alias("items"),
        )
        further = next(groups, None)
    return rows.select(F.col("row" if inside else "row.key").alias(key), "n_words", "spans", "items")


def _merged(spans: Column) -> Column:
    """Stretches in order, with those that touch or overlap made one."""

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(
            (F.size(done) > 0) & (span["first"] <= F.try_element_at(done, F.lit(-1))["end"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)),
        ).otherwise(F.concat(done, F.array(span)))

    empty = F.array().cast("array<struct<first: bigint, end: bigint>>")
    return F.aggregate(F.array_sort(spans), empty, add)


def digest(found: DataFrame) -> DataFrame:
    """The result of :func:`hits` as counts and a digest per document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["first"])
    return found.select(
        *[c for c in found.columns if c not in ("n_words", "spans", "items")],
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
