"""Byte-level BPE by ranks: padded matrices of distinct pieces, merged one pair per row and round."""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import hold, map_texts, ranges, run_starts

_NONE = np.int32(np.iinfo(np.int32).max)
#: Pieces up to this many bytes are merged in matrices; longer ones one by one with a heap.
MATRIX_BYTES = 256
#: Cells of a matrix, and entries of a worker's memory of pieces: both bound what a task holds.
MATRIX_CELLS = 1 << 20
REMEMBERED, REMEMBERED_CHARS = 300_000, 64


@dataclass
class Ranks:
    """A vocabulary of byte strings with their ranks, which are also their ids.

    Pairs of tokens are looked up by the hash of (left id, right id) in an open-addressed table of
    every way to cut a token in two tokens; its value is the rank of the whole.
    """

    tokens: list[bytes]
    pattern: str

    def __post_init__(self) -> None:
        ids = {t: i for i, t in enumerate(self.tokens)}
        self.ids = ids
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        self.splitter = regex.compile(self.pattern)
        self.pairs = {
            (left << 32) | right: i
            for t, i in ids.items()
            for cut in range(1, len(t))
            if (left := ids.get(t[:cut])) is not None and (right := ids.get(t[cut:])) is not None
        }
        keys = np.fromiter(self.pairs.keys(), np.int64, len(self.pairs))
        values = np.fromiter(self.pairs.values(), np.int32, len(self.pairs))
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several keys for one slot the last one gets it
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & (len(self.keys) - 1)
        flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.flat, self.lengths, self.starts = flat, lengths, run_starts(lengths)
        self.memory: dict[bytes, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; the largest integer where a pair is no token or an id is -1."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        out = np.full(keys.shape, _NONE, np.int32)
        open_, at = np.arange(keys.size), self._slot(keys.ravel())
        flat, found = keys.ravel(), out.ravel()
        while len(open_):
            held = self.keys[at]
            hit = held == flat[open_]
            found[open_[hit]] = self.values[at[hit]]
            on = ~hit & (held != -1)
            open_, at = open_[on], (at[on] + 1) & (len(self.keys) - 1)
        return found.reshape(keys.shape)

    # -- merging ---------------------------------------------------------------------------

    def merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of similar length, as rows of one padded matrix.

        Every round, each row that still has a mergeable pair merges its leftmost pair of least
        rank: the row is closed up behind it and only the two pairs beside it are looked up anew.
        Rows that are done leave the matrix.
        """
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        rows = np.repeat(np.arange(len(pieces)), lengths)
        ids[rows, ranges(np.zeros(len(pieces), np.int64), lengths)] = self.byte_ids[
            np.frombuffer(b"".join(pieces), np.uint8)
        ]
        ranks = np.full((len(pieces), width + 1), _NONE, np.int32)
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        out: list[np.ndarray] = [None] * len(pieces)
        here, columns = np.arange(len(pieces)), np.arange(width + 1)
        while len(here):
            at = ranks.argmin(axis=1)
            line = np.arange(len(here))
            least = ranks[line, at]
            done = least == _NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[here[r]] = ids[r, : lengths[r]]
                keep = ~done
                here, ids, ranks, lengths = here[keep], ids[keep], ranks[keep], lengths[keep]
                if not len(here):
                    break
                used = int(lengths.max()) + 1
                ids, ranks, columns = ids[:, :used], ranks[:, :used], columns[:used]
                at, least, line = at[keep], least[keep], np.arange(len(here))
            from_ = columns + (columns > at[:, None])
            from_[:, -1] = len(columns) - 1
            ids = np.take_along_axis(ids, from_, 1)
            ranks = np.take_along_axis(ranks, from_, 1)
            ids[line, at] = least
            lengths = lengths - 1
            ranks[line, at] = self.rank(least, ids[line, at + 1])
            left = np.flatnonzero(at > 0)
            if len(left):
                ranks[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], least[left])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one very long piece, by a heap of its pairs: the same merges in n log n steps."""
        import heapq

        ids = [int(x) for x in self.byte_ids[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        before, after, stamp = list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n
        alive = [True] * n
        find = self.pairs.get
        heap = [
            (rank, i, 0) for i in range(n - 1) if (rank := find((ids[i] << 32) | ids[i + 1])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            rank, i, mark = heapq.heappop(heap)
            if not alive[i] or stamp[i] != mark:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k < 0:
                    continue
                stamp[k] += 1
                if after[k] < n and (r := find((ids[k] << 32) | ids[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, stamp[k]))
        return np.array([x for x, live in zip(ids, alive) if live], np.int32)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of every piece."""
        out: list[bytes] = [b""] * len(pieces)
        order = sorted((len(p), i) for i, p in enumerate(pieces))
        start = 0
        while start < len(order):
            size = order[start][0]
            if size == 0:
                start += 1
                continue
            if size > MATRIX_BYTES:
                for _, i in order[start:]:
                    out[i] = self.merge_long(pieces[i]).astype("<u4").tobytes()
                break
            # Lengths in a bucket differ by a quarter at most, so padding stays small.
            most, end = min(MATRIX_BYTES, size + max(1, size // 4)), start
            room = max(1, MATRIX_CELLS // (most + 1))
            while end < len(order) and order[end][0] <= most and end - start < room:
                end += 1
            picked = [i for _, i in order[start:end]]
            for i, ids in zip(picked, self.merge_rows([pieces[i] for i in picked])):
                out[i] = ids.astype("<u4").tobytes()
            start = end
        return out

    # -- texts -----------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts.

        A text without two white-space characters in a row is cut before each space first: no
        match of the pattern reaches across such a place, and the chunks repeat so often that
        most are found in the worker's memory. Other texts are matched whole.
        """
        cut = [self._chunks(t) for t in texts]
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        fresh = [c for c in set().union(*cut) if c not in memory] if cut else []
        if fresh:
            matches = [self.splitter.findall(c) for c in fresh]
            pieces = {p for m in matches for p in m}
            unknown = [p for p in pieces if p not in memory]
            ids = dict(zip(unknown, self.merge([p.encode() for p in unknown])))
            for chunk, match in zip(fresh, matches):
                memory[chunk] = b"".join([ids[p] if p in ids else memory[p] for p in match])
        out = [b"".join([memory[c] for c in chunks]) for chunks in cut]
        for chunk in fresh:
            if len(chunk) > REMEMBERED_CHARS:
                del memory[chunk]
        return out

    def _chunks(self, text: str) -> list[str]:
        if _DOUBLE.search(text):
            return self.splitter.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + c for c in rest]]

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids."""
        ids = np.frombuffer(packed, "<u4")
        return self.flat[ranges(self.starts[ids], self.lengths[ids])].tobytes()


_DOUBLE = regex.compile(r"\s\s|^\s|\s$")


def load(data: bytes, pattern: str) -> Ranks:
    """A rank file: base64 token and rank per line, ranks 0, 1, 2, ..."""
    ranked = {int(rank): base64.b64decode(token) for token, rank in (x.split() for x in data.splitlines() if x)}
    return Ranks([ranked[i] for i in range(len(ranked))], pattern)


_LOADED: dict = {}


def ship(spark, path: str) -> str:
    """Send a vocabulary file (a few megabytes) to the executors; its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def shared(name: str, pattern: str) -> Ranks:
    """The vocabulary of a shipped file, loaded once per worker process."""
    hold(_LOADED.clear)
    if (name, pattern) not in _LOADED:
        with open(SparkFiles.get(name), "rb") as file:
            _LOADED[name, pattern] = load(file.read(), pattern)
    return _LOADED[name, pattern]


def encode_decode(documents: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key``, ids (packed, little-endian unsigned 32 bits) and decoded (bytes) of every text.

    Row by row, without a shuffle. A null text counts as empty, an empty text has no ids; rows are
    kept as they are, repeated ones too. The decoded bytes come from the ids alone.
    """
    name = ship(documents.sparkSession, path)

    def run(texts):
        ranks = shared(name, pattern)
        packed = ranks.encode([(t or b"").decode() for t in texts])
        return [pa.array(packed, pa.binary()), pa.array([ranks.decode(p) for p in packed], pa.binary())]

    return map_texts(documents, key, "ids binary, decoded binary", run)


def digests(documents: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """As :func:`encode_decode`, with counts and digests in place of the ids and bytes."""
    name = ship(documents.sparkSession, path)

    def run(texts):
        ranks = shared(name, pattern)
        packed = ranks.encode([(t or b"").decode() for t in texts])
        return [
            pa.array([len(p) // 4 for p in packed], pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
            pa.array([hashlib.sha256(ranks.decode(p)).hexdigest() for p in packed]),
        ]

    return map_texts(documents, key, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", run)
