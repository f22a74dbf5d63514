"""Importance resampling towards a target: hashed n-gram gains, summed per document, and a Gumbel draw."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, numbered, portions, ranges, run_starts

#: Buckets that n-grams are hashed to, words of the longest n-gram.
BUCKETS, LONGEST = 10_000, 2
#: Documents with fewer words are not drawn; of a hundred of the others so many are.
LEAST_WORDS, PERCENT = 20, 25
SALT = "7:"
#: Strings longer than this are hashed one by one.
_LONG = 128
# Words are runs of digits, letters a-z and bytes above 0x7F, after lower-casing A-Z.
_WORD_BYTES = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256)
)
# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _mixed(sums: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    return _rotated(sums + lanes * _P2, 31) * _P1


def xxh64(strings: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the rows of a matrix of bytes: strings of one length, side by side."""
    n, length = strings.shape
    lanes = np.ascontiguousarray(strings[:, : length // 8 * 8]).view("<u8")
    with np.errstate(over="ignore"):
        if length >= 32:
            sums = [np.full(n, s) for s in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
            stripes = length // 32 * 4
            for i in range(0, stripes, 4):
                sums = [_mixed(s, lanes[:, i + k]) for k, s in enumerate(sums)]
            h = sum((_rotated(s, r) for s, r in zip(sums[1:], (7, 12, 18))), _rotated(sums[0], 1))
            for s in sums:
                h = (h ^ _mixed(np.uint64(0), s)) * _P1 + _P4
        else:
            h, stripes = np.full(n, _P5), 0
        h = h + np.uint64(length)
        for i in range(stripes, length // 8):
            h = _rotated(h ^ _mixed(np.uint64(0), lanes[:, i]), 27) * _P1 + _P4
        at = length // 8 * 8
        if length - at >= 4:
            word = np.ascontiguousarray(strings[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64)
            h, at = _rotated(h ^ word * _P1, 23) * _P2 + _P3, at + 4
        for i in range(at, length):
            h = _rotated(h ^ strings[:, i].astype(np.uint64) * _P5, 11) * _P1
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        return h ^ h >> np.uint64(32)


class Interned:
    """An open-addressed table of the n-grams of a batch.

    A slot is found by the XXH64 of the n-gram, probing onwards from there; a slot with the same hash is
    taken only if the bytes are the same. Slots hold the bucket of their n-gram and how often it occurs.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS) -> None:
        n = len(starts)
        self.data, self.starts, self.ends = data, starts, ends
        bits = max(4, int(2 * n).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.owner = np.full(1 << bits, -1, np.int64)  # the first occurrence of the slot's n-gram
        self.keys = np.zeros(1 << bits, np.uint64)
        self.slots = np.zeros(n, np.int64)
        lengths = ends - starts
        order = np.argsort(lengths, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if n else ():
            for at in range(0, len(part), 1 << 16):
                self._intern(part[at : at + (1 << 16)], int(lengths[part[0]]))
        used = np.flatnonzero(self.owner >= 0)
        self.bucket = np.zeros(1 << bits, np.int64)
        flat, own = data.tobytes(), self.owner[used]
        crcs = (zlib.crc32(flat[a:b]) for a, b in zip(starts[own].tolist(), ends[own].tolist()))
        self.bucket[used] = np.fromiter(crcs, np.int64, len(used)) % buckets
        self.count = np.bincount(self.slots, minlength=1 << bits)

    def _bytes(self, which: np.ndarray, length: int) -> np.ndarray:
        return self.data[self.starts[which][:, None] + np.arange(length)]

    def _intern(self, which: np.ndarray, length: int) -> None:
        """Slots of the occurrences ``which``, all of one length."""
        if length > _LONG:
            keys = np.array([xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes()) for i in which], np.uint64)
            strings = None
        else:
            strings = self._bytes(which, length)
            keys = xxh64(strings)
        at = (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        left = np.arange(len(which))
        while len(left):
            free = self.owner[at] < 0
            self.owner[at[free]] = which[left[free]]  # of several that come for a free slot the last one has it
            self.keys[at[free]] = keys[left[free]]
            mine = self.owner[at]
            same = (self.keys[at] == keys[left]) & (self.ends[mine] - self.starts[mine] == length)
            near = np.flatnonzero(same & (mine != which[left]))
            if len(near):
                same[near] = self._equal(strings, which, left[near], mine[near], length)
            self.slots[which[left[same]]] = at[same]
            left, at = left[~same], (at[~same] + 1) & self.mask

    def _equal(self, strings, which: np.ndarray, left: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
        if strings is not None:
            return (strings[left] == self._bytes(owners, length)).all(axis=1)
        pairs = zip(self.starts[which[left]].tolist(), self.starts[owners].tolist())
        return np.array([np.array_equal(self.data[a : a + length], self.data[b : b + length]) for a, b in pairs], bool)


def ngrams(texts: list[bytes | None], longest: int = LONGEST):
    """(bytes, starts, ends, document, words per document) of all runs of 1 to ``longest`` words in a batch of texts."""
    plain = [b" ".join((t or b"").translate(_WORD_BYTES).split()) for t in texts]
    sizes = np.array([len(p) + 1 for p in plain], np.int64)
    data = np.frombuffer(b"\n".join([*plain, b""]), np.uint8)
    first = run_starts(sizes)
    gaps = np.flatnonzero((data == 32) | (data == 10))
    begin = np.concatenate([[0], gaps[:-1] + 1]) if len(gaps) else gaps
    full = gaps > begin  # a text without words is an empty stretch
    begin, end = begin[full], gaps[full]
    owner = np.searchsorted(first, begin, "right") - 1
    words = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    starts, ends, documents = [], [], []
    for n in range(1, longest + 1):
        whole = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        starts.append(begin[whole])
        ends.append(end[whole + n - 1])
        documents.append(owner[whole])
    return data, np.concatenate(starts), np.concatenate(ends), np.concatenate(documents), words


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Occurrences of n-grams per bucket over all texts.

    Tasks add up what they have seen; a row per task and bucket is summed by Spark, and one row per bucket, a fixed
    number, comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in portions(batch):
                table = Interned(*ngrams(found, longest)[:3], buckets)
                np.add.at(total, table.bucket, table.count)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    picked = texts.select(F.lit(0).alias("key"), F.col("text").cast("string").alias("text"))
    rows = picked.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, each count raised by one."""
    n = len(source)
    total, aim = float(source.sum()) + n, float(target.sum()) + n
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * total / ((s + 1.0) * aim))) for s, t in pairs], np.int64)


def _noise(key: str) -> Column:
    """Thousandths of a Gumbel variable drawn by the digest of the key; a null key is drawn as an empty one."""
    name = F.concat(F.lit(SALT), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    documents: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
) -> DataFrame:
    """(``key``, n_words, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    Features are all runs of 1 to ``longest`` consecutive words, hashed to ``buckets``; a bucket's gain compares its
    share in the texts of ``target`` with that in ``documents``, both counted over all rows. A document's
    weight is the floored mean of its features' gains, its score the weight plus a Gumbel variable that its key
    fixes. Of the documents with at least ``least_words`` words, the ``percent`` in a hundred (floored) of
    highest score are drawn without replacement, equal scores in order of the key.

    A null or empty text has no words, no features and weight 0. Null keys share one draw and come last among
    equals; repeated rows are documents of their own, in any order. Texts of any length are taken whole.
    Other columns of ``documents`` are not looked at. No documents: no rows; no target: gains from ``documents`` alone.

    Texts stay where they are in both passes; only 10,000 counters and one slim row per document move.
    """
    gain = documents.sparkSession.sparkContext.broadcast(
        gains(bucket_counts(documents, buckets, longest), bucket_counts(target, buckets, longest))
    )

    def run(texts):
        data, starts, ends, owner, words = ngrams(texts, longest)
        table = Interned(data, starts, ends, buckets)
        n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        sums = np.bincount(owner, gain.value[table.bucket[table.slots]], len(texts)).astype(np.int64)
        return [pa.array(words), pa.array(n), pa.array(sums // np.maximum(n, 1))]

    weighed = map_texts(documents, key, "n_words bigint, n_features bigint, weight bigint", run)
    scored = weighed.withColumn("score", F.col("weight") + _noise(key))
    fit = F.col("n_words") >= least_words
    order = [F.col("fit").desc(), F.col("score").desc(), F.asc_nulls_last(key), F.col("n_features").asc()]
    placed, counts = numbered(scored.withColumn("fit", fit), order, "rank", F.count_if("fit"))
    drawn = percent * (counts or 0) // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return placed.select(key, "n_words", "n_features", "weight", "score", rank.alias("rank"))
