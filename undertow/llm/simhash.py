"""SimHash near-duplicates: fingerprints meet at the codewords of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import lower_ascii, map_texts
from .components import labelled

SHINGLE = 3
SEED = 42
THRESHOLD = 2
#: Anchors with more home fingerprints than this are compared through common neighbours.
CROWDED = 256

# -- fingerprints ---------------------------------------------------------------------------


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half the XXH64 values of the text's word shingles.

    Words are separated by ASCII white space, A-Z is lower-cased, shingles count with repeats. A
    text of fewer words is one shingle; null and texts without words give zero.
    """
    found = lower_ascii(text).split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found])
        first = [0, *ends[:-shingle].tolist()]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first, (ends[shingle - 1 :] - 1).tolist())]
    values = np.array(hashes, ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):  # a very long text needs no more memory than a part of it
        ones += np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values)).view(">u8")[0])


def fingerprints(documents: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint as a signed 64-bit number) of every text."""

    def run(texts):
        return [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]

    return map_texts(documents, key, "fp bigint", run)


# -- the covering code ----------------------------------------------------------------------

# The binary Golay code [23, 12, 7]: every 23-bit word is within 3 bits of exactly one of its
# 4,096 words. Fixed value: its generator polynomial.
_GOLAY = 0b101011100011
_RADIUS, _LENGTH = 3, 23


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    words = words.astype(np.int64)
    for bit in range(_LENGTH - 1, 10, -1):
        words = np.where(words >> bit & 1, words ^ (_GOLAY << (bit - 11)), words)
    return words


def _patterns(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the errors of up to radius + threshold bits, and the bits over the radius.

    Rows are padded; padding counts as more bits over than any search allows.
    """
    words = np.arange(1 << _LENGTH, dtype=np.int64)
    weight = np.bitwise_count(words)
    words = words[weight <= _RADIUS + threshold]
    weight, syndrome = np.bitwise_count(words).astype(np.int64), _syndromes(words)
    order = np.lexsort((weight, syndrome))
    words, weight, syndrome = words[order], weight[order], syndrome[order]
    counts = np.bincount(syndrome, minlength=2048)
    column = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    errors = np.zeros((2048, counts.max()), np.int64)
    over = np.full((2048, counts.max()), 99, np.int64)
    errors[syndrome, column] = words
    over[syndrome, column] = np.maximum(weight - _RADIUS, 0)
    return errors, over


_CODE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, whether the anchor is its home) of every anchor it goes to.

    An anchor is a pair of Golay words over the low 23 and the next 23 bits, so there are 2**24,
    and the covering radius is 3 in each half. The home is the nearest anchor. If x and y differ
    in d1 and d2 bits of the halves, d1 + d2 <= threshold, then y is within 3 + d1 and 3 + d2 of
    x's home: so y goes to every anchor within these, over all such d1 and d2, which is 68 anchors
    at most for a threshold of 2, whatever the number of fingerprints.
    """
    if threshold not in _CODE:
        _CODE[threshold] = _patterns(threshold)
    errors, over = _CODE[threshold]
    mask = (1 << _LENGTH) - 1
    low, high = fps & mask, fps >> _LENGTH & mask
    s_low, s_high = _syndromes(low), _syndromes(high)
    beyond = over[s_low][:, :, None] + over[s_high][:, None, :]
    who, i, j = np.nonzero(beyond <= threshold)
    a = low[who] ^ errors[s_low[who], i]
    b = high[who] ^ errors[s_high[who], j]
    # The upper 12 bits of a word of this code tell it from all others.
    return who, (a >> 11) << 12 | b >> 11, beyond[who, i, j] == 0


def _visits(fps: DataFrame, threshold: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 2048):
                part = values[at : at + 2048]
                who, anchor, home = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.astype(np.int32)), pa.array(part[who]), pa.array(home)],
                    names=["anchor", "fp", "home"],
                )

    return fps.mapInArrow(run, "anchor int, fp bigint, home boolean")


def links(fps: DataFrame, threshold: int = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """Edges (u, v) that join all distinct fingerprints ``fp`` within ``threshold`` bits of each other.

    At an anchor its home fingerprints are compared with all that came, in one equi-join whose
    condition counts differing bits; pairs that fail are never rows. Where an anchor is home to
    more than ``crowded`` fingerprints, the ones that came there are joined instead through the
    64-bit words at half the threshold from them: two are within the threshold exactly if they
    share such a word, a word has at most 65 of them, and each is joined to the least, so a dense
    group costs a number of rows in proportion to its size. (For a threshold of 2.)
    """
    visits = pin(_visits(fps.select("fp").distinct(), threshold), "anchors")
    homes = visits.where("home").select("anchor", F.col("fp").alias("u"))
    busy = homes.groupBy("anchor").count().where(F.col("count") > crowded).select("anchor")
    busy = pin(busy, "anchors")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold
    came = visits.select("anchor", F.col("fp").alias("v"))
    sparse = homes.join(busy, "anchor", "left_anti").join(came, "anchor").where((F.col("u") != F.col("v")) & near)
    edges = sparse.select("u", "v")
    if threshold == 2 and not busy.isEmpty():
        dense = came.join(busy, "anchor", "left_semi").select("v").distinct()
        flips = F.expr("array_append(transform(sequence(0, 63), i -> shiftleft(1L, i)), 0L)")
        around = dense.select("v", F.explode(flips).alias("flip"))
        around = around.select("v", F.col("v").bitwiseXOR(F.col("flip")).alias("word"))
        least = around.groupBy("word").agg(F.min("v").alias("u"), F.collect_list("v").alias("vs")).where(F.size("vs") > 1)
        edges = edges.union(least.select("u", F.explode("vs").alias("v")))
    elif not busy.isEmpty():
        rest = homes.join(busy, "anchor", "left_semi").join(came, "anchor").where((F.col("u") != F.col("v")) & near)
        edges = edges.union(rest.select("u", "v"))
    return edges


def groups(documents: DataFrame, key: str = "doc_id", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``key``, fp and component_id of every document: the least key reachable over linked fingerprints.

    Equal fingerprints are made one before anything else, so any number of exact copies costs one
    entry. Null or wordless texts have fingerprint zero and link like any other; rows with a null
    key are kept and do not name a group unless all of it is null; repeated rows are all kept. No
    documents give no rows.
    """
    held = pin(fingerprints(documents, key, shingle), "fingerprints")
    distinct = held.groupBy("fp").agg(F.min(key).alias("least"))
    joined = labelled(distinct, "fp", links(distinct, threshold), "root")
    joined = pin(joined, "fingerprints")
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(names, "root").select(F.col("fp").alias("_fp"), "component_id")
    return held.join(by_fp, F.col("fp") == F.col("_fp")).select(key, "fp", "component_id")


def hexadecimal(fp: str):
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
