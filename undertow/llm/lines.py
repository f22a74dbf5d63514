"""Line dedup: an exact set-similarity join of lines, whose later matches are removed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import pin
from .common import hold, portions, ranges, run_starts

SIMILARITY = 0.8
#: A token in more than LIMIT prefixes, or with more than CROWDED candidate pairs per prefix, compares its
#: lines with its earliest one first.
LIMIT, CROWDED = 4096, 8
#: Counters of token frequencies.
COUNTERS = 1 << 18
_PARTS = 16
#: Words for each bucket of tokens, and buckets at most; postings that a task sends at a time at least.
_BUCKET_WORDS, _MOST_BUCKETS, _SENT = 1 << 16, 1 << 15, 1 << 17
#: Postings of a bucket in memory before those of crowded tokens are put out; sizes of lines are told apart up to the largest.
_HELD, _LARGEST = 1 << 20, (1 << 16) - 1
#: Pairs of postings that a task looks at at a time; tokens with some postings are taken many at a time, and few are no crowd.
_TRIED, _SOME, _FEW = 200_000, 256, 16
#: Bits of the filter of needed lines for each of them, and at most: beyond, more sets are sent than needed.
_NEEDED_BITS, _MOST_BITS = 16, 1 << 27
#: Line ids that a task remembers, so as not to send a line twice.
_SEEN = 1_000_000
#: Rounds in which the earliest line of a crowded token is compared with the others, and the share of the rest that
#: a round must decide for another to follow.
PIVOTS, WORTH = 4, 0.1
# Words are runs of digits, letters a-z and bytes above 0x7F, after lower-casing A-Z; lines stay apart.
_WORD_BYTES = bytes(
    i + 32 if 65 <= i <= 90 else i if i == 10 or 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32
    for i in range(256)
)
#: Matches texts with a word in them, in the engine's regular expressions.
HAS_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


#: Bytes of a word that are read at a time, and of a word beyond which it is hashed by itself.
_STEP, _LONG = 8, 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(_STEP + 1)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _nothing() -> None:
    """What this operator remembers in a worker: nothing (see :func:`hold`)."""


def _mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values, each bit spread over all; different ones stay different."""
    values = (values ^ values >> np.uint64(30)) * _ODD[1]
    values = (values ^ values >> np.uint64(27)) * _ODD[2]
    return values ^ values >> np.uint64(31)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts; the number of words of each line, and of lines of each text.

    Lines end at line feeds. All words take their next eight bytes at once: different words of one length up to eight have
    different hashes, and others with the chance of 64 random bits.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = b"".join([b" ", b"\n".join(texts).translate(_WORD_BYTES), b" " * _STEP])
    found = np.frombuffer(data, np.uint8)
    inside = found > 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    ends = np.append(np.searchsorted(starts, np.flatnonzero(found == 10)), len(starts))
    words = np.lib.stride_tricks.as_strided(found[:_STEP].view("<u8"), (len(data) - _STEP + 1,), (1,))
    hashes = _mixed(sizes.astype(np.uint64) * _ODD[0] ^ words[starts] & _MASKS[np.minimum(sizes, _STEP)])
    left = np.flatnonzero(sizes > _STEP)
    for at in range(_STEP, _LONG, _STEP):
        left = left[sizes[left] > at]
        if not len(left):
            break
        hashes[left] = _mixed(hashes[left] * _ODD[0] ^ words[starts[left] + at] & _MASKS[np.minimum(sizes[left] - at, _STEP)])
    for i in np.flatnonzero(sizes > _LONG):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return hashes, np.diff(ends, prepend=0), np.array([t.count(b"\n") + 1 for t in texts], np.int64)


def line_ids(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of the words in order, for each line; every line has a word."""
    place = np.arange(len(hashes)) - np.repeat(run_starts(lengths), lengths)
    placed = _mixed(hashes + (place + 1).astype(np.uint64) * _ODD[0])
    return _mixed(np.add.reduceat(placed, run_starts(lengths)) if len(lengths) else placed).view(np.int64)


def prefix_length(size: int | np.ndarray, similarity: float = SIMILARITY):
    """Tokens of a set of ``size`` of which one must be shared with any set that is similar enough."""
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


def ordered_sets(hashes: np.ndarray, lengths: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct token hashes of every line, the rarest first, one line after another; and set sizes. At most 2 ** 16 lines."""
    line = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    level = rarity[hashes & np.uint64(COUNTERS - 1)].astype(np.uint64)
    order = np.argsort(line << np.uint64(48) | level << np.uint64(42) | hashes >> np.uint64(22))
    hashes, line = hashes[order], line[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
    return hashes[fresh], np.bincount(line[fresh].astype(np.int64), minlength=len(lengths))


def _identified(documents: DataFrame, key: str) -> DataFrame:
    return documents.select(
        F.struct(F.col(key).alias("key"), F.xxhash64("text").alias("mark")).alias("doc"),
        F.col("text").cast("string").alias("text"),
    )


def _survey(docs: DataFrame) -> DataFrame:
    """Per document the ids of its lines; per task the counters of its tokens, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        hold(_nothing)
        for docs_, texts in (p for batch in batches for p in portions(batch)):
            hashes, lengths, counts = word_hashes([t or b"" for t in texts])
            total += np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            ids, n = np.zeros(len(lengths), np.int64), len(texts)
            ids[lengths > 0] = line_ids(hashes, lengths[lengths > 0])
            ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            ids = pa.ListArray.from_arrays(ends, pa.array(ids, mask=lengths == 0))
            yield pa.RecordBatch.from_arrays(
                [docs_, ids, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names
            )
        if total.any():
            parts = [p.astype("<u8").tobytes() for p in np.split(total, _PARTS)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(_PARTS, doc_type),
                    pa.nulls(_PARTS, pa.list_(pa.int64())),
                    pa.array(range(_PARTS), pa.int32()),
                    pa.array([task % 64] * _PARTS, pa.int32()),
                    pa.array(parts, pa.binary()),
                ],
                names=names,
            )

    from pyspark.sql.pandas.types import to_arrow_type

    doc = docs.schema["doc"]
    schema = StructType([StructField("doc", doc.dataType), *StructType.fromDDL("ids array<bigint>, part int, salt int, counts binary").fields])
    names, doc_type = schema.names, to_arrow_type(doc.dataType)
    return docs.mapInArrow(run, schema)


def _rarity(survey: DataFrame) -> tuple[np.ndarray, int]:
    """The logarithm of each counter, and the words of all. Counters are added up in two steps; their number is fixed."""
    counters = survey.where("part is not null").select("part", "salt", "counts")

    def add(rows):
        total = sum(np.frombuffer(c, "<u8").astype(np.int64) for c in rows["counts"])
        return rows.head(1).assign(counts=[total.astype("<u8").tobytes()])

    kind = "part int, salt int, counts binary"
    some = counters.groupBy("part", "salt").applyInPandas(add, kind)
    parts = {r["part"]: r["counts"] for r in some.groupBy("part").applyInPandas(add, kind).collect()}
    if not parts:
        return np.zeros(COUNTERS, np.uint8), 0
    total = np.concatenate([np.frombuffer(parts[i], "<u8") for i in range(_PARTS)])
    return np.floor(np.log2(total + 1.0) * 1.5).clip(0, 63).astype(np.uint8), int(total.sum())


def _chunks(batches: Iterator[pa.RecordBatch], room: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, hashes of words, words per line) of lines that have some, a bounded number of lines at a time."""
    hold(_nothing)
    for _, texts in (p for batch in batches for p in portions(batch)):
        hashes, lengths, _ = word_hashes([t or b"" for t in texts])
        lengths = lengths[lengths > 0]
        ids, ends = line_ids(hashes, lengths), np.append(0, np.cumsum(lengths))
        for at in range(0, len(ids), room):
            part = slice(at, at + room)
            yield ids[part], hashes[ends[at] : ends[min(at + room, len(ids))]], lengths[part]


def _picked(hashes: np.ndarray, lengths: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and lengths of some of the lines, whose numbers ascend."""
    return hashes[ranges(run_starts(lengths)[lines], lengths[lines])], lengths[lines]


def _postings(docs: DataFrame, rarity: np.ndarray, similarity: float, buckets: int) -> DataFrame:
    """(bucket, postings): the prefix of each line, once per line text and task.

    A posting is (token, id, meta, sign, more), see :func:`_reaches` and :func:`_alike`; a token is the upper 48 bits of a hash. Postings are sent by the
    bucket of their token, many in one row: what a task found in a few megabytes of texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        seen: set[int] = set()
        for ids, hashes, lengths in _chunks(batches):
            if len(seen) > _SEEN:
                seen.clear()
            new = np.array([i for i, x in enumerate(ids.tolist()) if not (x in seen or seen.add(x))], np.int64)
            if not len(new):
                continue
            hashes, sizes = ordered_sets(*_picked(hashes, lengths, new), shared.value)
            n = prefix_length(sizes, similarity)
            place = np.arange(int(n.sum())) - np.repeat(run_starts(n), n)
            kind = hashes >> np.uint64(20) & np.uint64(127)
            bits = np.uint64(1) << (kind & np.uint64(63))
            signs = [np.where(kind >> np.uint64(6) == half, bits, np.uint64(0)) for half in (0, 1)]
            signs = [np.bitwise_xor.reduceat(b, run_starts(sizes)).view(np.int64) for b in signs]
            found = np.empty((len(place), 5), np.int64)
            found[:, 0] = hashes[np.repeat(run_starts(sizes), n) + place] >> np.uint64(16)
            for i, column in enumerate([ids[new], sizes << 32, *signs], 1):
                found[:, i] = np.repeat(column, n)
            found[:, 2] |= place
            yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _gathered(prefixes(batches), max(_SENT, 32 * buckets)):
            found = found[np.argsort(found[:, 0])]
            bucket, first = np.unique(found[:, 0] * buckets >> 48, return_index=True)
            ends = pa.py_buffer((np.append(first, len(found)) * found.itemsize * 5).astype(np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(bucket), [None, ends, pa.py_buffer(found)])
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), packed], names=["bucket", "postings"])

    return docs.select(F.lit(0), "text").mapInArrow(run, "bucket int, postings binary")


def _gathered(parts: Iterator[np.ndarray], room: int) -> Iterator[np.ndarray]:
    """The rows of all parts in pieces of some ``room`` rows."""
    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= room:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _size(meta):
    """Tokens of the line, from the upper half of a posting's ``meta``; numpy array or column."""
    return meta >> 32 if isinstance(meta, np.ndarray) else F.shiftright(meta, 32)


def _place(meta):
    """Place of the token in the line's order, from 0."""
    return meta & 0xFFFFFFFF if isinstance(meta, np.ndarray) else meta.bitwiseAND(F.lit(0xFFFFFFFF))


def _reaches(x, y, similarity: float, least=np.minimum, ceil=np.ceil):
    """Whether two postings of one token, told by their ``meta``, may belong to lines that match; loses no match.

    The lengths must allow the similarity; so must the tokens from this one on, if it is the first
    that the lines share.
    """
    a, b = _size(x), _size(y)
    needed = ceil((a + b) * (similarity / (1 + similarity)) - 1e-9)
    rest = least(a - _place(x), b - _place(y))
    return (a >= b * similarity - 1e-9) & (b >= a * similarity - 1e-9) & (rest >= needed)


def _alike(x, y, x_signs, y_signs, similarity: float, ones=np.bitwise_count):
    """Whether two lines may match by their pairs (sign, more); loses no match.

    These have a bit per class of token hashes, set if the line has an odd number of such tokens: each differing bit is a
    token that only one of the lines has.
    """
    apart = [ones(p ^ q if isinstance(p, np.ndarray) else p.bitwiseXOR(q)) for p, q in zip(x_signs, y_signs)]
    apart = apart[0].astype(np.int64) + apart[1] if isinstance(apart[0], np.ndarray) else apart[0] + apart[1]
    return apart <= (_size(x) + _size(y)) * ((1 - similarity) / (1 + similarity)) + 1e-9


def _meetings(postings: DataFrame, similarity: float, limit: int, crowded: int, buckets: int) -> DataFrame:
    """One shuffle of the postings by bucket of their token: candidate pairs, and the postings of crowded tokens.

    Rows are (a, b) with a < b for lines that met at a token and fit each other, and (a = id, token,
    meta, sign, more) for each posting of a crowded token: one with over ``limit`` postings, or with more
    than ``crowded`` fitting pairs per posting. Buckets stream past in order; a line is only tried with lines of fitting
    size. A task holds a bucket, of whose crowded tokens it keeps none, and a
    batch, and what it puts out is bounded by a multiple of what it reads.
    """

    def fitting(ids: np.ndarray, meta: np.ndarray, signs: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray):
        on = _reaches(meta[x], meta[y], similarity) & (ids[x] != ids[y])
        x, y = x[on], y[on]
        at_x, at_y = ([s[at].view(np.uint64) for s in signs] for at in (x, y))
        on = _alike(meta[x], meta[y], at_x, at_y, similarity)
        return x[on], y[on]

    def several(ids, meta, signs, first, size):
        """(pairs, numbers of crowded tokens), of many tokens with some postings at a time; few of them are no crowd."""
        at, token = ranges(first, size), np.repeat(np.arange(len(first)), size)
        ids, meta, signs = ids[at], meta[at], [s[at] for s in signs]
        length = np.minimum(_size(meta), _LARGEST)
        longest = np.minimum(length / similarity + 1e-6, _LARGEST).astype(np.int64)
        width = np.searchsorted(token << 16 | length, token << 16 | longest, "right") - np.arange(len(at)) - 1
        starts, most = run_starts(size), np.where(size > min(_FEW, limit), crowded * size, len(at) ** 2)
        cuts = np.flatnonzero(np.diff(np.cumsum(np.add.reduceat(width, starts)) // _TRIED, prepend=0)) if len(first) else []
        for a, b in zip([0, *cuts], [*cuts, len(first)]):
            if a < b:
                part = slice(starts[a], starts[b - 1] + size[b - 1])
                here = np.arange(part.start, part.stop)
                x, y = fitting(ids, meta, signs, np.repeat(here, width[part]), ranges(here + 1, width[part]))
                many = np.bincount(token[x] - a, minlength=b - a) > most[a:b]
                on = ~many[token[x] - a]
                yield (ids[x[on]], ids[y[on]]), a + np.flatnonzero(many)

    def large(ids, meta, signs):
        """Pairs of one token; None if they are too many."""
        size = np.minimum(_size(meta), _LARGEST)
        end = np.searchsorted(size, size / similarity + 1e-6, "right")
        width, here = end - np.arange(len(ids)) - 1, np.arange(len(ids))
        cuts = np.unique(np.searchsorted(np.cumsum(width), np.arange(0, width.sum() + _TRIED, _TRIED)))
        found, n = [], 0
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            if a < b:
                x = np.repeat(here[a:b], width[a:b])
                x, y = fitting(ids, meta, signs, x, ranges(here[a:b] + 1, width[a:b]))
                found.append((ids[x], ids[y]))
                n += len(found[-1][0])
                if n > crowded * len(ids):
                    return None
        return found

    def rows(a, b=None, *crowd) -> pa.RecordBatch:
        columns = [a, b, *(crowd or (None, None, None, None))]
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([none if c is None else pa.array(c) for c in columns], names=names)

    def once(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Pairs that met at several tokens, once."""
        a, b = (np.concatenate(c) for c in zip(*pairs))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.argsort(_mixed(a.view(np.uint64)) + b.view(np.uint64))
        a, b = a[order], b[order]
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        return rows(a[fresh], b[fresh])

    def in_order(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings by token and size; where each token begins, and how many it has."""
        found = found[np.argsort(found[:, 0] << 16 | np.minimum(_size(found[:, 2]), _LARGEST))]
        token = found[:, 0]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        return found, first, np.diff(np.append(first, len(token)))

    def settle(found: np.ndarray, crowd: np.ndarray):
        """Output of whole buckets; ``crowd`` are the tokens already known to be crowded."""
        found, first, size = in_order(found)
        token, ids, meta, *signs = (np.ascontiguousarray(c) for c in found.T)
        known = np.isin(token[first], crowd)
        some, pairs, n_pairs = (size <= min(_SOME, limit)) & ~known, [], 0
        many = (size > limit) | known
        for met, crowds in several(ids, meta, signs, first[some], size[some]):
            many[np.flatnonzero(some)[crowds]] = True
            pairs.append(met)
            n_pairs += len(met[0])
            if n_pairs > _TRIED:
                yield once(pairs)
                pairs, n_pairs = [], 0
        for i in np.flatnonzero(~some | many):
            part = slice(first[i], first[i] + size[i])
            met = None if many[i] else large(ids[part], meta[part], [s[part] for s in signs])
            if met is None:
                yield rows(ids[part], None, token[part], meta[part], *[s[part] for s in signs])
                continue
            pairs += met
            n_pairs += sum(len(a) for a, _ in met)
            if n_pairs > _TRIED:
                yield once(pairs)
                pairs, n_pairs = [], 0
        if pairs:
            yield once(pairs)

    def shed(found: np.ndarray):
        """Without the tokens that are crowded by now; and the postings of these."""
        found, first, size = in_order(found)
        many = np.repeat(size > limit, size)
        return found[~many], found[many]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_nothing)
        held, crowd, room = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), _HELD
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, packed = batch.column(0), batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1] // 40
            found = np.frombuffer(packed.buffers()[2], np.int64)[: ends[-1] * 5].reshape(-1, 5)[ends[0] :]
            bucket = bucket.to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            ended = found[: ends[last] - ends[0]]
            if len(held) and (last or held[0, 0] * buckets >> 48 != bucket[-1]):
                ended, held = np.concatenate([held, ended]), held[:0]
            if len(ended):
                yield from settle(ended, crowd)
                crowd, room = crowd[:0], _HELD
            held = np.concatenate([held, found[ends[last] - ends[0] :]])
            if len(held) > room:
                held, gone = shed(held)
                crowd, room = np.union1d(crowd, gone[:, 0]), max(_HELD, 2 * len(held))
                if len(gone):
                    yield rows(gone[:, 1], None, gone[:, 0], *gone[:, 2:].T)
        if len(held):
            yield from settle(held, crowd)

    names = ["a", "b", "token", "meta", "sign", "more"]
    ordered = postings.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _pairs(x: DataFrame, y: DataFrame, similarity: float) -> DataFrame:
    """Distinct candidate pairs (x, y, first) of postings (id, first, token, meta, sign, more) that meet at a token, ``x`` the earlier line."""
    met = x.alias("x").join(y.alias("y"), "token").where(F.col("x.first") < F.col("y.first"))
    signs = [[F.col(f"{side}.sign"), F.col(f"{side}.more")] for side in ("x", "y")]
    met = met.where(_reaches(F.col("x.meta"), F.col("y.meta"), similarity, F.least, F.ceil))
    met = met.where(_alike(F.col("x.meta"), F.col("y.meta"), *signs, similarity, F.bit_count))
    return met.select(F.col("x.id").alias("x"), F.col("y.id").alias("y"), F.col("x.first").alias("first")).distinct()


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(id, tokens) of the lines with the needed ids, and of few others.

    The needed ids are told by a bitmap of bounded size, so the documents are only read, and only
    these sets are shuffled.
    """
    bits = min(_MOST_BITS, 1 << max(16, (needed.count() * _NEEDED_BITS).bit_length()))
    bit = F.pmod("id", F.lit(bits)) + 1
    rows = needed.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    )
    filter_ = np.zeros(bits // 8 + 8192, np.uint8)
    for r in rows.collect():
        at = (r["bucket"] - 1) * 4096
        filter_[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared, alike = docs.sparkSession.sparkContext.broadcast(filter_), np.zeros(COUNTERS, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = shared.value, set()
        for ids, hashes, lengths in _chunks(batches):
            if len(seen) > _SEEN:
                seen.clear()
            place = ids & (bits - 1)
            wanted = np.flatnonzero(held[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            new = [i for i, x in zip(wanted.tolist(), ids[wanted].tolist()) if not (x in seen or seen.add(x))]
            new = np.array(new, np.int64)
            tokens, sizes = ordered_sets(*_picked(hashes, lengths, new), alike)
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            tokens = pa.ListArray.from_arrays(ends, pa.array(tokens.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[new]), tokens], names=["id", "tokens"])

    found = docs.select(F.lit(0), "text").mapInArrow(run, "id bigint, tokens array<bigint>")
    return found.groupBy("id").agg(F.any_value("tokens").alias("tokens"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The later lines (y) of those candidate pairs (x, y) that match, by their whole sets (id, tokens)."""
    both = pairs.select("x", "y").join(sets.select(F.col("id").alias("x"), F.col("tokens").alias("s")), "x")
    both = both.join(sets.select(F.col("id").alias("y"), F.col("tokens").alias("t")), "y")
    shared = F.size(F.array_intersect("s", "t"))
    return both.where(shared >= (F.size("s") + F.size("t") - shared) * similarity - 1e-9).select("y").distinct()


def _matched(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(y): the lines that match an earlier one among their candidates (x, y, first); ``first`` is where x stands.

    One match decides a line, so its earliest candidate is looked at first, and only a line
    that this does not decide meets all the others: sets are sent for the pairs of a round.
    """
    turn = F.row_number().over(Window.partitionBy("y").orderBy("first"))
    pairs = pin(pairs.select("x", "y", turn.alias("turn")), "pairs")
    gone = pin(_verified(pairs.where("turn = 1"), sets, similarity), "matches")
    others = pin(pairs.where("turn > 1").join(gone, "y", "left_anti"), "pairs")
    return gone if others.isEmpty() else pin(gone.union(_verified(others, sets, similarity)), "matches")


def _crowds(crowd: DataFrame, sets: DataFrame, similarity: float, gone: DataFrame) -> DataFrame:
    """``gone`` (y) with the lines of crowded tokens (token, id, first, meta, sign, more) that match an earlier one there.

    A few rounds compare the earliest undecided line of each token with the others, which
    costs as many pairs as there are lines and decides crowds of near copies. They end when a round decides few, and what is
    left meets all that fit it.
    """
    undecided = gone.withColumnRenamed("y", "id")
    turn = pin(crowd.join(undecided, "id", "left_anti"), "crowd")
    sets, gone = pin(sets.join(crowd.select("id"), "id", "left_semi"), "sets"), [gone]
    for _ in range(PIVOTS):
        pivots = turn.groupBy("token").agg(F.min(F.struct("first", "id", "meta", "sign", "more")).alias("p")).select("token", "p.*")
        pivots = pin(pivots, "pivots")
        gone.append(pin(_verified(_pairs(pivots, turn, similarity), sets, similarity), "matches"))
        left = turn.join(pivots.select("token", "id"), ["token", "id"], "left_anti")
        before, turn = turn.count(), pin(left.join(gone[-1].withColumnRenamed("y", "id"), "id", "left_anti"), "crowd")
        if before - pivots.count() - turn.count() <= before * WORTH:
            break
    # What no round decided meets all others, pivots among it.
    left = crowd
    for found in gone:
        left = left.join(found.withColumnRenamed("y", "id"), "id", "left_anti")
    gone.append(_matched(_pairs(crowd, left, similarity), sets, similarity))
    return reduce(DataFrame.union, gone)


def removed_lines(documents: DataFrame, key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(doc, gone): for each document with lines to remove their numbers from 0; doc is (key, mark of the text).

    Lines are sets of words; two match if their Jaccard similarity is at least ``similarity``. A
    line is removed if an earlier one matches it, in the order of documents by key and of lines in
    them, whether or not the earlier one is itself removed. Lines without words are no match.

    1. Equal lines are counted as one from here on, so a line in a third of all documents is one entry.
    2. Words are ordered by a frequency that is counted over all documents in counters of a fixed
       number; any fixed order gives the same matches, a rarest-first one gives few candidates.
    3. Two lines that match share a word among the rarest of each: the postings of these prefixes
       are joined by word, under filters on length, position and the parity of token classes. A word in many prefixes first
       compares its lines with the earliest ones; those that match are decided, and only
       the rest is compared with all. So a crowd of near copies costs its size and not its square.
    4. Candidates are verified on their whole sets, the earliest of each line first: one match is enough.
    """
    docs = _identified(documents, key)
    survey = pin(_survey(docs), "lines")
    rarity, words = _rarity(survey)
    buckets = min(max(words // _BUCKET_WORDS, 1), _MOST_BUCKETS)
    lines = survey.where("doc is not null").select("doc", F.posexplode("ids").alias("line", "id")).where("id is not null")
    first, again = F.min(F.struct("doc", "line")).alias("first"), (F.count("*") > 1).alias("again")
    firsts = pin(lines.groupBy("id").agg(first, again), "lines")
    met = pin(_meetings(_postings(docs, rarity, similarity, buckets), similarity, LIMIT, CROWDED, buckets), "meetings")
    light = pin(met.where("token is null").select("a", "b").distinct(), "pairs")
    crowd = met.where("token is not null").select("token", F.col("a").alias("id"), "meta", "sign", "more")
    crowd = pin(crowd.distinct(), "crowd")
    needed = light.select(F.col("a").alias("id")).union(light.select("b")).union(crowd.select("id"))
    sets = pin(_sets(docs, needed).join(firsts.select("id", "first"), "id"), "sets")
    ends = [sets.select(F.col("id").alias(c), F.col("first").alias(f"{c}_first")) for c in ("a", "b")]
    light = light.join(ends[0], "a").join(ends[1], "b")
    turned = F.col("b_first") < F.col("a_first")
    x, y = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    light = light.select(x.alias("x"), y.alias("y"), F.least("a_first", "b_first").alias("first"))
    gone = _matched(light, sets, similarity)
    if not crowd.isEmpty():
        gone = _crowds(crowd.join(sets.select("id", "first"), "id"), sets, similarity, gone)
    gone = gone.select(F.col("y").alias("id"), F.lit(True).alias("gone"))
    decided = firsts.join(gone, "id", "left").where("again or gone")
    later = F.struct("doc", "line") > F.col("first")
    marked = lines.join(decided, "id").where(later | F.coalesce("gone", F.lit(False)))
    return marked.groupBy("doc").agg(F.collect_set("line").alias("gone"))


def _copies_apart(documents: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The documents with one row of those without a key and equal in text; and the others of these, if any row has no key.

    Only rows without a key are written, with the place that tells them apart; their texts are not shuffled by value.
    """
    unnamed = documents.where(F.col(key).isNull())
    if unnamed.isEmpty():
        return documents, None
    unnamed = pin(unnamed.withColumn("_place", F.monotonically_increasing_id()), "unnamed")
    firsts = pin(unnamed.groupBy(F.xxhash64("text")).agg(F.min("_place").alias("_place")).select("_place"), "unnamed")
    named = documents.where(F.col(key).isNotNull())
    first, copies = (unnamed.join(firsts, "_place", kind).drop("_place") for kind in ("left_semi", "left_anti"))
    return named.union(first), copies


def dedup(documents: DataFrame, key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """All columns of ``documents``, with the lines of :func:`removed_lines` taken out of ``text``, and n_lines, n_removed.

    Columns of any name are carried as they are: where the documents have an n_lines or n_removed of their own, the
    new column has underscores behind its name.

    A null text stays null and has no lines; an empty one has one line, without words. Rows equal
    in key and text are one document here: what goes from one goes from each. A null key names no
    document, so each row without a key is one of its own: of those equal in text all but one lose
    every line with a word. Null keys come first in the order. Lines are told apart by 64-bit hashes of their words, so one in 10**7 may be
    taken for another in a corpus of 10**12 lines.
    """
    rows = documents.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    rows, copies = _copies_apart(rows, "key")
    taken = removed_lines(rows, "key", similarity)
    # Texts are sent once, inside their rows.
    own = rows.select("row", "key", F.xxhash64("text").alias("mark"))
    same = F.col("d.key").eqNullSafe(F.col("t.doc.key")) & (F.col("d.mark") == F.col("t.doc.mark"))
    joined = own.alias("d").join(taken.alias("t"), same, "left")
    joined = joined.select("d.row", F.col("d.row.text").cast("string").alias("text"), "t.gone")
    lines = F.split("text", "\n")
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("bigint")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_removed = F.coalesce(F.size("gone"), F.lit(0)).cast("bigint")
    done = joined.select("row", text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))
    if copies is not None:
        wordless = F.filter(lines, lambda x: ~F.regexp_like(x, F.lit(HAS_WORD)))
        n_removed = F.coalesce(F.size(lines) - F.size(wordless), F.lit(0)).cast("bigint")
        text = F.array_join(wordless, "\n")
        done = done.union(copies.select("row", text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed")))
    carried = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns]
    for count in ("n_lines", "n_removed"):
        name = count
        while name in documents.columns:
            name += "_"
        carried.append(F.col(count).alias(name))
    return done.select(*carried)
