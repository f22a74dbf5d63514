"""Language identification by unigram pieces, summed over every way to cut a word into pieces."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from .bpe import ship
from .common import hold, id_class, map_texts, run_starts

UNKNOWN = "und"
#: Training texts per language (an expected number, picked by a hash of the id) and words per language.
SAMPLE_DOCS, SAMPLE_WORDS = 500, 20_000
#: Languages that a model may have: it holds a row of probabilities of each.
MOST_LANGUAGES = 1000
ROUNDS = 3
#: Bytes of a word scored at a time, and words in the memory of a worker.
PART_BYTES, REMEMBERED = 255, 250_000
#: Pieces looked up at a time, and bytes summed over side by side, where words are longer than PART_BYTES.
_LOOKED_UP, _SUMMED = 1 << 22, 1 << 22
_SMOOTHING = 0.01
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NOT_LETTERS = regex.compile(r"\P{L}+")
_ASCII_LETTERS = bytes(i if 97 <= i <= 122 else 32 for i in range(256))


def runs(text: bytes | None) -> list[bytes]:
    """Runs of letters, lower-cased."""
    if not text:
        return []
    if text.isascii():
        return text.lower().translate(_ASCII_LETTERS).split()
    return _NOT_LETTERS.sub(" ", text.decode().lower()).encode().split()


def words(text: bytes | None) -> list[bytes]:
    """:func:`runs`, those of over PART_BYTES bytes in parts. Scores are of whole runs."""
    return [w[i : i + PART_BYTES] for w in runs(text) for i in range(0, len(w), PART_BYTES)]


class Pieces:
    """The byte strings of a public vocabulary that can occur in a lower-case word after a space.

    All single bytes are among them, so every word can be cut into pieces.
    """

    def __init__(self, data: bytes) -> None:
        tokens = [base64.b64decode(line.split()[0]) for line in data.splitlines() if line]
        fits = re.compile(rb" ?[a-z\x80-\xff]+| ")
        kept = sorted({t for t in tokens if fits.fullmatch(t)} | {bytes([b]) for b in range(256)})
        self.longest = max(map(len, kept))
        self.count = len(kept)
        hashes = np.zeros(len(kept), np.uint64)
        for i, piece in enumerate(kept):
            h = 0
            for byte in piece:
                h = (h * int(_BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[i] = h
        bits = 19  # about sixteen places per piece, so that most lookups end at once
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.hashes = hashes
        at, left = self._slot(hashes), np.arange(len(kept), dtype=np.int32)
        while len(left):
            free = self.slots[at] == -1
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash; -1 where there is none."""
        flat = h.ravel()
        out = np.full(flat.shape, -1, np.int32)
        at, open_ = self._slot(flat), np.arange(len(flat))
        while len(open_):
            held = self.slots[at]
            used = held >= 0
            hit = used & (self.hashes[held] == flat[open_])
            out[open_[hit]] = held[hit]
            on = used & ~hit
            open_, at = open_[on], (at[on] + 1) & self.mask
        return out.reshape(h.shape)

    def lattice(self, found: list[bytes]):
        """Per bucket of equal length: (places of its words, length, ends) with ends[i][k - 1] the
        piece of k bytes that ends before byte i of each word, its leading space included. Words of
        over PART_BYTES bytes are left to :meth:`long`."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(found):
            if len(w) <= PART_BYTES:
                by_length.setdefault(len(w), []).append(i)
        for size, all_places in by_length.items():
            for at in range(0, len(all_places), 4096):
                places = all_places[at : at + 4096]
                joined = b"".join([b" " + found[i] for i in places])
                grid = np.frombuffer(joined, np.uint8).reshape(len(places), size + 1).astype(np.uint64) + np.uint64(1)
                rolling = np.zeros((size + 2, len(places)), np.uint64)
                for j in range(size + 1):
                    rolling[j + 1] = rolling[j] * _BASE + grid[:, j]
                power, ends = np.uint64(1), [[] for _ in range(size + 2)]
                for k in range(1, min(self.longest, size + 1) + 1):
                    power = np.uint64(int(power) * int(_BASE) & 0xFFFFFFFFFFFFFFFF)
                    ids = self.find(rolling[k:] - rolling[:-k] * power)
                    for i in range(k, size + 2):
                        ends[i].append(ids[i - k])
                yield places, size + 1, ends

    def long(self, found: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Words of over PART_BYTES bytes in groups to be looked at side by side, the longest first:
        (places of the words, their lengths with the leading space)."""
        places = sorted((i for i, w in enumerate(found) if len(w) > PART_BYTES), key=lambda i: -len(found[i]))
        while places:
            n = max(1, min(_LOOKED_UP // (PART_BYTES * self.longest), _SUMMED // len(found[places[0]])))
            yield places[:n], np.array([len(found[i]) + 1 for i in places[:n]])
            places = places[n:]

    def stretch(self, group: list[bytes], first: int) -> np.ndarray:
        """ids[i][k - 1] for bytes ``first`` to ``first`` + PART_BYTES of words: the piece of k bytes that
        ends with byte ``first`` + i of each. Before and behind a word lie zero bytes."""
        reach = self.longest
        size, at = reach + PART_BYTES, first - reach - 1  # where the stretch and what it reaches back to begin in a word
        parts = [w[max(0, at) : at + size] if at >= 0 else b"\0" * (-1 - at) + b" " + w[: at + size] for w in group]
        joined = b"".join([p.ljust(size, b"\0") for p in parts])
        grid = np.frombuffer(joined, np.uint8).reshape(len(group), size).T.astype(np.uint64) + np.uint64(1)
        rolling = np.zeros((size + 1, len(group)), np.uint64)
        for j in range(size):
            rolling[j + 1] = rolling[j] * _BASE + grid[j]
        power, ids = np.uint64(1), np.empty((PART_BYTES, reach, len(group)), np.int32)
        for k in range(1, reach + 1):
            power = np.uint64(int(power) * int(_BASE) & 0xFFFFFFFFFFFFFFFF)
            ends = slice(reach + 1 - k, size + 1 - k)
            ids[:, k - 1] = self.find(rolling[reach + 1 :] - rolling[ends] * power)
        return ids


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (pieces + 1, languages); the last row, for "no piece", is minus infinity

    def word_scores(self, pieces: Pieces, found: list[bytes]) -> np.ndarray:
        """log P(word | language): the forward sum over all segmentations."""
        out = np.zeros((len(found), len(self.languages)))
        p = np.exp(self.log_p)
        for places, size, ends in pieces.lattice(found):
            alpha, _ = _forward(p, size, ends, len(places))
            out[places] = alpha
        for places, lengths in pieces.long(found):
            for first, sums in _long_forward(p, pieces, [found[i] for i in places], lengths):
                for j in np.flatnonzero((lengths > first) & (lengths <= first + len(sums))):
                    out[places[j]] = sums[lengths[j] - first - 1, j]
        return out


def _forward(p: np.ndarray, size: int, ends, n: int, keep: bool = False):
    """Log of the forward sums at the ends of words; with ``keep`` the scaled sums at all places too."""
    sums = np.zeros((size + 1, n, p.shape[1]))
    sums[0] = 1
    scale = np.zeros((n, p.shape[1]))
    scales = [scale]
    for i in range(1, size + 1):
        for k, ids in enumerate(ends[i], 1):
            sums[i] += sums[i - k] * p[ids]
        if i % 32 == 0:  # all places that later sums read are brought back to the same scale
            low = max(0, i - len(ends[size]))
            up = sums[i].copy()
            sums[low : i + 1] /= up
            scale = scale + np.log(up)
        scales.append(scale)
    return np.log(sums[size]) + scale, (sums, scales)


def _long_forward(p: np.ndarray, pieces: Pieces, group: list[bytes], lengths: np.ndarray):
    """(first, logs of the forward sums at the ends of the PART_BYTES bytes from there) of words in order of
    falling length, one stretch after another: the sums that the next one reaches back to are carried over."""
    reach, n = pieces.longest, len(group)
    sums = np.zeros((reach + PART_BYTES, n, p.shape[1]))
    sums[reach - 1] = 1
    scale = np.zeros((n, p.shape[1]))
    for first in range(0, int(lengths[0]), PART_BYTES):
        n = int((lengths > first).sum())
        ids, sums, scale = pieces.stretch(group[:n], first), sums[:, :n], scale[:n]
        logs = np.empty((PART_BYTES, n, p.shape[1]))
        for i in range(PART_BYTES):
            at = reach + i
            sums[at] = np.einsum("kng,kng->ng", sums[at - reach : at][::-1], p[ids[i]])
            logs[i] = np.log(sums[at]) + scale
            if i % 8 == 7 or i == PART_BYTES - 1:  # as in _forward; earlier sums may be far greater than this one
                up = sums[at] * 1e150
                sums[at - reach : at + 1] /= up
                scale = scale + np.log(up)
        yield first, logs
        sums = np.concatenate([sums[-reach:], np.zeros_like(sums[reach:])])


def _long_expected(p: np.ndarray, pieces: Pieces, found: list[bytes], counts: np.ndarray) -> np.ndarray:
    """As :func:`_expected`, for the words of over PART_BYTES bytes.

    From the end of a word backwards, the chance that a segmentation has a border behind a byte is
    shared out to the pieces that end there, each to the border before it.
    """
    total, reach = np.zeros(pieces.count + 1), pieces.longest
    with np.errstate(divide="ignore"):
        log_p = np.log(p)
    for places, lengths in pieces.long(found):
        group, end = [found[i] for i in places], -(-int(lengths[0]) // PART_BYTES) * PART_BYTES
        logs = np.full((reach + end, len(group)), -np.inf)  # forward sums; reach - 1 is the place before all bytes
        logs[reach - 1] = 0
        for first, sums in _long_forward(p[:, None], pieces, group, lengths):
            logs[reach + first : reach + first + PART_BYTES, : sums.shape[1]] = sums[:, :, 0]
        border = np.zeros_like(logs)
        border[reach + lengths - 1, np.arange(len(group))] = 1
        for first in range(end - PART_BYTES, -1, -PART_BYTES):
            n = int((lengths > first).sum())
            ids = pieces.stretch(group[:n], first)
            uses = np.zeros(ids.shape)
            for i in range(min(PART_BYTES, int(lengths[0]) - first) - 1, -1, -1):
                at = reach + first + i
                before = slice(at - reach, at)
                share = np.exp((logs[before, :n] - logs[at, :n])[::-1] + log_p[ids[i]])
                uses[i] = share * border[at, :n]
                border[before, :n] += uses[i][::-1]
            total += np.bincount(np.where(ids < 0, pieces.count, ids).ravel(), (uses * counts[places][:n]).ravel(), len(total))
    total[-1] = 0
    return total


def _expected(p: np.ndarray, pieces: Pieces, found: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over all segmentations of the counted words, for one language."""
    total = np.zeros(pieces.count + 1)
    for places, size, ends in pieces.lattice(found):
        n = len(places)
        forward = np.zeros((size + 1, n))
        forward[0] = 1
        norm = np.ones((size + 1, n))  # sums are kept near one: norm[i] divides place i and all after it
        backward = np.zeros((size + 1, n))
        for i in range(1, size + 1):
            reach = np.ones(n)
            for k, ids in enumerate(ends[i], 1):
                forward[i] += forward[i - k] * reach * p[ids]
                reach = reach / norm[i - k]
            norm[i] = forward[i]
            forward[i] = 1
        backward[size] = 1
        for i in range(size, 0, -1):
            reach = 1 / norm[i]
            for k, ids in enumerate(ends[i], 1):
                step = backward[i] * reach * p[ids]
                backward[i - k] += step
                np.add.at(total, ids, step * counts[places])
                reach = reach / norm[i - k]
    total[-1] = 0
    return total


def _estimate(pieces: Pieces, found: list[bytes], counts: np.ndarray, rounds: int) -> np.ndarray:
    """Log probabilities of the pieces by expectation maximisation over segmentations."""
    p = np.full(pieces.count + 1, 1 / pieces.count)
    p[-1] = 0
    for _ in range(rounds):
        uses = _expected(p, pieces, found, counts) + _long_expected(p, pieces, found, counts) + _SMOOTHING
        p = uses / uses[:-1].sum()
        p[-1] = 0
    with np.errstate(divide="ignore"):
        return np.log(p)


_LOADED: dict[str, Pieces] = {}


def _shared(name: str) -> Pieces:
    if name not in _LOADED:
        with open(SparkFiles.get(name), "rb") as file:
            _LOADED[name] = Pieces(file.read())
    return _LOADED[name]


def train(documents: DataFrame, path: str, key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit the piece probabilities of every language in ``lang``.

    Learns from a bounded sample: of every language about ``sample_docs`` documents, picked by a
    hash of their id among those with a text and a language, and of their words the SAMPLE_WORDS
    most frequent. Each language is fitted in a task of its own; what comes to the driver is one
    row of probabilities per language. Documents without text or language teach nothing. A column of more than
    MOST_LANGUAGES values is no column of languages and is refused before anything of it is gathered.
    """
    name = ship(documents.sparkSession, path)
    known = documents.where("lang is not null and text is not null").select(key, "lang", "text")
    sizes = pin(known.groupBy("lang").agg(F.count("*").alias("_n")), "languages")
    if (n := sizes.count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} values of lang; a model has at most {MOST_LANGUAGES}")
    place = F.pmod(F.xxhash64(F.lit("train"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    # One row per language, of which a model has one on the driver too: small, so texts stay where they are.
    picked = known.join(F.broadcast(sizes), "lang").where(place < sample_docs / F.col("_n")).select("lang", "text")

    def count(texts):
        tally = []
        for text in texts:
            seen: dict[bytes, int] = {}
            for w in runs(text):
                seen[w] = seen.get(w, 0) + 1
            tally.append([{"word": w, "n": n} for w, n in seen.items()])
        kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        return [pa.array(tally, kind)]

    tally = map_texts(picked, "lang", "words array<struct<word: binary, n: bigint>>", count)
    tally = tally.select("lang", F.explode("words").alias("w")).groupBy("lang", "w.word").agg(F.sum("w.n").alias("n"))
    most = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    tally = tally.withColumn("_place", most).where(F.col("_place") <= SAMPLE_WORDS).drop("_place")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        found = [bytes(w) for w in group["word"]]
        log_p = _estimate(_shared(name), found, group["n"].to_numpy(float), ROUNDS)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "log_p": [log_p.astype("<f8").tobytes()]})

    fitted = tally.groupBy("lang").applyInPandas(fit, "lang string, log_p binary").collect()
    fitted.sort(key=lambda r: r["lang"])
    if not fitted:
        return Model([], np.zeros((0, 0)))
    return Model([r["lang"] for r in fitted], np.stack([np.frombuffer(r["log_p"], "<f8") for r in fitted], axis=1))


class Memory(dict):
    """Row numbers of words already scored; a missing word is noted and given the next number."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


_SCORED: dict[str, tuple[Memory, np.ndarray]] = {}


# Functions of the module see the module of the worker process, which lasts from task to task; what a
# function handed to Spark names itself is a copy for one task.
def _remembered(mark: str, languages: int) -> tuple[Memory, np.ndarray]:
    """Words scored so far by this worker under a model, and their scores."""
    hold(_SCORED.clear)
    memory, scores = _SCORED.get(mark) or (Memory(), np.zeros((0, languages)))
    return (memory, scores) if len(memory) <= REMEMBERED else (Memory(), np.zeros((0, languages)))


def _remember(mark: str, memory: Memory, scores: np.ndarray) -> None:
    _SCORED.clear()
    _SCORED[mark] = memory, scores


def predict(documents: DataFrame, model: Model, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, lang_pred and score of every whole text.

    The score is the posterior of the predicted language, all taken as equally likely before. Null
    texts, texts without a letter, and any text under a model that learnt no language are ``und``
    with score 0. Of equally likely languages the first by name is taken. Rows are kept as they
    are, repeated ones too; nothing is shuffled.
    """
    name = ship(documents.sparkSession, path)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    mark = f"{name}-{hash(model.log_p.tobytes())}"

    def run(texts):
        model, pieces = shared.value, _shared(name)
        languages = len(model.languages)
        memory, scores = _remembered(mark, languages)
        found = [runs(t) for t in texts]
        counts = np.array([len(f) for f in found], np.int64)
        # Words of any length would fill the memory; they are scored anew, and come last in the scores.
        long = dict.fromkeys(w for f in found for w in f if len(w) > PART_BYTES)
        long = {w: i - len(long) for i, w in enumerate(long)}
        places = (long[w] if w in long else memory[w] for f in found for w in f) if long else (memory[w] for f in found for w in f)
        rows = np.fromiter(places, np.int64, int(counts.sum()))
        if memory.new and languages:
            scores = np.concatenate([scores, model.word_scores(pieces, memory.new)])
        memory.new = []
        _remember(mark, memory, scores)
        if long and languages:
            scores = np.concatenate([scores, model.word_scores(pieces, list(long))])
        best, share = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if languages:
            full = np.flatnonzero(counts)
            total = np.zeros((len(texts), languages))
            if len(rows):
                total[full] = np.add.reduceat(scores[rows], run_starts(counts)[full], axis=0)
            for i in full:
                top = int(total[i].argmax())
                best[i] = model.languages[top]
                share[i] = 1 / np.exp(total[i] - total[i, top]).sum()
        return [pa.array(best, pa.string()), pa.array(share)]

    return map_texts(documents, key, "lang_pred string, score double", run)


def identify(documents: DataFrame, path: str, key: str = "doc_id", folds: int = 5) -> DataFrame:
    """:func:`predict` with a model learnt from the documents outside the held-out fold.

    A document is held out if crc32 of its id as text, modulo ``folds``, is 0; a null id is not
    held out and does not teach. Adds held_out after the key.
    """
    fold = id_class(key, folds)
    model = train(documents.where(fold != 0), path, key)
    found = predict(documents, model, path, key)
    return found.select(key, F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
