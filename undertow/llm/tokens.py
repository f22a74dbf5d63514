"""Token ids of whole texts by the tokenizers library, with a memory of chunks between spaces."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import ship
from .common import hold, map_texts, ranges, run_starts

#: Chunks in the memory of a worker, and bytes of their text; words in its memory of words.
REMEMBERED, REMEMBERED_BYTES, REMEMBERED_WORDS = 800_000, 48 << 20, 600_000
#: Bytes of text encoded at a time: the more, the fewer chunks are asked for twice.
TOGETHER = 16 << 20
# Latin letters that are still letters, and no marks, once composed and lower-cased.
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-įıĲ-ſ]+")
_LOADED: dict[tuple[str, str, bool], Chunks] = {}


def _byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it is printable."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Chunks:
    """Encodes texts chunk by chunk.

    For a tokenizer whose normaliser works on characters and whose pre-tokenizer matches never
    hold white space, a text has the ids of its chunks between spaces and line ends, one after
    another: neither end of a chunk can compose, or match, across a space. Each new chunk is
    encoded by the library once. A chunk of Latin letters is one match, so the library's model is
    asked directly, and one stop behind it is a match of its own.
    """

    def __init__(self, file: str, packing: str, plain: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = plain
        self.model = self.tokenizer.model
        self.packing, self.code = packing, {"<u2": "H", "<u4": "I"}[packing]
        self.characters = _byte_characters()
        self._forget()
        self.words: dict[str, bytes] = {}
        self.stops = {stop: self._word(stop) if stop else b"" for stop in ("", ".", ",")}

    def _word(self, word: str) -> bytes:
        """Packed ids of a word, which is remembered in lower case, whatever stop is behind it."""
        word = word.lower()
        known = self.words.get(word)
        if known is None:
            if len(self.words) > REMEMBERED_WORDS:
                self.words.clear()
            # Letters of ASCII are written as themselves.
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.characters)
            self.words[word] = known = array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return known

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Packed ids of every text: each chunk by its number among the known ones, whose ids lie in one array."""
        if len(self.known) > REMEMBERED or self.known.nbytes > REMEMBERED_BYTES:
            self._forget()
        column = pa.array([t or b"" for t in texts], pa.large_binary()).cast(pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = pc.dictionary_encode(cut.flatten())
        place = pc.index_in(coded.dictionary, value_set=self.known)
        fresh = coded.dictionary.filter(place.is_null())
        number = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        number[place.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
        self._learn(fresh)
        which = number[coded.indices.to_numpy()]
        sizes = self.lengths[which]
        ids = self.ids[ranges(self.starts[which], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids = np.zeros(0, self.packing)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def _learn(self, fresh: pa.Array) -> None:
        """Add chunks that are not known, each encoded once."""
        packed = self._ids(fresh.to_pylist())
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // np.dtype(self.packing).itemsize
        self.starts = np.concatenate([self.starts, len(self.ids) + run_starts(lengths)]) if len(lengths) else self.starts
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(packed), self.packing)])
        self.known = pa.concat_arrays([self.known, fresh])

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of different chunks."""
        found: list[bytes] = []
        others = []
        for i, chunk in enumerate(chunks):
            stop = chunk[-1:] if chunk[-1:] in (".", ",") else ""
            word = chunk[: len(chunk) - len(stop)]
            if word.isascii() and word.isalpha() or _WORD.fullmatch(word):
                found.append(self._word(word) + self.stops[stop])
            else:
                found.append(b"")
                others.append(i)
        asked = self.tokenizer.encode_batch_fast([chunks[i] for i in others], add_special_tokens=False)
        for i, answer in zip(others, asked):
            found[i] = np.array(answer.ids, self.packing).tobytes()
        return found


def _chunks(name: str, packing: str, plain: bool) -> Chunks:
    """The encoder of a shipped file, with the memory of this worker process (see ``langid``)."""
    from pyspark import SparkFiles

    hold(_LOADED.clear)
    if (name, packing, plain) not in _LOADED:
        _LOADED[name, packing, plain] = Chunks(SparkFiles.get(name), packing, plain)
    return _LOADED[name, packing, plain]


def encode(
    documents: DataFrame, path: str, end_id: int, key: str = "doc_id", packing: str = "<u4", plain: bool = True
) -> DataFrame:
    """``key`` and ids (packed) of every whole text, with ``end_id`` appended to each.

    With ``plain`` the strings that name control tokens are characters like any others, so that a text cannot
    forge one; without, they are encoded as the control tokens they name, which is the library's default.

    Row by row, without a shuffle; a null text is empty and has the end id alone, an empty table has no rows, and
    repeated rows are encoded each. Texts of any length are encoded whole. Other columns of ``documents`` are not looked
    at. The file of the tokenizer goes to each executor once, and is loaded once per worker process.
    """
    name = ship(documents.sparkSession, path)
    end = np.array([end_id], packing).tobytes()

    def run(texts):
        packed = _chunks(name, packing, plain).encode(texts)
        return [pa.array([p + end for p in packed], pa.binary())]

    return map_texts(documents, key, "ids binary", run, TOGETHER)
