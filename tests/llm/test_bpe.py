import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from undertow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    "", " ", "\n", "  a  b \n\n c", " x 　y", "日本語のテキストです。", "a" * 3000, "ab" * 700, " " * 400, "\n \n  x",
    "can't we'll 'S 12345 ½²", "🙂🙃 éx", "x\x1cy \x85z", "%%%***" * 200, "<|endoftext|>", "one two\nthree four  five",
    "e\u0301 " + "x" * 300 + " y",
]


def test_ids_are_those_of_the_library(theirs):
    random.seed(3)
    noise = ["".join(chr(random.choice([32, 10, 97, 98, 233, 0x4E00, 0x1F600, 48])) for _ in range(200)) for _ in range(30)]
    ranks = bpe.load(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    for text, packed in zip(ODD + noise, ranks.encode(ODD + noise)):
        assert np.frombuffer(packed, "<u4").tolist() == theirs.encode_ordinary(text)
        assert ranks.decode(packed) == text.encode()


def test_long_pieces_merge_as_rows_do(theirs):
    ranks = bpe.load(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    for piece in (b"abcabcab" * 20, "éàé".encode() * 30, b"the" * 50):
        assert ranks.merge_long(piece).tolist() == ranks.merge_rows([piece, b"xy"])[0].tolist()


def test_query_rows(spark, docs, theirs):
    texts = [*ODD, None, "twice", "twice"]
    ids = [*range(len(ODD)), None, 7, 7]
    got = bpe.digests(docs(texts, ids), PATH, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in zip(ids, texts):
        packed = np.array(theirs.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.digests(docs([]), PATH, public_tokenizers.PATTERN).count() == 0
