import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from undertow.llm import rans, tokens


def coded(sizes, symbols, seed=0):
    rng = np.random.default_rng(seed)
    blocks = [rng.choice(symbols, n, p=None).astype(np.uint32) for n in sizes]
    found, counts = np.unique(np.concatenate(blocks), return_counts=True)
    return blocks, rans.Table(found, rans.scaled(found, counts))


@pytest.mark.parametrize("symbols", [[7], [0, 1], list(range(40000)), [3] * 1000 + [9]])
def test_round_trip(symbols):
    blocks, table = coded([1, 63, 64, 65, 64 * 256, 64 * 256 + 1, 50_000], symbols)
    rows = [{"n_tokens": len(b), **e} for b, e in zip(blocks, rans.encode_blocks(blocks, table))]
    for want, got in zip(blocks, rans.decode_blocks(rows, table)):
        assert got.tolist() == want.tolist()


def test_a_stretch_is_decoded_alone():
    (block,), table = coded([64 * 256 * 3], list(range(100)))
    (e,) = rans.encode_blocks([block], table)
    one = {
        "n_tokens": 64 * 256,
        "states": e["states"][64 * 8 : 2 * 64 * 8],
        "offsets": e["offsets"][1:2],
        "words": e["words"],
    }
    assert rans.decode_blocks([one], table)[0].tolist() == block[64 * 256 : 2 * 64 * 256].tolist()


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(1)
    block = rng.geometric(0.05, 200_000).astype(np.uint32)
    found, counts = np.unique(block, return_counts=True)
    table = rans.Table(found, rans.scaled(found, counts))
    (e,) = rans.encode_blocks([block], table)
    p = counts / counts.sum()
    assert len(e["words"]) * 8 < 1.01 * len(block) * -(p * np.log2(p)).sum() + 64 * 64
    assert rans.scaled(found, counts).sum() == 1 << rans.SCALE_BITS


def test_files_of_documents(spark, tmp_path):
    random.seed(1)
    docs = [(random.randrange(1000), [random.randrange(500) for _ in range(random.choice([0, 1, 3, 400]))]) for _ in range(150)]
    docs += [(None, [1, 2]), (5, []), (5, [9]), (5, [9])]
    rows = [(i, bytearray(np.array(x, "<u2").tobytes())) for i, x in docs] + [(1001, None)]
    docs.append((1001, []))
    frame = spark.createDataFrame(rows, "doc_id bigint, ids binary")
    rans.write(frame, f"{tmp_path}/set", packing="<u2", block_tokens=700)
    got = rans.read(spark, f"{tmp_path}/set", "crc bigint", lambda x: [zlib.crc32(x.astype("<u4").tobytes())]).collect()
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, np.array(d[1], "<u2").tobytes()))
    want, start = [], 0
    for i, x in order:
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_no_documents(spark, tmp_path):
    rans.write(spark.createDataFrame([], "doc_id bigint, ids binary"), f"{tmp_path}/set")
    assert rans.read(spark, f"{tmp_path}/set", "n bigint", lambda x: [len(x)]).count() == 0


def test_damage_is_noticed(spark, tmp_path):
    frame = spark.createDataFrame([(1, bytearray(np.arange(999, dtype="<u4").tobytes()))], "doc_id bigint, ids binary")
    rans.write(frame, f"{tmp_path}/set")
    blocks = spark.read.parquet(f"{tmp_path}/set/blocks")
    blocks.withColumn("crc32", blocks.crc32 + 1).write.parquet(f"{tmp_path}/bad/blocks")
    spark.read.parquet(f"{tmp_path}/set/table").write.parquet(f"{tmp_path}/bad/table")
    with pytest.raises(Exception, match="damaged"):
        rans.read(spark, f"{tmp_path}/bad", "n bigint", lambda x: [len(x)]).collect()


TEXTS = [
    "", "One, two.", "can't WE'LL 'S x's.", "á É  \t tab\nline", "日本。語", "<|endoftext|> ok", "12.5,x ½²", "...,", "Ünï.", "x\x1cy\x85z",
    "very" * 200 + ".", "a.b. c", "＜|ｘ", "İstanbul ΣΑΣ.", "≮ ≠ a",
]


def test_ids_are_those_of_the_library(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    random.seed(6)
    noise = ["".join(random.choice(" \n.,'ab́é1½İ，") for _ in range(60)) for _ in range(60)]
    texts = TEXTS + noise + [None]
    got = tokens.encode(docs(texts), path, 2).orderBy("doc_id").collect()
    for text, row in zip(texts, got):
        want = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(row["ids"], "<u4").tolist() == want, text


def test_control_strings_by_the_libraries_default(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["end <|endoftext|> next", "a<|startoftext|>b<|endoftext|>.", "<|ENDOFTEXT|> <|endoftext|", "<|startoftext|>\n<|endoftext|>", *TEXTS]
    got = tokens.encode(docs(texts), path, 2, plain=False).orderBy("doc_id").collect()
    for text, row in zip(texts, got):
        want = library.encode(text, add_special_tokens=False).ids + [2]
        assert np.frombuffer(row["ids"], "<u4").tolist() == want, text


def test_rows_without_an_id_are_dealt_by_their_ids(spark, tmp_path):
    """They come first, in the order of their ids, and spread over the shards."""
    rows = [(None, np.array([i % 50, i], "<u4").tobytes()) for i in range(400)] + [(1, np.array([7], "<u4").tobytes())]
    rans.write(spark.createDataFrame(rows, "doc_id bigint, ids binary"), str(tmp_path / "set"), block_tokens=32)
    shards = spark.read.parquet(str(tmp_path / "set/blocks")).select("shard").distinct().count()
    back = rans.read(spark, str(tmp_path / "set"), "ids binary", lambda ids: [ids.astype("<u4").tobytes()]).collect()
    assert shards > 1 and sorted(bytes(r["ids"]) for r in back if r["doc_id"] is None) == sorted(x for _, x in rows[:-1])
    assert [r["start"] for r in back if r["doc_id"] == 1] == [800]
